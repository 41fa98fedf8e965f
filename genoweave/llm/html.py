"""HTML extraction with wrappers inferred as union-free regular expressions.

A page becomes a stream of block tags and text slots; stretches that repeat fold into
groups. Pages of one host with the same folded stream count once. A host's streams are
aligned one after another, in bounded groups and then the groups' results alike: what
both have stays, a stretch that one lacks becomes one more turn of a repeated group or
optional, and text that differs becomes a slot. Layouts too unlike to align keep wrappers
of their own. Element names and roles say what is chrome for sure; a class or id word is
a vote, and how much text differs from page to page inside and outside of the element
decides. What the wrappers' slots hold is summed over the host: which zone is the article's,
which texts are the template's, and which voted elements stay.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import astuple, dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import pieces, texts_of
from genoweave.plans.durable import write_table

#: HTML's element names by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math object canvas select xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
)
CHROME = frozenset("nav footer aside form button dialog menu head".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Class and id words that vote against an element: it may be the site's, or it may be other people's text, which differs from page to page too.
SITE_WORDS = frozenset(
    """nav navbar navigation menu breadcrumb breadcrumbs pagination pager masthead topbar footer sidebar
    cookie cookies consent gdpr paywall copyright newsletter subscribe subscription
    banner header widget notice notices privacy alert popup modal overlay disclaimer
    share sharing social signup login search form toolbar side rail bottom""".split()
)
OTHERS_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promoted promotion
    comment comments reply replies disqus respond discussion feedback related recommended recommendations""".split()
)
#: Words that may stand beside one of these in a class name without changing what it says.
BESIDE = frozenset("box bar block wrap wrapper container section area links buttons button list items item posts articles stories page site post top left right inner main".split())

#: Wrappers of a host that one task aligns in one round, on average; cells of a table of costs; and cells beyond which two layouts stay apart.
TOGETHER = 16
CELLS = 1 << 22
MOST_CELLS = 1 << 32
#: The share of the shorter wrapper's tokens that two layouts must have in common to be aligned, and hashes by which like ones find each other.
ALIKE = 0.6
MARKS = 3
#: Pages of different content that share a text before it counts as the template's, and times the text elsewhere that votes yield to.
LEAST_PAGES = 3
OUTWEIGHS = 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|[^<]+|<", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s\"'>]+)))?")
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
_NAME = re.compile(r"[A-Za-z]+")


@dataclass
class Block:
    """A stretch of text between block tags, with its zone (main, plain or chrome) and the elements around it that words vote against, outermost first."""

    text: str
    zone: str
    doubt: tuple[str, ...] = ()


@dataclass
class Page:
    """The stream of block tags and slots ('#'), and the block of each slot in order."""

    stream: list[str]
    blocks: list[Block]


def _vote(name: str) -> int:
    """How a class or id name votes: 2 for other people's text, 1 for the site's, 0 for neither."""
    words = {w.lower() for w in _NAME.findall(name)}
    if not words <= SITE_WORDS | OTHERS_WORDS | BESIDE:
        return 0
    return 2 if words & OTHERS_WORDS else int(bool(words & SITE_WORDS))


def _marks(attributes: str) -> tuple[str, bool, int]:
    """The element's own name from class and id, whether it says that it isn't content, and the strongest vote of its class and id words."""
    if not attributes or attributes.isspace():
        return "", False, 0
    named, chrome, vote = [], False, 0
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        value, key = (a or b or c), key.lower()
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
            chrome = True
        elif key == "role":
            chrome |= value.lower() in ROLES
        elif key in ("class", "id"):
            named.append(value)
            vote = max([vote, *map(_vote, value.split())])
    return ".".join(re.sub(r"[\s|>~+]+", " ", re.sub(r"\d+", "0", v)).strip() for v in named), chrome, vote


def _raw_end(html: str, name: str, start: int) -> int:
    found = re.compile(rf"</{re.escape(name)}\s*[^>]*(?:>|\Z)", re.I).search(html, start)
    return found.end() if found else len(html)


def read_page(html: str) -> Page:
    """Tokenise a page, however malformed: stray end tags are passed over, paragraphs close where HTML closes them."""
    stream: list[str] = []
    blocks: list[Block] = []
    stack: list[tuple[str, str, tuple[str, ...]]] = []  # name, zone and the voted elements around
    parts: list[str] = []

    def zone() -> str:
        return stack[-1][1] if stack else "plain"

    def flush() -> None:
        text = " ".join(entities.unescape("".join(parts)).split())
        parts.clear()
        if text:
            blocks.append(Block(text, zone(), stack[-1][2] if stack else ()))
            stream.append("#")

    at, n = 0, len(html)
    while at < n:
        token = _TOKEN.match(html, at)
        if token is None:
            break
        if token.group(0) == "<":  # a quote that never ends: the tag ends at the next '>'
            token = _LOOSE.match(html, at) or token
        at = token.end()
        name = token.group(2) if token.re is _LOOSE or token.lastindex else None
        if name is None:
            text = token.group(0)
            if not text.startswith(("<!", "<?")):
                parts.append(text)
            elif text.startswith("<![CDATA["):
                parts.append(entities.escape(text[9:].removesuffix("]]>")))
            continue
        name, closing, attributes = name.lower(), bool(token.group(1)), token.group(3)
        if name in RAW and not closing:
            if not (name in ("svg", "math") and _EMPTY.search(attributes)):
                at = _raw_end(html, name, at)
            continue
        if name in INLINE:
            if not closing:
                label, chrome, vote = _marks(attributes)
                if chrome or vote:  # an inline advert or button: treat as a block
                    flush()
                    around = stack[-1][2] if stack else ()
                    stack.append((name, "chrome" if chrome else zone(), around if chrome or zone() == "chrome" else (*around, f"{vote}{name}.{label}")))
                    stream.append(f"<{name}.{label}>")
            elif any(s[0] == name for s in stack):
                flush()
                while stack.pop()[0] != name:
                    pass
                stream.append(f"</{name}>")
            continue
        flush()
        if name in VOID:
            continue
        if closing:
            if name == "p" and not any(s[0] == "p" for s in stack):
                continue
            if any(s[0] == name for s in stack):
                while True:
                    gone = stack.pop()[0]
                    stream.append(f"</{gone}>")
                    if gone == name:
                        break
            continue
        for closer, names in (("p", CLOSES_PARAGRAPH), ("li", {"li"}), ("tr", {"tr"}), ("td", {"td", "th", "tr"}), ("th", {"td", "th", "tr"}), ("dd", {"dt", "dd"}), ("dt", {"dt", "dd"}), ("option", {"option"})):
            if name in names and stack and stack[-1][0] == closer:
                stack.pop()
                stream.append(f"</{closer}>")
        label, chrome, vote = _marks(attributes)
        above = zone()
        if above == "chrome" or chrome or name in CHROME or name == "header" and above != "main":
            own = "chrome"
        else:
            own = "main" if above == "main" or name in MAIN else "plain"
        around = stack[-1][2] if stack else ()
        if vote and name not in ("html", "body") and own != "chrome":
            around = (*around, f"{vote}{name}.{label}")
        stack.append((name, own, around))
        stream.append(f"<{name}.{label}>" if label else f"<{name}>")
    flush()
    stream.extend(f"</{name}>" for name, *_ in reversed(stack))
    return Page(stream, blocks)


@dataclass
class _Unit:
    """A folded subtree: its tokens without repeat marks as one string, the tokens, and the places in the stream that each stands for."""

    key: str
    tokens: list[str]
    members: list[list[int]]


def _folded(units: list[_Unit]) -> tuple[list[str], list[list[int]]]:
    """Stretches of siblings that repeat side by side, of any length, as one stretch marked with '+'."""
    keys = [u.key for u in units]
    later: dict[str, int] = {}
    distance = [0] * len(keys)
    for k in range(len(keys) - 1, -1, -1):
        distance[k] = later.get(keys[k], k) - k
        later[keys[k]] = k
    tokens: list[str] = []
    members: list[list[int]] = []
    k = 0
    while k < len(units):
        width, stop = distance[k], k + 1
        if width and keys[k : k + width] == keys[k + width : k + 2 * width]:
            stop = k + 2 * width
            while keys[stop : stop + width] == keys[k : k + width]:
                stop += width
        for j in range(k, k + width if stop > k + 1 else stop):
            same = units[j:stop:width] if stop > k + 1 else [units[j]]
            for n, token in enumerate(same[0].tokens):
                repeats = stop > k + 1 or any(u.tokens[n].endswith("+") for u in same)
                tokens.append(token.removesuffix("+") + "+" * repeats)
                members.append([t for u in same for t in u.members[n]])
        k = stop
    return tokens, members


def fold(stream: list[str]) -> tuple[list[str], list[int]]:
    """Fold subtrees and stretches of them that repeat side by side, and give each token's place in the folded stream.

    Equal subtrees fold from the leaves up, so that folded stretches may lie inside
    wider ones. A stretch may be of any number of tokens.
    """
    levels: list[list[_Unit]] = [[]]
    opened: list[int] = []
    for k, token in enumerate(stream):
        if token.startswith("</") and opened:
            start = opened.pop()
            tokens, members = _folded(levels.pop())
            tokens, members = [stream[start], *tokens, token], [[start], *members, [k]]
            key = xxhash.xxh128_hexdigest("\n".join(t.removesuffix("+") for t in tokens))
            levels[-1].append(_Unit(key, tokens, members))
        elif token.startswith("<") and not token.startswith("</"):
            opened.append(k)
            levels.append([])
        else:
            levels[-1].append(_Unit(token, [token], [[k]]))
    while opened:  # elements without an end
        start = opened.pop()
        tokens, members = _folded(levels.pop())
        levels[-1].append(_Unit(stream[start], [stream[start]], [[start]]))
        levels[-1].extend(_Unit(t, [t], [m]) for t, m in zip(tokens, members, strict=True))
    tokens, members = _folded(levels[0])
    place = [0] * len(stream)
    for k, group in enumerate(members):
        for t in group:
            place[t] = k
    return tokens, place


@dataclass
class Node:
    """A place of a wrapper: a tag or a slot, whether it is optional or repeats, and for a slot where it lies, how its text differs and how long it is in all."""

    token: str
    optional: bool = False
    repeats: bool = False
    pages: int = 0
    constant: int | None = None
    zone: str = "plain"
    varies: bool = False
    chars: int = 0


def _table(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, from a whole table."""
    best = np.zeros((len(x) + 1, len(y) + 1), np.int32)
    for i in range(len(x) - 1, -1, -1):  # a row at a time, from the right
        reached = np.maximum(best[i + 1, :-1], best[i + 1, 1:] + (y == x[i]))
        best[i, :-1] = np.maximum.accumulate(reached[::-1])[::-1]
    out = []
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def _last_row(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Lengths of longest common subsequences of ``x`` with each beginning of ``y``."""
    row = np.zeros(len(y) + 1, np.int32)
    for code in x:
        row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (y == code)))
    return row


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places of a longest common subsequence, in space that grows with the lengths' sum (divide and conquer)."""
    if len(x) * len(y) <= CELLS or len(x) < 2:
        return _table(x, y)
    half = len(x) // 2
    split = int(np.argmax(_last_row(x[:half], y) + _last_row(x[half:][::-1], y[::-1])[::-1]))
    return common(x[:half], y[:split]) + [(i + half, j + split) for i, j in common(x[half:], y[split:])]


def _ends(wrapper: list[Node], stream: list[Node]) -> tuple[int, int]:
    """How many places both begin and end with alike."""
    a, b = len(wrapper), len(stream)
    head = 0
    while head < min(a, b) and _same(wrapper[head], stream[head]):
        head += 1
    tail = 0
    while tail < min(a, b) - head and _same(wrapper[a - 1 - tail], stream[b - 1 - tail]):
        tail += 1
    return head, tail


def alike(wrapper: list[Node], stream: list[Node]) -> bool:
    """Whether two layouts have enough in common to be aligned, and aren't too long for it."""
    ours, theirs = (Counter((n.token, n.zone) for n in side) for side in (wrapper, stream))
    head, tail = _ends(wrapper, stream)
    cells = (len(wrapper) - head - tail) * (len(stream) - head - tail)
    return (ours & theirs).total() >= ALIKE * min(len(wrapper), len(stream)) and cells <= MOST_CELLS


def align(wrapper: list[Node], stream: list[Node]) -> list[Node]:
    """The wrapper that covers both: a longest common subsequence kept, mismatches resolved.

    A stretch that only one side has is one more turn of a group if it repeats, tag by
    tag, what stands right before it; else it is optional.
    """
    head, tail = _ends(wrapper, stream)  # these need no table
    x, y = wrapper[head : len(wrapper) - tail], stream[head : len(stream) - tail]
    codes: dict[tuple[str, str], int] = {}
    rows, columns = (np.array([codes.setdefault((p.token, p.zone), len(codes)) for p in side], np.int64) for side in (x, y))
    out = [_join(p, q) for p, q in zip(wrapper[:head], stream[:head], strict=True)]

    def resolve(extra: list[Node]) -> None:
        before = out[len(out) - len(extra) :]
        if extra and len(before) == len(extra) and all(_same(p, q) for p, q in zip(before, extra, strict=True)) and _balanced(extra):
            out[len(out) - len(extra) :] = [replace(_join(p, q), repeats=True, pages=max(p.pages, q.pages)) for p, q in zip(before, extra, strict=True)]
        else:
            out.extend(replace(p, optional=True) for p in extra)

    i = j = 0
    for k, m in [*common(rows, columns), (len(x), len(y))]:
        resolve(x[i:k])
        resolve(y[j:m])
        if k < len(x):
            out.append(_join(x[k], y[m]))
        i, j = k + 1, m + 1
    out += [_join(p, q) for p, q in zip(wrapper[len(wrapper) - tail :], stream[len(stream) - tail :], strict=True)]
    return out


def _balanced(nodes: list[Node]) -> bool:
    depth = 0
    for node in nodes:
        depth += 0 if node.token == "#" else -1 if node.token.startswith("</") else 1
        if depth < 0:
            return False
    return depth == 0


def _same(a: Node, b: Node) -> bool:
    return a.token == b.token and a.zone == b.zone


def _join(a: Node, b: Node) -> Node:
    varies = a.varies or b.varies or a.constant != b.constant
    return Node(a.token, a.optional or b.optional, a.repeats or b.repeats, a.pages + b.pages, a.constant, a.zone, varies, a.chars + b.chars)


def signature(html: str) -> tuple[list[str], list[Block], list[int], list[int]]:
    """Folded tokens (slots with their zones), blocks, and for each folded place a hash of its text (0: differs or none) and the length of all of it."""
    page = read_page(html)
    folded, place = fold(page.stream)
    slots = [k for k, t in enumerate(page.stream) if t == "#"]
    zones = ["" for _ in folded]
    texts, chars = [0] * len(folded), [0] * len(folded)
    many = [False] * len(folded)
    for block, at in zip(page.blocks, slots, strict=True):
        k = place[at]
        zones[k] = ">".join((block.zone, *block.doubt))
        value = xxhash.xxh64_intdigest(block.text.encode()) >> 1
        many[k] |= texts[k] not in (0, value)
        texts[k] = value
        chars[k] += len(block.text)
    return [t + "|" + z if z else t for t, z in zip(folded, zones, strict=True)], page.blocks, [0 if m else t for m, t in zip(many, texts, strict=True)], chars


def nodes_of(tokens: list[str], pages: int, texts: list[int], varies: list[bool], chars: list[int] | None = None) -> list[Node]:
    """The wrapper of one folded stream."""
    nodes = []
    for t, value, other, n in zip(tokens, texts, varies, chars or [0] * len(tokens), strict=True):
        token, _, zone = t.partition("|") if t.startswith("#") else (t, "", "")
        nodes.append(Node(token.removesuffix("+"), repeats=token.endswith("+"), pages=pages, constant=value, zone=zone, varies=other or value == 0, chars=n))
    return nodes


def infer(streams: list[tuple]) -> list[Node]:
    """A host's wrapper from its distinct folded streams (tokens, pages, text hashes, whether texts vary), the most frequent first."""
    out: list[Node] = []
    for nodes in (nodes_of(*s) for s in streams):
        out = align(out, nodes) if out else nodes
    return out


def merge(wrappers: Iterator[list[Node]]) -> list[list[Node]]:
    """Wrappers that cover all, each aligned to the first that it is like."""
    out: list[list[Node]] = []
    for nodes in wrappers:
        for k, held in enumerate(out):
            if alike(held, nodes):
                out[k] = align(held, nodes)
                break
        else:
            out.append(nodes)
    return out


@dataclass
class Slots:
    """What a host's slots of one zone and one chain of voted elements hold: text that differs, all text, pages, most pages of a slot that differs, and pages that have the zone."""

    zone: str
    doubt: tuple[str, ...]
    mass: int
    chars: int
    pages: int
    varying: int
    seen: int


def choose(slots: list[Slots]) -> tuple[str, set[str]]:
    """What of a host's pages is the article: its zone, and the chains of voted elements that belong to it.

    Of the zones, the one whose slots hold most of the text that differs from page to
    page is the article's: with an article or main element on most pages that is
    ``main``, on other hosts ``plain``. A voted element, outermost first, stays if
    nothing differs outside of it. With a vote for the site's text it also stays if it
    holds as much of what differs as all the rest, or slot by slot at least half as much
    text as usual that differs; where pages are too few to tell, or the vote is for other people's
    text, only if it holds ``OUTWEIGHS`` times the rest.
    """
    mass = lambda zone: sum(s.mass for s in slots if s.zone == zone)
    seen = lambda zone: max((s.seen for s in slots if s.zone == zone), default=0)
    most = max((s.seen for s in slots), default=0)
    zone = "main" if mass("main") and (2 * seen("main") >= most or mass("main") >= mass("plain")) else "plain"
    alive = [s for s in slots if s.zone == zone]
    kept: set[str] = set()
    for chain in sorted({s.doubt[: k + 1] for s in alive for k in range(len(s.doubt))}, key=lambda c: (len(c), c)):
        its = [s for s in alive if s.doubt[: len(chain)] == chain]
        if not its:
            continue
        rest = [s for s in alive if s.doubt[: len(chain)] != chain]
        inside, outside = sum(s.mass for s in its), sum(s.mass for s in rest)
        sure = [s for s in rest if not s.doubt] or rest
        usual = sum(s.chars for s in sure) / max(1, sum(s.pages for s in sure))
        differs = max(s.varying for s in its) > 1
        stays = not outside or inside >= OUTWEIGHS * outside
        if chain[-1].startswith("1") and differs:
            stays |= inside >= outside or sum(s.chars for s in its) >= 0.5 * usual * sum(s.pages for s in its)
        if stays:
            kept.add(">".join(chain))
        else:
            alive = rest
    return zone, kept


def slots_of(wrapper: list[Node]) -> list[tuple[str, str, int | None, int, int, int]]:
    """The text slots: zone, chain of voted elements, hash of the text (None: it differs), pages, length, and for each zone's first slot the pages that have the zone."""
    found = [n for n in wrapper if n.token == "#"]
    seen: dict[str, int] = {}
    for n in found:
        zone = n.zone.partition(">")[0]
        seen[zone] = max(seen.get(zone, 0), n.pages)
    return [(z, chain, None if n.varies else n.constant, n.pages, n.chars, seen.pop(z, 0)) for n in found for z, _, chain in [n.zone.partition(">")]]


def article_slots(wrapper: list[Node], least_pages: int = LEAST_PAGES) -> tuple[str, set[int], set[str]]:
    """For one wrapper: the article's zone, hashes of the template's own texts, and the voted elements that belong to the article.

    Text of the zone ``plain`` that ``least_pages`` pages of different content or more
    share word for word belongs to the template, unless an article element says that it
    doesn't; copies of a page are one content.
    """
    found = slots_of(wrapper)
    rows = [Slots(z, tuple(c.split(">")) if c else (), n if h is None or p < least_pages else 0, n, p, p if h is None else 0, s) for z, c, h, p, n, s in found]
    zone, kept = choose(rows)
    return zone, {h for z, _, h, p, _, _ in found if z == "plain" and h and p >= least_pages}, kept


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


WRAPPERS = "host string, shape string, pages long, marks array<long>, nodes string"


def _packed(wrapper: list[Node]) -> str:
    return json.dumps([[x.item() if isinstance(x, np.generic) else x for x in astuple(n)] for n in wrapper])


def _unpacked(text: str) -> list[Node]:
    return [Node(*fields) for fields in json.loads(text)]


def _row(host: str, shape: str, pages: int, wrapper: list[Node]) -> tuple:
    tokens = {n.token for n in wrapper} or {""}
    return host, shape, pages, [min(xxhash.xxh64_intdigest(t.encode(), k) >> 1 for t in tokens) for k in range(MARKS)], _packed(wrapper)


def streams(pages: DataFrame) -> DataFrame:
    """Rows of ``WRAPPERS``: per host each distinct folded stream, with the pages of different content that have it.

    Pages become folded streams where they lie, and are summed there and by host before
    anything meets in one task; a stream is known by its hash until then.
    """
    kind = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            seen: dict[tuple[str, str], list] = {}
            for host, text in zip(batch.column("host").to_pylist(), texts_of(batch, "html").to_pylist(), strict=True):
                tokens, blocks, texts, chars = signature(text)
                key = (host, "\n".join(tokens))
                low, high, size, contents = seen.setdefault(key, [texts, texts, [0] * len(texts), set()])
                content = xxhash.xxh64_intdigest("\n".join(b.text for b in blocks).encode()) >> 1
                size = size if content in contents else [p + q for p, q in zip(size, chars, strict=True)]
                seen[key] = [[min(p) for p in zip(low, texts, strict=True)], [max(p) for p in zip(high, texts, strict=True)], size, contents | {content}]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([h for h, _ in seen], pa.string()),
                    pa.array([xxhash.xxh128_hexdigest(s.encode()) for _, s in seen], pa.string()),
                    pa.array([s for _, s in seen], pa.string()),
                    *(pa.array([sorted(v[c]) if c == 3 else v[c] for v in seen.values()], kind) for c in range(4)),
                ],
                names=["host", "shape", "stream", "low", "high", "chars", "contents"],
            )

    found = pages.select(_host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    found = write_table(found.mapInArrow(run, "host string, shape string, stream string, low array<long>, high array<long>, chars array<long>, contents array<long>"), "streams")
    key = ["host", "shape"]
    # equal texts in several shapes are still one content: it counts for one of them
    pages_of = found.select(*key, F.explode("contents").alias("content")).groupBy("host", "content").agg(F.min("shape").alias("shape")).groupBy(*key).agg(F.count("*").alias("pages"))
    slots = found.select(*key, F.posexplode(F.arrays_zip("low", "high", "chars")).alias("k", "x"))
    slots = slots.groupBy(*key, "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"), F.sum("x.chars").alias("chars"))
    slots = slots.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("k", "low", "high", "chars"))).alias("slots"))
    texts = found.groupBy(*key).agg(F.min("stream").alias("stream"))
    distinct = texts.join(slots, key).join(pages_of, key, "left").select(*key, "stream", "slots", F.coalesce("pages", F.lit(0)).alias("pages"))

    def single(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            made = [
                _row(r.host, r.shape, int(r.pages), nodes_of(r.stream.split("\n"), int(r.pages), [s["low"] for s in r.slots], [s["low"] != s["high"] for s in r.slots], [int(s["chars"]) for s in r.slots]))
                for r in rows.itertuples()
            ]
            yield pd.DataFrame(made, columns=["host", "shape", "pages", "marks", "nodes"])

    return write_table(distinct.mapInPandas(single, WRAPPERS), "wrappers")


def dealt(wrappers: DataFrame, turn: int) -> DataFrame:
    """``wrappers`` with ``mark`` and ``part``: each host's rows of one mark (a hash that like layouts share) dealt to parts of about ``TOGETHER`` rows."""
    marked = wrappers.withColumn("mark", F.col("marks")[turn % MARKS])
    sizes = marked.groupBy("host", "mark").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("shape", F.lit(turn)), F.ceil(F.col("n") / TOGETHER))
    return marked.join(sizes, ["host", "mark"]).withColumn("part", part)


def aligned_in_rounds(wrappers: DataFrame) -> DataFrame:
    """Each host's wrappers aligned part by part, the most frequent first, then the parts' wrappers alike, until no turn in ``MARKS`` leaves fewer."""

    def one_part(key: tuple, found: pd.DataFrame) -> pd.DataFrame:
        found = found.sort_values(["pages", "shape"], ascending=[False, True])
        made = merge(_unpacked(x) for x in found["nodes"])
        rows = [_row(key[0], found["shape"].iloc[0] + (f".{k}" if k else ""), max((n.pages for n in nodes), default=0), nodes) for k, nodes in enumerate(made)]
        return pd.DataFrame(rows, columns=["host", "shape", "pages", "marks", "nodes"])

    turn, idle, before = 0, 0, wrappers.count()
    while idle < MARKS and wrappers.groupBy("host").count().where("count > 1").limit(1).count():
        met = dealt(wrappers, turn)
        alone = met.where("n = 1").select(*wrappers.columns)
        wrappers = write_table(alone.unionByName(met.where("n > 1").groupBy("host", "mark", "part").applyInPandas(one_part, WRAPPERS)), f"wrappers-{turn}")
        now = wrappers.count()
        turn, idle, before = turn + 1, idle + 1 if now == before else 0, now
    return wrappers


def decisions(aligned: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """Per host: zone, template (hashes of its own texts) and kept (voted elements that belong to the article), summed over its wrappers."""

    def flat(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in parts:
            rows = [(host, *slot) for host, nodes in zip(found["host"], found["nodes"], strict=True) for slot in slots_of(_unpacked(nodes))]
            columns = dict(zip(("host", "zone", "doubt", "constant", "pages", "chars", "seen"), zip(*rows, strict=True), strict=True)) if rows else {}
            yield pd.DataFrame({c: pd.array(v, dtype="Int64") if c == "constant" else list(v) for c, v in columns.items()}, columns=["host", "zone", "doubt", "constant", "pages", "chars", "seen"])

    slots = aligned.select("host", "nodes").mapInPandas(flat, "host string, zone string, doubt string, constant long, pages long, chars long, seen long")
    texts = slots.groupBy("host", "zone", "doubt", "constant").agg(F.sum("pages").alias("pages"), F.sum("chars").alias("chars"), F.max("pages").alias("most"), F.sum("seen").alias("seen"))
    differs = F.col("constant").isNull()
    template = ~differs & (F.col("zone") == "plain") & (F.col("pages") >= least_pages)
    chains = texts.groupBy("host", "zone", "doubt").agg(
        F.sum(F.when(differs | (F.col("pages") < least_pages), F.col("chars")).otherwise(0)).alias("mass"),
        F.sum("chars").alias("chars"),
        F.sum("pages").alias("pages"),
        F.max(F.when(differs, F.col("most")).otherwise(0)).alias("varying"),
        F.sum("seen").alias("seen"),
        F.collect_list(F.when(template, F.col("constant"))).alias("own"),
    )
    zones = chains.groupBy("host", "zone").agg(F.sum("seen").alias("all_seen"))
    hosts = chains.join(zones, ["host", "zone"]).groupBy("host").agg(F.collect_list(F.struct("zone", "doubt", "mass", "chars", "pages", "varying", F.col("all_seen").alias("seen"))).alias("slots"), F.flatten(F.collect_list("own")).alias("own"))

    def chosen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in parts:
            made = [choose([Slots(s["zone"], tuple(s["doubt"].split(">")) if s["doubt"] else (), *(int(s[c]) for c in ("mass", "chars", "pages", "varying", "seen"))) for s in slots]) for slots in found["slots"]]
            yield pd.DataFrame({"host": found["host"], "zone": [z for z, _ in made], "template": [[int(h) for h in own if h] for own in found["own"]], "kept": [sorted(k) for _, k in made]})

    return hosts.mapInPandas(chosen, "host string, zone string, template array<long>, kept array<string>")


def wrappers(pages: DataFrame) -> DataFrame:
    """Rows (host, wrapper): each host's wrappers as text, one for each kind of layout."""

    def shown(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in parts:
            texts = [" ".join(("(" + n.token + ")" + "+" * n.repeats + "?" * n.optional) for n in _unpacked(x)) for x in found["nodes"]]
            yield pd.DataFrame({"host": found["host"], "wrapper": texts})

    return aligned_in_rounds(streams(pages)).mapInPandas(shown, "host string, wrapper string")


def extract(pages: DataFrame) -> DataFrame:
    """The main text of every page: page_id, url, text, n_chars.

    The host's wrappers say which slots hold the article; a page without such slots
    gives its other text outside chrome instead. Null html counts as empty and gives
    an empty text; a null or odd url belongs to the host ''. Repeated ids give a row each.
    """
    learned = write_table(decisions(aligned_in_rounds(streams(pages))), "decisions").withColumnRenamed("host", "__host")
    met = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host("url").alias("host"))
    met = met.join(learned, met.host == learned["__host"], "left").select("page_id", "url", "html", "zone", "template", "kept")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            columns = (batch.column(c).to_pylist() for c in ("zone", "template", "kept"))
            out = [main_text(text, (zone or "main", set(own or ()), set(kept or ()))) for text, zone, own, kept in zip(texts_of(batch, "html").to_pylist(), *columns, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return met.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def main_text(html: str, decided: tuple[str, set[int], set[str]] | None = None) -> str:
    """Text of the article's slots: those of its zone, without the template's own texts and voted elements other than those kept (by this page alone, if nothing is ``decided``)."""
    if decided is None:
        tokens, _, texts, chars = signature(html)
        decided = article_slots(nodes_of(tokens, 1, texts, [False] * len(tokens), chars))
    first, own, kept = decided
    blocks = read_page(html).blocks
    stays = lambda b: all(">".join(b.doubt[: k + 1]) in kept for k in range(len(b.doubt)))
    found: list[Block] = []
    for zone in dict.fromkeys((first, "main", "plain")):
        inside = [b for b in blocks if b.zone == zone]
        found = [b for b in inside if stays(b)] or inside
        if found:
            break
    return " ".join(b.text for b in found if b.zone == "main" or not own or (xxhash.xxh64_intdigest(b.text.encode()) >> 1) not in own)
