"""Benchmark decontamination by suffix arrays over shards of the training text.

A task turns a shard of documents into word codes and sorts its suffixes. Words that no
test item has can't be part of a match, so they end a suffix like the end of a text does,
and stretches between them that are too short for any window are left out. Every test
suffix is binary-searched word by word: the interval at the window's length has all
occurrences, and going on from there gives the longest verbatim match of each place.
Test items go to the tasks in blocks of bounded size, one block after another.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import coded, distinct, expanded, pieces, replaced, texts_of, words_of
from genoweave.plans.durable import write_table

#: Words of a window, bytes of test items that a task holds at once, and bytes of text in a shard.
WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 16 << 20
#: Pairs of places and windows that are held at once.
PAIRS = 1 << 22

_WORD_BYTES = np.full(256, 32, np.uint8)
_WORD_BYTES[0x80:] = np.arange(0x80, 0x100)
_WORD_BYTES[ord("0") : ord("9") + 1] = np.arange(ord("0"), ord("9") + 1)
_WORD_BYTES[ord("a") : ord("z") + 1] = _WORD_BYTES[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def item_words(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-cased words (0-9, a-z and all beyond ASCII) in order, and the offset of each text's first."""
    return words_of(replaced(values, _WORD_BYTES))


@dataclass
class TestBlock:
    """Test items: their words (codes from 1), each item's words, the suffixes that begin with a window, and the ids."""

    vocabulary: pa.Array
    codes: np.ndarray
    starts: np.ndarray
    windows: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    ids: list[str]

    @property
    def least(self) -> int:
        return int(self.windows.min()) if len(self.windows) else 0

    @property
    def deepest(self) -> int:
        return int((self.ends - self.starts).max()) if len(self.starts) else 0


def test_block(ids: list[str], texts: list[str], window: int = WINDOW) -> TestBlock:
    """Items of fewer words than a window are one window; items without words have none."""
    words, offsets = item_words(pa.array(texts, pa.string()))
    numbers, vocabulary = coded(words)
    sizes = np.diff(offsets)
    length = np.minimum(sizes, window)
    starts, owner = expanded(offsets[:-1], np.where(sizes > 0, sizes - length + 1, 0))
    return TestBlock(vocabulary, numbers.astype(np.int32) + 1, starts, length[owner], offsets[1:][owner], owner, ids)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``text`` other than 0 in the order of their suffixes, by prefix doubling over those still tied.

    A 0 ends a suffix, and the text ends with one. Suffixes equal over ``depth``
    codes or more may stay in any order.
    """
    order = np.flatnonzero(text)
    n = len(order)
    if not n:
        return order
    ends = np.flatnonzero(text == 0)
    left = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(text))
    order = order[np.argsort(text[order], kind="stable")]
    rank = np.zeros(len(text), np.int64)
    slots, key, known = np.arange(n), text[order].astype(np.int64), 1
    while True:
        heads = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[slots]] = np.maximum.accumulate(np.where(heads, slots + 1, 0))
        tied = ~(heads & np.concatenate([heads[1:], [True]]))
        slots = slots[tied]
        slots = slots[left[order[slots]] >= known]
        if known >= depth or not len(slots):
            return order
        key = rank[order[slots]] * (n + 1) + rank[order[slots] + known]
        by = np.argsort(key, kind="stable")
        order[slots], key = order[slots][by], key[by]
        known *= 2


def narrowed(order: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, depth: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each interval of the suffix array whose code at ``depth`` is the wanted one, by binary search of all at once."""
    edges = []
    for above in (False, True):
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            middle = (a + b) >> 1
            met = text[np.where(open_, order[np.where(open_, middle, 0)] + depth, 0)]
            right = open_ & ((met <= wanted) if above else (met < wanted))
            a = np.where(right, middle + 1, a)
            b = np.where(open_ & ~right, middle, b)
        edges.append(a)
    return edges[0], edges[1]


@dataclass
class Found:
    """Occurrences of windows in a shard: places and lengths (words), pairs of text and item, and the longest match that begins at a place."""

    places: np.ndarray
    lengths: np.ndarray
    texts: np.ndarray
    items: np.ndarray
    longest_places: np.ndarray
    longest: np.ndarray


def search_shard(codes: np.ndarray, offsets: np.ndarray, block: TestBlock) -> Found:
    """All windows of the block in a shard of texts, given as codes (0: no test word) and the offset of each text's first word."""
    none = np.zeros(0, np.int64)
    result = Found(none, none, none, none, none, none)
    if not len(block.starts) or not len(codes):
        return result
    # stretches of test words within one text, long enough for a window
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    known = codes > 0
    joined = known[1:] & known[:-1] & (text_of[1:] == text_of[:-1])
    heads = np.flatnonzero(known & ~np.concatenate([[False], joined]))
    tails = np.flatnonzero(known & ~np.concatenate([joined, [False]])) + 1
    long = tails - heads >= block.least
    heads, sizes = heads[long], (tails - heads)[long]
    if not len(heads):
        return result
    places, owner = expanded(heads, sizes + 1)  # one more for the 0 behind each
    text = codes[np.minimum(places, len(codes) - 1)]
    text[np.cumsum(sizes + 1) - 1] = 0
    order = suffix_array(text, block.deepest)

    active = np.arange(len(block.starts))
    low, high = np.zeros(len(active), np.int64), np.full(len(active), len(order))
    depth, found, deepest = 0, [], []
    before = np.full(len(active) + 1, -1)  # occurrences of each suffix, one word less deep
    follows = np.concatenate([block.item[1:] == block.item[:-1], [False]])
    while len(active):
        low, high = narrowed(order, text, low, high, depth, block.codes[block.starts[active] + depth])
        some = high > low
        active, low, high = active[some], low[some], high[some]
        depth += 1
        full = block.windows[active] == depth
        if full.any():
            found.append((active[full], low[full], high[full], depth))
        matched = block.windows[active] <= depth
        if matched.any():
            first, at = np.unique(low[matched], return_index=True)
            deepest.append((first, high[matched][at] - first, depth))
        more = block.starts[active] + depth < block.ends[active]
        if depth > block.least:
            # where the suffix before has all occurrences, one word earlier, its matches are the longer ones
            covering = active[follows[active] & (before[active + 1] == high - low)] + 1
            more &= ~(np.isin(active, covering) & (block.windows[active] < depth))
        before[:] = -1
        before[active] = high - low
        active, low, high = active[more], low[more], high[more]

    hits, lengths, pairs = [], [], []
    count = len(block.ids)
    for suffixes, a, b, n in found:
        first, at, group = np.unique(a, return_index=True, return_inverse=True)
        slots, window = expanded(first, b[at] - first)
        here = places[order[slots]]
        hits.append(here)
        lengths.append(np.full(len(here), n))
        # every text of a window with every item that has it
        texts = distinct(window * (len(offsets) - 1) + text_of[here])
        owners = distinct(group * count + block.item[suffixes])
        window, size = texts // (len(offsets) - 1), np.bincount(owners // count, minlength=len(first))
        begin = np.cumsum(size) - size
        reach = np.cumsum(size[window])
        cut = 0
        while cut < len(texts):
            stop = max(cut + 1, int(np.searchsorted(reach, (reach[cut - 1] if cut else 0) + PAIRS, side="right")))
            at_owner, row = expanded(begin[window[cut:stop]], size[window[cut:stop]])
            pairs.append(distinct((texts[cut:stop] % (len(offsets) - 1))[row] * count + owners[at_owner] % count))
            cut = stop
    if not hits:
        return result
    pair = distinct(np.concatenate(pairs))
    longest = np.zeros(len(order), np.int64)
    for first, size, n in deepest:  # deeper ones come later
        longest[expanded(first, size)[0]] = n
    reached = np.flatnonzero(longest)
    return Found(np.concatenate(hits), np.concatenate(lengths), pair // count, pair % count, places[order[reached]], longest[reached])


def _spans(places: np.ndarray, lengths: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and ends of the stretches of words that any of the ranges covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, places, 1)
    np.add.at(change, places + lengths, -1)
    inside = np.cumsum(change)[:n] > 0
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


MATCHES = "n_words long, spans array<struct<first: long, last: long>>, items array<string>, longest long"


def _scan(frame: DataFrame, block: TestBlock, begun: bool) -> DataFrame:
    """``frame`` with the columns of ``MATCHES``, those of earlier blocks taken up."""
    shared = frame.sparkSession.sparkContext.broadcast(block)
    rest = [c for c in frame.columns if c not in ("n_words", "spans", "items", "longest")]
    kinds = dict(frame.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in pieces(batches, "text", SHARD_BYTES):
            words, offsets = item_words(texts_of(batch, "text"))
            codes = np.asarray(pc.fill_null(pc.index_in(words, known.vocabulary), -1)).astype(np.int32) + 1
            found = search_shard(codes, offsets, known)
            places, lengths, owners = [found.places], [found.lengths], np.searchsorted(offsets, found.longest_places, side="right") - 1
            longest = np.zeros(batch.num_rows, np.int64)
            np.maximum.at(longest, owners, found.longest)
            items: list[set[str]] = [set() for _ in range(batch.num_rows)]
            for text, item in zip(found.texts.tolist(), found.items.tolist(), strict=True):
                items[text].add(known.ids[item])
            if begun:
                longest = np.maximum(longest, np.asarray(batch.column("longest")))
                for k, earlier in enumerate(batch.column("items").to_pylist()):
                    items[k].update(earlier)
                earlier = batch.column("spans")
                size = np.asarray(pc.list_value_length(earlier))
                flat = earlier.flatten()
                first, last = (np.asarray(flat.field(c)) for c in ("first", "last"))
                places.append(first + np.repeat(offsets[:-1], size))
                lengths.append(last - first + 1)
            first, end = _spans(np.concatenate(places), np.concatenate(lengths), len(words))
            # a span never reaches over the end of a text, but two texts' spans may touch
            cuts = offsets[1:-1]
            inner = np.searchsorted(first, cuts, side="right") - 1
            crossed = cuts[(inner >= 0) & (first[np.maximum(inner, 0)] < cuts) & (end[np.maximum(inner, 0)] > cuts)] if len(first) else cuts[:0]
            first, end = np.sort(np.concatenate([first, distinct(crossed)])), np.sort(np.concatenate([end, distinct(crossed)]))
            owner = np.searchsorted(offsets, first, side="right") - 1
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            spans = pa.StructArray.from_arrays([pa.array(first - offsets[owner]), pa.array(end - 1 - offsets[owner])], ["first", "last"])
            columns = [
                *(batch.column(c) for c in rest),
                pa.array(np.diff(offsets)),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), spans),
                pa.array([sorted(s) for s in items], pa.list_(pa.string())),
                pa.array(longest),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest, "n_words", "spans", "items", "longest"])

    return frame.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), MATCHES]))


def find_matches(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document the columns ``keep``, text, n_words, spans, items and longest.

    ``spans`` are the stretches of words (from 0) inside occurrences of windows,
    ``items`` the ids of items with a window there, as strings, and ``longest`` the
    words of the longest verbatim match. A window is ``window`` consecutive words of an
    item, or all of a shorter one. Null and empty texts have no words and no matches;
    items without words match nothing; rows of one item_id are one item, and a null
    item_id reads as ''. Repeated documents give a row each, empty tables none.
    """
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    blocks = max(1, -(-size // block_bytes))
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    frame = documents.select(*keep, "text")
    for k in range(blocks):
        some = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).collect()  # about block_bytes
        frame = _scan(frame, test_block([r.id for r in some], [r.text for r in some], window), k > 0)
        if k < blocks - 1:
            frame = write_table(frame, f"matches-{k}")
    return frame


def decontaminate(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``documents`` without those that hold a window of the benchmark."""
    held = documents.select("text", F.struct("*").alias("__row"))
    clean = find_matches(held, benchmark, window, keep=("__row",)).where(F.size("spans") == 0)
    return clean.select(*(F.col("__row").getField(c).alias(c) for c in documents.columns))


def decontamination_report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated and the longest match in words."""
    found = find_matches(documents, benchmark, window)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        "longest",
    )


#: The report without suffixes: windows as strings, joined; ``longest`` by runs of windows of one item and shift.
REPORT_SQL = r"""
with d as (select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select row_number() over () as i, coalesce(item_id::varchar, '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bk as (select i, item, w, least(len(w), 10) as n, unnest(range(1, len(w) - least(len(w), 10) + 2)) as j from b where len(w) > 0),
v as (select i, item, n, j, array_to_string(list_slice(w, j, j + n - 1), ' ') as x from bk),
s as (select distinct n from v),
dk as (select r, w, n, unnest(range(1, len(w) - n + 2)) as k from d, s where len(w) >= n),
o as (select r, k, n, array_to_string(list_slice(w, k, k + n - 1), ' ') as x from dk),
m as (select o.r, o.k, o.n, v.i, v.item, v.j from o join v on o.n = v.n and o.x = v.x),
h as (select r, count(distinct p)::bigint as n_hit from (select distinct r, unnest(range(k, k + n)) as p from m) group by r),
t as (select r, count(*)::bigint as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from m) group by r),
g as (select r, i, n, k - j as shift, k - row_number() over (partition by r, i, n, k - j order by k) as run from m),
l as (select r, max(c)::bigint as longest from (select r, n + count(*) - 1 as c from g group by r, i, n, shift, run) group by r)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated, coalesce(longest, 0)::bigint as longest
from d left join h on d.r = h.r left join t on d.r = t.r left join l on d.r = l.r
"""
