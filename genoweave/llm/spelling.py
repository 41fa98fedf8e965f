"""Spelling variants: pairs of words one edit apart, found by a positional q-gram index.

Two words one edit apart share their first or their last half, so words are dealt to
groups by halves; a group that is too large is dealt anew by more of its words'
letters, half of what is left at a time, until it is small or its words differ in one
place only. In a group an inverted index has the words by gram, place and length. The
postings of a word's rarest grams, under the limits of place and length, are merged in
order, and pairs that share at least as many as one edit must leave are verified.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import coded, expanded, mixed, pieces, raw, texts_of, words_of
from genoweave.plans.durable import write_table

#: Code points and occurrences of a word, times that a form must be as frequent, and the rule for deletions.
LEAST_CHARS = 6
LEAST_COUNT = 5
TIMES = 5
DELETED_ONE_IN = 199
#: Words of a group above which it is dealt anew, rows a task works on together, grams of a word whose postings are merged, and postings held at once.
GROUP = 2048
TOGETHER = 40_000
MERGED = 8
POSTINGS = 1 << 21
PIECE_BYTES = 16 << 20

_LETTER = np.full(256, 32, np.uint8)
_LETTER[ord("a") : ord("z") + 1] = _LETTER[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def letter_runs(values: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased, and the offset of each text's first."""
    data, offsets = raw(values)
    out = _LETTER[data]
    lead = np.flatnonzero(data == 0xC3)  # the first byte of just these letters beyond ASCII
    out[lead], out[lead + 1] = 0xC3, data[lead + 1]
    return words_of(pa.Array.from_buffers(pa.large_string(), len(values), [None, pa.py_buffer(offsets), pa.py_buffer(out)]))


def _shifts(lengths: np.ndarray) -> np.ndarray:
    """For each length a table (4, 256): what so many more bytes do to each byte of a crc32."""
    bit = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        bit = np.where(bit & 1, (bit >> np.uint32(1)) ^ np.uint32(0xEDB88320), bit >> np.uint32(1)).astype(np.uint32)
    state = np.uint32(1) << np.arange(32, dtype=np.uint32)
    tables, done = np.zeros((len(lengths), 4, 256), np.uint32), 0
    for k, n in enumerate(lengths):
        for _ in range(done, int(n)):
            state = (state >> np.uint32(8)) ^ bit[state & np.uint32(255)]
        done = int(n)
        for part in range(4):
            for b in range(8):
                tables[k, part, 1 << b : 2 << b] = tables[k, part, : 1 << b] ^ state[8 * part + b]
    return tables


def joined_crc32(first: np.ndarray, second: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """crc32 of joined byte strings from those of both parts and the second's length."""
    sizes, which = np.unique(lengths, return_inverse=True)
    tables = _shifts(sizes)
    first = first.astype(np.uint32)
    out = second.astype(np.uint32)
    for part in range(4):
        out = out ^ tables[which, part, (first >> np.uint32(8 * part)) & np.uint32(255)]
    return out


def counted(ids: list[str | None], values: pa.Array, least: int = LEAST_CHARS, one_in: int = DELETED_ONE_IN) -> tuple[pa.Array, np.ndarray]:
    """Words of some documents, with a code point deleted where the rule says so, and how often each occurs."""
    words, offsets = letter_runs(values)
    text = np.repeat(np.arange(len(values)), np.diff(offsets))
    long = pc.greater_equal(pc.utf8_length(words), least)
    words, text = words.filter(long), text[np.asarray(long)]
    number, known = coded(words)
    spelled = known.to_pylist()
    raw_words = [w.encode() for w in spelled]
    own = np.array([zlib.crc32(w) for w in raw_words], np.uint32)
    size = np.array([len(w) for w in raw_words], np.int64)
    before = np.array([0 if i is None else zlib.crc32(f"{i}:".encode()) for i in ids], np.uint32)
    named = np.array([i is not None for i in ids], bool)
    n = np.bincount(number, minlength=len(known))
    more: dict[str, int] = {}
    if len(number):
        sum_ = joined_crc32(before[text], own[number], size[number])
        for k in np.flatnonzero((sum_ % one_in == 0) & named[text]).tolist():
            word = spelled[number[k]]
            n[number[k]] -= 1
            at = int(sum_[k]) % len(word)
            word = word[:at] + word[at + 1 :]
            if len(word) >= least:
                more[word] = more.get(word, 0) + 1
    some = n > 0
    return pa.concat_arrays([known.filter(pa.array(some)).cast(pa.string()), pa.array([*more], pa.string())]), np.concatenate([n[some], np.array([*more.values()], np.int64)])


def word_counts(documents: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, one_in: int = DELETED_ONE_IN) -> DataFrame:
    """Rows (word, n): the words of enough code points and occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", PIECE_BYTES):
            words, n = counted(batch.column("id").to_pylist(), texts_of(batch, "text"), least_chars, one_in)
            yield pa.RecordBatch.from_arrays([words, pa.array(n)], names=["word", "n"])

    found = documents.select(F.col("doc_id").cast("string").alias("id"), "text").mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _keyed(rows: DataFrame) -> DataFrame:
    """``rows`` with the key of their group: the length of its shorter words, the halves chosen so far, and the ``x`` first and ``y`` last code points that all share."""
    shared = F.expr("xxhash64(m, path, left(word, x), right(word, y))")
    return rows.withColumn("key", shared)


def half_groups(words: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """Each word four times: by first and last half, as a word of length ``m`` (base) and as the longer one beside words of length ``m``."""
    length = F.char_length("word")
    rows = words.withColumn("base", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("m", F.when(F.col("base"), length).otherwise(length - 1)).where(F.col("m") >= least)
    half = F.floor(F.col("m") / 2).cast("int")
    sides = F.array(
        F.struct(half.alias("x"), F.lit(0).alias("y"), F.col("m").alias("lim"), F.lit("P").alias("path")),
        F.struct(F.lit(0).alias("x"), half.alias("y"), (half - 1).alias("lim"), F.lit("S").alias("path")),
    )
    return _keyed(rows.withColumn("side", F.explode(sides)).select("word", "n", "base", "m", "side.x", "side.y", "side.lim", "side.path"))


def _split(rows: DataFrame) -> DataFrame:
    """The rows of too large groups by half of what is left: that half at its start, or at its end, is equal too."""
    half = F.floor((F.col("m") - F.col("x") - F.col("y")) / 2).cast("int")
    sides = F.array(
        F.struct((F.col("x") + half).alias("x"), F.col("y").alias("y"), F.col("lim").alias("lim"), F.concat("path", F.lit("P")).alias("path")),
        F.struct(F.col("x").alias("x"), (F.col("y") + half).alias("y"), F.least("lim", F.col("x") + half - 1).alias("lim"), F.concat("path", F.lit("S")).alias("path")),
    )
    return _keyed(rows.withColumn("side", F.explode(sides)).select("word", "n", "base", "m", "side.x", "side.y", "side.lim", "side.path"))


def bounded_groups(rows: DataFrame, most: int = GROUP) -> DataFrame:
    """Groups of at most ``most`` rows, or whose words differ in one place; pairs that meet in several belong to one of them by ``lim``."""
    rows = write_table(rows, "groups")
    while True:
        large = rows.where(F.col("m") - F.col("x") - F.col("y") >= 2).groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > most)
        large = write_table(large.select("key"), "large-groups")
        if large.isEmpty():
            return rows
        rows = write_table(rows.join(large, "key", "left_anti").unionByName(_split(rows.join(large, "key", "left_semi"))), "groups")


class Words:
    """Words as code points one after another, with where each begins and its length."""

    def __init__(self, words: list[str]):
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes


def _alike(words: Words, i: np.ndarray, j: np.ndarray, from_: np.ndarray, most: np.ndarray, back: bool) -> np.ndarray:
    """Code points that pairs of words share at their start (or end), from ``from_`` on, at most ``most``."""
    same = from_.copy()
    open_ = np.flatnonzero(same < most)
    while len(open_):
        a, b, k = i[open_], j[open_], same[open_]
        at = (words.sizes[a] - 1 - k, words.sizes[b] - 1 - k) if back else (k, k)
        open_ = open_[words.codes[words.starts[a] + at[0]] == words.codes[words.starts[b] + at[1]]]
        same[open_] += 1
        open_ = open_[same[open_] < most[open_]]
    return same


def near_pairs(words: Words, group: np.ndarray, base: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, lim: np.ndarray, merged: int = MERGED, most: int = POSTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group whose words are one edit apart: a base row, and a base row further on or a longer one.

    Only grams that reach into what the group doesn't share are indexed: pairs of code
    points, or single ones where so few are left that an edit could spoil all pairs.
    """
    n = len(group)
    first, last = np.maximum(x - 1, 0), np.minimum(words.sizes - y, words.sizes - 1)
    # what one edit of a base word spoils, and so what the pair must share of k merged grams: k - 2 and k - 1 (pairs), k - 1 and k (single)
    pairs = np.minimum(m - y, m - 1) - first >= 3
    left = m - x - y
    first = np.where(pairs, first, x)
    size = np.where(pairs, last - first, np.where(left >= 2, words.sizes - x - y, 1))
    row = np.repeat(np.arange(n), size)
    place = expanded(first, size)[0]
    code = words.starts[row] + np.minimum(place, words.sizes[row] - 1)
    gram = np.where(pairs[row], (words.codes[code] << 21) + words.codes[np.minimum(code + 1, len(words.codes) - 1)], words.codes[code])
    blank = ~pairs & (left < 2)
    gram[blank[row]], place[blank[row]] = 0, 0

    def key(longer: np.ndarray, shift: int) -> np.ndarray:
        return mixed(mixed(mixed(group[row] * 2 + longer) + place.astype(np.uint64) + np.uint64(shift)) + gram.astype(np.uint64))

    posted = key((~base[row]).astype(np.int64), 0)
    by = np.lexsort([row, posted])
    posted, rows_of = posted[by], row[by]
    own = np.empty(len(by), np.int64)
    own[by] = np.arange(len(by))
    probe = base[row]
    lows, highs = [own + 1], [np.searchsorted(posted, posted[own], side="right")]
    for shift in (0, 1):
        wanted = key(np.ones(len(row), np.int64), shift)
        lows.append(np.searchsorted(posted, wanted, side="left"))
        highs.append(np.searchsorted(posted, wanted, side="right") if shift == 0 else np.where(blank[row], lows[-1], np.searchsorted(posted, wanted, side="right")))
    sizes = np.where(probe, np.stack(highs) - np.stack(lows), 0)
    weight = sizes.sum(0)
    # the rarest grams of each word
    rarest = np.lexsort([weight, row])
    begin = np.cumsum(size) - size
    rank = np.empty(len(row), np.int64)
    rank[rarest] = np.arange(len(row)) - np.repeat(begin, size)
    sizes[:, rank >= merged] = 0
    chosen = np.minimum(size, merged)
    bound = np.stack([np.where(pairs, chosen - 2, chosen - 1), np.where(pairs, chosen - 1, chosen)])
    bound = np.maximum(np.where(blank, 1, bound), 1)
    reach = np.cumsum(np.bincount(row, weights=sizes.sum(0), minlength=n)).astype(np.int64)
    found_i, found_j = [], []
    cut = 0
    while cut < n:
        stop = max(cut + 1, int(np.searchsorted(reach, (reach[cut - 1] if cut else 0) + most, side="right")))
        part = slice(begin[cut], begin[stop - 1] + size[stop - 1])
        met = []
        for low, many in zip(lows, sizes, strict=True):
            slots, owner = expanded(low[part], many[part])
            met.append(row[part][owner] * n + rows_of[slots])
        met = np.sort(np.concatenate(met))  # the postings merged
        cut = stop
        if not len(met):
            continue
        heads = np.flatnonzero(np.concatenate([[True], met[1:] != met[:-1]]))
        shared = np.diff(np.concatenate([heads, [len(met)]]))
        i, j = met[heads] // n, met[heads] % n
        enough = shared >= bound[(~base[j]).astype(np.int64), i]
        i, j = i[enough], j[enough]
        shorter = words.sizes[i]
        start = _alike(words, i, j, x[i], shorter, False)
        end = _alike(words, i, j, np.minimum(y[i], shorter - start), shorter - start, True)
        near = (start + end >= shorter - base[j]) & (start <= lim[i]) & ~(base[j] & (start == shorter))
        found_i.append(i[near])
        found_j.append(j[near])
    none = np.zeros(0, np.int64)
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (none, none)


NEAR = "word string, n_near long, best_n long, best string"


def _found(rows: pa.Table) -> pa.RecordBatch:
    """For the words of whole groups: how many near words each has there, and the most frequent of them."""
    column = lambda c: np.asarray(rows.column(c).combine_chunks())
    texts = rows.column("word").combine_chunks()
    key = column("key")
    group = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
    i, j = near_pairs(Words(texts.to_pylist()), group, column("base").astype(bool), *(column(c).astype(np.int64) for c in ("m", "x", "y", "lim")))
    number = column("n")
    order = np.empty(len(key), np.int64)
    order[np.asarray(pc.sort_indices(texts)).astype(np.int64)] = np.arange(len(key))
    source, other = np.concatenate([i, j]), np.concatenate([j, i])
    by = np.lexsort([order[other], -number[other], source])
    source, other = source[by], other[by]
    heads = np.flatnonzero(np.concatenate([[True], source[1:] != source[:-1]])) if len(source) else np.zeros(0, np.int64)
    counts = np.diff(np.concatenate([heads, [len(source)]]))
    return pa.RecordBatch.from_arrays([texts.take(pa.array(source[heads])), pa.array(counts), pa.array(number[other[heads]]), texts.take(pa.array(other[heads]))], names=["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, least: int = LEAST_CHARS, most: int = GROUP) -> DataFrame:
    """Rows (word, n_near, best_n, best) of words (word, n): near words in a group and the most frequent, ties to the smaller; a word may have several rows."""
    groups = bounded_groups(half_groups(words, least), most)
    dealt = groups.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < TOGETHER:
                continue
            rows = pa.Table.from_batches(held)
            key = np.asarray(rows.column("key").combine_chunks())
            whole = int(np.searchsorted(key, key[-1]))  # the last group may go on
            if whole:
                yield _found(rows.slice(0, whole))
                held = rows.slice(whole).combine_chunks().to_batches()
        if held:
            yield _found(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, NEAR)


def last_forms(links: DataFrame) -> DataFrame:
    """Rows (word, root) of links (word, form): where the forms end, each round twice as far."""
    roots = write_table(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = write_table(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            return roots.select("word", "root")
        roots = roots.drop("moved")


def spelling_variants(documents: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, most: int = GROUP) -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    A word's form is its most frequent near word (one code point inserted, deleted or
    replaced; ties to the smaller word) if that is at least ``times`` as frequent, and
    its root is where forms lead. Null and empty texts have no words; in rows with a
    null doc_id nothing is deleted; rows of one id count one by one; no words, no rows.
    """
    words = write_table(word_counts(documents, least_chars, least_count), "words")
    near = near_words(words, least_chars, most)
    nothing = F.lit(None)
    both = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), nothing.cast("long").alias("best_n"), nothing.cast("string").alias("best"))
    both = both.unionByName(near.select("word", nothing.cast("long").alias("n"), "n_near", "best_n", "best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("minus_n"), F.col("best").alias("form"))))
    stats = both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    takes = -F.col("best.minus_n") >= times * F.col("n")
    stats = write_table(stats.select("word", "n", "n_near", F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.minus_n")).alias("form_n")), "near-words")
    roots = last_forms(stats.where("form is not null"))
    return stats.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
