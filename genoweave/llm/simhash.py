"""SimHash near-duplicates: exact links by tiled exclusive-or and bit counts.

Fingerprints are compared exactly. Two that differ in at most three of 64 bits
agree in at least one of four 16-bit quarters, so each distinct fingerprint is
dealt to four blocks, one per quarter. In a block fingerprints lie in order of
their bit count and are cut into tiles; tile pairs whose counts differ by more than
the radius are skipped, the others compared with exclusive-or and bit counts. A
block of more fingerprints than a task should hold is dealt out as tile pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import pieces, texts_of, words_of
from genoweave.operators.components import connected_components
from genoweave.plans.durable import write_table

SHINGLE = 3
SEED = 42
BITS = 64
RADIUS = 3
QUARTERS = 4
#: Fingerprints of a block that one task compares; larger blocks are dealt out as tile pairs.
BLOCK = 8192
TILE = 1024


def fingerprints(values: pa.Array, width: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprint of each text, as unsigned numbers.

    A bit is set where more than half of the shingles' hashes have it; repeated
    shingles count each time. A text of fewer words than a shingle hashes them
    all, one without words has fingerprint zero.
    """
    words, starts = words_of(pc.ascii_lower(values))
    out = np.zeros(len(values), np.uint64)
    if len(words) == 0:
        return out
    n = len(words)
    lengths = np.asarray(pc.binary_length(words)).astype(np.int64)
    blob = " ".join(words.to_pylist()).encode()
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:n]
    end = begin + lengths
    count = np.diff(starts)
    shingles = np.where(count >= width, count - width + 1, np.minimum(count, 1))
    offsets = np.concatenate([[0], np.cumsum(shingles)])
    first = np.repeat(starts[:-1] - offsets[:-1], shingles) + np.arange(offsets[-1])
    last = np.minimum(first + width - 1, np.repeat(starts[1:] - 1, shingles))
    digest, view = xxhash.xxh64_intdigest, memoryview(blob)
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begin[first].tolist(), end[last].tolist(), strict=True)], np.uint64)
    full = np.flatnonzero(shingles)
    # Bits in blocks of rows, so that 64 bytes a shingle never exist for a whole batch.
    sums = np.zeros((len(full), BITS), np.int64)
    step = 1 << 16
    text = np.repeat(np.arange(len(full)), shingles[full])
    for k in range(0, len(hashes), step):
        part = hashes[k : k + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        owner = text[k : k + step]
        heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        sums[owner[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    majority = sums * 2 > shingles[full][:, None]
    out[full] = np.packbits(majority, axis=1, bitorder="little").view(np.uint64).reshape(-1)
    return out


def fingerprint_documents(documents: DataFrame, width: int = SHINGLE, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` and ``fp``, the fingerprint as a signed 64-bit number. Null texts count as empty."""
    kept = documents.select(*keep, F.col("text").alias("__text"))
    fields = [f for f in kept.schema.fields if f.name != "__text"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + ["fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "__text"):
            found = fingerprints(texts_of(batch, "__text"), width)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in fields] + [pa.array(found.view(np.int64))], names=[f.name for f in fields] + ["fp"])

    return kept.mapInArrow(run, schema)


def tile_links(left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs, one of each side, that differ in at most ``radius`` bits."""
    return np.nonzero(np.bitwise_count(left[:, None] ^ right[None, :]) <= radius)


def _root(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of ``a`` and ``b`` in ``parent``, which leads every node to its set's least."""
    while len(a):
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    return parent


def block_links(values: np.ndarray, radius: int = RADIUS, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same sets as all pairs within ``radius``, at most one per fingerprint.

    ``values`` (and ``other``, if two sides are compared) are distinct. Tiles are
    taken in order of bit count; pairs of tiles too far apart in it are skipped.
    """
    both = values if other is None else np.concatenate([values, other])
    parent = np.arange(len(both))
    counts = np.bitwise_count(both)

    def tiles(at: np.ndarray) -> list[np.ndarray]:
        ordered = at[np.argsort(counts[at], kind="stable")]
        return [ordered[k : k + TILE] for k in range(0, len(ordered), TILE)]

    one = tiles(np.arange(len(values)))
    two = one if other is None else tiles(np.arange(len(values), len(both)))
    for i, x in enumerate(one):
        for y in two[i:] if other is None else two:
            if int(counts[y[0]]) - int(counts[x[-1]]) > radius or int(counts[x[0]]) - int(counts[y[-1]]) > radius:
                continue
            a, b = tile_links(both[x], both[y], radius)
            a, b = x[a], y[b]
            apart = a != b
            if apart.any():
                parent = _root(parent, a[apart], b[apart])
    linked = np.flatnonzero(parent != np.arange(len(both)))
    return both[linked], both[parent[linked]]


def _small_tiles(key: np.ndarray, values: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links in runs of equal ``key``, each one a tile.

    All tiles are compared at once, every value with the d-th next of its tile in order
    of bit count; a tile is done where the counts differ beyond the radius.
    """
    counts = np.bitwise_count(values)
    order = np.lexsort([counts, key])
    key, values, counts = key[order], values[order], counts[order].astype(np.int64)
    left, right = [], []
    at, d = np.arange(len(key)), 0
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[(key[at + d] == key[at]) & (counts[at + d] - counts[at] <= radius)]
        a, b = values[at], values[at + d]
        near = np.bitwise_count(a ^ b) <= radius
        left.append(b[near])
        right.append(a[near])
    return left, right


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, side, fp) in order of block: links within each block."""

    def emit(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def links(block: np.ndarray, side: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        sizes = np.diff(np.concatenate([heads, [len(block)]]))
        size = np.repeat(sizes, sizes)
        two_sided = np.repeat(np.add.reduceat(side, heads) > 0, sizes)
        small = (size <= TILE) & ~two_sided
        a, b = _small_tiles(block[small], fp[small], RADIUS)
        if a:
            yield emit(np.concatenate(a), np.concatenate(b))
        for h, n in zip(heads, sizes, strict=True):
            if small[h]:
                continue
            part, sides = fp[h : h + n], side[h : h + n]
            if sides.any():
                yield emit(*block_links(part[sides == 0], RADIUS, part[sides == 1]))
            else:
                yield emit(*block_links(part, RADIUS))

    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(tuple(np.asarray(batch.column(c)) for c in ("block", "side", "fp")))
        block, side, fp = (np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.searchsorted(block, block[-1]))
        held = [(block[cut:], side[cut:], fp[cut:])]
        if cut:
            yield from links(block[:cut], side[:cut].astype(np.int64), fp[:cut].view(np.uint64))
    if held:
        block, side, fp = held[0]
        yield from links(block, side.astype(np.int64), fp.view(np.uint64))


def links_between(distinct: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join what all pairs of distinct ``fp`` within the radius join."""
    width = BITS // QUARTERS
    quarters = F.explode(F.array(*(F.struct(F.lit(k).alias("q"), F.shiftrightunsigned("fp", width * k).bitwiseAND((1 << width) - 1).alias("v")) for k in range(QUARTERS))))
    dealt = distinct.select("fp", quarters.alias("x")).select("fp", (F.col("x.q") * (1 << width) + F.col("x.v")).alias("quarter"))
    sizes = dealt.groupBy("quarter").agg(F.count("*").alias("n"))
    large = F.broadcast(sizes.where(F.col("n") > block))  # at most 4 * 65,536 rows
    dealt = dealt.join(large, "quarter", "left")
    plain = dealt.where("n is null").select(F.col("quarter").cast("long").alias("block"), F.lit(0).alias("side"), "fp")
    # A large block: tiles by bit count and a hash; each tile meets those within the radius.
    tiled = dealt.where("n is not null").select(
        "quarter", "fp", F.bit_count("fp").alias("ones"), F.ceil(F.col("n") / (8 * block)).cast("int").alias("salts")
    )
    tiled = tiled.withColumn("salt", F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int"))
    meets = F.expr(
        f"filter(flatten(transform(sequence(ones - {RADIUS}, ones + {RADIUS}), o -> transform(sequence(0, salts - 1), s -> struct(o, s)))), m -> m.o between 0 and {BITS})"
    )
    tiled = tiled.withColumn("meet", F.explode(meets)).withColumn("mine", F.struct(F.col("ones").alias("o"), F.col("salt").alias("s")))
    tiled = tiled.select(
        F.xxhash64("quarter", F.least("mine", "meet"), F.greatest("mine", "meet")).alias("block"),
        F.when(F.col("mine") > F.col("meet"), 1).otherwise(0).alias("side"),
        "fp",
    )
    return (
        plain.unionByName(tiled)
        .repartition("block")
        .sortWithinPartitions("block")
        .mapInArrow(_compare, "a long, b long")
    )


def near_duplicates(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the least doc_id reachable through links of three bits or
    fewer, the document's own included; texts without words link like any other.
    Equal fingerprints meet before anything is compared, so copies make no pairs.
    Repeated ids give a row each; a null id gets the component of its fingerprint,
    null if no document of it has an id.
    """
    marked = write_table(fingerprint_documents(documents, width), "fingerprints")
    distinct = write_table(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    grouped = _rooted(distinct)
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    membership = grouped.join(named, "root").select("fp", "component_id")
    return marked.join(membership, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def _rooted(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints with ``root``, one for each class of linked ones."""
    classes = connected_components(links_between(distinct.select("fp")), "a", "b")
    return distinct.join(classes, distinct.fp == classes.node, "left").select(*distinct.columns, F.coalesce("component", "fp").alias("root"))


def one_of_each(documents: DataFrame, width: int = SHINGLE) -> DataFrame:
    """``documents`` with one row of each class of near-duplicates: that of least doc_id, any one of its rows with that id; null ids come last.

    Rows go one by one: another row of the same id stays if its text is in another class.
    """
    numbered = write_table(documents.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("number")), "numbered")
    marked = fingerprint_documents(numbered.select("number", "row.doc_id", "row.text"), width, keep=("number", "doc_id"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "number")).alias("first")
    distinct = write_table(marked.groupBy("fp").agg(first), "distinct")
    kept = _rooted(distinct).groupBy("root").agg(F.min("first").alias("first")).select("first.number")
    return numbered.join(kept, "number", "left_semi").select(*(F.col("row").getField(c).alias(c) for c in documents.columns))
