"""LM scoring by partial matching: byte contexts of up to five bytes with escapes and exclusion.

Spark counts every (context, byte) of the training texts; every context that occurs
is kept. A context's law gives each byte it has seen its count, leaves the number of
distinct bytes for the escape (method C), and passes the rest to the shorter context
with the seen bytes excluded, down to a uniform law. Laws are worked out once for each
distinct (context, byte) of the documents, where contexts with the same last two bytes
meet (the same last three, where many do); documents ask for theirs in groups, one request for each distinct (context, byte)
of a group, so what a task holds doesn't grow with the corpus's contexts.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import coded, distinct, mixed, per_text, pieces, raw, texts_of, words_of
from genoweave.plans.durable import write_table

ORDER = 5
#: Bytes of text whose requests for laws are made together.
GROUP_BYTES = 48 << 20
#: Laws of a part, and requests that meet them in one task, on average.
PART, REQUESTS = 1 << 20, 1 << 22
#: Rows of the count table whose laws are worked out at once, when no two bytes (three where hot) end more contexts.
LAWS = 1 << 20
#: Two bytes are hot if contexts of over LAWS rows, and of more than one row in HOT_ENDS, end in them; so at most HOT_ENDS are.
HOT_ENDS = 1 << 12
#: Words of at least one in so many training tokens go to every task; so there are at most so many.
COMMON_WORDS = 1 << 20
COMMON_BYTES = 32
#: Bytes of text that are worked on at once.
PIECE = 2 << 20
#: Bytes that no UTF-8 text has, for what precedes a text and for its end.
START, END = 0xFE, 0xFF
#: Entries of a count table in a task before it is passed on.
HELD = 1 << 22


def padded(values: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, each after ``order`` start bytes and before an end byte; which places are scored; and how many each text has."""
    data, at = raw(values)
    sizes = np.diff(at)
    starts = np.concatenate([[0], np.cumsum(sizes + order + 1)])
    out = np.full(starts[-1], START, np.uint8)
    out[starts[1:] - 1] = END
    out[np.arange(len(data)) + np.repeat(np.arange(len(sizes)) * (order + 1) + order, sizes)] = data
    scored = np.ones(len(out), bool)
    for k in range(order):
        scored[starts[:-1] + k] = False
    return out, scored, sizes + 1


def grams(values: pa.Array, order: int = ORDER) -> np.ndarray:
    """For every scored place the ``order`` bytes before it and its own, as one number."""
    data, scored, _ = padded(values, order)
    n = max(0, len(data) - order)
    code = np.zeros(n, np.int64)
    for k in range(order, -1, -1):
        code <<= 8
        code |= data[order - k : order - k + n]
    return code[scored[order:]]


def _run_lengths(ordered: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    if weights is None:
        return ordered[heads], np.diff(np.concatenate([heads, [len(ordered)]]))
    return ordered[heads], np.add.reduceat(weights, heads) if len(heads) else np.zeros(0, np.int64)


def count_corpus(documents: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (word, gram, n): how often each word, and each context with its byte, occurs. Exactly one of word and gram is set.

    Rows with ``held_out`` set, where there is such a column, count nothing: their
    words are left out and their grams come with what the other rows count, maybe 0.
    """
    held_out = F.col("held_out") if "held_out" in documents.columns else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(words: pa.Array | None, codes: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            counts = pa.array(n.astype(np.int64))
            return pa.RecordBatch.from_arrays(
                [words if words is not None else pa.nulls(len(n), pa.string()), pa.array(codes, pa.int64()) if codes is not None else pa.nulls(len(n), pa.int64()), counts],
                names=["word", "gram", "n"],
            )

        held, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in pieces(batches, "text", PIECE):
            values = texts_of(batch, "text")
            trains = ~np.asarray(batch.column("held_out"))
            ids, known = coded(words_of(pc.ascii_lower(values.filter(pa.array(trains))))[0])
            yield emit(known, None, np.bincount(ids, minlength=len(known)))
            marked = np.repeat(trains, np.diff(raw(values)[1]) + 1)
            new, new_n = _run_lengths(np.sort((grams(values, order) << 1) | marked))
            new, new_n = _run_lengths(new >> 1, new_n * (new & 1))
            both, n = np.concatenate([held, new]), np.concatenate([held_n, new_n])
            at = np.argsort(both, kind="stable")
            held, held_n = _run_lengths(both[at], n[at])
            if len(held) > HELD:
                yield emit(None, held, held_n)
                held, held_n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(held):
            yield emit(None, held, held_n)

    return documents.select("text", held_out.alias("held_out")).mapInArrow(run, "word string, gram long, n long").groupBy("word", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Trie:
    """Nodes by ``parent`` and ``last``, the byte by which a context is longer; ``law[node, byte]``: log10 of the byte's probability."""

    order: int
    parent: np.ndarray
    last: np.ndarray
    law: np.ndarray

    @functools.cached_property
    def child(self) -> np.ndarray:
        """``child[node, byte]``: the node of the context longer by that byte, or -1. Made where it is used, not sent."""
        out = np.full((len(self.parent), 256), -1, np.int32)
        out[self.parent[1:], self.last[1:]] = np.arange(1, len(self.parent))
        return out


def build_trie(entries: list[tuple[np.ndarray, np.ndarray, np.ndarray]], order: int = ORDER) -> Trie:
    """From (context, byte, count) for each context length 0 to ``order``; every suffix of a context must be there."""
    index: dict[tuple[int, int], int] = {(0, 0): 0}
    parents, levels, last = [0], [0], [0]
    for k in range(1, order + 1):
        for context in np.unique(entries[k][0]).tolist():
            parent = index.get((k - 1, context & ((1 << 8 * (k - 1)) - 1)))
            if parent is None:
                continue
            index[k, context] = len(parents)
            parents.append(parent)
            levels.append(k)
            last.append(context >> 8 * (k - 1))
    size = len(parents)
    parent, level = np.array(parents), np.array(levels)
    counts = np.zeros((size, 256), np.float32)
    for k in range(order + 1):
        contexts, symbols, n = entries[k]
        distinct, back = np.unique(contexts, return_inverse=True)
        nodes = np.array([index.get((k, int(c)), -1) for c in distinct], np.int64)[back] if len(contexts) else np.zeros(0, np.int64)
        counts[nodes[nodes >= 0], symbols[nodes >= 0]] = n[nodes >= 0]
    law = np.zeros((size, 256), np.float32)
    for a in range(0, size, 1024):
        nodes = np.arange(a, min(a + 1024, size))
        mass, excluded = np.ones(len(nodes)), np.zeros((len(nodes), 256), bool)
        out = np.zeros((len(nodes), 256))
        here, active = nodes.copy(), np.ones(len(nodes), bool)
        while active.any():
            c = np.where(excluded, 0, counts[here]).astype(np.float64)
            seen = c > 0
            total, kinds = c.sum(1), seen.sum(1)
            use = active & (kinds > 0)
            whole = np.where(use, total + kinds, 1)[:, None]
            out += np.where(use[:, None], mass[:, None] * c / whole, 0)
            mass = np.where(use, mass * kinds / whole[:, 0], mass)
            excluded |= seen & use[:, None]
            active &= level[here] > 0
            here = np.where(active, parent[here], here)
        rest = ~excluded
        left = rest.sum(1)
        out += np.where(rest, (mass / np.maximum(left, 1))[:, None], 0)
        out /= out.sum(1, keepdims=True)  # a context that has seen all 256 bytes has nothing to escape to
        law[nodes] = np.log10(out)
    return Trie(order, parent, np.array(last, np.int64), law)


def train(counted: DataFrame, order: int = ORDER) -> Trie:
    """The trie of all contexts in a table from ``count_corpus``, for corpora that one process can hold.

    Tests hold ``laws`` against it; ``score_documents`` doesn't use it.
    """
    found = counted.where("gram is not null and n > 0").select("gram", "n").toPandas()
    gram, n = found.gram.to_numpy(np.int64), found.n.to_numpy(np.int64)
    tables = [_summed(gram, n, k) for k in range(order + 1)]
    return build_trie([(g >> 8, g & 255, c.astype(np.float64)) for g, c in tables], order)


def _summed(gram: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts by context of length ``k`` and byte."""
    short = gram & ((1 << 8 * (k + 1)) - 1)
    at = np.argsort(short, kind="stable")
    return _run_lengths(short[at], n[at])


def _found(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each value is in a sorted table, and whether it is there."""
    at = np.minimum(np.searchsorted(table, values), max(0, len(table) - 1))
    return at, table[at] == values if len(table) else np.zeros(len(values), bool)


def laws_of(gram: np.ndarray, n: np.ndarray, short: tuple[np.ndarray, np.ndarray], order: int, hot: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray:
    """log10 of the probability of each gram's byte after its context.

    ``gram`` and ``n`` hold all rows of the count table whose contexts end in the same
    two bytes as any of them; ``short`` the counts of the whole corpus after one byte.
    Where the last two bytes are hot, the rows need only be all with the same last
    three, and ``hot`` holds the counts of the whole corpus after these two bytes.
    Bytes seen after a context were seen after every shorter one; so all that a longer
    context takes from a shorter one's law is what its own bytes count there. For each
    context, ``shared`` is what its parent's law divides by without these bytes, and
    ``escapes`` sums the logarithms of the escapes from its parent on downwards.
    """
    tables = [_summed(*short, k) for k in (0, 1)] + [_summed(gram[n > 0], n[n > 0], k) for k in range(2, order + 1)]
    if hot is not None and order > 1:
        mine = np.isin(hot[0] >> 8, (gram >> 8) & 0xFFFF)
        others = ~np.isin(tables[2][0] >> 8, hot[0] >> 8)
        rows, counts = (np.concatenate([tables[2][k][others], hot[k][mine]]) for k in (0, 1))
        at = np.argsort(rows)
        tables[2] = rows[at], counts[at]
    none = -np.log10(256 - len(tables[0][0]))
    value, below = np.full(len(gram), none), np.full(len(gram), none)
    seen_shorter = log_shorter = None
    for k in range(order + 1):
        rows, counts = tables[k]
        if not len(rows):
            break
        heads = np.flatnonzero(np.concatenate([[True], rows[1:] >> 8 != rows[:-1] >> 8]))
        contexts, total, kinds = rows[heads] >> 8, np.add.reduceat(counts, heads), np.diff(np.concatenate([heads, [len(rows)]]))
        if k == 0:
            shared, escapes = np.ones(1), np.zeros(1)
        else:
            parent = np.searchsorted(contexts_shorter, contexts & ((1 << 8 * (k - 1)) - 1))
            taken = np.add.reduceat(tables[k - 1][1][np.searchsorted(tables[k - 1][0], rows & ((1 << 8 * k) - 1))], heads)
            left = kinds_shorter[parent] - kinds
            shared = np.where(left > 0, total_shorter[parent] - taken + left, 1)
            escapes = escapes_shorter[parent] + np.log10(np.where(left > 0, left, 1) / shared)
        at, have = _found(contexts, (gram >> 8) & ((1 << 8 * k) - 1))
        place, seen = _found(rows, gram & ((1 << 8 * (k + 1)) - 1))
        log_count = np.log10(counts[place])
        if k:
            first = have & ~seen & seen_shorter
            below = np.where(first, log_shorter - np.log10(shared[at]) - escapes[at], below)
        whole = np.log10(total[at] + kinds[at])
        value = np.where(seen, log_count - whole, np.where(have, np.log10(kinds[at]) - whole + escapes[at] + below, value))
        contexts_shorter, total_shorter, kinds_shorter, escapes_shorter = contexts, total, kinds, escapes
        seen_shorter, log_shorter = seen, log_count
    return value


def _part(gram: np.ndarray, parts: int) -> np.ndarray:
    return (mixed(gram) % np.uint64(parts)).astype(np.int32)


def laws(counted: DataFrame, order: int = ORDER, parts: int = 1, many: int = LAWS) -> DataFrame:
    """Rows (gram, law, part): log10 of the byte's probability, for each gram of a table from ``count_corpus``.

    Rows meet by the last two bytes of their contexts; where these are hot (over ``many``
    rows), by the last three, which 2^24 rows share at most. What is sent to every task
    is the counts after one byte, 65,536 at most, and after hot ends, 256 for each.
    """
    rows = counted.where("gram is not null").select("gram", "n")
    end, longer = F.shiftright("gram", 8).bitwiseAND(0xFFFF), F.shiftright("gram", 8).bitwiseAND(0xFFFFFF)
    sizes = rows.groupBy(end.alias("end")).agg(F.count("*").alias("rows")).toPandas()  # 65,536 rows at most
    is_hot = np.zeros(1 << 16, bool)
    is_hot[sizes.end[(sizes.rows > many) & (sizes.rows * HOT_ENDS > sizes.rows.sum())].to_numpy(np.int64)] = True
    ends = [int(x) for x in np.flatnonzero(is_hot)]
    hot = None
    if ends:
        found = rows.where(end.isin(ends) & (F.col("n") > 0)).groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("n").alias("n")).orderBy("gram").toPandas()
        hot = found.gram.to_numpy(np.int64), found.n.to_numpy(np.int64)
    short = rows.where("n > 0").groupBy(F.col("gram").bitwiseAND(0xFFFF).alias("gram")).agg(F.sum("n").alias("n")).toPandas()
    shared = rows.sparkSession.sparkContext.broadcast(((short.gram.to_numpy(np.int64), short.n.to_numpy(np.int64)), hot, is_hot))

    def meeting(gram: np.ndarray) -> np.ndarray:
        context = gram >> 8
        return np.where(shared.value[2][context & 0xFFFF], (1 << 24) + (context & 0xFFFFFF), context & 0xFFFF)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(gram: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            law = laws_of(gram, n, shared.value[0], order, shared.value[1])
            return pa.RecordBatch.from_arrays([pa.array(gram), pa.array(law.astype(np.float32)), pa.array(_part(gram, parts))], names=["gram", "law", "part"])

        grams_held, counts_held, size = [], [], 0
        for batch in batches:
            grams_held.append(np.asarray(batch.column("gram")))
            counts_held.append(np.asarray(batch.column("n")))
            size += batch.num_rows
            if size >= LAWS:
                gram, n = np.concatenate(grams_held), np.concatenate(counts_held)
                keys = meeting(gram)
                cut = int(np.searchsorted(keys, keys[-1]))
                if cut:
                    yield work(gram[:cut], n[:cut])
                grams_held, counts_held, size = [gram[cut:]], [n[cut:]], 0 if cut == 0 else len(gram) - cut
        if grams_held:
            gram, n = np.concatenate(grams_held), np.concatenate(counts_held)
            if len(gram):
                yield work(gram, n)

    key = F.when(end.isin(ends), longer + (1 << 24)).otherwise(end) if ends else end
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, "gram long, law float, part int")


def log10_probabilities(values: pa.Array, trie: Trie) -> np.ndarray:
    """log10 of the model's probability of each whole text, its end included."""
    data, scored, sizes = padded(values, trie.order)
    places = np.flatnonzero(scored)
    child, law = trie.child.reshape(-1), trie.law.reshape(-1)
    out = np.zeros(len(places))
    for a in range(0, len(places), 1 << 20):
        at = places[a : a + (1 << 20)]
        node = np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        for k in range(1, trie.order + 1):
            longer = child[(node[alive] << 8) | data[at[alive] - k]]
            ok = longer >= 0
            alive, longer = alive[ok], longer[ok]
            node[alive] = longer
        out[a : a + len(at)] = law[(node << 8) | data[at]]
    return per_text(out, np.concatenate([[0], np.cumsum(sizes)]))


def _packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as their count and the compressed planes of their bytes."""
    planes = np.ascontiguousarray(numbers.astype(np.int64).view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpacked(packed: bytes) -> np.ndarray:
    n = int.from_bytes(packed[:8], "little")
    planes = np.frombuffer(pa.decompress(packed[8:], 8 * n, "zstd"), np.uint8)
    return np.ascontiguousarray(planes.reshape(8, -1).T).view(np.int64).reshape(-1)


def _steps(ordered: np.ndarray) -> bytes:
    """Sorted numbers as differences, which compress."""
    return _packed(np.diff(ordered, prepend=0))


def _from_steps(steps: pa.Scalar) -> np.ndarray:
    return np.cumsum(_unpacked(steps.as_py()))


def _dealt(gram: np.ndarray, parts: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The order of sorted grams by part, and the grams of each part in order."""
    part = _part(gram, parts)
    at = np.argsort(part, kind="stable")
    return at, np.split(gram[at], np.searchsorted(part[at], np.arange(1, parts)))


def is_held_out(column: str = "doc_id"):
    """Rows kept from training: the CRC-32 of the id as text leaves 2 by 7. A null id trains."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score_documents(documents: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and the model's score.

    Words that make up at least one in ``COMMON_WORDS`` training tokens are counted
    against a table in every task; the others leave the task as one row per
    distinct word and document, and meet their counts in a join. Grams leave it as
    one sorted list per group of documents. Its parts, as many as the laws need, meet
    their laws in lots of groups, to each of which the laws are copied: so parts and pieces grow
    with the laws, lots with the requests. The laws
    then meet the group's texts, which move as compressed blocks. Null texts count as empty (one end token). Every
    row is scored, repeated ids too; without training rows every count is 0 and
    the law uniform.
    """
    spark = documents.sparkSession
    marked = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), is_held_out().alias("held_out"))
    counted = write_table(count_corpus(marked), "corpus-counts")
    ends = marked.where("not held_out").select("doc_id").count()
    words = counted.where("word is not null")
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    tokens, kinds = totals.n + ends, totals.v + (1 if ends else 0)
    below = tokens + kinds + 1
    common = words.where((F.col("n") * COMMON_WORDS >= tokens) & (F.octet_length("word") <= COMMON_BYTES)).select("word", "n").toPandas()
    shared = spark.sparkContext.broadcast((common.word.tolist(), common.n.to_numpy(np.int64)))
    kind = dict(documents.dtypes)["doc_id"]
    fields = f"group long, row long, doc_id {kind}, held_out boolean, n_tokens long, n_listed long, base_listed double, unlisted array<struct<word:string,k:long>>, kinds long, block binary, sizes binary, grams binary"
    names = ["group", "row", "doc_id", "held_out", "n_tokens", "n_listed", "base_listed", "unlisted", "kinds", "block", "sizes", "grams"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed, counts = shared.value
        listed = pa.array(listed, pa.string())
        value = np.log10(np.concatenate([counts, [0]]) + 1.0) - np.log10(below)
        group, size, wanted, nulls = TaskContext.get().partitionId() << 32, 0, np.zeros(0, np.int64), None
        row = group
        for batch in pieces(batches, "text", PIECE):
            texts = texts_of(batch, "text")
            if size and size + len(raw(texts)[0]) > GROUP_BYTES:
                yield other(nulls, group, kinds=len(wanted), grams=_steps(wanted))
                group, size, wanted = group + 1, 0, np.zeros(0, np.int64)
            size += len(raw(texts)[0]) + len(texts)
            wanted = distinct(np.concatenate([wanted, distinct(grams(texts))]))
            nulls = batch.column("doc_id").type
            flat, starts = words_of(pc.ascii_lower(texts))
            ids, known = coded(flat)
            place = np.asarray(pc.fill_null(pc.index_in(known, value_set=listed), len(listed))).astype(np.int64) if len(known) else np.zeros(0, np.int64)
            per_word = place[ids]
            rare = per_word == len(listed)
            base = per_text(np.where(rare, 0.0, value[per_word]), starts)
            text = np.repeat(np.arange(len(texts)), np.diff(starts))[rare]
            pair, n = _run_lengths(np.sort(text * max(1, len(known)) + ids[rare]))
            owner = pair // max(1, len(known))
            offsets = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
            unlisted = pa.StructArray.from_arrays([known.take(pa.array(pair % max(1, len(known)))), pa.array(n.astype(np.int64))], names=["word", "k"])
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, group)), pa.array(np.arange(row, row + n)), batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(starts) + 1), pa.array(per_text(~rare, starts)), pa.array(base), pa.ListArray.from_arrays(pa.array(offsets), unlisted), pa.nulls(n, pa.int64()), *(pa.nulls(n, pa.binary()) for _ in range(3))],
                names=names,
            )
            data, at = raw(texts)
            yield other(nulls, group, row, block=pa.compress(data.tobytes(), "zstd", asbytes=True), sizes=_packed(np.diff(at)))
            row += n
        if size:
            yield other(nulls, group, kinds=len(wanted), grams=_steps(wanted))

    def other(kind: pa.DataType, group: int, row: int | None = None, kinds: int | None = None, block: bytes | None = None, sizes: bytes | None = None, grams: bytes | None = None) -> pa.RecordBatch:
        """A row that is no document's: a block of texts from ``row`` on, or a group's grams."""
        listed = pa.list_(pa.struct([("word", pa.string()), ("k", pa.int64())]))
        empty = [pa.nulls(1, t) for t in (kind, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), listed)]
        ends = [pa.array([x], pa.binary()) for x in (block, sizes, grams)]
        return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([row], pa.int64()), *empty, pa.array([kinds], pa.int64()), *ends], names=names)

    placed = write_table(marked.mapInArrow(run, fields), "scored")
    asked = placed.where("grams is not null").select("group", "grams")
    requests = placed.agg(F.sum("kinds").alias("n")).first().n or 1
    parts = -(-max(1, counted.where("gram is not null").count()) // PART)
    lots = -(-requests // (parts * REQUESTS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, steps in zip(batch.column("group").to_pylist(), batch.column("grams"), strict=True):
                lot = _part(np.array([group]), lots)
                for part, gram in enumerate(_dealt(_from_steps(steps), parts)[1]):
                    if len(gram):
                        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array(lot), pa.array([group]), pa.array([_steps(gram)])], names=["part", "lot", "group", "grams"])

    def answer(wanted: pa.Table, known: pa.Table) -> pa.Table:
        gram, law = np.asarray(known.column("gram")), np.asarray(known.column("law"))
        at = np.argsort(gram)
        gram, law = gram[at], law[at]
        out = []
        for steps in wanted.column("grams"):
            place, there = _found(gram, _from_steps(steps))
            if not there.all():
                raise ValueError("a gram of the documents is missing from their count table")
            out.append(law[place].tobytes())
        return pa.table({"group": wanted.column("group"), "part": wanted.column("part"), "laws": pa.array(out, pa.binary())})

    def total(rows: pa.Table, answers: pa.Table) -> pa.Table:
        is_block = pc.is_valid(rows.column("block"))
        gram = _from_steps(rows.filter(pc.invert(is_block)).column("grams")[0])
        law = np.empty(len(gram), np.float32)
        law[_dealt(gram, parts)[0]] = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in answers.sort_by("part").column("laws")])
        ids, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        blocks = rows.filter(is_block)
        for row, block, packed in zip(blocks.column("row").to_pylist(), blocks.column("block"), blocks.column("sizes"), strict=True):
            ends = np.concatenate([[0], np.cumsum(_unpacked(packed.as_py()))])
            data = pa.decompress(block.as_buffer(), int(ends[-1]), "zstd")
            texts = pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), data])
            codes = grams(texts)
            at = np.argsort(codes)
            heads, n = _run_lengths(codes[at])
            out = np.empty(len(codes))
            out[at] = np.repeat(law[np.searchsorted(gram, heads)], n)
            ids.append(np.arange(row, row + len(texts)))
            sums.append(per_text(out, np.concatenate([[0], np.cumsum(np.diff(ends) + 1)])))
        return pa.table({"row": np.concatenate(ids), "score": np.concatenate(sums)})

    dealt = asked.mapInArrow(deal, "part int, lot int, group long, grams binary")
    known = laws(counted, ORDER, parts, LAWS).withColumn("lot", F.explode(F.sequence(F.lit(0), F.lit(lots - 1))))
    answers = dealt.groupBy("part", "lot").cogroup(known.groupBy("part", "lot")).applyInArrow(answer, "group long, part int, laws binary")
    sent = placed.where("block is not null or grams is not null").select("group", "row", "block", "sizes", "grams")
    scores = sent.groupBy("group").cogroup(answers.groupBy("group")).applyInArrow(total, "row long, score double")
    scored = placed.where("block is null and grams is null").drop("group", "kinds", "block", "sizes", "grams")
    rare = scored.select("row", F.explode("unlisted").alias("u")).select("row", "u.word", "u.k")
    met = rare.join(words.select("word", "n"), "word", "left")
    logs = F.log10(F.coalesce("n", F.lit(0)) + F.lit(1.0)) - F.log10(F.lit(float(below)))
    rest = met.groupBy("row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("n_rare"), F.sum(F.col("k") * logs).alias("base_rare"))
    end = float(np.log10(ends + 1.0) - np.log10(below))
    return scored.drop("unlisted").join(scores, "row").join(rest, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_listed") + F.coalesce("n_rare", F.lit(0)) + F.lit(1 if ends else 0)).cast("long").alias("n_known"),
        F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("base_listed") + F.coalesce("base_rare", F.lit(0.0)) + F.lit(end)).alias("base_score"),
        "score",
    )
