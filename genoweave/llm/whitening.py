"""Embedding whitening from a covariance in double-double arithmetic.

Sums of the integer vectors are exact. Tasks centre each vector on the exact mean, held
as two doubles, and add up the outer products with error-free sums and products; the
high and low parts of tasks are merged in rounds of bounded fan-in. The eigenvectors
come from tridiagonal divide and conquer (numpy's ``eigh`` is LAPACK's ``syevd``) and
are refined once in extended precision against both parts of the covariance.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from genoweave.plans.durable import write_table

#: The scale and shift of entries.
SCALE = 1024
SHIFT = 100_000
#: Components returned, partial sums that meet in one task, doubles of products that a task holds at once, and the largest entry.
COMPONENTS = 8
FAN_IN = 64
HELD = 1 << 17
LARGEST = 1 << 52

Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded sum and its exact error."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """The rounded product and its exact error, by splitting each factor into two halves."""
    p = a * b
    c = 134217729.0 * a
    a1 = c - (c - a)
    a2 = a - a1
    c = 134217729.0 * b
    b1 = c - (c - b)
    b2 = b - b1
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def dd_add(a: Pair, b: Pair) -> Pair:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_multiply(a: Pair, b: Pair) -> Pair:
    """Product of two double-doubles."""
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def dd_total(values: Pair) -> Pair:
    """Sum along the first axis, halving it each time."""
    high, low = values
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([v, np.zeros_like(v[:1])]) for v in (high, low))
        high, low = dd_add((high[0::2], low[0::2]), (high[1::2], low[1::2]))
    return high[0], low[0]


def mean_pair(sums: list[int], n: int) -> Pair:
    """Sums over n as doubles and what they lack."""
    high = np.array([float(Fraction(int(s), n)) for s in sums])
    return high, np.array([float(Fraction(int(s), n) - Fraction(h)) for s, h in zip(sums, high.tolist(), strict=True)])


def products(rows: np.ndarray, mean: Pair) -> Pair:
    """Sum over rows of the upper triangle of their centred outer products."""
    i, j = np.triu_indices(rows.shape[1])
    total = np.zeros(len(i)), np.zeros(len(i))
    step = max(1, HELD // max(1, len(i)))
    for a in range(0, len(rows), step):
        some = rows[a : a + step]
        high, low = two_sum(some, np.broadcast_to(-mean[0], some.shape))
        high, low = two_sum(high, low - mean[1])
        total = dd_add(total, dd_total(dd_multiply((high[:, i], low[:, i]), (high[:, j], low[:, j]))))
    return total


def usable(embedding: str = "embedding"):
    """Vectors of the fit: not null, with entries, none of them null or non-finite."""
    return F.expr(f"{embedding} is not null and size({embedding}) > 0 and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")


def _matrices(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length of the batch's vectors: it, the rows that have it, and what ``column`` has for them as a matrix."""
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield int(size), rows, np.asarray(batch.column(column).take(pa.array(rows)).flatten()).reshape(len(rows), -1)


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(1024 c) + 100000 of each entry, within +-2^52."""
    return np.clip(np.floor(SCALE * vectors.astype(np.float64)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _sums(vectors: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """Per length of vector how many there are and their exact sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _matrices(batch, "x"):
                total = x.sum(0).tolist() if np.abs(x).max() < 2**40 else x.astype(object).sum(0).tolist()
                yield pa.RecordBatch.from_arrays([pa.array([size] * size, pa.int32()), pa.array(range(size), pa.int32()), pa.array([len(rows)] * size), pa.array([str(t) for t in total])], names=["size", "k", "n", "s"])

    parts = vectors.select("size", "x").mapInArrow(run, "size int, k int, n long, s string")
    sums = parts.groupBy("size", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).cast("string").alias("s"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in sums.orderBy("size", "k").collect():  # a number for each component of each length
        found.setdefault(r["size"], (r.n, []))[1].append(int(r.s))
    return found


PARTS = "size int, part int, high binary, low binary"


def _merged(partials: pd.DataFrame) -> pd.DataFrame:
    """One row of partial double-double sums of a size."""
    parts = [np.stack([np.frombuffer(v) for v in partials[c]]) for c in ("high", "low")]
    high, low = dd_total((parts[0], parts[1]))
    return pd.DataFrame({"size": partials["size"].iloc[:1].tolist(), "part": [int(partials["part"].min()) // FAN_IN], "high": [high.tobytes()], "low": [low.tobytes()]})


def centred_products(vectors: DataFrame, means: dict[int, Pair], column: str) -> DataFrame:
    """One row (size, part, high, low) per length of vector: the summed centred outer products of ``column`` (upper triangle)."""
    shared = vectors.sparkSession.sparkContext.broadcast(means)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, Pair] = {}
        for batch in batches:
            for size, _, x in _matrices(batch, column):
                mine = products(x.astype(np.float64), shared.value[size])
                total[size] = dd_add(total[size], mine) if size in total else mine
        columns = [pa.array([*total], pa.int32()), pa.array([v[0].tobytes() for v in total.values()], pa.binary()), pa.array([v[1].tobytes() for v in total.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["size", "high", "low"])

    parts = vectors.select("size", column).mapInArrow(run, "size int, high binary, low binary").withColumn("part", F.spark_partition_id()).select("size", "part", "high", "low")
    parts = write_table(parts, "products")
    while (parts.agg(F.max("part").alias("part")).first().part or 0) > 0:
        parts = write_table(parts.groupBy("size", F.floor(F.col("part") / FAN_IN).alias("among")).applyInPandas(lambda found: _merged(found), PARTS), "products")
    return parts


def refined(v: Pair, values: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and vectors after one correction in extended precision (first order in what they lack)."""
    exact = v[0].astype(np.longdouble) + v[1]
    x = vectors.astype(np.longdouble)
    lacks = np.eye(len(x), dtype=np.longdouble) - x.T @ x
    turned = x.T @ exact @ x
    diagonal = np.diag(turned) / (1 - np.diag(lacks))
    gap = diagonal[None, :] - diagonal[:, None]
    scale = np.abs(diagonal).max() if len(x) else 0
    close = np.abs(gap) <= scale * 1e-13
    fix = np.where(close, lacks / 2, (turned + diagonal[None, :] * lacks) / np.where(close, 1, gap))
    fix = np.where(np.eye(len(x), dtype=bool), np.diag(lacks) / 2, fix)
    out = x + x @ fix
    out = out / np.sqrt((out**2).sum(0))
    return diagonal.astype(np.float64), out.astype(np.float64)


def components(total: Pair, n: int, size: int, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Eigenvalues in falling order, their unit vectors (columns), and their shares of the trace, of summed products (upper triangle).

    A component without variance (at most rounding beside the largest) has eigenvalue 0.
    """
    upper = np.triu_indices(size)
    high, low = (np.zeros((size, size)) for _ in range(2))
    for matrix, part in ((high, total[0]), (low, total[1])):
        matrix[upper] = part
        matrix.T[upper] = part
    # divided by n, both parts
    quotient = high / n
    p, e = two_product(quotient, np.full_like(quotient, n))
    rest = ((high - p) - e + low) / n
    v = two_sum(quotient, rest)
    values, vectors = refined(v, *np.linalg.eigh(v[0]))
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order]
    trace = float(np.trace(v[0]))
    values = np.where(values > size * 1e-15 * max(values[0], 0), values, 0.0)
    share = values / trace if trace > 0 else np.zeros(size)
    return values[:most], vectors[:, :most], share[:most]


def fit(vectors: DataFrame, most: int = COMPONENTS) -> dict[int, tuple]:
    """Per length of vector: n, sums, mean, eigenvalues, directions and shares, of vectors (size, x)."""
    sums = _sums(vectors)
    means = {d: mean_pair(s, n) for d, (n, s) in sums.items()}
    counts = {d: n for d, (n, _) in sums.items()}

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for found in batches:
            out = [components((np.frombuffer(h), np.frombuffer(w)), counts[d], d, most) for d, h, w in zip(found["size"].tolist(), found["high"], found["low"], strict=True)]
            yield pd.DataFrame({"size": found["size"], "values": [v.tolist() for v, _, _ in out], "directions": [v.tobytes() for _, v, _ in out], "share": [v.tolist() for _, _, v in out]})

    solved = centred_products(vectors, means, "x").mapInPandas(solve, "size int, values array<double>, directions binary, share array<double>")
    models = {}
    for r in solved.collect():  # ``most`` vectors of each length
        models[r["size"]] = (*sums[r["size"]], means[r["size"]], np.array(r["values"]), np.frombuffer(r.directions).reshape(r["size"], -1), np.array(r.share))
    return models


def whiten(embeddings: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """Per usable row and component: vec_id, component, n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, empty or holds a null or non-finite entry are left out.
    Vectors are fitted with those of their own length, which as a rule is all. A vector
    of fewer entries has as many components. Where a component has no variance,
    ``whitened`` is null, and it counts for nothing in ``identity_error``. Entries beyond
    +-2^52 / 1024 count as that; a deviation beyond a long is null. Repeated ids give
    their rows each, a null id stays null, an empty table gives none.
    """
    kind = dict(embeddings.dtypes)["vec_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            sizes = np.asarray(pc.list_value_length(lists)).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            x = pa.ListArray.from_arrays(pa.array(offsets), pa.array(integers(np.asarray(lists.flatten()))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(sizes), x], names=["vec_id", "size", "x"])

    vectors = write_table(embeddings.where(usable()).select("vec_id", "embedding").mapInArrow(read, f"vec_id {kind}, size int, x array<long>"), "vectors")
    models = fit(vectors, most)
    shared = embeddings.sparkSession.sparkContext.broadcast(models)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, rows, x in _matrices(batch, "x"):
                n, s, mean, values, directions, share = shared.value[size]
                some = values > 0
                white = np.where(some, ((x - mean[0]) - mean[1]) @ directions / np.sqrt(np.where(some, values, 1)), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("vec_id").take(pa.array(rows)),
                        pa.array(np.full(len(rows), size, np.int32)),
                        pa.array(np.full(len(rows), n, np.int64)),
                        pa.array(deviations(x, n, s), pa.int64()),
                        pa.array(white.tolist(), pa.list_(pa.float64())),
                        pa.array([share.tolist()] * len(rows), pa.list_(pa.float64())),
                        pa.array([some.tolist()] * len(rows), pa.list_(pa.bool_())),
                    ],
                    names=["vec_id", "size", "n", "deviation", "white", "share", "varies"],
                )

    white = write_table(vectors.mapInArrow(project, f"vec_id {kind}, size int, n long, deviation long, white array<double>, share array<double>, varies array<boolean>"), "whitened")
    errors = identity_errors(white, models)
    error = F.lit(None).cast("double")
    if errors:
        error = F.create_map(*(F.lit(v) for pair in errors.items() for v in pair))[F.col("size")]
    each = white.select("vec_id", "size", "n", "deviation", F.posexplode(F.arrays_zip("white", "share", "varies")).alias("k", "x"))
    whitened = F.when(F.col("x.varies"), F.col("x.white"))
    return each.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), "n", "deviation", whitened.alias("whitened"), F.col("x.share").alias("explained"), error.alias("identity_error"))


def deviations(x: np.ndarray, n: int, s: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2 of each row, exact; None where a long can't hold it."""
    far = n * x.astype(np.float64) - np.array([float(v) for v in s])
    if n * float(np.abs(x).max(initial=1)) < 2**61 and (far**2).sum(1).max(initial=0) < 2**61:
        return ((n * x - np.array(s, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(v) - t) ** 2 for v, t in zip(row, s, strict=True)) for row in x.tolist()]
    return [v if v < 2**63 else None for v in exact]


def identity_errors(white: DataFrame, models: dict[int, tuple]) -> dict[int, float]:
    """Per length of vector the largest entry of the whitened values' covariance minus the identity, centred on their own mean."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, _, w in _matrices(batch, "white"):
                high, low = dd_total((w, np.zeros_like(w)))
                yield pa.RecordBatch.from_arrays([pa.array([size] * len(high), pa.int32()), pa.array(range(len(high)), pa.int32()), pa.array(high), pa.array(low)], names=["size", "k", "high", "low"])

    sums = white.select("size", "white").mapInArrow(run, "size int, k int, high double, low double").groupBy("size", "k").agg(F.sum("high").alias("high"), F.sum("low").alias("low"))
    means = {d: (np.zeros(len(m[3])), np.zeros(len(m[3]))) for d, m in models.items()}
    for r in sums.collect():  # a number for each component of each length
        means[r["size"]][0][r.k] = (r.high + r.low) / models[r["size"]][0]
    errors = {}
    for r in centred_products(white, means, "white").collect():
        n, values = models[r["size"]][0], models[r["size"]][3]
        i, j = np.triu_indices(len(values))
        off = (np.frombuffer(r.high) + np.frombuffer(r.low)) / n - (i == j)
        errors[r["size"]] = float(np.abs(off[(values[i] > 0) & (values[j] > 0)]).max(initial=0.0))
    return errors
