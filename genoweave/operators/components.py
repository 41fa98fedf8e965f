"""Connected components of an undirected edge list, by contraction in rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.plans.durable import drop_tables, write_counted, write_table

#: Links up to which one task settles what is left, in place of many rounds over few rows.
LINKS_AT_ONCE = 1 << 18


def _order(node: Column, k: int) -> Column:
    """A node's place in the order of round ``k``, which no other round shares."""
    return F.xxhash64(node, F.lit(k))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 100, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """Rows (node, component) for every node that has an edge; component is the least node.

    In a round every node goes over to the first one, in the round's own random order,
    among itself and its neighbours, and edges follow their ends. Each round leaves at
    most about two thirds of the nodes and only edges between different ones, so rounds
    grow with the logarithm of the nodes and their work shrinks; one task settles the
    last ``at_once`` links. What went over to what
    is then put together from the last round back. Null ends and self links are ignored,
    and repeated edges count once. A node without a link to another has no row.
    Raises when the rounds run out, so a partial labelling is never returned.
    """
    a, b = F.col(left), F.col(right)
    ends = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    current, counted = write_counted(ends.distinct(), "links", n=F.count(F.lit(1)))
    moves: list[DataFrame] = []
    for k in range(max_rounds):
        if counted["n"] <= at_once:
            if counted["n"]:
                moves.append(write_table(current.coalesce(1).mapInArrow(_settled, "node long, at long"), "moves"))
            return _put_together(moves, current)
        both = current.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        near = both.groupBy("a").agg(F.min_by("b", _order(F.col("b"), k)).alias("b"))
        ahead = _order(F.col("b"), k) < _order(F.col("a"), k)
        moved = write_table(near.select(F.col("a").alias("node"), F.when(ahead, F.col("b")).otherwise(F.col("a")).alias("at")), "moves")
        moves.append(moved)
        once = current.join(moved.select(F.col("node").alias("a"), F.col("at").alias("x")), "a")
        twice = once.join(moved.select(F.col("node").alias("b"), F.col("at").alias("y")), "b").where("x <> y")
        later, counted = write_counted(twice.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links", n=F.count(F.lit(1)))
        drop_tables(current)
        current = later
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, at) from links (a, b): ``at`` is the least node that links lead to."""
    least: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := least.setdefault(x, x)) != x:
            least[x] = x = least[up]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            least[max(a, b)] = min(a, b)
    nodes = list(least)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], names=["node", "at"])


def _put_together(moves: list[DataFrame], none: DataFrame) -> DataFrame:
    """Rows (node, component) of what each round's nodes went over to."""
    if not moves:
        return none.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = moves[-1]
    for moved in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("at"), F.col("at").alias("__last"))
        out = moved.join(later, "at", "left").select("node", F.coalesce("__last", "at").alias("at"))
        found = write_table(out, "reached")
    drop_tables(*moves[:-1])
    least = found.groupBy("at").agg(F.min("node").alias("component"))
    return found.join(least, "at").select("node", "component")
