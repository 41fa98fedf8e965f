"""Column functions on block lists (size, q, t) and intervals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def zip_blocks(sizes: str, q_starts: str, t_starts: str, made: Callable[[dict[str, Column]], Column]) -> Column:
    """What ``made`` makes of each size, q and t of three parallel arrays, as an array."""
    return F.transform(
        F.arrays_zip(F.col(sizes).alias("a"), F.col(q_starts).alias("b"), F.col(t_starts).alias("c")),
        lambda x: made({"size": x["a"].cast("bigint"), "q": x["b"].cast("bigint"), "t": x["c"].cast("bigint")}),
    )


def global_block(block: dict[str, Column], strand: Column, q_size: Column, q_offset: Column, t_offset: Column) -> Column:
    """The block in concatenated positions; on the other strand q becomes the block's exclusive forward end."""
    q = F.when(strand == "+", block["q"] + q_offset).otherwise(q_size - block["q"] + q_offset)
    return F.struct(block["size"].alias("size"), q.alias("q"), (block["t"] + t_offset).alias("t"))


def cut_places(blocks: Column, strand: Column, max_gap: int) -> Column:
    """0, how many blocks lie before each gap that is negative or above ``max_gap`` on either side, and how many there are."""
    n = F.size(blocks)
    places = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))

    def cut(i: Column) -> Column:
        a, b = F.element_at(blocks, i), F.element_at(blocks, i + 1)
        t_gap = b["t"] - (a["t"] + a["size"])
        q_gap = F.when(strand == "+", b["q"] - (a["q"] + a["size"])).otherwise(a["q"] - (b["q"] + a["size"]))
        return (t_gap < 0) | (t_gap > max_gap) | (q_gap < 0) | (q_gap > max_gap)

    return F.concat(F.array(F.lit(0)), F.filter(places, cut), F.array(n))


def mirrored_blocks(blocks: Column, strand: Column) -> Column:
    """Blocks with query and target swapped; on the other strand in reverse order, q again the exclusive end."""
    plain = F.transform(blocks, lambda b: F.struct(b["size"].alias("size"), b["t"].alias("q"), b["q"].alias("t")))
    turned = F.reverse(F.transform(blocks, lambda b: F.struct(b["size"].alias("size"), (b["t"] + b["size"]).alias("q"), (b["q"] - b["size"]).alias("t"))))
    return F.when(strand == "+", plain).otherwise(turned)


def lift(position: Column, blocks: Column, strand: Column) -> Column:
    """Target position to query position: within the last block that starts at or before it, gaps and ends snap to the block's."""
    at = F.greatest(F.size(F.filter(blocks, lambda b: b["t"] <= position)), F.lit(1))


    def within(block: Column) -> Column:
        far = F.least(F.greatest(position - block["t"], F.lit(0)), block["size"])
        return F.when(strand == "+", block["q"] + far).otherwise(block["q"] - far)

    return F.element_at(F.transform(F.array(F.element_at(blocks, at)), within), 1)  # the block is looked up once


def coverage(first: Column, last: Column, start: Column, end: Column) -> Column:
    """Share of [first, last] within [start, end], in single precision; negative when they lie apart."""
    over = (F.least(last, end) - F.greatest(first, start)).cast("float")
    return (over / F.greatest(last - first, F.lit(1)).cast("float")).cast("float")
