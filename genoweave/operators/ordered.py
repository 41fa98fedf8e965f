"""Running values over one long order, without bringing all rows into one task.

Positions are cut into chunks. A window runs within each chunk; what earlier chunks
hand on comes from a window over one row per chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

CHUNK = 1 << 20


def _chunked(rows: DataFrame, order: list[str], chunk: int) -> tuple[DataFrame, W]:
    out = rows if "__chunk" in rows.columns else rows.withColumn("__chunk", F.floor(F.col(order[0]) / chunk).cast("bigint"))
    return out, W.partitionBy("__chunk").orderBy(*order)


def counted(rows: DataFrame, order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """The distinct values of ``order``, how often each occurs (``name``), and __chunk, by which they are dealt: the passes below move them no more."""
    cut = rows.select(order, F.floor(F.col(order) / chunk).cast("bigint").alias("__chunk")).repartition("__chunk")
    return cut.groupBy("__chunk", order).agg(F.count("*").alias(name))


def _carried(rows: DataFrame, value: Column) -> DataFrame:
    return rows.groupBy("__chunk").agg(value.alias("__v"))


def max_before(rows: DataFrame, value: str, order: list[str], name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the greatest ``value`` of all rows before this one in ``order`` (null for the first)."""
    cut, w = _chunked(rows, order, chunk)
    before = W.partitionBy(F.lit(1)).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = _carried(cut, F.max(value)).select(F.col("__chunk").alias("__c"), F.max("__v").over(before).alias("__from"))
    local = cut.withColumn("__local", F.max(value).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return local.join(carried, F.col("__chunk") == F.col("__c")).withColumn(name, F.greatest("__local", "__from")).drop("__chunk", "__c", "__from", "__local")


def last_before(rows: DataFrame, value: str, order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the last ``value`` that isn't null of all rows before this one in ``order`` (null where there is none)."""
    cut, w = rows.withColumn("__sect", F.floor(F.col(order) / chunk).cast("bigint")), W.partitionBy("__sect").orderBy(order)
    before = W.partitionBy(F.lit(1)).orderBy("__sect").rowsBetween(W.unboundedPreceding, -1)
    carried = cut.groupBy("__sect").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("__v")).select(F.col("__sect").alias("__c"), F.last("__v", ignorenulls=True).over(before).alias("__earlier"))
    local = cut.withColumn("__local", F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)))
    return local.join(carried, F.col("__sect") == F.col("__c")).withColumn(name, F.coalesce("__local", "__earlier")).drop("__sect", "__c", "__earlier", "__local")


def running_sums(rows: DataFrame, sums: dict[str, Column], order: list[str], chunk: int = CHUNK) -> DataFrame:
    """Adds for each name of ``sums`` the sum of its column up to and with this row, all in one pass."""
    cut, w = _chunked(rows.withColumns({f"__x{k}": v.cast("bigint") for k, v in enumerate(sums.values())}), order, chunk)
    before = W.partitionBy(F.lit(1)).orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1)
    totals = cut.groupBy("__chunk").agg(*(F.sum(f"__x{k}").alias(f"__v{k}") for k in range(len(sums))))
    carried = totals.select(F.col("__chunk").alias("__c"), *(F.coalesce(F.sum(f"__v{k}").over(before), F.lit(0)).alias(f"__from{k}") for k in range(len(sums))))
    here = w.rowsBetween(W.unboundedPreceding, 0)
    local = cut.withColumns({f"__local{k}": F.sum(f"__x{k}").over(here) for k in range(len(sums))})
    out = local.join(carried, F.col("__chunk") == F.col("__c")).withColumns({name: F.col(f"__local{k}") + F.col(f"__from{k}") for k, name in enumerate(sums)})
    return out.drop("__chunk", "__c", *(f"__{c}{k}" for c in ("x", "local", "from") for k in range(len(sums))))


def running_sum(rows: DataFrame, value: Column, order: list[str], name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and with this row."""
    return running_sums(rows, {name: value}, order, chunk)


def next_value(rows: DataFrame, value: str, order: list[str], name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``name``: ``value`` of the next row in ``order`` (null for the last)."""
    cut, w = _chunked(rows, order, chunk)
    later = W.partitionBy(F.lit(1)).orderBy("__chunk")
    carried = _carried(cut, F.min_by(value, F.struct(*order) if len(order) > 1 else order[0])).select(F.col("__chunk").alias("__c"), F.lead("__v").over(later).alias("__from"))
    local = cut.withColumn("__local", F.lead(value).over(w))
    # left, though every chunk is there: a filter on nulls would keep both sides from sharing an exchange
    return local.join(carried, F.col("__chunk") == F.col("__c"), "left").withColumn(name, F.coalesce("__local", "__from")).drop("__chunk", "__c", "__from", "__local")


def numbered_next(rows: DataFrame, value: str, order: str, number: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """Adds ``number`` (place in the order, from 0) and ``name`` (``value`` of the next row, null for the last) in one pass."""
    cut, w = _chunked(rows, [order], chunk)
    by = W.partitionBy(F.lit(1)).orderBy("__chunk")
    sums = cut.groupBy("__chunk").agg(F.count("*").alias("__n"), F.min_by(F.struct(F.col(value).alias("v")), order).alias("__v"))
    before = F.coalesce(F.sum("__n").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select(F.col("__chunk").alias("__c"), before.alias("__before"), F.lead("__v").over(by).alias("__later"))
    local = cut.withColumn("__k", F.row_number().over(w) - 1).withColumn("__next", F.lead(F.struct(F.col(value).alias("v"))).over(w))
    out = local.join(carried, F.col("__chunk") == F.col("__c"))
    out = out.withColumn(number, F.col("__k") + F.col("__before")).withColumn(name, F.coalesce("__next", "__later")["v"])
    return out.drop("__chunk", "__c", "__before", "__later", "__k", "__next")
