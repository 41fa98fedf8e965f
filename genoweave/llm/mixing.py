"""Mixing sources to target weights with hash-threshold histograms.

Every row has a 48-bit hash. Words are summed by source and hash bucket; the bucket
in which a source's budget runs out is split into buckets again, and only that one,
until the threshold is a single hash. Rows below it are taken. What is left of the
budget goes, under a nested threshold, to later rows small enough for it. Nothing is
sorted but the histogram of a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoweave.llm.text import WORD_CLASS
from genoweave.plans.durable import write_table

WEIGHTS = (1, 2, 3)
#: A source gives at most this many times its size.
MOST_COPIES = 3
HASH_BITS = 48
LEVEL_BITS = 12
PASSES = 3


def row_hash(doc_id: Column) -> Column:
    """48 bits of the MD5 of the id as text (null: empty), as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """``documents`` with __size (its words; null text: 0) and __hash."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD_CLASS)), F.lit(0)).cast("long")
    return documents.withColumn("__size", size).withColumn("__hash", row_hash(F.col("doc_id")))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in order of code point, null last, weigh ``weights`` in turn. They share
    all words by weight; a target stops at ``MOST_COPIES`` times the source's size,
    and what lies above goes to the others by weight. With sources in order of the
    share at which they stop, those that stop are the first ones for which an even
    share of the rest would still be too much; so no loop is needed. The one
    ordered pass is over one row per source.
    """
    totals = sizes.groupBy("source").agg(F.sum("__size").alias("source_size"))
    order = W.partitionBy(F.lit(1)).orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.col("source_size") * MOST_COPIES).withColumn("stop", F.col("cap") / F.col("w"))
    by_stop = W.partitionBy(F.lit(1)).orderBy("stop", F.col("source").isNull(), F.col("source").cast("binary"))
    everything = W.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("cap").over(by_stop.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(by_stop.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(everything)
    stopped = weighed.withColumn("total", total).withColumn("stops", (F.col("total") - before) / after > F.col("stop"))
    free = stopped.withColumn("spent", F.sum(F.when(F.col("stops"), F.col("cap")).otherwise(0)).over(everything)).withColumn(
        "rest_w", F.sum(F.when(F.col("stops"), 0).otherwise(F.col("w"))).over(everything)
    )
    share = (F.col("total") - F.col("spent")) / F.col("rest_w") * F.col("w")
    return free.select("source", "source_size", F.when(F.col("stops"), F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"))


def _same_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    right = right.withColumnRenamed("source", "__source")
    return left.join(right, left["source"].eqNullSafe(right["__source"]), how).drop("__source")


def _threshold(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per source the hash at which ``budget`` runs out and the words left then: source, tau, rest.

    ``rows`` (source, __size, __hash); ``budgets`` (source, budget). tau is 2**48
    where all rows fit. Each level sums the rows of the one bucket that is open.
    """
    state = budgets.select("source", F.lit(0).cast("long").alias("prefix"), F.col("budget").alias("rest"), F.lit(True).alias("open"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = _same_source(rows, state.where("open").select("source", "prefix"))
        inside = inside.where(F.shiftright("__hash", shift + LEVEL_BITS) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("__hash", shift).alias("bucket")).agg(F.sum("__size").alias("words"))
        running = sums.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("bucket")))
        met = _same_source(running, state.select("source", F.col("rest").alias("__rest")))
        found = met.groupBy("source").agg(
            F.min(F.when(F.col("upto") > F.col("__rest"), F.struct("bucket", (F.col("upto") - F.col("words")).alias("used")))).alias("edge"),
            F.max("upto").alias("all"),
        )
        joined = _same_source(state, found, "left")
        state = joined.select(
            "source",
            F.when(F.col("open") & F.col("edge").isNotNull(), F.col("edge.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            (F.col("rest") - F.when(F.col("open"), F.coalesce(F.col("edge.used"), F.col("all"), F.lit(0))).otherwise(0)).alias("rest"),
            (F.col("open") & F.col("edge").isNotNull()).alias("open"),
        )
        state = write_table(state, "thresholds")
    return state.select("source", F.when(F.col("open"), F.col("prefix")).otherwise(F.lit(1 << HASH_BITS)).alias("tau"), "rest")


def plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source_size, target, whole (copies of every row), and nested thresholds.

    ``taus`` and ``rests``: a row gets one copy more if, for some pass p, its hash
    lies after taus[p-1] and before taus[p] and its size is at most rests[p-1].
    """
    out = targets(sizes, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    out = write_table(out.withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")), "targets")
    state = out.select("source", F.array(F.lit(-1).cast("long")).alias("taus"), F.array(F.lit(float("inf"))).alias("rests"), F.col("budget").alias("budget"))
    rows = sizes.select("source", "__size", "__hash").where("__size > 0")
    for _ in range(PASSES):
        last = state.select("source", F.element_at("taus", -1).alias("tau0"), F.element_at("rests", -1).alias("rest0"))
        eligible = _same_source(rows, last).where("__hash > tau0 and __size <= rest0").select("source", "__size", "__hash")
        found = _threshold(eligible, state.select("source", "budget"))
        state = _same_source(state.drop("budget"), found).select(
            "source", F.concat("taus", F.array("tau")).alias("taus"), F.concat("rests", F.array("rest")).alias("rests"), F.col("rest").alias("budget")
        )
        state = write_table(state, "plan")
    return write_table(_same_source(out.drop("budget"), state.select("source", "taus", "rests")), "mix")


def with_copies(sizes: DataFrame, mix: DataFrame) -> DataFrame:
    """Rows with source_size, target and __copies, the times that the mix takes the row."""
    met = _same_source(sizes, mix)
    extra = F.lit(False)
    for p in range(1, PASSES + 1):
        later = F.col("__hash") > F.element_at("taus", p)
        extra = extra | (later & (F.col("__hash") < F.element_at("taus", p + 1)) & (F.col("__size") <= F.element_at("rests", p)))
    return met.withColumn("__copies", F.col("whole") + F.when((F.col("__size") > 0) & extra, 1).otherwise(0)).drop("whole", "taus", "rests")


def mix_sizes(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row: doc_id, size, source_size, target and taken, the words that the mix takes.

    Only ids, sources and sizes are kept and moved. The hash depends on the id
    alone, so reruns agree; rows that share an id are taken together or not at all.
    Empty texts have size 0 and take nothing. Sources compare by code point; null is one.
    """
    sizes = write_table(sized(documents.select("doc_id", "source", "text")).drop("text"), "sizes")
    taken = with_copies(sizes, plan(sizes, weights))
    return taken.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("__copies") * F.col("__size")).alias("taken"))


def mix_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The mix itself: each row as many times as it is taken, with its own columns.

    Rows without words take no room, and stay once.
    """
    columns = documents.columns
    rows = sized(documents.select("doc_id", "source", "text", F.struct("*").alias("__row")))
    sizes = write_table(rows.select("doc_id", "source", "__size", "__hash"), "sizes")
    taken = with_copies(rows.drop("text"), plan(sizes, weights))
    times = F.when(F.col("__size") == 0, 1).otherwise(F.col("__copies")).cast("int")
    repeated = taken.where(times > 0).select("__row", F.explode(F.sequence(F.lit(1), times)).alias("__k"))
    return repeated.select(*(F.col("__row").getField(c).alias(c) for c in columns))


MIX_SQL = f"""
with s as (select doc_id, source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, {HASH_BITS // 4}))::bigint as h from documents),
t as (select source, sum(size)::bigint as source_size from s group by source),
w as (select *, 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3 as w, source_size * 3 as cap from t),
v as (select *, cap / w as stop, sum(source_size) over () as total,
    coalesce(sum(cap) over (order by cap / w, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) as before,
    sum(w) over (order by cap / w, source is null, encode(source) rows between current row and unbounded following) as after from w),
u as (select *, (total - before) / after > stop as stops from v),
g as (select *, sum(case when stops then cap else 0 end) over () as spent, sum(case when stops then 0 else w end) over () as rest_w from u),
p0 as (select source, source_size, case when stops then cap::double else ((total - spent) / rest_w * w)::double end as target from g),
p1 as (select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint as whole from p0),
p2 as (select *, target - whole * source_size as budget from p1),
d0 as (select s.*, p2.source_size, p2.target, p2.whole, p2.budget as b1 from s join p2 on s.source is not distinct from p2.source),
e1 as (select *, sum(size) over (partition by source order by h range unbounded preceding) as r from d0),
f1 as (select *, coalesce(min(case when r > b1 then h end) over (partition by source), {1 << HASH_BITS}) as t1 from e1),
g1 as (select *, b1 - coalesce(sum(case when h < t1 then size end) over (partition by source), 0) as b2 from f1),
e2 as (select *, sum(case when h > t1 and size <= b2 then size else 0 end) over (partition by source order by h range unbounded preceding) as r2 from g1),
f2 as (select *, coalesce(min(case when h > t1 and size <= b2 and r2 > b2 then h end) over (partition by source), {1 << HASH_BITS}) as t2 from e2),
g2 as (select *, b2 - coalesce(sum(case when h > t1 and size <= b2 and h < t2 then size end) over (partition by source), 0) as b3 from f2),
e3 as (select *, sum(case when h > t2 and size <= b3 then size else 0 end) over (partition by source order by h range unbounded preceding) as r3 from g2),
f3 as (select *, coalesce(min(case when h > t2 and size <= b3 and r3 > b3 then h end) over (partition by source), {1 << HASH_BITS}) as t3 from e3)
select doc_id, size, source_size, target,
    size * (whole + case when size > 0 and (h < t1 or h > t1 and h < t2 and size <= b2 or h > t2 and h < t3 and size <= b3) then 1 else 0 end)::bigint as taken
from f3
"""
