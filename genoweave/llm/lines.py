"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

A run is a table (h1, h2, documents), one row per distinct line key of the
documents it covers, bucketed and sorted by hash. Batches of documents come in
descending order of their ids. Each one merge-anti-joins its line hashes against the
runs: what no run has yet is kept by the greatest id of this batch. It then adds its
own run to level 0; when a level holds two runs they are merged into one of the next
level, by a merge join of the sorted tables. In the end the runs say which keys enough documents hold.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from genoweave.llm.text import SPACES
from genoweave.plans.durable import sorted_scans, write_sorted, write_table

#: Code points a key needs, documents it must be found in, and batches.
LEAST_CHARS = 20
LEAST_DOCUMENTS = 3
BATCHES = 6
#: Ids that batches are cut by, and how many of the most frequent keys are looked up without an exchange of their lines.
SAMPLED_IDS = 1000
HOT_KEYS = 1000
#: Hashes to drop of one text above which they are looked up by bucket.
BUCKETS = 1024

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lowered(text: Column) -> Column:
    """A-Z in lower case, other letters as they are; plain ASCII takes the quick way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def line_keys(text: Column) -> Column:
    """The key of each line of the text, in order."""
    return F.transform(F.split(_lowered(F.coalesce(text, F.lit(""))), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)))


def _first_hash(key: Column) -> Column:
    return F.xxhash64(key)


def _second_hash(key: Column) -> Column:
    return F.xxhash64(F.lit("second"), key)


KEYS = ["h1", "h2"]


def batch_lines(batch: DataFrame) -> DataFrame:
    """Rows (h1, h2, doc_id, with ``batch`` if there is such a column): the distinct keys of each document that are long enough."""
    more = ["batch"] if "batch" in batch.columns else []
    keys = F.array_distinct(F.filter(line_keys(F.col("text")), lambda k: F.char_length(k) >= LEAST_CHARS))
    rows = batch.select("doc_id", *more, F.explode(keys).alias("key"))
    return rows.select(_first_hash(F.col("key")).alias("h1"), _second_hash(F.col("key")).alias("h2"), "doc_id", *more)


def run_of(rows: DataFrame, *by: str) -> DataFrame:
    """Of distinct rows (h1, h2, doc_id): how many documents hold each key, and their greatest id."""
    return rows.groupBy(*by, *KEYS).agg(F.count("*").alias("documents"), F.max("doc_id").alias("top"))


@dataclass
class LineRuns:
    """The runs, level by level. All of them are sorted tables in the shared folder."""

    levels: list[list[DataFrame]] = field(default_factory=list)

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def unseen(self, rows: DataFrame) -> DataFrame:
        """The rows whose key (h1, h2) no run has: the merge anti-join."""
        for run in self.runs():
            rows = rows.join(run.hint("merge"), KEYS, "left_anti")
        return rows

    def add(self, run: DataFrame, level: int = 0) -> None:
        """Add a run; compact every level that is full."""
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) == 2:
            full, self.levels[level] = self.levels[level], []
            self.add(compacted(*full), level + 1)

    def merged(self) -> DataFrame:
        """One run of all."""
        return functools.reduce(compacted, self.runs())


def merge(one: DataFrame, two: DataFrame) -> DataFrame:
    """One row per key of two runs, by a merge join."""
    named = two.select(*KEYS, F.col("documents").alias("__n"))
    summed = F.coalesce("documents", F.lit(0)) + F.coalesce("__n", F.lit(0))
    return one.join(named.hint("merge"), KEYS, "full").select(*KEYS, summed.alias("documents"))


def compacted(one: DataFrame, two: DataFrame) -> DataFrame:
    return write_sorted(merge(one, two), KEYS, "run", dealt=True)


def with_batch(documents: DataFrame, batches: int) -> DataFrame:
    """Adds ``batch``, from 0 for the greatest ids on; null ids go with the least ones.

    Cut at ids of a bounded sample by hash: only how even the batches are depends on it.
    """
    sample = documents.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLED_IDS)
    ids = sorted({r.doc_id for r in sample.collect()}, reverse=True)
    cuts = [ids[len(ids) * k // batches] for k in range(1, batches)] if ids else []
    number = F.lit(0)
    for cut in sorted(set(cuts)):
        number = number + F.coalesce(F.col("doc_id") <= F.lit(cut), F.lit(True)).cast("int")
    return documents.withColumn("batch", number)


def build_runs(rows: DataFrame, batches: int = BATCHES) -> tuple[LineRuns, DataFrame]:
    """Runs over distinct rows (h1, h2, doc_id, batch), one batch after another, and (h1, h2, keeper) as the anti-joins gave it."""
    table = write_sorted(run_of(rows, "batch"), KEYS, "batches", by="batch")
    runs, first = LineRuns(), []
    for k in range(batches):
        mine = table.where(F.col("batch") == k).drop("batch")
        first.append(runs.unseen(mine).select(*KEYS, F.col("top").alias("keeper")))
        runs.add(mine.select(*KEYS, "documents"))
    return runs, functools.reduce(DataFrame.unionByName, first)


def dedup_lines(documents: DataFrame, batches: int = BATCHES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Drop shared lines; one row per document: ``keep``, n_lines, n_dropped, kept_text.

    A key of ``LEAST_CHARS`` code points or more that ``LEAST_DOCUMENTS`` ids or more
    hold loses all its lines but in the rows of the greatest doc_id that holds it.
    Rows of one id count as one document, and all rows of the keeping id keep the
    line. Null ids count as one and never keep unless all holders are null. Null and
    empty texts have one empty line, which always stays.
    Only hashes and ids are shuffled by line, and those of the at most ``HOT_KEYS``
    most frequent keys not even once more; texts move once, to meet what they lose.
    """
    spark = documents.sparkSession
    with sorted_scans(spark):
        held = write_table(batch_lines(with_batch(documents.select("doc_id", "text"), batches)).distinct(), "lines")
        runs, keepers = build_runs(held, batches)
        often = runs.merged().where(F.col("documents") >= LEAST_DOCUMENTS).select(*KEYS, "documents")
        shared = write_sorted(keepers.join(often.hint("merge"), KEYS), KEYS, "shared", dealt=True)
        # a key that one row in HOT_KEYS has; there can't be more of them than that
        hot = shared.where(F.col("documents") * HOT_KEYS >= F.lit(held.count())).select(*KEYS, "keeper")
        rest = held.join(F.broadcast(hot.select(*KEYS)), KEYS, "left_anti").join(shared.select(*KEYS, "keeper").hint("merge"), KEYS)
        lost = held.join(F.broadcast(hot), KEYS).unionByName(rest).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        lost = write_table(lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEYS)).alias("__lost")).withColumnRenamed("doc_id", "__lost_id"), "lost")
    # Many hashes are dealt into buckets here, below the join, so that it happens once a document and not once a line.
    buckets = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.filter("__lost", lambda d: F.pmod(d["h1"], F.lit(BUCKETS)) == b))
    lost = lost.withColumn("__dealt", F.when(F.size("__lost") > BUCKETS, buckets))
    kept = documents.select(*keep, F.col("doc_id").alias("__id"), F.col("text").alias("__text"))
    met = kept.join(lost, F.col("__id").eqNullSafe(F.col("__lost_id")), "left")
    text = F.coalesce(F.col("__text"), F.lit(""))

    def goes(line: Column) -> Column:
        key = line["key"]
        pair = F.struct(_first_hash(key).alias("h1"), _second_hash(key).alias("h2"))
        bucket = F.element_at(F.col("__dealt"), (F.pmod(_first_hash(key), F.lit(BUCKETS)) + 1).cast("int"))
        among = F.when(F.col("__dealt").isNotNull(), F.array_contains(bucket, pair)).otherwise(F.array_contains(F.col("__lost"), pair))
        return F.when(F.char_length(key) >= LEAST_CHARS, among).otherwise(F.lit(False))

    lines = F.split(text, "\n", -1)
    paired = F.transform(lines, lambda x: F.struct(x.alias("line"), F.btrim(_lowered(x), F.lit(SPACES)).alias("key")))
    left = F.transform(F.filter(paired, lambda x: ~goes(x)), lambda x: x["line"])
    out = met.withColumn("__lines", F.size(lines)).withColumn("__left", F.when(F.col("__lost").isNotNull(), left))
    return out.select(
        *keep,
        F.col("__lines").cast("long").alias("n_lines"),
        F.when(F.col("__lost").isNull(), 0).otherwise(F.col("__lines") - F.size("__left")).cast("long").alias("n_dropped"),
        F.when(F.col("__lost").isNull(), text).otherwise(F.array_join("__left", "\n")).alias("kept_text"),
    )
