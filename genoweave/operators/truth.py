"""Ground truth of simulated genomes: homology classes, merged families, segments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from genoweave.operators.components import connected_components
from genoweave.operators.ordered import running_sum
from genoweave.plans.durable import write_table

GENES = 1 << 32


def homology_edges(rows: DataFrame) -> DataFrame:
    """Distinct (g1, x, g2, y), genes from 0, of matrix rows (g1, g2, gene, others) with g2 at or after g1."""
    return rows.where("g2 >= g1").select("g1", F.col("gene").alias("x"), "g2", F.explode(F.transform("others", lambda y: y - 1)).alias("y")).distinct()


def homology_classes(edges: DataFrame) -> DataFrame:
    """genome, gene, class_nr: components of linked genes, numbered from 0 by their least (genome, gene)."""
    ends = edges.select((F.col("g1") * F.lit(GENES) + F.col("x")).alias("a"), (F.col("g2") * F.lit(GENES) + F.col("y")).alias("b"))
    found = connected_components(ends, "a", "b")
    alone = ends.where("a = b").select(F.col("a").alias("node"), F.col("a").alias("component")).distinct().join(found.select("node"), "node", "left_anti")
    found = found.unionByName(alone)
    roots = running_sum(found.where("node = component").select("component"), F.lit(1), ["component"], "n").select("component", (F.col("n") - 1).alias("class_nr"))
    return found.join(roots, "component").select(F.expr(f"node div {GENES}").cast("int").alias("genome"), (F.col("node") % GENES).cast("int").alias("gene"), "class_nr")


def right_neighbours(genes: DataFrame) -> DataFrame:
    """class_nr, n_neighbours, n_ends: distinct (class, orientation) to the right of its genes, read along their strand, and genes at an end.

    ``genes``: genome, place (order in the genome), strand (1 or -1), class_nr.
    """
    w = W.partitionBy("genome").orderBy("place")
    both = genes.withColumn("n", F.lead(F.struct("class_nr", "strand")).over(w)).withColumn("p", F.lag(F.struct("class_nr", "strand")).over(w))
    side = both.select("class_nr", F.when(F.col("strand") > 0, F.col("n")).otherwise(F.col("p")).alias("side")).where("class_nr is not null")
    return side.groupBy("class_nr").agg(F.countDistinct("side").alias("n_neighbours"), F.count_if(F.col("side").isNull()).alias("n_ends"))


def _beside(slots: DataFrame, *columns: str) -> DataFrame:
    """Rows (genome, near, and ``n_`` columns) to find what lies at a slot next to another of the same genome."""
    return slots.select("genome", F.col("slot").alias("near"), *(F.col(c).alias(f"n_{c}") for c in columns))


def _blocks(slots: DataFrame) -> DataFrame:
    """Adds ``block``: stretches of slots of one genome whose runs have one class."""
    before = slots.select(F.col("slot") + 1, F.struct("genome", "class_nr")).toDF("slot", "b")
    joined = slots.join(before, "slot", "left")
    change = F.when(F.struct("genome", "class_nr").eqNullSafe(F.col("b")), 0).otherwise(1)
    return running_sum(joined, change, ["slot"], "block").drop("b")


def merge_families(genes: DataFrame) -> DataFrame:
    """Contract families that always stand before one and the same neighbour.

    ``genes``: genome, place, strand (1 or -1), length, pos, class_nr (null: in no
    family). Families take their turns in ascending order. At its turn a family whose
    members all have the same neighbour (class and strand), read along the strand of
    the run each lies in, is merged with it: the two runs become one with class and
    strand of the left one, lengths add up, and positions follow in the member's
    reading order. Runs of the right one's class that directly follow it count as it.
    A member at an end, or whose neighbour is in its own run, rules its family out.

    A turn only depends on, and changes, the blocks of equal class around the members.
    So a round on Spark decides every family that no earlier undecided one shares a
    block with; families before the first that can merge are decided as they are, and
    when none can merge all are. Returns genome, place, strand, length, positions
    (array), class_nr for every gene: those of one run carry the same values.
    """
    keyed = genes.withColumn("at", F.col("genome").cast("bigint") * GENES + F.col("place"))
    slots = running_sum(keyed, F.lit(1), ["at"], "slot").select(
        "genome", "place", "slot", F.col("class_nr").alias("family"), F.col("slot").alias("run"), "class_nr", F.col("strand").cast("int").alias("strand"), F.col("length").cast("bigint").alias("length"), F.array("pos").alias("positions")
    )
    slots = write_table(_blocks(slots), "slots")
    waiting = write_table(slots.where("family is not null").select("family").distinct(), "families")
    while True:
        members = slots.join(waiting, "family").withColumn("near", F.col("slot") + F.col("strand"))
        met = members.join(_beside(slots, "class_nr", "strand", "run"), ["genome", "near"], "left").withColumn("n", F.when(F.col("n_run").isNotNull(), F.struct("n_class_nr", "n_strand")))
        met = write_table(met.select("family", "genome", "slot", "strand", "run", "n_run", "n"), "members")
        ready = met.groupBy("family").agg((F.countDistinct("n") == 1).alias("one"), F.bool_and(F.coalesce(F.col("run") != F.col("n_run"), F.lit(False))).alias("whole"))
        ready = write_table(ready.select("family", (F.col("one") & F.col("whole")).alias("merges")), "ready")
        first = ready.where("merges").agg(F.min("family").alias("f")).first().f
        if first is None:
            return slots.select("genome", "place", "strand", "length", "positions", F.col("class_nr").cast("double").alias("class_nr"))
        later = met.where(F.col("family") >= first).select("family", "genome", F.explode(F.array(F.col("slot") - 1, F.col("slot"), F.col("slot") + 1)).alias("near"))
        zones = later.join(_beside(slots, "block"), ["genome", "near"]).select("family", F.col("n_block").alias("block")).distinct()
        least = zones.groupBy("block").agg(F.min("family").alias("least"))
        decided = write_table(zones.join(least, "block").groupBy("family").agg(F.bool_and(F.col("family") == F.col("least")).alias("turn")).where("turn").select("family"), "decided")
        links = met.join(decided, "family", "left_semi").join(ready.where("merges"), "family", "left_semi")
        links = links.select(F.least("run", "n_run").alias("left"), F.greatest("run", "n_run").alias("right"), "strand")
        slots = write_table(_blocks(_contracted(slots, write_table(links, "links"))), "slots")
        waiting = write_table(waiting.where(F.col("family") >= first).join(decided, "family", "left_anti"), "families")


def _contracted(slots: DataFrame, links: DataFrame) -> DataFrame:
    """Slots after the runs that links (left, right, strand of the member) join have become one, links of a chain from left to right."""
    rooted = links.withColumn("root", F.col("left"))
    while True:  # a chain of k links takes log k turns
        ups = rooted.select(F.col("right").alias("root"), F.col("root").alias("up"))
        joined = rooted.join(ups, "root", "left")
        if joined.where("up is not null").isEmpty():
            break
        rooted = write_table(joined.select("left", "right", "strand", F.coalesce("up", "root").alias("root")), "chains")
    runs = slots.groupBy("run").agg(F.first("class_nr").alias("class_nr"), F.first("strand").alias("strand"), F.first("length").alias("length"), F.first("positions").alias("positions"), F.max("slot").alias("end"), F.first("block").alias("block"))
    steps = rooted.join(runs.select(F.col("run").alias("right"), "length", "positions", "end", "block"), "right")
    chain = F.sort_array(F.collect_list(F.struct("right", F.col("strand").alias("ahead"), "length", "positions")))
    joins = steps.groupBy(F.col("root").alias("run")).agg(chain.alias("chain")).join(runs, "run")
    total = F.aggregate("chain", F.col("length"), lambda n, x: n + x["length"])
    order = F.aggregate("chain", F.col("positions"), lambda p, x: F.when(x["ahead"] > 0, F.concat(p, x["positions"])).otherwise(F.concat(x["positions"], p)))
    made = joins.select(F.col("run").alias("root"), F.col("class_nr").alias("c"), F.col("strand").alias("s"), total.alias("l"), order.alias("p"))
    # a linked run takes with it what follows in its block, up to the next linked one
    own = slots.join(rooted.select(F.col("right").alias("run"), "root"), "run", "left").join(made.select(F.col("root").alias("run"), F.lit(True).alias("is_root")), "run", "left")
    after = steps.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("right", "root"))).alias("linked"))
    own = own.join(after, "block", "left")
    target = F.coalesce("root", F.when(F.col("is_root"), F.col("run")), F.try_element_at(F.transform(F.filter("linked", lambda x: x["right"] <= F.col("run")), lambda x: x["root"]), F.lit(-1)))
    placed = own.withColumn("target", target).drop("root", "is_root", "linked").join(made, F.col("target") == F.col("root"), "left")
    is_new = F.col("target").isNotNull()
    pick = lambda new, old: F.when(is_new, F.col(new)).otherwise(F.col(old)).alias(old)
    return placed.select("genome", "place", "slot", "family", F.coalesce("target", "run").alias("run"), pick("c", "class_nr"), pick("s", "strand"), pick("l", "length"), pick("p", "positions"))


def segment_truth(genes: DataFrame) -> DataFrame:
    """genome, start (from 1), end, strand, family, pos_in_fasta: segments along each genome, equal neighbours once."""
    w = W.partitionBy("genome").orderBy("place")
    mark = F.struct("strand", "length", "positions", "class_nr")
    kept = genes.withColumn("__same", F.coalesce(mark.eqNullSafe(F.lag(mark).over(w)), F.lit(False))).where("not __same")
    upto = F.sum("length").over(w.rowsBetween(W.unboundedPreceding, 0))
    return kept.withColumn("__end", upto).select(
        "genome",
        (F.col("__end") - F.col("length") + 1).alias("start"),
        F.col("__end").alias("end"),
        F.when(F.col("strand") < 0, "-").otherwise("+").alias("strand"),
        F.col("class_nr").cast("long").alias("family"),
        F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("pos_in_fasta"),
    )
