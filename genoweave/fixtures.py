"""PSL-shaped rows, genes and sequences projected from the TPC-H-like tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEQUENCE = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def psl_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alignment per (order, line number) of all of ``lineitem``; line 7 gets a block of size 0 as well."""
    raw = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min("l_partkey").alias("p"),
        F.min("l_suppkey").alias("s"),
        F.min("l_quantity").cast("int").alias("q"),
        F.round(F.min("l_discount") * 100).cast("int").alias("d"),
        F.min(F.when(F.col("l_returnflag") == "R", 1).otherwise(0)).alias("r"),  # a number, so that rows are hashed and not sorted
    )
    line, order = F.col("l_linenumber"), F.col("l_orderkey")
    rows = raw.select(
        (order * 8 + line).cast("bigint").alias("aln_id"),
        (1000 - 30 * F.col("d")).alias("matches"),
        (30 * F.col("d")).alias("mismatches"),
        F.lit(0).alias("rep_matches"),
        F.when(F.col("r") == 1, "-").otherwise("+").alias("strand"),
        F.concat(F.lit("S"), F.expr("l_orderkey div 10")).alias("q_name"),
        F.concat(F.lit("S"), F.expr("(p * 3) div 4")).alias("t_name"),
        F.lit(SEQUENCE).cast("bigint").alias("q_size"),
        F.lit(SEQUENCE).cast("bigint").alias("t_size"),
        (1 + line % 3).alias("n"),
        (600 + 100 * (line % 4)).cast("bigint").alias("bs"),
        (F.col("q") % 20).cast("bigint").alias("gap"),
        (1000 * (F.col("p") * 7 % 190) + 20 * (F.col("s") % 3)).cast("bigint").alias("t0"),
        (1000 * (order * 3 % 190) + 20 * (line % 3)).cast("bigint").alias("q0"),
        (line == 7).alias("zero"),
    )
    # sequences and repeats, which Spark compiles; functions of list members it doesn't
    step = F.col("bs") + F.col("gap")
    reach = (F.col("n") - 1) * step
    even = lambda first: F.coalesce(F.sequence(first, first + reach, step), F.array_repeat(F.lit(None).cast("bigint"), F.col("n")))
    sizes = F.array_repeat(F.col("bs").cast("int"), F.col("n"))
    t = even(F.col("t0"))
    q = even(F.when(F.col("strand") == "+", F.col("q0")).otherwise(SEQUENCE - (F.col("q0") + reach + F.col("bs"))))
    more = lambda array, last: F.when(F.col("zero"), F.concat(array, F.array(last))).otherwise(array)
    return rows.select(
        "aln_id", "matches", "mismatches", "rep_matches", "strand", "q_name", "q_size", "t_name", "t_size",
        (F.col("n") + F.col("zero").cast("int")).alias("block_count"),
        more(sizes, F.lit(0)).alias("block_sizes"),
        more(q, F.when(F.col("strand") == "+", F.col("q0") + F.col("n") * step).otherwise(SEQUENCE - F.col("q0"))).alias("q_starts"),
        more(t, F.col("t0") + F.col("n") * step).alias("t_starts"),
    )


def psl_lines(rows: DataFrame) -> DataFrame:
    """The rows as PSL text, one line each, in order of aln_id."""
    listed = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), F.lit(","))
    zero = F.lit("0")
    fields = [
        "matches", "mismatches", "rep_matches", zero, zero, zero, zero, zero, "strand", "q_name", "q_size", zero, "q_size", "t_name", "t_size", zero, "t_size", "block_count",
        listed("block_sizes"), listed("q_starts"), listed("t_starts"),
    ]
    text = F.concat_ws("\t", *(F.col(f).cast("string") if isinstance(f, str) else f for f in fields))
    return rows.select(F.lit(0).alias("file_no"), F.col("aln_id").alias("line_no"), text.alias("value"))


def gene_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, genome, locus, seq: the A, C, G and T of every whole text, twenty texts a genome."""
    sign = F.when(F.col("doc_id") % 3 == 0, -1).otherwise(1)
    seq = F.regexp_replace(F.upper(F.coalesce("text", F.lit(""))), "[^ACGT]", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.expr("doc_id div 20").alias("genome"), (sign * (F.col("doc_id") + 1)).alias("locus"), seq.alias("seq"))


def homology_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(g1, g2, gene, others): genes (supplier % 5, part) of two lines next to each other in an order."""
    w = "over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey)"
    rows = table(spark, sf_dir, "lineitem").selectExpr(
        "cast(l_suppkey % 5 as int) as g", "cast(l_partkey as int) as x", f"lead(cast(l_suppkey % 5 as int)) {w} as h", f"lead(cast(l_partkey as int)) {w} as y"
    )
    turned = rows.where("h is not null").selectExpr("least(g, h) as g1", "case when g <= h then x else y end as gene", "greatest(g, h) as g2", "case when g <= h then y else x end as other")
    return turned.groupBy("g1", "g2", "gene").agg(F.collect_list(F.col("other") + 1).alias("others"))


def simulated_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """genome, place, strand, length, pos, class_nr: the parts as genes in five genomes, of 97 families."""
    part = table(spark, sf_dir, "part")
    return part.select(
        F.expr("cast(p_partkey % 5 as int)").alias("genome"),
        F.col("p_partkey").alias("place"),
        F.when(F.col("p_size") % 2 == 0, 1).otherwise(-1).alias("strand"),
        (F.col("p_size") * 10).cast("bigint").alias("length"),
        F.col("p_partkey").alias("pos"),
        (F.col("p_partkey") * 7 % 97).cast("bigint").alias("class_nr"),
    )
