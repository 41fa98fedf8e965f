"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.llm import lines, mixing, quality, simhash, subwords
from genoweave.llm.queries import model_path, table
from genoweave.plans.durable import write_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned list reject go."""
    rules = quality.learn_from(docs, table(spark, sf_dir, "labels"))
    judged = quality.judge(docs.select("text", F.struct("*").alias("__row")), rules, keep=("__row",))
    return judged.where("kept").select(*(F.col("__row").getField(c).alias(c) for c in docs.columns))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go from all documents but one; n_chars follows the text."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    held = docs.select("doc_id", "text", F.struct(*others).alias("__row"))
    clean = lines.dedup_lines(held, keep=("__row",))
    out = {"text": F.col("kept_text"), "n_chars": F.char_length("kept_text").cast("long")}
    return clean.select(*((out[c] if c in out else F.col("__row").getField(c)).alias(c) for c in docs.columns))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row stays, that of least id (null ids last); texts without words are one group."""
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights; a document taken several times is there as many times."""
    return mixing.mix_documents(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document left."""
    return subwords.token_digests(docs, model_path())


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("sentencepiece", token_stage),
]

#: No SQL: the learned rules, the fingerprints and the tokens can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = write_table(docs, f"stage-{k}")
    return docs
