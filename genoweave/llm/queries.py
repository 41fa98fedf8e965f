"""The queries of this subpackage: (session, folder of tables) to a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from genoweave.llm import ann, html, lines, mixing, ppm, preference, quality, simhash, spelling, subwords, suffixes, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = toxicity.held_out()
    model = toxicity.train(documents.where(~held), labels.where(~held))
    scored = toxicity.score(documents, model)
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted", "n_passages", "first_word", "last_word")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    rules = quality.learn_from(documents, table(spark, sf_dir, "labels"))
    return quality.judge(documents, rules).select("doc_id", *quality.COUNTS, "base_failed", "rule", "kept")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(table(spark, sf_dir, "documents"))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subwords.token_digests(table(spark, sf_dir, "documents"), model_path())


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preference.preference_report(table(spark, sf_dir, "conversations"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_documents(table(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search_every(table(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.decontamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


LINE_SQL = r"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
l as (select r, doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from d),
m as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, max(doc_id) as keeper from m where length(key) >= 20 group by key having count(distinct doc_id) + max((doc_id is null)::int) >= 3),
j as (select m.*, s.key is not null and m.doc_id is distinct from s.keeper as goes from m left join s on m.key = s.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (goes)::bigint as n_dropped,
    sha256(coalesce(string_agg(line, chr(10) order by k) filter (not goes), '')) as kept_sha256
from j group by r, doc_id
"""

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_quality_rules": op2_quality_rules,
    "op3_mixing": op3_mixing,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_html_extraction": op5_html_extraction,
    "op6_line_dedup": op6_line_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_simhash": op8_simhash,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_neighbours": op10_neighbours,
    "op11_decontamination": op11_decontamination,
    "op12_spelling": op12_spelling,
    "op13_whitening": op13_whitening,
}

ORACLES = {"op3_mixing": mixing.MIX_SQL, "op6_line_dedup": LINE_SQL, "op7_chat_formatting": preference.PREFERENCE_SQL, "op11_decontamination": suffixes.REPORT_SQL}
