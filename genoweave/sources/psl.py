"""PSL text: scans in file and line order, list files, reports on lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The 21 columns of a PSL line, in order.
COLUMNS = (
    "matches mismatches rep_matches n_count q_num_insert q_base_insert t_num_insert t_base_insert strand "
    "q_name q_size q_start q_end t_name t_size t_start t_end block_count block_sizes q_starts t_starts"
).split()
_INTS = {"matches", "mismatches", "rep_matches", "n_count", "q_num_insert", "q_base_insert", "t_num_insert", "t_base_insert", "block_count"}
_LONGS = {"q_size", "q_start", "q_end", "t_size", "t_start", "t_end"}


def paths_in(spark: SparkSession, list_file: str) -> list[str]:
    """Paths of a list file, one a line, blank lines passed over."""
    return [r.value for r in spark.read.text(list_file).where("value <> ''").collect()]


def _checked(field: Column, kind: str, name: str) -> Column:
    """The field as a number; one that is missing, no number or too large stops the job."""
    wrong = F.raise_error(F.concat(F.lit(f"{name} is not of type {kind}: "), F.coalesce(field, F.lit("(missing)"))))
    number = field.try_cast(kind)
    return F.when(number.isNull(), wrong).otherwise(number)


def _numbers(text: Column, kind: str, name: str) -> Column:
    return F.transform(F.filter(F.split(text, ","), lambda x: x != ""), lambda x: _checked(x, kind, name))


def _qualified(spark: SparkSession, path: str) -> str:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return _one_slash(place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toUri().toString())


def _one_slash(uri: str) -> str:
    """Local files have one slash or three, as the writer likes."""
    return re.sub(r"^file:/+", "file:/", uri)


def _block_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines of all files in one scan: file_no, file_block_start, ``__at`` (rising within a block) and value.

    Files are numbered in the order of ``paths``; one listed twice counts twice.
    """
    named = spark.createDataFrame([(k, p, _qualified(spark, p)) for k, p in enumerate(paths)], "file_no int, file string, __uri string")
    lines = spark.read.text(sorted(set(paths))).select("value", F.regexp_replace("_metadata.file_path", "^file:/+", "file:/").alias("__uri"), F.col("_metadata.file_block_start").alias("__start"), F.monotonically_increasing_id().alias("__at"))
    return lines.join(F.broadcast(named), "__uri").drop("__uri")


def numbered_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Lines with file_no (order of ``paths``) and line_no (from 1): their place in their block of the file, after the lines of the blocks before."""
    lines = _block_lines(spark, paths)
    block = W.partitionBy("file_no", "__start")
    counts = lines.groupBy("file_no", "__start").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.partitionBy("file_no").orderBy("__start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = counts.select("file_no", "__start", before.alias("__before"))
    local = lines.withColumn("__k", F.row_number().over(block.orderBy("__at")))
    return local.join(before, ["file_no", "__start"]).select("value", (F.col("__k") + F.col("__before")).cast("bigint").alias("line_no"), "file_no", "file")


def parse_lines(lines: DataFrame, skip: str = "leading_hash") -> DataFrame:
    """PSL rows of (file_no, line_no, value): typed columns, three arrays of block_count numbers, and aln_id in input order.

    ``skip`` says which lines aren't rows: empty ones and those that begin with '#',
    or, as 'contains_##', those that hold '##' anywhere (fields then part at any
    white space). A field that isn't a number of its type stops the job.
    """
    if skip == "contains_##":
        kept = lines.where(~F.col("value").contains("##") & (F.trim("value") != ""))
        fields = F.split(F.trim("value"), r"\s+")
    else:
        kept = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
        fields = F.split("value", "\t")
    kept = kept.withColumn("__f", fields)
    blocks = _checked(F.get("__f", F.lit(17)), "int", "block_count")
    out = []
    for k, name in enumerate(COLUMNS):
        field = F.get("__f", F.lit(k))
        if name in _INTS:
            field = _checked(field, "int", name)
        elif name in _LONGS:
            field = _checked(field, "bigint", name)
        elif name == "strand":
            field = F.substring(field, 1, 1)
        elif name == "block_sizes":
            field = F.slice(_numbers(field, "int", name), F.lit(1), blocks)
        elif name in ("q_starts", "t_starts"):
            field = F.slice(_numbers(field, "bigint", name), F.lit(1), blocks)
        out.append(field.alias(name))
    return kept.select("file_no", "line_no", (F.shiftleft(F.col("file_no").cast("long"), 40) + F.col("line_no")).alias("aln_id"), *out)


def _open_ended(spark: SparkSession, paths: list[str]) -> list[int]:
    """Numbers of the files whose last byte is no line feed: one byte read of each."""
    found = []
    for k, path in enumerate(paths):
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = place.getFileSystem(spark._jsc.hadoopConfiguration())
        size = files.getFileStatus(place).getLen()
        if size:
            stream = files.open(place)
            try:
                stream.seek(size - 1)
                if stream.read() != 10:
                    found.append(k)
            finally:
                stream.close()
    return found


def read_psl(spark: SparkSession, paths: list[str], skip: str = "leading_hash", legacy_eof: bool = False) -> DataFrame:
    """Rows of PSL files in order. ``legacy_eof`` drops a last line without a line feed, as some tools do."""
    lines = numbered_lines(spark, paths)
    if legacy_eof:
        last = lines.where(F.col("file_no").isin(_open_ended(spark, paths))).groupBy("file_no").agg(F.max("line_no").alias("line_no"))
        lines = lines.join(last, ["file_no", "line_no"], "left_anti")
    return parse_lines(lines, skip)


def zero_block_report(rows: DataFrame, by: list[str], line: str, list_lines: bool = True) -> DataFrame:
    """Per ``by``: how many of the rows have a block of size 0, and which lines."""
    zero = rows.where(F.exists("block_sizes", lambda s: s == 0)).groupBy(*by)
    aggs = [F.count("*").alias("n_lines")]
    if list_lines:
        aggs.append(F.sort_array(F.collect_list(line)).alias("lines"))
    return zero.agg(*aggs)
