"""Places for intermediate results that outlive a lost executor."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can read: the session's ``spark.checkpoint.dir``.

    On one machine (master ``local``), and only there, a temporary folder takes its
    place where the setting is absent.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        current = context._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif context.master.startswith("local"):
            folder = tempfile.mkdtemp(prefix="genoweave-")
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(folder)
    return folder


def cut_lineage(frame: DataFrame) -> DataFrame:
    """``frame`` computed once, stored in the shared folder, without its history."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def _tables(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}"


def write_table(frame: DataFrame, name: str) -> DataFrame:
    """``frame`` written as Parquet to the shared folder and read again."""
    spark = frame.sparkSession
    path = f"{_tables(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def write_counted(frame: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``write_table``, and aggregates of the rows that pass while they are written (0 where none do)."""
    seen = Observation()
    table = write_table(frame.observe(seen, *(m.alias(k) for k, m in measures.items())), name)
    found = seen.get
    return table, {k: found.get(k) or 0 for k in measures}


def write_sorted(frame: DataFrame, keys: list[str], name: str, by: str | None = None, dealt: bool = False) -> DataFrame:
    """``frame`` in the shared folder as a table bucketed and sorted by ``keys``, one file a bucket (and value of ``by``).

    ``dealt`` says that the frame comes from such tables, by bucket already. There are as many buckets as shuffle partitions. Joins and aggregations by the keys
    need no exchange of it, and under ``sorted_scans`` no sort either.
    """
    spark = frame.sparkSession
    label = f"{name}_{uuid.uuid4().hex}"
    path = f"{_tables(spark)}/{label}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [by, *keys] if by else keys
    rows = frame if dealt else frame.repartition(buckets, *keys)
    writer = rows.sortWithinPartitions(*order).write.format("parquet").option("path", path)
    if by:
        writer = writer.partitionBy(by)
    writer.bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(label)
    return spark.table(label)


def table_label(name: str) -> str:
    """A new name for a table of ``append_bucketed``."""
    return f"{name}_{uuid.uuid4().hex}"


def append_bucketed(frame: DataFrame, key: str, label: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``frame`` added to the table ``label`` in the shared folder, bucketed by ``key``, and aggregates of the new rows as in ``write_counted``.

    The frame should be dealt by ``key`` to as many tasks as there are shuffle partitions, one file each.
    Joins and aggregations of the table by the key need no exchange of it.
    """
    spark = frame.sparkSession
    seen = Observation()
    rows = frame.observe(seen, *(m.alias(k) for k, m in measures.items())) if measures else frame
    writer = rows.write.mode("append").format("parquet").option("path", f"{_tables(spark)}/{label}")
    writer.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).saveAsTable(label)
    found = seen.get if measures else {}
    return spark.table(label), {k: found.get(k) or 0 for k in measures}


@contextlib.contextmanager
def sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Plans made inside know that tables of ``write_sorted`` are sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_tables(*frames: DataFrame) -> None:
    """Delete the files behind frames that ``write_table`` gave and nothing will read again."""
    for frame in frames:
        for file in frame.inputFiles():
            before, mark, rest = file.partition(f"/tables/{frame.sparkSession.sparkContext.applicationId}/")
            if mark:
                _delete(frame.sparkSession, before + mark + rest.split("/")[0])
                break


def clear_tables(spark: SparkSession) -> None:
    """Delete every table that this application wrote; for the end of a job whose result is stored elsewhere."""
    _delete(spark, _tables(spark))


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
