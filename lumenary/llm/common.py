"""Helpers the training-data operators share: durable intermediate tables and input selection."""

from __future__ import annotations

import math
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows sent to a Python worker at once and bytes of a row group, both small so that memory stays low with long texts.
BATCH_ROWS, GROUP_BYTES = 1_000, 16 << 20
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: ``spark.checkpoint.dir``. Only a local master, whose executors share the
    driver's disk, may leave it unset and gets a temporary one, as in tests; on a cluster that is an error."""
    sc = spark.sparkContext
    where = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lumenary-")
        sc.setCheckpointDir(where)
    return where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The lineage ends there, so a lost executor costs only the tasks it ran, and columns such as
    ``monotonically_increasing_id`` keep the values they were written with. The files go when the
    application's file system is closed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lumenary-{name}-{uuid.uuid4().hex}"
    batch = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(batch), BATCH_ROWS) if int(batch) > 0 else BATCH_ROWS)
    try:
        df.write.option("compression", "zstd").option("parquet.block.size", GROUP_BYTES).parquet(path)
    finally:
        spark.conf.set(_BATCH, batch)
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    for paths in getattr(_recording, "lists", ()):
        paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


_recording = threading.local()


@contextmanager
def recorded() -> Iterator[list[str]]:
    """Lists the paths of the tables that this thread materializes meanwhile."""
    lists = _recording.__dict__.setdefault("lists", [])
    lists.append(paths := [])
    try:
        yield paths
    finally:
        lists[:] = [x for x in lists if x is not paths]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def remainder(key: str, n: int):
    """crc32 of the id as text, mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % n


def texts(docs: DataFrame, row: str | None = None, rows: bool = False) -> DataFrame:
    """doc_id and the text's bytes only, so that other columns can have any name. With ``rows``, also
    row: the column of that name, which numbers the rows, or numbers of their own."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")]
    if rows:
        columns.append(F.col(row).alias("row") if row else F.monotonically_increasing_id().alias("row"))
    return docs.select(*columns)


def bucket_count(rows: int) -> int:
    """Buckets to rank ``rows`` in: both their number and their size grow as the square root of the rows."""
    return max(1, math.isqrt(rows // 64))


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """doc_id, text, number and the whole row as ``whole``, written once so that the numbers hold."""
    kept = materialize(docs.select(F.struct("*").alias("whole"), F.monotonically_increasing_id().alias("number")), name)
    return kept.select("whole.doc_id", "whole.text", "number", "whole")


def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The whole rows of ``numbered`` whose number is not in ``gone`` (column row)."""
    return rows.select("whole", "number").join(gone, F.col("number") == F.col("row"), "left_anti").select("whole.*")
