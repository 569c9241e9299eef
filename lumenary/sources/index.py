"""A dense index that is built wave by wave and can be resumed, and its verification.

A folder holds: ``state`` (what it is built from), ``input`` (texts in batches of falling length, dealt to waves), ``vectors``
and ``receipts`` (a part each for every finished wave), ``index`` (rows in order of their keys) and ``manifest``, which is
written last. A wave's vectors are written whole, then its receipt with a digest of each batch; a wave without receipt never
happened and is written again. Everything goes through Spark's writers, so executors share nothing but the folder.
"""

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schedule import numbered
from .io import scratch

TOLERANCE = 2e-6
__all__ = ["build", "encoder", "fingerprint", "load", "progress", "scratch", "verify"]


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether a writer has committed there."""
    return _exists(spark, f"{path}/_SUCCESS")


def _say(spark: SparkSession, path: str, what: dict) -> None:
    spark.createDataFrame([(json.dumps(what, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _said(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def fingerprint(docs: DataFrame, key: str, text: str) -> dict:
    """Rows, and an order-free digest of keys and texts."""
    row = F.sha2(F.concat_ws("\x1f", F.col(key).cast("string"), F.coalesce(F.col(text), F.lit("\x00"))), 256)
    part = lambda i: F.bit_xor(F.conv(F.substring(row, 1 + 15 * i, 15), 16, 10).cast("long"))
    found = docs.agg(F.count("*"), *[part(i) for i in range(4)]).first()
    return {"rows": found[0], "digest": "".join(f"{x or 0:015x}" for x in found[1:])}


def encoder(encode: Callable[[list[str]], np.ndarray]) -> Callable[[DataFrame], DataFrame]:
    """A model over lists of texts as an encoder of rows (key, place, batch, wave, text): it gets texts of like length together."""

    def over(rows: DataFrame) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                numbers = b.column("batch").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
                for lo, hi in zip(cuts, cuts[1:]):
                    part = b.slice(lo, hi - lo)
                    vectors = np.asarray(encode(part.column("text").to_pylist()), np.float32)
                    yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("key", "place", "batch")], pa.array(list(vectors), pa.list_(pa.float32()))], names=["key", "place", "batch", "vector"])

        kind = rows.schema["key"].dataType.simpleString()
        return rows.select("key", "place", "batch", "text").mapInArrow(run, f"key {kind}, place long, batch long, vector array<float>")

    return over


def _receipts(vectors: DataFrame) -> DataFrame:
    """batch, n, first, last, digest; a batch is as large as was asked for, so its digests come together."""
    row = F.sha2(F.to_json(F.struct("key", "vector")), 256)
    found = vectors.groupBy("batch").agg(F.count("*").alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.array_sort(F.collect_list(F.struct("place", row.alias("d")))).alias("l"))
    return found.select("batch", "n", "first", "last", F.sha2(F.array_join(F.transform("l", lambda x: x["d"]), ""), 256).alias("digest"))


def build(docs: DataFrame, key: str, text: str, length: Column, encode: Callable[[DataFrame], DataFrame], path: str, settings: dict, size: int = 1_024, waves: int = 8, resume: bool = False) -> dict:
    """Builds the index of ``docs`` at ``path`` and gives its manifest.

    Batches of ``size`` follow falling length, then key, so that a model pads little; rows end in order of their keys. A complete
    index is never changed; a part of one is gone on with if ``resume`` is set and its settings and texts are the same, else it
    is an error. Batches with a receipt are checked against it, not encoded again. Null texts count as empty; keys must be
    unique and not null.
    """
    spark = docs.sparkSession
    if _finished(spark, f"{path}/manifest"):
        raise ValueError("a complete index is not changed; name another folder")
    if _exists(spark, path) and not resume:
        raise ValueError("part of an index is there; resume it or name another folder")
    identity = {"settings": settings, "size": size, "waves": waves, "corpus": fingerprint(docs, key, text)}
    if _finished(spark, f"{path}/state") and _said(spark, f"{path}/state") != identity:
        raise ValueError("the part that is there was built from other texts or settings")
    if docs.where(F.col(key).isNull()).limit(1).count() or docs.groupBy(key).count().where("count > 1").limit(1).count():
        raise ValueError("keys must be unique and not null")
    _say(spark, f"{path}/state", identity)
    rows = identity["corpus"]["rows"]
    if not _finished(spark, f"{path}/input"):
        ordered = numbered(docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), length.cast("long").alias("length")), [F.desc("length"), "key"], "place")
        batch, count = F.floor(F.col("place") / size), max(1, -(-rows // size))
        planned = ordered.withColumn("batch", batch).withColumn("wave", F.floor(F.col("batch") * waves / count).cast("int"))
        # whole batches are dealt by hash: by range a wave's texts, long or short ones, would lie in few files, of which each is one task's work
        planned.repartition("batch").sortWithinPartitions("place").write.partitionBy("wave").mode("overwrite").parquet(f"{path}/input")
    made = reused = 0
    for wave in range(waves if rows else 0):
        at, receipt = f"{path}/vectors/wave={wave}", f"{path}/receipts/wave={wave}"
        if not _exists(spark, f"{path}/input/wave={wave}"):
            continue
        if _finished(spark, receipt):
            if _receipts(spark.read.parquet(at)).exceptAll(spark.read.parquet(receipt)).limit(1).count():
                raise ValueError(f"vectors of wave {wave} were changed after they were written")
            reused += spark.read.parquet(receipt).count()
            continue
        encode(spark.read.parquet(f"{path}/input/wave={wave}")).select("key", "place", "batch", "vector").write.mode("overwrite").parquet(at)
        _receipts(spark.read.parquet(at)).write.mode("overwrite").parquet(receipt)
        made += spark.read.parquet(receipt).count()
    vectors = spark.read.parquet(f"{path}/vectors") if rows else spark.createDataFrame([], f"key {docs.schema[key].dataType.simpleString()}, place long, batch long, vector array<float>, wave int")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    bad = vectors.agg(F.count("*").alias("n"), F.count_if(F.coalesce(~(F.abs(norm - 1) <= TOLERANCE), F.lit(True))).alias("bad"), F.min(F.size("vector")).alias("least"), F.max(F.size("vector")).alias("most")).first()
    if bad.n != rows or bad.bad or bad.least != bad.most:
        raise ValueError(f"{rows} rows, {bad.n} vectors, {bad.bad} of them not of unit length, {bad.least} to {bad.most} components")
    shas = spark.read.schema(f"key {docs.schema[key].dataType.simpleString()}, text string").parquet(f"{path}/input").select("key", F.sha2("text", 256).alias("text_sha256"))
    vectors.drop("wave").join(shas, "key").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/index")
    manifest = {"identity": identity, "rows": rows, "dimension": bad.least, "batches_made": made, "batches_reused": reused}
    _say(spark, f"{path}/manifest", manifest)
    return manifest


def progress(spark: SparkSession, path: str) -> dict:
    """How far a build has come, from its receipts: rows and batches completed, rows in all, whether the index is complete."""
    total = _said(spark, f"{path}/state")["corpus"]["rows"] if _finished(spark, f"{path}/state") else None
    waves = _said(spark, f"{path}/state")["waves"] if total is not None else 0
    done = [f"{path}/receipts/wave={w}" for w in range(waves) if _finished(spark, f"{path}/receipts/wave={w}")]
    found = spark.read.parquet(*done).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("batches")).first() if done else None
    return {"total": total, "completed": found.rows if found else 0, "batches": found.batches if found else 0, "complete": _finished(spark, f"{path}/manifest")}


def load(spark: SparkSession, path: str) -> DataFrame:
    """key, place, batch, vector, text_sha256 of a complete index."""
    if not _finished(spark, f"{path}/manifest"):
        raise ValueError("there is no complete index")
    return spark.read.parquet(f"{path}/index")


def verify(docs: DataFrame, key: str, text: str, path: str, size: int) -> DataFrame:
    """code, n of what differs between a complete index and the texts now, row by row: MISSING_ROW, UNKNOWN_ROW, TEXT_CHANGED,
    NOT_UNIT, OTHER_DIMENSION, WRONG_BATCH; no rows if nothing does."""
    spark = docs.sparkSession
    rows, dimension = load(spark, path), _said(spark, f"{path}/manifest")["dimension"]
    now = docs.select(F.col(key).alias("key"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("now"), F.lit(True).alias("there"))
    both = rows.join(now, "key", "full_outer")
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    has = F.col("vector").isNotNull()
    found = {
        "MISSING_ROW": ~has, "UNKNOWN_ROW": F.col("there").isNull(), "TEXT_CHANGED": F.col("now") != F.col("text_sha256"), "NOT_UNIT": has & ~(F.abs(norm - 1) <= TOLERANCE),
        "OTHER_DIMENSION": has & (F.size("vector") != dimension), "WRONG_BATCH": has & (F.floor(F.col("place") / size) != F.col("batch")),
    }
    return both.select(F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()]))).alias("code")).groupBy("code").agg(F.count("*").alias("n"))
