"""The resumable index: killed, changed and complete ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenary.sources import index

DOCS = [(i * 7 % 101, "w " * (i * 37 % 60) + f"text {i}" if i % 9 else None) for i in range(101)]


def letters(texts):
    v = np.array([[t.count(c) + (c == "t") for c in "txw 1"] for t in texts], float) + 0.25
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(DOCS, "id long, body string").repartition(3)


def built(docs, path, encode, **more):
    return index.build(docs, "id", "body", F.length(F.coalesce("body", F.lit(""))), encode, path, {"model": "m"}, size=8, waves=4, **more)


def rows(spark, path):
    return [(r.key, r.place, r.batch, tuple(r.vector), r.text_sha256) for r in index.load(spark, path).collect()]


def test_killed_and_run_again(spark, docs, tmp_path):
    """A run that dies in its third wave leaves two; the next one makes the rest only, and the result is that of a whole run."""
    whole, part = f"file://{tmp_path}/whole", f"file://{tmp_path}/part"
    assert built(docs, whole, index.encoder(letters))["batches_made"] == 13
    seen, encode = [], index.encoder(letters)

    def dying(df):
        seen.append(sorted(r.batch for r in df.select("batch").distinct().collect()))
        if len(seen) == 3:
            raise RuntimeError("killed")
        return encode(df)

    with pytest.raises(RuntimeError, match="killed"):
        built(docs, part, dying)
    assert index.progress(spark, f"file://{tmp_path}/nothing") == {"total": None, "completed": 0, "batches": 0, "complete": False}
    half = index.progress(spark, part)
    assert half == {"total": 101, "completed": 8 * half["batches"], "batches": len(seen[0]) + len(seen[1]), "complete": False}
    with pytest.raises(ValueError, match="resume"):
        built(docs, part, encode)
    manifest = built(docs, part, dying, resume=True)
    assert manifest["batches_made"] + manifest["batches_reused"] == 13 and manifest["batches_reused"] == len(seen[0]) + len(seen[1])
    assert seen[2] == seen[3] and sum(len(s) for s in seen[:2] + seen[3:]) == 13 and len({b for s in seen for b in s}) == 13
    assert rows(spark, part) == rows(spark, whole)
    assert index.progress(spark, part) == {"total": 101, "completed": 101, "batches": 13, "complete": True}
    found = rows(spark, whole)
    assert [r[0] for r in found] == sorted(i for i, _ in DOCS)
    order = sorted(DOCS, key=lambda d: (-len(d[1] or ""), d[0]))
    assert {r[0]: (r[1], r[2]) for r in found} == {i: (p, p // 8) for p, (i, _) in enumerate(order)}
    with pytest.raises(ValueError, match="complete"):
        built(docs, whole, encode, resume=True)


def test_changed_parts_are_refused(spark, docs, tmp_path):
    path, encode, seen = f"file://{tmp_path}/p", index.encoder(letters), []

    def dying(df):
        seen.append(1)
        if len(seen) == 2:
            raise RuntimeError("killed")
        return encode(df)

    with pytest.raises(RuntimeError):
        built(docs, path, dying)
    with pytest.raises(ValueError, match="other texts"):
        built(docs.where("id <> 5"), path, encode, resume=True)
    first = spark.read.parquet(f"{path}/vectors/wave=0")
    changed = first.withColumn("vector", F.transform("vector", lambda x: -x)).collect()
    spark.createDataFrame(changed, first.schema).write.mode("overwrite").parquet(f"{path}/vectors/wave=0")
    with pytest.raises(ValueError, match="wave 0"):
        built(docs, path, encode, resume=True)


def test_vectors_must_be_of_unit_length(docs, tmp_path):
    with pytest.raises(ValueError, match="unit length"):
        built(docs, f"file://{tmp_path}/a", index.encoder(lambda texts: letters(texts) * 1.01))
    with pytest.raises(ValueError, match="unique"):
        built(docs.union(docs.limit(1)), f"file://{tmp_path}/b", index.encoder(letters))


def test_verify_and_empty(spark, docs, tmp_path):
    path = f"file://{tmp_path}/v"
    built(docs, path, index.encoder(letters))
    assert index.verify(docs, "id", "body", path, 8).count() == 0
    now = docs.where("id <> 3").withColumn("body", F.when(F.col("id") < 10, "new").otherwise(F.col("body"))).union(spark.createDataFrame([(-1, "x")], "id long, body string"))
    assert {r.code: r.n for r in index.verify(now, "id", "body", path, 8).collect()} == {"MISSING_ROW": 1, "UNKNOWN_ROW": 1, "TEXT_CHANGED": 9}
    assert {r.code: r.n for r in index.verify(docs, "id", "body", path, 7).collect()}.keys() == {"WRONG_BATCH"}
    none = docs.limit(0)
    assert built(none, f"file://{tmp_path}/none", index.encoder(letters))["rows"] == 0 and index.load(spark, f"file://{tmp_path}/none").count() == 0


def test_waves_lie_in_many_files(spark, tmp_path):
    """Each wave is work for all tasks, whatever the lengths of its texts, and no batch is cut between two."""
    path, key = f"file://{tmp_path}/deal", "spark.sql.adaptive.coalescePartitions.enabled"
    many = spark.range(400).select("id", F.expr("repeat('w', cast(400 - id as int))").alias("body"))
    spark.conf.set(key, "false")
    try:
        index.build(many, "id", "body", F.length("body"), index.encoder(letters), path, {}, size=4, waves=3)
    finally:
        spark.conf.unset(key)
    files = spark.read.parquet(f"{path}/input").select("wave", "batch", F.input_file_name().alias("file"))
    assert {r.wave: r.n for r in files.groupBy("wave").agg(F.countDistinct("file").alias("n")).collect()} == {0: 4, 1: 4, 2: 4}
    assert files.groupBy("batch").agg(F.countDistinct("file").alias("n")).where("n > 1").count() == 0
