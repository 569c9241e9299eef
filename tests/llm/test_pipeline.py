"""The pipeline's stages against plain versions, each on what the one before it kept."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenary.llm import lang_id, quality
from lumenary.llm.common import materialize

from .test_operators import brute_near, check_packing, docs_of, fold


@pytest.fixture(scope="module")
def stages(spark):
    sf_dir = "/root/testdata/sf0.01"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        kept = materialize(stage(spark, docs, sf_dir), name)
        out.append((docs, kept))
        docs = kept
    return out


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == before.columns and 0 < after.count() <= before.count()


def test_language_stage(spark, stages):
    before, after = stages[0]
    said = lang_id.identify(before, lang_id.learn(before))
    keep = said.where("lang_pred <> 'und' and not foreign")
    assert rows(after) == rows(before.join(keep.select("doc_id"), "doc_id", "left_semi"))
    odd = docs_of(spark, [(10_000, "12 34 !!", None), (10_001, None, None), (10_002, "я не знаю этого языка совсем", None), (10_003, "A", None)]).select(*before.columns)
    assert said.where("foreign and lang_pred <> 'und'").count() == 0
    mixed = before.unionByName(odd)
    assert [r.doc_id for r in corpus_pipeline.identify_language(spark, mixed, "").where("doc_id >= 10000").collect()] == [10_003]


def test_quality_stage(spark, stages):
    before, after = stages[1]
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    keep = quality.predict(before, labels).where(F.col("score") >= corpus_pipeline.LEAST_QUALITY)
    assert rows(after) == rows(before.join(keep.select("doc_id"), "doc_id", "left_semi"))
    marked = labels.join(before, "doc_id").select("doc_id", "quality").join(after.select("doc_id", F.lit(1).alias("kept")), "doc_id", "left").fillna(0)
    assert marked.where("quality = 1").agg(F.avg("kept")).first()[0] > 0.97 and marked.where("quality = 0").agg(F.avg("kept")).first()[0] < 0.2


def test_exact_stage(stages):
    before, after = stages[2]
    best = {}
    for r in before.collect():
        best[fold(r.text)] = max(best.get(fold(r.text), r.doc_id), r.doc_id)
    assert sorted(r.doc_id for r in after.collect()) == sorted(best.values())


def test_near_stage(stages):
    before, after = stages[3]
    table = [(r.doc_id, r.text, r.lang) for r in before.collect()]
    groups = defaultdict(set)
    for d, _, c in brute_near(table, 5):
        groups[c].add(d)
    kept = {r.doc_id for r in after.collect()}
    assert len(kept) == after.count() == len(groups) and all(len(g & kept) == 1 for g in groups.values())


def test_packing_stage(stages):
    import public_tokenizers
    from tokenizers import Tokenizer

    before, after = stages[4]
    check_packing([(r.doc_id, r.text) for r in before.collect()], after.collect(), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_repeated_and_null_rows(spark):
    docs = docs_of(spark, [(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "A b c d e f", "en"), (None, "a b c d e f", None), (3, None, None), (3, "", None), (4, "z", "en")])
    exact = corpus_pipeline.drop_copies(spark, docs, "")
    assert exact.columns == docs.columns and sorted((r.doc_id for r in exact.collect())) == [2, 3, 4]
    near = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert near.columns == docs.columns and near.where("text like '%b c d%'").count() == 1 and near.count() == 4
    for stage in (corpus_pipeline.drop_copies, corpus_pipeline.drop_near_copies, corpus_pipeline.identify_language):
        assert stage(spark, docs.limit(0), "").count() == 0


def test_quality_and_packing_rows(spark, tmp_path):
    """Null, empty and repeated rows, extra columns with clashing names, and empty tables in the second and the last stage."""
    docs = docs_of(spark, [(1, "a plain text with some words.", "en")] * 2 + [(2, None, None), (3, "", "en"), (None, "# | $$ %% && ##", None), (4, "x " * 50_000, "en")])
    for name, labels in (("some", [(1, 1, 0), (2, 0, 0), (None, 1, 0), (4, None, 1)]), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        kept = corpus_pipeline.classify_quality(spark, docs, folder)
        scores = {r.doc_id: r.score for r in quality.predict(docs, spark.read.parquet(f"{folder}/labels.parquet")).collect()}
        assert kept.columns == docs.columns
        assert rows(kept) == sorted((tuple(r) for r in docs.collect() if scores[r.doc_id] >= corpus_pipeline.LEAST_QUALITY), key=str)
        assert corpus_pipeline.classify_quality(spark, docs.limit(0), folder).count() == 0
    packed = corpus_pipeline.pack_sequences(spark, docs, "")
    assert sorted((r.doc_id, r.n) for r in packed.groupBy("doc_id").agg(F.sum("length").alias("n")).where("doc_id in (2, 3)").collect()) == [(2, 1), (3, 1)]
    assert packed.where("doc_id = 1").count() == 2 and packed.where("doc_id = 4").count() > 10
    assert corpus_pipeline.pack_sequences(spark, docs.limit(0), "").count() == 0
