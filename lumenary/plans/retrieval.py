"""Vector retrieval and evidence queries."""

from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import evidence, topk
from .registry import Tables, query

_TOP = """WITH s AS (SELECT q.vec_id AS query_id, c.vec_id AS id, q.label AS ql, c.label AS cl, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
  FROM embeddings q, embeddings c WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) """


def _rows(t: Tables):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _top(t: Tables, k: int = 5):
    return topk.exact_top_k(_rows(t).where("id % 20 = 0"), _rows(t), k)


@query(_TOP + "SELECT query_id, rank, id, score FROM r WHERE rank <= 5")
def topk_exact_batch(t: Tables):
    return _top(t)


@query("""SELECT c.vec_id AS id, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 9) AS score
FROM embeddings c, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY 2 DESC, 1 LIMIT 5""")
def topk_single(t: Tables):
    probe = _rows(t).where("id = 0").select(F.col("v").cast("array<double>").alias("v")).first()
    return topk.single_top_k(probe.v, _rows(t), 5)


@query(_TOP + """SELECT label, count(*) AS n_queries, round(avg(share), 6) AS mean_share FROM (
  SELECT query_id, any_value(ql) AS label, avg((ql = cl)::INT) AS share FROM r WHERE rank BETWEEN 2 AND 6 GROUP BY query_id) GROUP BY label""")
def topk_label_recall(t: Tables):
    labels = _rows(t).select("id", "label")
    top = _top(t, 6).where("rank >= 2").join(labels, "id").join(labels.toDF("query_id", "own"), "query_id")
    share = top.groupBy("query_id").agg(F.first("own").alias("label"), F.avg((F.col("own") == F.col("label")).cast("int")).alias("share"))
    return share.groupBy("label").agg(F.count("*").alias("n_queries"), F.round(F.avg("share"), 6).alias("mean_share"))


@query("""SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) - 1) > 2e-6) AS bad_norm,
 count(*) FILTER (len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite, count(DISTINCT len(embedding)) AS dims FROM embeddings""")
def vector_norm_check(t: Tables):
    v = F.col("v")
    return _rows(t).agg(F.count("*").alias("n"), F.count_if(F.abs(vectors.norm(v) - 1) > 2e-6).alias("bad_norm"), F.count_if(~vectors.finite(v)).alias("not_finite"), F.countDistinct(F.size(v)).alias("dims"))


@query("""WITH n AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS r, count(*) OVER () AS c FROM embeddings),
s AS (SELECT q.vec_id AS probe_id, e.vec_id AS top_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 9) DESC, e.vec_id) AS k
 FROM n q, embeddings e WHERE q.r IN (0, q.c // 4, q.c // 2, q.c - 1))
SELECT probe_id, top_id, probe_id = top_id AS ok FROM s WHERE k = 1""")
def vector_self_probe(t: Tables):
    from ..operators.schedule import numbered

    ranked = numbered(_rows(t), ["id"], "r")
    n = F.lit(t.embeddings.count())
    probes = ranked.where((F.col("r") == 0) | (F.col("r") == F.floor(n / 4)) | (F.col("r") == F.floor(n / 2)) | (F.col("r") == n - 1))
    return topk.exact_top_k(probes, _rows(t), 1).select(F.col("query_id").alias("probe_id"), F.col("id").alias("top_id"), (F.col("query_id") == F.col("id")).alias("ok"))


def _evidence(t: Tables):
    return t.lineitem.select(F.col("l_orderkey").alias("question"), (F.col("l_suppkey") % 3).alias("grp"), (F.col("l_linenumber") % 2).alias("combo"), F.col("l_partkey").alias("chunk"))


def _recalls(t: Tables):
    return evidence.coverage(_evidence(t), t.part.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("chunk")))


_RECALL = """WITH c AS (SELECT l_orderkey AS question, l_suppkey % 3 AS grp, l_linenumber % 2 AS combo,
  bool_and(l_partkey IN (SELECT p_partkey FROM part WHERE p_partkey % 3 <> 0)) AS whole FROM lineitem GROUP BY ALL),
g AS (SELECT question, grp, bool_or(whole) AS hit FROM c GROUP BY ALL),
q AS (SELECT question, count(*) AS n_groups, count(*) FILTER (hit) AS n_hit, avg(hit::INT) AS recall, bool_and(hit) AS complete FROM g GROUP BY question) """


@query(_RECALL + "SELECT question, n_groups, n_hit, round(recall, 6) AS recall, complete FROM q")
def dnf_evidence_recall(t: Tables):
    return _recalls(t).withColumn("recall", F.round("recall", 6))


@query(_RECALL + """SELECT CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS label, count(*) AS n, round(avg(recall), 6) AS mean_recall,
 count(*) FILTER (complete) AS n_complete, count(*) FILTER (recall = 0) AS n_none, count(*) FILTER (recall > 0 AND recall < 1) AS n_partial
 FROM q JOIN orders ON o_orderkey = question GROUP BY GROUPING SETS ((), (o_orderpriority))""")
def dnf_summary_all_types(t: Tables):
    kinds = t.orders.select(F.col("o_orderkey").alias("question"), F.col("o_orderpriority").alias("kind"))
    return evidence.recall_summary(_recalls(t).join(kinds, "question"), "kind").withColumn("mean_recall", F.round("mean_recall", 6))


@query(_RECALL + """SELECT complete, count(*) AS n, round(avg(recall), 6) AS mean_recall, round(avg(o_totalprice), 4) AS mean_quality, count(*) FILTER (o_orderstatus = 'F') AS n_finished
 FROM q JOIN orders ON o_orderkey = question GROUP BY complete""")
def quality_by_completeness(t: Tables):
    facts = t.orders.select(F.col("o_orderkey").alias("question"), "o_totalprice", "o_orderstatus")
    return _recalls(t).join(facts, "question").groupBy("complete").agg(
        F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.round(F.avg("o_totalprice"), 4).alias("mean_quality"), F.count_if(F.col("o_orderstatus") == "F").alias("n_finished")
    )


@query("""WITH c AS (SELECT l_orderkey AS question, l_suppkey % 2 AS grp, l_linenumber % 2 AS combo, list(DISTINCT l_partkey) AS c FROM lineitem GROUP BY ALL),
q AS (SELECT DISTINCT question FROM c)
SELECT q.question, min(len(list_distinct(list_concat(coalesce(a.c, []), coalesce(b.c, []))))) AS min_cover
FROM q LEFT JOIN (SELECT * FROM c WHERE grp = 0) a ON a.question = q.question LEFT JOIN (SELECT * FROM c WHERE grp = 1) b ON b.question = q.question GROUP BY q.question""")
def min_cover_size(t: Tables):
    rows = t.lineitem.select(F.col("l_orderkey").alias("question"), (F.col("l_suppkey") % 2).alias("grp"), (F.col("l_linenumber") % 2).alias("combo"), F.col("l_partkey").alias("chunk"))
    return evidence.min_cover(rows)


@query("""SELECT user_id, round(avg(cos) * (1 - (min(flag) = 1)::INT), 6) AS value FROM (SELECT user_id, value / 1000 - 0.02 AS cos, (event_type <> 'purchase')::INT AS flag FROM events) GROUP BY user_id""")
def answer_relevance(t: Tables):
    from ..operators.metrics import relevance

    rows = t.events.select("user_id", (F.col("value") / 1000 - 0.02).alias("cos"), (F.col("event_type") != "purchase").cast("int").alias("flag"))
    return relevance(rows, "user_id").withColumn("value", F.round("value", 6))
