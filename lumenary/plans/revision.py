"""Queries on revisions: gates, sensitivity, derived results, claims, reviews, ledgers' errors, matches and segments."""

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import redact
from ..operators import checks, evidence, grid, ledger, recovery
from ..sources.io import cut_lineage
from ..streaming.rollups import unfinished
from .registry import Tables, query
from .retrieval import _RECALL, _recalls


@query("""WITH n AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_orderkey % 11 = 0 THEN o_custkey + 1 ELSE o_custkey END AS cust FROM orders WHERE o_orderkey % 13 <> 0),
f AS (SELECT o.o_orderkey AS k, unnest(CASE WHEN n.k IS NULL THEN ['row'] ELSE list_filter([CASE WHEN o.o_orderstatus <> n.status THEN 'status' END, CASE WHEN o.o_custkey <> n.cust THEN 'cust' END], lambda x: x IS NOT NULL) END) AS field
 FROM orders o LEFT JOIN n ON n.k = o.o_orderkey)
SELECT CASE WHEN field = 'status' AND k % 2 = 0 THEN 'DECLARED' ELSE 'UNDECLARED' END AS verdict, field, count(*) AS n FROM f GROUP BY ALL""")
def declared_delta_gate(t: Tables):
    old = t.orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("cust"))
    new = old.where("k % 13 <> 0").select("k", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("status")).alias("status"), F.when(F.col("k") % 11 == 0, F.col("cust") + 1).otherwise(F.col("cust")).alias("cust"))
    return checks.delta_gate(old, new, "k", ["status", "cust"], old.where("k % 2 = 0").select("k", F.lit("status").alias("field")))


@query(_RECALL + """SELECT variant, count(*) AS n, round(avg(recall), 6) AS mean_recall, count(*) FILTER (complete) AS n_complete
 FROM (SELECT q.*, unnest(CASE WHEN o_orderstatus = 'F' THEN ['published'] ELSE ['published', 'without_finished'] END) AS variant FROM q JOIN orders ON o_orderkey = question) GROUP BY variant""")
def recall_sensitivity(t: Tables):
    facts = t.orders.select(F.col("o_orderkey").alias("question"), "o_orderstatus")
    variants = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("published"))).otherwise(F.array(F.lit("published"), F.lit("without_finished")))
    rows = _recalls(t).join(facts, "question").select("recall", "complete", F.explode(variants).alias("variant"))
    return rows.groupBy("variant").agg(F.count("*").alias("n"), F.round(F.avg("recall"), 6).alias("mean_recall"), F.count_if("complete").alias("n_complete"))


@query("""SELECT l_orderkey, round(avg((l_linestatus = 'F')::INT), 6) AS coverage, round(avg((l_linestatus = 'F')::INT) FILTER (l_linenumber <> 1), 6) AS derived, count(*) FILTER (l_linenumber <> 1) AS n_left
 FROM lineitem GROUP BY l_orderkey""")
def derived_coverage(t: Tables):
    met = (F.col("l_linestatus") == "F").cast("int")
    left = F.col("l_linenumber") != 1
    return t.lineitem.groupBy("l_orderkey").agg(F.round(F.avg(met), 6).alias("coverage"), F.round(F.avg(F.when(left, met)), 6).alias("derived"), F.count_if(left).alias("n_left"))


@query("""SELECT conv_id, turn, n, n_distinct, n_blank, n_blank = 0 AND n = n_distinct AS valid FROM (
 SELECT conv_id, turn, len(c) AS n, len(list_distinct(c)) AS n_distinct, len(list_filter(c, lambda x: trim(x) = '')) AS n_blank FROM (SELECT conv_id, turn, string_split(text, '. ') AS c FROM conversations WHERE role = 'assistant' AND text IS NOT NULL))""")
def claim_validation(t: Tables):
    c = F.split("text", r"\. ")
    rows = t.conversations.where("role = 'assistant' AND text IS NOT NULL").select("conv_id", "turn", F.size(c).cast("long").alias("n"), F.size(F.array_distinct(c)).cast("long").alias("n_distinct"), F.size(F.filter(c, lambda x: F.trim(x) == "")).cast("long").alias("n_blank"))
    return rows.withColumn("valid", (F.col("n_blank") == 0) & (F.col("n") == F.col("n_distinct")))


@query("""SELECT o_orderpriority, CASE WHEN o_orderpriority <> '1-URGENT' AND o_custkey % 2 = 0 AND o_orderstatus <> 'P' THEN 'CLOSED' ELSE 'ACTIVE' END AS status, count(*) AS n FROM orders GROUP BY ALL""")
def review_closure(t: Tables):
    closed, active = ledger.close_reviews(t.orders, F.col("o_orderpriority") != "1-URGENT", F.col("o_custkey") % 2 == 0, F.col("o_orderstatus") != "P")
    rows = closed.select("o_orderpriority", "status").union(active.select("o_orderpriority", F.lit("ACTIVE")))
    return rows.groupBy("o_orderpriority", "status").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS record_id, l_linenumber - 1 AS s, l_linenumber - 1 + l_suppkey % 5 AS e, 'S' AS b, CASE WHEN l_returnflag = 'A' THEN 'S' ELSE 'x' END AS a FROM lineitem),
r AS (SELECT p_partkey, p_type FROM part WHERE p_partkey % 9 <> 0),
j AS (SELECT p.*, p_type AS t, lag(e) OVER (PARTITION BY record_id ORDER BY s, e, id) AS prev, count(*) OVER (PARTITION BY id) AS times FROM p LEFT JOIN r ON p_partkey = record_id),
k AS (SELECT *, t IS NOT NULL AND s >= 0 AND e > s AND e <= length(t) AS inside FROM j)
SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN times > 1 THEN 'DUPLICATE_ID' END, CASE WHEN t IS NULL THEN 'NO_RECORD' END, CASE WHEN t IS NOT NULL AND NOT inside THEN 'OUT_OF_RANGE' END,
 CASE WHEN inside AND substr(t, s + 1, e - s) <> b THEN 'BEFORE_MISMATCH' END, CASE WHEN b = a THEN 'NO_CHANGE' END, CASE WHEN s < prev THEN 'OVERLAP' END]) AS code FROM k) WHERE code IS NOT NULL GROUP BY code""")
def patch_validation(t: Tables):
    start = F.col("l_linenumber").cast("int") - 1
    patches = t.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("record_id"), start.alias("start"), (start + (F.col("l_suppkey") % 5).cast("int")).alias("end"),
        F.lit("S").alias("before"), F.when(F.col("l_returnflag") == "A", "S").otherwise("x").alias("after"),
    )
    return ledger.patch_errors(patches, t.part.where("p_partkey % 9 <> 0").select(F.col("p_partkey").alias("record_id"), F.col("p_type").alias("text")))


@query("""SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+', '<EMAIL>', 'g'), '[0-9]{5,}', '<NUMBER>', 'g')) AS sha FROM documents""")
def redacted_texts(t: Tables):
    return t.documents.select("doc_id", F.sha2(redact(F.col("text"), {"[A-Za-z0-9._]+@[A-Za-z0-9.]+": "EMAIL", "[0-9]{5,}": "NUMBER"}), 256).alias("sha"))


@query("""WITH c AS (SELECT c_nationkey AS n, floor(c_acctbal / 100)::BIGINT AS b, min(c_custkey) AS c_custkey FROM customer GROUP BY ALL HAVING count(*) = 1)
SELECT s_suppkey, c_custkey, CASE WHEN c_custkey IS NULL THEN 'UNMATCHED' ELSE 'MATCHED' END AS status FROM supplier LEFT JOIN c ON n = s_nationkey AND b = floor(s_acctbal / 100)::BIGINT""")
def unique_match_join(t: Tables):
    key = lambda x: F.struct(F.col(f"{x}_nationkey"), F.floor(F.col(f"{x}_acctbal") / 100)).alias("at")
    once = t.customer.select("c_custkey", key("c")).groupBy("at").agg(F.min("c_custkey").alias("c_custkey"), F.count("*").alias("n")).where("n = 1").drop("n")
    found = t.supplier.select("s_suppkey", key("s")).join(once, "at", "left")
    return found.select("s_suppkey", "c_custkey", F.when(F.col("c_custkey").isNull(), "UNMATCHED").otherwise("MATCHED").alias("status"))


@query("""WITH b AS (SELECT p_brand AS page, p_type AS box_id, min(p_size)::DOUBLE AS x0, max(p_size)::DOUBLE AS x1, min(p_retailprice)::DOUBLE AS y0, max(p_retailprice)::DOUBLE AS y1 FROM part GROUP BY ALL)
SELECT a.page, a.box_id AS one, c.box_id AS other FROM b a JOIN b c ON a.page = c.page AND a.box_id < c.box_id
WHERE greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) / greatest(1, least(a.x1 - a.x0, c.x1 - c.x0)) >= 0.7 AND greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) / greatest(1, least(a.y1 - a.y0, c.y1 - c.y0)) >= 0.55""")
def spatial_overlap_pairs(t: Tables):
    sides = {"x0": F.min("p_size"), "y0": F.min("p_retailprice"), "x1": F.max("p_size"), "y1": F.max("p_retailprice")}
    b = t.part.groupBy(F.col("p_brand").alias("page"), F.col("p_type").alias("box_id")).agg(*[v.cast("double").alias(c) for c, v in sides.items()])
    side = lambda p, name: b.select("page", F.col("box_id").alias(name), *[F.col(c).alias(p + c) for c in sides])
    pairs = grid.overlapping(side("a", "one"), side("b", "other"), ["page"], math.nextafter(0.7, 0), math.nextafter(0.55, 0))  # at least these shares
    return pairs.where("one < other").select("page", "one", "other")


@query("""WITH e AS (SELECT user_id, value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS d FROM events)
SELECT user_id, 1 + count(*) FILTER (d > 24 OR d < -5) AS n_segments FROM e GROUP BY user_id""")
def jump_segments(t: Tables):
    step = F.col("value") - F.lag("value").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    rows = t.events.select("user_id", step.alias("d"))
    return rows.groupBy("user_id").agg((F.lit(1) + F.count_if((F.col("d") > 24) | (F.col("d") < -5))).alias("n_segments"))


@query("""SELECT user_id, event_type AS label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type DESC) AS r FROM events) WHERE r = 1""")
def label_of_largest(t: Tables):
    return t.events.groupBy("user_id").agg(F.max(F.struct("value", "event_type")).alias("top")).select("user_id", F.col("top.event_type").alias("label"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resumable_work(t: Tables):
    done = t.lineitem.where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return unfinished(t.orders.select("o_orderkey"), done, "o_orderkey")


def judged(t: Tables):
    """(attempts, claims, sources, metrics): a conversation's turns are its sources, and its claims. The first attempt of a stage names
    another source, the second cuts quotes to two lines of the text, the third turns these round."""
    c = F.col
    turns = t.conversations.where("text is not null").select(c("conv_id").alias("key"), c("turn"), c("text"), F.split("text", r"\s+").alias("w"))
    span = lambda a, n: F.array_join(F.slice(c("w"), a, n), " ")
    both = {1: F.concat(span(2, 4), F.lit("\n"), span(9, 4)), 2: F.concat(span(2, 4), F.lit("\n"), span(9, 4)), 3: F.concat(span(9, 4), F.lit("\n"), span(2, 4))}
    rows = None
    for n, cut in both.items():
        quote = F.when(c("turn") % 3 == 0, cut).otherwise(span(1, 3))
        ids = F.array(F.when(F.lit(n) == 1, F.concat(F.lit("T"), c("turn") + 1000)).otherwise(F.concat(F.lit("T"), "turn")))
        own = turns.select("key", F.struct("turn", F.concat(F.lit("claim "), "turn").alias("statement"), (c("turn") % 2 == 0).cast("int").alias("verdict"), ids.alias("evidence_ids"), F.array(quote).alias("evidence_quotes")).alias("s"))
        own = own.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias("l")).select("key", F.lit("faithfulness").alias("stage"), F.lit(n).alias("attempt"), F.transform("l", lambda s: s.dropFields("turn")).alias("statements"))
        rows = own if rows is None else rows.unionByName(own)
    attempts = rows.withColumns({"error": F.when(c("key") % 10 == 9, "OTHER").otherwise("UNVERIFIABLE_SOURCE_QUOTE"), "complete": ~((c("key") % 7 == 3) & (c("attempt") == 2)), "intact": F.lit(True)})
    claims = turns.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("claim "), "turn").alias("s")))).alias("l"))
    claims = claims.select("key", F.transform("l", lambda x: F.when(c("key") % 11 == 5, F.upper(x["s"])).otherwise(x["s"])).alias("claims"))
    sources = turns.select("key", F.lit("faithfulness").alias("stage"), F.concat(F.lit("T"), "turn").alias("source_id"), "text")
    metrics = claims.select("key", F.explode(F.array(F.lit("faithfulness"), F.lit("relevance"))).alias("metric")).withColumns({"value": F.when(c("metric") == "relevance", 0.5), "status": F.when(c("metric") == "relevance", "OK").otherwise("ERROR")})
    return attempts, claims, sources, metrics


@query()
def recovered_stages(t: Tables):
    """Metrics once stages have been recovered from attempts with quotes put right; the search for a quote isn't SQL."""
    attempts, claims, sources, metrics = judged(t)
    stages, _ = recovery.recover(attempts, claims, sources)
    return recovery.corrected(metrics, stages).join(stages.select("key", F.col("stage").alias("metric"), "attempt", "n_changes"), ["key", "metric"], "left")


_COVER = """SELECT question, min(len(list_distinct(list_concat(coalesce(a, []), coalesce(b, []), coalesce(d, []))))) AS size FROM (SELECT DISTINCT question FROM {0}) LEFT JOIN (SELECT question, c AS a FROM {0} WHERE grp = 0) USING (question)
 LEFT JOIN (SELECT question, c AS b FROM {0} WHERE grp = 1) USING (question) LEFT JOIN (SELECT question, c AS d FROM {0} WHERE grp = 2) USING (question) GROUP BY question"""


@query(f"""WITH e AS (SELECT DISTINCT l_orderkey AS question, l_suppkey % 3 AS grp, l_linenumber % 2 AS combo, l_partkey AS chunk FROM lineitem),
n AS (SELECT * FROM e WHERE NOT (question % 6 = 1 AND combo = 1) UNION SELECT DISTINCT question, grp, 9, -1 FROM e WHERE question % 4 = 0 UNION SELECT question, grp, combo, -2 FROM e WHERE question % 6 = 1 AND combo = 1),
o AS (SELECT question, grp, combo, list(chunk) AS c FROM e GROUP BY ALL), m AS (SELECT question, grp, combo, list(chunk) AS c FROM n GROUP BY ALL),
x AS ({_COVER.format('o')}), y AS ({_COVER.format('m')})
SELECT x.question, x.size AS before, y.size AS after, CASE WHEN x.question % 6 = 1 AND x.question % 4 = 0 THEN 'ADDED_AND_REPLACED' WHEN x.question % 4 = 0 THEN 'ADDED' WHEN x.question % 6 = 1 AND EXISTS (SELECT 1 FROM e WHERE e.question = x.question AND combo = 1) THEN 'REPLACED' END AS change FROM x LEFT JOIN y USING (question)""")
def gold_revision_cover(t: Tables):
    """The least number of chunks that suffice before and after combinations were added and replaced."""
    old = t.lineitem.select(F.col("l_orderkey").alias("question"), (F.col("l_suppkey") % 3).alias("grp"), (F.col("l_linenumber") % 2).alias("combo"), F.col("l_partkey").alias("chunk")).distinct()
    old = cut_lineage(old)
    added = old.where("question % 4 = 0").select("question", "grp", F.lit(9).alias("combo"), F.lit(-1).cast("long").alias("chunk")).distinct()
    replaced = old.where("question % 6 = 1 and combo = 1").select("question", "grp", "combo", F.lit(-2).cast("long").alias("chunk")).distinct()
    return evidence.revision(old, added, replaced)
