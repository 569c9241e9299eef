"""Metric, pairing, timing, schedule and attempt queries."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import exact, metrics, schedule
from ..operators.intervals import islands
from .registry import Tables, query


@query("""WITH m AS (SELECT lang AS condition, source AS type, unnest(['quality', 'toxic']) AS metric, unnest([quality, toxic])::DOUBLE AS value FROM documents LEFT JOIN labels USING (doc_id)),
h AS (SELECT condition, CASE WHEN grouping(type) = 1 THEN 'all' ELSE type END AS label, metric, CASE WHEN value IS NULL THEN 'N/A' ELSE 'OK' END AS status, sum(value) AS s, count(value) AS v, count(*) AS n
 FROM m GROUP BY GROUPING SETS ((condition, metric, status), (condition, type, metric, status)))
SELECT condition, label, metric, round(sum(s) / sum(v), 6) AS mean, sum(v)::BIGINT AS valid_n, sum(n)::BIGINT AS processed_n, string_agg(status || '=' || n, ',' ORDER BY status) AS statuses FROM h GROUP BY ALL""")
def metric_cube_nullable(t: Tables):
    rows = t.documents.join(t.labels, "doc_id", "left").select(F.col("lang").alias("condition"), F.col("source").alias("type"), "quality", "toxic")
    long = rows.unpivot(["condition", "type"], ["quality", "toxic"], "metric", "value").withColumn("value", F.col("value").cast("double"))
    long = long.withColumn("status", F.when(F.col("value").isNull(), "N/A").otherwise("OK"))
    return metrics.cube(long).withColumn("mean", F.round("mean", 6))


@query("""WITH g AS (SELECT l_partkey AS k, l_returnflag AS c, [avg(l_discount), avg(l_tax), avg(l_quantity)] AS vs FROM lineitem GROUP BY l_partkey, l_returnflag),
m AS (SELECT k, c, unnest(['discount', 'tax', 'quantity']) AS metric, unnest(vs) AS value FROM g),
p AS (SELECT metric, max(value) FILTER (c = 'R') - max(value) FILTER (c = 'A') AS d FROM m GROUP BY metric, k)
SELECT metric, count(d) AS paired_n, round(avg(d), 6) AS mean_difference, count(*) FILTER (d > 1e-9) AS higher, count(*) FILTER (abs(d) <= 1e-9) AS equal, count(*) FILTER (d < -1e-9) AS lower FROM p GROUP BY metric""")
def paired_difference(t: Tables):
    rows = t.lineitem.groupBy("l_partkey", F.col("l_returnflag").alias("condition")).agg(F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.avg("l_quantity").alias("quantity"))
    long = rows.unpivot(["l_partkey", "condition"], ["discount", "tax", "quantity"], "metric", "value")
    return metrics.paired(long, "l_partkey", "A", "R", 1e-9).withColumn("mean_difference", F.round("mean_difference", 6))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS condition, median(l_extendedprice) AS x FROM lineitem GROUP BY ALL)
SELECT condition, count(*) AS n, round(quantile_cont(x, 0.5), 4) AS median, round(quantile_cont(x, 0.95), 4) AS p95 FROM r GROUP BY condition""")
def timing_median_of_rounds_p95(t: Tables):
    rounds = t.lineitem.groupBy("l_orderkey", F.col("l_returnflag").alias("condition")).agg(F.median("l_extendedprice").alias("x"))
    return exact.percentiles(rounds, ["condition"], "x", {"median": 0.5, "p95": 0.95}).withColumns({"median": F.round("median", 4), "p95": F.round("p95", 4)})


@query("""WITH g AS (SELECT o_orderkey AS q, unnest(['A', 'N', 'R']) AS c FROM orders),
f AS (SELECT l_orderkey AS q, l_returnflag AS c, bool_or(l_linestatus = 'F') AS bad, max(l_discount) > 0.09 AS odd FROM lineitem GROUP BY ALL),
r AS (SELECT g.q, unnest(list_filter([CASE WHEN f.q IS NULL THEN 'NOT_ATTEMPTED' END, CASE WHEN bad THEN 'GENERATION_FAILURE' END, CASE WHEN odd THEN 'TIMING_ANOMALY' END, ''], lambda x: x IS NOT NULL)) AS reason FROM g LEFT JOIN f USING (q, c)),
s AS (SELECT q, coalesce(string_agg(DISTINCT reason, ',' ORDER BY reason) FILTER (reason <> ''), '') AS reasons FROM r GROUP BY q)
SELECT reasons, count(*) AS n FROM s GROUP BY reasons""")
def timing_exclusion_reasons(t: Tables):
    grid = t.orders.select(F.col("o_orderkey").alias("q"), F.explode(F.array(*map(F.lit, "ANR"))).alias("c"))
    facts = t.lineitem.groupBy(F.col("l_orderkey").alias("q"), F.col("l_returnflag").alias("c")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("bad"), (F.max("l_discount") > 0.09).alias("odd"))
    checks = {"GENERATION_FAILURE": F.col("bad"), "TIMING_ANOMALY": F.col("odd")}
    return metrics.completeness(grid, facts, ["q", "c"], checks, "q").groupBy("reasons").agg(F.count("*").alias("n"))


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


@query("""WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, count(*) AS n, coalesce(max(gap), 0)::BIGINT AS max_gap_us, round(median(value) FILTER (event_type = 'view'), 6) AS idle_median, max(value) FILTER (event_type = 'purchase') AS peak,
 count(*) FILTER (event_type = 'view') > 0 AND count(*) FILTER (event_type = 'purchase') > 0 AND count(*) FILTER (event_type = 'error') = 0 AS valid FROM e GROUP BY user_id""")
def sample_gap_rollup(t: Tables):
    rows = t.events.withColumn("us", _micros())
    rows = rows.withColumn("gap", F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("ts", "event_id")))
    kind = F.col("event_type")
    return rows.groupBy("user_id").agg(
        F.count("*").alias("n"), F.coalesce(F.max("gap"), F.lit(0)).alias("max_gap_us"), F.round(F.median(F.when(kind == "view", F.col("value"))), 6).alias("idle_median"),
        F.max(F.when(kind == "purchase", F.col("value"))).alias("peak"), ((F.count_if(kind == "view") > 0) & (F.count_if(kind == "purchase") > 0) & (F.count_if(kind == "error") == 0)).alias("valid"),
    )


@query("""WITH b AS (SELECT c_custkey AS q, row_number() OVER (ORDER BY sha256('42|' || c_custkey), c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer),
r AS (SELECT *, unnest([1, 2, 3]) AS round FROM b), p AS (SELECT *, CASE WHEN round = 2 THEN n - 1 - pos ELSE pos END AS place FROM r), h AS (SELECT *, unnest([0, 1]) AS half FROM p),
c AS (SELECT *, CASE WHEN (half = 0) = ((place + round - 1) % 2 = 0) THEN 'LLM_ONLY' ELSE 'RAG' END AS condition FROM h)
SELECT ((round - 1) * 2 * n + 2 * place + half + 1)::BIGINT AS sequence, round::BIGINT AS round, q AS question_id, condition, 'r' || round || '-' || q || '-' || lower(condition) AS key FROM c""")
def paired_schedule(t: Tables):
    return schedule.paired_schedule(t.customer.select(F.col("c_custkey").alias("question_id")))


_ATTEMPTS = """WITH a AS (SELECT user_id, event_type AS stage, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS attempt, CASE WHEN value > 15 THEN 'OK' ELSE 'ERROR' END AS status, event_id AS parsed, value FROM events) """


def _attempts(t: Tables):
    w = W.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return t.events.select("user_id", F.col("event_type").alias("stage"), F.row_number().over(w).cast("long").alias("attempt"), F.when(F.col("value") > 15, "OK").otherwise("ERROR").alias("status"), F.col("event_id").alias("parsed"), "value")


@query(_ATTEMPTS + "SELECT user_id || '/' || stage AS k, min(attempt) FILTER (status = 'OK') AS attempt, arg_min(parsed, attempt) FILTER (status = 'OK') AS parsed, count(*) AS n_attempts FROM a WHERE attempt <= 3 GROUP BY 1")
def first_valid_attempt(t: Tables):
    return schedule.first_valid(_attempts(t).withColumn("k", F.concat_ws("/", "user_id", "stage")), "k")


@query(_ATTEMPTS + "SELECT stage, count(*) AS attempts, count(*) FILTER (status = 'OK') AS responses, sum(floor(value))::BIGINT AS tokens FROM a WHERE attempt <= 3 GROUP BY stage")
def attempt_usage(t: Tables):
    return _attempts(t).where("attempt <= 3").groupBy("stage").agg(F.count("*").alias("attempts"), F.count_if(F.col("status") == "OK").alias("responses"), F.sum(F.floor("value")).alias("tokens"))


@query("SELECT conv_id, role, count(DISTINCT text) AS n_texts, count(DISTINCT text) > 1 AS varies FROM conversations GROUP BY conv_id, role")
def answer_variation(t: Tables):
    return t.conversations.groupBy("conv_id", "role").agg(F.countDistinct("text").alias("n_texts"), (F.countDistinct("text") > 1).alias("varies"))


@query("""WITH f AS (SELECT source, doc_id, min(doc_id) OVER w AS lo, max(doc_id) OVER w AS hi FROM documents WINDOW w AS (PARTITION BY source)),
r AS (SELECT *, (doc_id = lo OR doc_id = hi)::INT AS edge FROM f)
SELECT source, doc_id, edge FROM r QUALIFY row_number() OVER (PARTITION BY source ORDER BY edge DESC, sha256('sample|' || source || '|' || doc_id), doc_id) <= 5""")
def stratified_sample(t: Tables):
    return schedule.stratified(t.documents.select("source", "doc_id"), "source", "doc_id").select("source", "doc_id", "edge")


@query("""WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS cond, l_linestatus, (l_discount > 0.03)::INT AS verdict FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_returnflag = 'R')
SELECT k, count(l_linestatus) AS n_claims, CASE WHEN count(l_linestatus) = 0 THEN 0 ELSE round(avg(verdict) FILTER (l_linestatus IS NOT NULL), 6) END AS value,
 CASE WHEN count(l_linestatus) = 0 THEN 'NO_FACTUAL_CLAIM_ZERO' ELSE 'OK' END AS status FROM c GROUP BY k""")
def support_ratio(t: Tables):
    claims = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), (F.col("l_discount") > 0.03).cast("int").alias("verdict"))
    rows = t.orders.select(F.col("o_orderkey").alias("k")).join(claims, "k", "left")
    return metrics.support(rows, "k", True).withColumn("value", F.round("value", 6))


@query("""WITH v AS (SELECT l_orderkey AS k, bool_or(l_linestatus = 'F') AS w, bool_and(l_discount > 0.08) AS s, bool_and(l_tax > 0.07) AS u, count(*) FILTER (l_returnflag = 'R') AS n,
 bool_and(l_quantity > 1) AS a, bool_and(l_discount > 0.01) FILTER (l_returnflag = 'R') AS o, bool_and(l_tax > 0.01) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY k)
SELECT k, w AND NOT s AND NOT u AND (k % 2 = 0 OR n = 0 OR (a AND coalesce(o, true) AND coalesce(r, true))) AS abstains FROM v""")
def correct_abstention(t: Tables):
    claim = F.col("l_returnflag") == "R"
    v = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(
        F.bool_or(F.col("l_linestatus") == "F").alias("w"), F.bool_and(F.col("l_discount") > 0.08).alias("s"), F.bool_and(F.col("l_tax") > 0.07).alias("u"), F.count_if(claim).alias("n"),
        F.bool_and(F.col("l_quantity") > 1).alias("a"), F.bool_and(F.when(claim, F.col("l_discount") > 0.01)).alias("o"), F.bool_and(F.when(claim, F.col("l_tax") > 0.01)).alias("r"),
    )
    c = F.col
    return v.select("k", metrics.abstains(c("w"), c("s"), c("u"), c("k") % 2 != 0, c("n"), c("a"), c("o"), c("r")).alias("abstains"))


@query("""WITH e AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
s AS (SELECT *, sum((gap IS NULL OR gap > 21600000000)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM e)
SELECT user_id, count(DISTINCT island) AS n_sessions, max(n)::BIGINT AS longest FROM (SELECT user_id, island, count(*) AS n FROM s GROUP BY ALL) GROUP BY user_id""")
def gap_sessions(t: Tables):
    rows = t.events.withColumn("us", _micros())
    gap = F.col("us") - F.lag("us").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    found = islands(rows.withColumn("gap", gap), "user_id", ["ts", "event_id"], F.col("gap") > 21_600_000_000)
    return found.groupBy("user_id", "island").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))


@query("SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def event_tumbling(t: Tables):
    from ..streaming.rollups import tumbling

    rows = tumbling(t.events, "ts", "1 hour", "event_type")
    return rows.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"), "total": F.round("total", 4)})
