"""Stateful streams over the tables: each runs until its input is used up and gives what it has emitted."""

from pyspark.sql import functions as F

from ..sources.io import scratch
from ..streaming import stateful
from .registry import Tables, query

_GAP_US, _DELAY_S = 7_200_000_000, 600


def _emitted(t: Tables, name: str, build):
    """What ``build`` makes of the table as a stream; its checkpoint and sink go with the application."""
    path = f"{t.sf_dir}/{name}.parquet"
    before = {k: t.spark.conf.get(k) for k in stateful.STORE}
    for k, v in stateful.STORE.items():
        t.spark.conf.set(k, v)
    try:
        head, _, last = path.rpartition("/")
        stream = t.spark.readStream.schema(getattr(t, name).schema).parquet(f"{head}/[{last[0]}]{last[1:]}")
        out, sink = build(stream), scratch(t.spark, "stream")
        out.writeStream.format("parquet").option("checkpointLocation", f"{sink}-state").trigger(availableNow=True).start(sink).awaitTermination()
    finally:
        for k, v in before.items():
            t.spark.conf.set(k, v)
    return t.spark.read.schema(out.schema).parquet(sink)


@query(f"""WITH m AS (SELECT ((epoch_us(max(ts)) // 1000) - {_DELAY_S * 1000}) * 1000 AS w FROM events),
e AS (SELECT user_id::VARCHAR AS key, epoch_us(ts) AS us, CASE event_type WHEN 'view' THEN 'idle' WHEN 'error' THEN 'other' ELSE 'request' END AS phase, value FROM events, m WHERE epoch_us(ts) < w),
s AS (SELECT *, us - lag(us) OVER (PARTITION BY key ORDER BY us) AS step FROM e), c AS (SELECT *, coalesce(sum((step > {_GAP_US})::INT) OVER (PARTITION BY key ORDER BY us), 0) AS session FROM s)
SELECT key, min(us) AS start_us, max(us) AS end_us, count(*) AS n, count(*) FILTER (phase = 'idle') AS n_idle, count(*) FILTER (phase = 'request') AS n_active, coalesce(max(step) FILTER (step <= {_GAP_US}), 0)::BIGINT AS widest_us,
 max(value) FILTER (phase = 'request') AS peak, max(value) FILTER (phase = 'idle') AS idle_peak, count(*) FILTER (phase = 'idle') > 0 AND count(*) FILTER (phase = 'request') > 0 AS valid FROM c, m GROUP BY key, session, w HAVING w - max(us) > {_GAP_US}""")
def sampled_sessions(t: Tables):
    """Users' sessions of two hours' gap that the watermark has closed, from a stream of events as samples with phases."""
    phase = F.when(F.col("event_type") == "view", stateful.IDLE).when(F.col("event_type") == "error", "other").otherwise(stateful.ACTIVE)
    return _emitted(t, "events", lambda s: stateful.sessions(s.select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), phase.alias("phase"), F.col("value").alias("level")), _GAP_US, f"{_DELAY_S} seconds"))


@query("""WITH a AS (SELECT DISTINCT l_orderkey::VARCHAR AS key, l_linenumber AS attempt, min(l_linestatus) AS s FROM lineitem WHERE l_linenumber <= 3 GROUP BY ALL),
g AS (SELECT key, list({'attempt': attempt, 'ok': s = 'F'} ORDER BY attempt) AS l FROM a GROUP BY key),
r AS (SELECT key, list_filter(l, lambda x, i: x.attempt = i) AS l FROM g), f AS (SELECT key, l, list_filter(l, lambda x: x.ok)[1].attempt AS ok FROM r)
SELECT key, CASE WHEN ok IS NOT NULL THEN 'OK' ELSE 'STAGE_ATTEMPTS_EXHAUSTED' END AS status, ok::INT AS attempt, CASE WHEN ok IS NOT NULL THEN 'F' || ok END AS parsed, coalesce(ok, 3)::BIGINT AS n_attempts FROM f WHERE ok IS NOT NULL OR len(l) = 3""")
def streamed_attempts(t: Tables):
    """The first valid of three attempts, from a stream of lines in any order; of lines with one number the finished one counts."""
    status = F.when(F.col("l_linestatus") == "F", "OK").otherwise("RETRY")
    rows = lambda s: s.select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("attempt"), status.alias("status"), F.when(status == "OK", F.concat("l_linestatus", "l_linenumber")).alias("parsed"))
    return _emitted(t, "lineitem", lambda s: stateful.first_valid(rows(s))).where("status <> 'CACHED_ATTEMPT_CONTENT_CHANGED'")
