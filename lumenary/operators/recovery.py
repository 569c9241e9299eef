"""Judged stages recovered from stored attempts whose quotes don't stand in their sources as they are."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.diffs import repaired_quote
from ..functions.text import quoted

#: The error that a repair can mend, and the state of a metric that it has mended.
ERROR, RECOVERED = "UNVERIFIABLE_SOURCE_QUOTE", "OK_SOURCE_QUOTE_RECONSTRUCTED"


def repaired(attempts: DataFrame, sources: DataFrame) -> DataFrame:
    """key, stage, attempt, statement, quote, source_id, before, after: every quote of the attempts (key, stage, attempt, statements:
    array of (statement, verdict, evidence_ids, evidence_quotes)) as its source (key, stage, source_id, text) has it.

    after is null where the source is unknown or the quote can't be repaired. Nothing but quotes is changed. A quote meets its
    own source by key, so a source's text goes to its quotes, and to no others.
    """
    each = attempts.select("key", "stage", "attempt", F.posexplode("statements").alias("statement", "s"))
    quotes = each.select("key", "stage", "attempt", "statement", F.posexplode(F.arrays_zip(F.col("s.evidence_ids").alias("source_id"), F.col("s.evidence_quotes").alias("before"))).alias("quote", "q"))
    rows = quotes.select("key", "stage", "attempt", "statement", "quote", "q.source_id", "q.before").join(sources, ["key", "stage", "source_id"], "left")
    fixed = rows.withColumn("after", repaired_quote("before", "text"))
    return fixed.withColumn("after", F.when(quoted(F.col("text"), F.col("after")), F.col("after"))).drop("text")


def recover(attempts: DataFrame, claims: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stages, changes): for each key and stage the first attempt that repairs can mend, with its score recomputed.

    attempts: key, stage, attempt, error, complete, intact (its stored hash still fits), statements; claims: key, claims (in order).
    Only complete attempts with the one error count, and one that isn't intact is an error when it is read. An attempt is
    mended if its statements are the claims, each has as many quotes as sources, all sources are known, all quotes stand in
    them once repaired, and at least one had to be. stages: key, stage, attempt, score (share of statements borne out), status,
    statements with the new quotes; changes: key, stage, attempt, statement, quote, source_id, before, after.
    """
    sound = F.when(F.col("intact"), True).otherwise(F.raise_error(F.concat(F.lit("a stored attempt was changed: "), F.col("key").cast("string"), F.lit("/"), F.col("attempt").cast("string"))).cast("boolean"))
    asked = attempts.where((F.col("error") == ERROR) & F.col("complete")).where(sound).join(claims, "key")
    even = F.forall("statements", lambda s: F.size(s["evidence_ids"]) == F.size(s["evidence_quotes"]))
    fits = asked.where((F.transform("statements", lambda s: s["statement"]) == F.col("claims")) & even & (F.size("statements") > 0))
    quotes = repaired(fits, sources)
    changed = ~F.col("before").eqNullSafe(F.col("after"))
    whole = quotes.groupBy("key", "stage", "attempt").agg(
        F.count_if(F.col("after").isNull()).alias("lost"), F.count_if(changed).alias("n_changes"),
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("/", "statement", "quote").alias("k"), F.coalesce("after", F.lit("")).alias("v")))).alias("new"),
    )
    first = whole.where("lost = 0 and n_changes > 0").groupBy("key", "stage").agg(F.min_by(F.struct("attempt", "n_changes", "new"), "attempt").alias("m")).select("key", "stage", "m.*")
    met = first.join(fits, ["key", "stage", "attempt"])
    quote = lambda i, j: F.element_at("new", F.concat_ws("/", i.cast("string"), j.cast("string")))
    rebuilt = F.transform("statements", lambda s, i: s.withField("evidence_quotes", F.transform(s["evidence_quotes"], lambda q, j: quote(i, j))))
    verdicts = F.aggregate("statements", F.lit(0).cast("long"), lambda a, s: a + s["verdict"].cast("long"))
    stages = met.select("key", "stage", "attempt", (verdicts / F.size("statements")).alias("score"), F.lit(RECOVERED).alias("status"), F.col("n_changes"), rebuilt.alias("statements"))
    return stages, quotes.where(changed).join(first.select("key", "stage", "attempt"), ["key", "stage", "attempt"], "left_semi")


def corrected(metrics: DataFrame, stages: DataFrame) -> DataFrame:
    """Metrics (key, metric, value, status) with the recovered stages' scores and states in place of their errors; others as they are."""
    new = stages.select("key", F.col("stage").alias("metric"), F.col("score").alias("__score"), F.col("status").alias("__status"))
    rows = metrics.join(new, ["key", "metric"], "left")
    return rows.select("key", "metric", F.coalesce("__score", "value").alias("value"), F.coalesce("__status", "status").alias("status"))
