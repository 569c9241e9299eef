"""Metrics with nulls: a missing value is never zero, and every mean comes with its denominators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cube(metrics: DataFrame, condition: str = "condition", kind: str = "type") -> DataFrame:
    """condition, label, metric, mean, valid_n, processed_n, statuses for all and each type, from the long form
    (condition, type, metric, value, status). ``all`` holds every type; statuses is ``status=n`` joined by commas."""
    parts = metrics.groupingSets([[condition, "metric", "status"], [condition, kind, "metric", "status"]], condition, kind, "metric", "status").agg(
        F.grouping(kind).alias("g"), F.sum("value").alias("s"), F.count("value").alias("valid"), F.count("*").alias("n")
    )
    label = F.when(F.col("g") == 1, "all").otherwise(F.col(kind)).alias("label")
    merged = parts.groupBy(condition, label, "metric").agg(
        F.sum("s").alias("s"), F.sum("valid").alias("valid_n"), F.sum("n").alias("processed_n"), F.array_sort(F.collect_list(F.concat("status", F.lit("="), "n"))).alias("h")
    )
    return merged.select(condition, "label", "metric", F.when(F.col("valid_n") > 0, F.col("s") / F.col("valid_n")).alias("mean"), "valid_n", "processed_n", F.array_join("h", ",").alias("statuses"))


def paired(metrics: DataFrame, key: str, one: str, other: str, tolerance: float = 1e-12) -> DataFrame:
    """metric, paired_n, mean_difference (other - one), higher, equal, lower over keys with both values."""
    sides = metrics.where(F.col("condition").isin(one, other) & F.col("value").isNotNull())
    both = sides.groupBy("metric", key).agg(F.max(F.when(F.col("condition") == one, F.col("value"))).alias("a"), F.max(F.when(F.col("condition") == other, F.col("value"))).alias("b"))
    d = F.col("b") - F.col("a")
    return both.where("a is not null and b is not null").groupBy("metric").agg(
        F.count("*").alias("paired_n"), F.avg(d).alias("mean_difference"), F.count_if(d > tolerance).alias("higher"), F.count_if(F.abs(d) <= tolerance).alias("equal"), F.count_if(d < -tolerance).alias("lower")
    )


def support(verdicts: DataFrame, key: str, empty_is_zero: bool) -> DataFrame:
    """key, n_claims, value, status: share of claims borne out. Without claims: 0 for the oracle, null for faithfulness."""
    rows = verdicts.groupBy(key).agg(F.count("verdict").alias("n_claims"), F.avg("verdict").alias("v"))
    none = F.lit(0.0) if empty_is_zero else F.lit(None).cast("double")
    status = "NO_FACTUAL_CLAIM_ZERO" if empty_is_zero else "N/A_NO_CLAIM"
    return rows.select(key, "n_claims", F.when(F.col("n_claims") == 0, none).otherwise(F.col("v")).alias("value"), F.when(F.col("n_claims") == 0, status).otherwise("OK").alias("status"))


def relevance(cosines: DataFrame, key: str) -> DataFrame:
    """key, value: the mean cosine, zero if and only if all answers are noncommittal; negatives stay."""
    return cosines.groupBy(key).agg((F.avg("cos") * (~F.bool_and(F.col("flag") == 1)).cast("int")).alias("value"))


def abstains(withheld: Column, supplied: Column, unrelated: Column, is_rag: Column, partial: Column, allowed: Column, oracle_all: Column, retrieved_all: Column) -> Column:
    """Withheld, nothing supplied, no unrelated refusal; with retrieval, partial claims must be allowed and borne out."""
    yes = F.lit(True)
    backed = ~is_rag | (partial == 0) | (allowed & F.coalesce(oracle_all, yes) & F.coalesce(retrieved_all, yes))
    return withheld & ~supplied & ~unrelated & backed


def completeness(grid: DataFrame, facts: DataFrame, keys: list[str], checks: dict[str, Column], subject: str) -> DataFrame:
    """subject, reasons: for each subject, the sorted distinct reasons to leave it out, joined by commas.

    A grid row without facts is NOT_ATTEMPTED; ``checks`` are conditions on the facts by reason.
    """
    joined = grid.join(facts.withColumn("there", F.lit(True)), keys, "left")
    reasons = [F.when(F.col("there").isNull(), "NOT_ATTEMPTED"), *[F.when(F.col("there") & c, r) for r, c in checks.items()]]
    rows = joined.select(subject, F.array_compact(F.array(*reasons)).alias("r"))
    return rows.groupBy(subject).agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set("r")))), ",").alias("reasons"))
