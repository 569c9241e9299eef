"""Dispositions of text pieces, decisions, patches and reviews."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import running


def lines(docs: DataFrame, key: str, text: str, *more: str) -> DataFrame:
    """key, line_no, start, end, line: a text's lines with their line ends, a gap-free partition of its characters.
    Places are worked out within the text's row, so that no line is shuffled for them."""
    placed = lambda l: F.arrays_zip(l.alias("line"), running(F.transform(l, lambda x: F.length(x) + 1)).alias("next"))
    split = F.transform(F.array(F.split(F.col(text), "\n")), placed)[0]
    whole = docs.where(F.col(text).isNotNull()).select(key, *more, F.length(text).alias("length"), split.alias("__lines"))  # else the length is counted anew for each line
    rows = whole.select(key, *more, "length", F.posexplode_outer("__lines").alias("line_no", "__at"))  # a text has a line; an inner one would filter by its size first
    rows = rows.select(key, *more, "length", "line_no", F.col("__at")["line"].alias("line"), F.col("__at")["next"].cast("long").alias("next"))
    return rows.select(key, *more, "length", "line_no", "line", (F.col("next") - F.length("line") - 1).alias("start"), F.least(F.col("next"), F.col("length").cast("long")).alias("end"))


def disposition(out_of_scope: Column, blank: Column, claimed: Column, represented: Column, decision: Column) -> Column:
    """A piece's status by priority; a decision other than PREFERRED comes last but for review."""
    return (
        F.when(out_of_scope, "EXCLUDED_BY_SCOPE").when(blank, "LAYOUT_ONLY").when(claimed, "INCLUDED").when(represented, "DUPLICATE_ALTERNATIVE")
        .when(decision.isNotNull() & (decision != "PREFERRED"), decision).otherwise("NEEDS_REVIEW")
    )


def decide(decisions: DataFrame, key: str) -> DataFrame:
    """key, state, reasons from rows (key, state, reason): PREFERRED yields to any other; two distinct others are a conflict."""
    sets = decisions.groupBy(key).agg(F.collect_set("state").alias("all"), F.array_sort(F.collect_set("reason")).alias("reasons"))
    final = F.array_except("all", F.array(F.lit("PREFERRED")))
    state = F.when(F.size(final) == 0, "PREFERRED").when(F.size(final) == 1, final[0]).otherwise("NEEDS_REVIEW")
    return sets.select(key, state.alias("state"), F.array_join("reasons", "; ").alias("reasons"))


def patch_errors(patches: DataFrame, records: DataFrame) -> DataFrame:
    """code, n over a ledger (id, record_id, start, end, before, after) against records (record_id, text)."""
    w = W.partitionBy("record_id").orderBy("start", "end", "id")
    rows = patches.join(records, "record_id", "left").withColumn("previous", F.lag("end").over(w)).withColumn("times", F.count("*").over(W.partitionBy("id")))
    span = F.col("end") - F.col("start")
    inside = F.col("text").isNotNull() & (F.col("start") >= 0) & (span > 0) & (F.col("end") <= F.length("text"))
    found = {
        "DUPLICATE_ID": F.col("times") > 1, "NO_RECORD": F.col("text").isNull(), "OUT_OF_RANGE": F.col("text").isNotNull() & ~inside,
        "BEFORE_MISMATCH": inside & (F.substring(F.col("text"), F.col("start") + 1, span) != F.col("before")), "NO_CHANGE": F.col("before") == F.col("after"),
        "CARRIAGE_RETURN": F.col("after").contains("\r"), "OVERLAP": F.col("start") < F.col("previous"),
    }
    codes = F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()]))
    return rows.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("n"))


def close_reviews(reviews: DataFrame, normal: Column, owned: Column, unchanged: Column) -> tuple[DataFrame, DataFrame]:
    """(closed, active): a review of a normal code with an owner and unchanged sources is closed."""
    done = F.coalesce(normal & owned & unchanged, F.lit(False))
    return reviews.where(done).withColumn("status", F.lit("CLOSED")), reviews.where(~done)


def unclaimed(rows: DataFrame, claims: DataFrame, *keys: str) -> DataFrame:
    """The rows that no claim uses."""
    return rows.join(claims.select(*keys).distinct(), list(keys), "left_anti")


def first_of(rows: DataFrame, text: str, place: str) -> DataFrame:
    """The rows with ``is_first``: whether ``place`` is the least of those with the same text. Only digests of texts are grouped,
    and only those that occur more than once are joined back."""
    digest = F.struct(F.sha2(F.col(text), 256).alias("sha"), F.length(text).alias("n"))
    keyed = rows.withColumn("__d", digest)
    repeated = keyed.groupBy("__d").agg(F.count("*").alias("__c"), F.min(place).alias("__first")).where("__c > 1").drop("__c")
    return keyed.join(repeated, "__d", "left").withColumn("is_first", F.coalesce(F.col(place) == F.col("__first"), F.lit(True))).drop("__d", "__first")
