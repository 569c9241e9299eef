"""Half-open intervals [start, end): joins, unions, partitions, differences of ledgers, clusters."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F


def overlap_join(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Pairs of intervals (a0, a1) and (b0, b1) with equal keys that overlap; touching is no overlap.

    Both sides are dealt to buckets of ``width``; a pair is given in the bucket where the overlap starts.
    """

    def dealt(df: DataFrame, lo: str, hi: str) -> DataFrame:
        last = F.greatest(F.col(lo), F.col(hi) - 1)
        return df.where(F.col(hi) > F.col(lo)).withColumn("bucket", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(last / width))))

    pairs = dealt(a, "a0", "a1").join(dealt(b, "b0", "b1"), [*keys, "bucket"])
    first = F.greatest("a0", "b0")
    return pairs.where((first < F.least("a1", "b1")) & (F.floor(first / width) == F.col("bucket"))).drop("bucket")


def union_length(rows: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """key, covered: the length of the union of the intervals."""
    w = W.partitionBy(key).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(W.unboundedPreceding, -1))
    gain = F.greatest(F.lit(0), F.col(end) - F.greatest(F.col(start), F.coalesce(before, F.col(start))))
    return rows.withColumn("gain", gain).groupBy(key).agg(F.sum("gain").alias("covered"))


def is_partition(rows: DataFrame, key: str, length: str) -> DataFrame:
    """key, n, gap_free: whether the pieces (start, end) go from 0 to ``length`` without gap or overlap."""
    w = W.partitionBy(key).orderBy("start", "end")
    fits = F.col("start") == F.coalesce(F.lag("end").over(w), F.lit(0))
    rows = rows.withColumn("fits", fits)
    return rows.groupBy(key).agg(F.count("*").alias("n"), (F.bool_and("fits") & (F.max("end") == F.max(length))).alias("gap_free"))


def pieces(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """key, start, end, one, other: the elementary intervals of two gap-free labellings (start, end, label)."""
    marks = a.select(key, "start", F.col("label").alias("one"), F.lit(None).cast("string").alias("other"), "end").unionByName(
        b.select(key, "start", F.lit(None).cast("string").alias("one"), F.col("label").alias("other"), "end")
    )
    cuts = marks.groupBy(key, "start").agg(F.max("one").alias("one"), F.max("other").alias("other"), F.max("end").alias("end"))
    w = W.partitionBy(key).orderBy("start")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    stop = F.coalesce(F.lead("start").over(w), F.max("end").over(W.partitionBy(key)))
    return cuts.select(key, "start", stop.alias("end"), F.last("one", True).over(so_far).alias("one"), F.last("other", True).over(so_far).alias("other"))


def transitions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """transition, chars: length by ``one -> other`` where the labellings differ."""
    changed = pieces(a, b, key).where(~F.col("one").eqNullSafe(F.col("other")))
    return changed.groupBy(F.concat(F.coalesce("one", F.lit("NONE")), F.lit(" -> "), F.coalesce("other", F.lit("NONE"))).alias("transition")).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("chars"))


def shifted(patches: DataFrame, key: str) -> DataFrame:
    """Patches (start, end, after) with ``shifted``: where each starts once all earlier ones are applied."""
    w = W.partitionBy(key).orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    return patches.withColumn("shifted", F.col("start") + F.coalesce(F.sum(F.length("after") - (F.col("end") - F.col("start"))).over(w), F.lit(0)))


def as_of(points: DataFrame, facts: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """The points with ``last_<value>``: the value of the latest fact at or before each (the largest of a tie)."""
    both = points.withColumn("fact", F.lit(0)).withColumn(value, F.lit(None).cast(facts.schema[value].dataType)).unionByName(facts.withColumn("fact", F.lit(1)), allowMissingColumns=True)
    w = W.partitionBy(key).orderBy(at, F.desc("fact"), value).rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(f"last_{value}", F.last(value, True).over(w)).where("fact = 0").drop("fact", value)


def islands(rows: DataFrame, key: str, order: list[str], starts: Column) -> DataFrame:
    """The rows with ``island``: 1, 2, ... within the key, a new one where ``starts`` holds."""
    w = W.partitionBy(key).orderBy(*order)
    return rows.withColumn("new", F.coalesce(starts, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("new")
