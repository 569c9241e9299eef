"""Greedy sequences over sorted values, in parallel.

"Keep a value if it is far enough from the last one kept" looks sequential. As a function, each value has one successor, the
first value far enough behind it, and what is kept is what the first value reaches. Successors are found in buckets as wide
as the rule, and reached values by pointer doubling: each round joins the jumps with themselves, so rounds grow with the
logarithm of the longest chain. A value with nothing near before it is kept whatever came earlier, so chains begin anew at
each gap, and no key's values meet in one task.
"""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.io import cut_lineage


def _far(later: Column, earlier: Column, apart: float, inclusive: bool) -> Column:
    return later - earlier >= apart if inclusive else later - earlier > apart


def values(rows: DataFrame, key: str, value: str, apart: float) -> DataFrame:
    """key, v, n, bucket: the distinct values with their counts, nulls and NaN left out."""
    found = rows.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return found.groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("bucket", F.floor(F.col("v") / apart))


def gaps(nodes: DataFrame, key: str, apart: float, inclusive: bool = False) -> DataFrame:
    """key, v of the values that have no other within ``apart`` before them. Only the least value of a bucket can be one, and
    only the largest of the bucket before it matters."""
    ends = nodes.groupBy(key, "bucket").agg(F.min("v").alias("v"), F.max("v").alias("last"))
    before = ends.select(key, (F.col("bucket") + 1).alias("bucket"), F.col("last").alias("before"))
    return ends.join(before, [key, "bucket"], "left").where(F.col("before").isNull() | _far(F.col("v"), F.col("before"), apart, inclusive)).select(key, "v")


def _successors(nodes: DataFrame, key: str, apart: float, inclusive: bool) -> DataFrame:
    """key, v, jump: the first value far enough behind each, null if a gap comes first. It lies in the bucket of v + apart or is
    the least of the one behind; a bucket holds the values of one stretch as wide as the rule."""
    at = F.col("v") + apart
    none = F.lit(None).cast(nodes.schema["v"].dataType)
    probes = nodes.select(key, F.floor(at / apart).alias("bucket"), at.alias("pos"), F.lit(1).alias("probe"), "v", none.alias("u"))
    known = nodes.select(key, "bucket", F.col("v").alias("pos"), F.lit(0).alias("probe"), none.alias("v"), F.col("v").alias("u"))
    w = W.partitionBy(key, "bucket").orderBy("pos", "probe")
    # the last value up to v + apart counts too: rounding can put it on the far side
    met = probes.unionByName(known).withColumn("ahead", F.max("u").over(w.rowsBetween(W.unboundedPreceding, 0))).withColumn("behind", F.min("u").over(w.rowsBetween(1, W.unboundedFollowing)))
    met = met.where("probe = 1")
    least = nodes.groupBy(key, "bucket").agg(F.min("v").alias("next_least")).select(key, (F.col("bucket") - 1).alias("bucket"), "next_least")
    options = [F.when(_far(F.col(c), F.col("v"), apart, inclusive), F.col(c)) for c in ("ahead", "behind", "next_least")]
    return met.join(least, [key, "bucket"], "left").select(key, "v", F.least(*options).alias("jump"))


def starts(rows: DataFrame, key: str, value: str, apart: float, inclusive: bool = False) -> DataFrame:
    """key, value of the values that the greedy rule keeps: the least one, then each that is more than ``apart`` (with
    ``inclusive`` at least) from the last one kept. Repeated values count once; keys without values have no row."""
    nodes = cut_lineage(values(rows, key, value, apart))
    first = gaps(nodes, key, apart, inclusive).withColumn("kept", F.lit(True))
    chains = cut_lineage(_successors(nodes, key, apart, inclusive).join(first, [key, "v"], "left").select(key, "v", "jump", F.coalesce("kept", F.lit(False)).alias("kept")))
    while chains.where("kept and jump is not null").limit(1).count():
        reached = chains.where("kept and jump is not null").select(key, F.col("jump").alias("v"), F.lit(True).alias("reached")).distinct()
        onward = chains.select(key, F.col("v").alias("jump"), F.col("jump").alias("further"))
        moved = chains.join(onward, [key, "jump"], "left").select(key, "v", F.col("further").alias("jump"), "kept")
        chains = cut_lineage(moved.join(reached, [key, "v"], "left").select(key, "v", "jump", (F.col("kept") | F.coalesce("reached", F.lit(False))).alias("kept")))
    return chains.where("kept").select(key, F.col("v").alias(value))


def last_at(points: DataFrame, marks: DataFrame, key: str, at: str, mark: str, width: float) -> DataFrame:
    """The points with ``mark``: the largest mark (key, mark) at or before each; null if there is none. Points meet the marks of
    their own bucket; of all earlier buckets only the last mark counts, and that is carried over one row a bucket."""
    place = points.withColumn("__b", F.floor(F.col(at) / width))
    own = marks.select(key, F.col(mark).alias("__m"), F.floor(F.col(mark) / width).alias("__b")).distinct()
    asked = place.select(key, "__b").distinct().withColumn("__last", F.lit(None).cast(marks.schema[mark].dataType))
    steps = own.groupBy(key, "__b").agg(F.max("__m").alias("__last")).unionByName(asked).groupBy(key, "__b").agg(F.max("__last").alias("__last"))
    before = steps.select(key, "__b", F.last("__last", True).over(W.partitionBy(key).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    listed = own.groupBy(key, "__b").agg(F.array_sort(F.collect_list("__m")).alias("__own"))
    met = place.join(before, [key, "__b"], "left").join(listed, [key, "__b"], "left")
    here = F.array_max(F.filter("__own", lambda m: m <= F.col(at)))
    return met.withColumn(mark, F.coalesce(here, "__before")).drop("__b", "__before", "__own")


def clusters(rows: DataFrame, key: str, value: str, width: float) -> DataFrame:
    """key, anchor, n: sorted values join a cluster while they are less than ``width`` from its first member."""
    nodes = values(rows, key, value, width).drop("bucket")
    anchors = starts(rows, key, value, width, inclusive=True).withColumnRenamed(value, "anchor")
    return last_at(nodes, anchors, key, "v", "anchor", width).groupBy(key, "anchor").agg(F.sum("n").alias("n"))
