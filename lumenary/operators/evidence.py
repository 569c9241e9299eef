"""Evidence that is sufficient in alternatives: each group needs one of its combinations whole."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(evidence: DataFrame, retrieved: DataFrame) -> DataFrame:
    """question, n_groups, n_hit, recall, complete from rows (question, grp, combo, chunk) and retrieved chunks.

    A group is hit if all chunks of any of its combinations are retrieved. Questions without evidence have no row.
    """
    have = retrieved.select("chunk").distinct().withColumn("have", F.lit(True))
    marked = evidence.join(have, "chunk", "left").withColumn("have", F.coalesce("have", F.lit(False)))
    combos = marked.groupBy("question", "grp", "combo").agg(F.bool_and("have").alias("whole"))
    groups = combos.groupBy("question", "grp").agg(F.bool_or("whole").alias("hit"))
    return groups.groupBy("question").agg(
        F.count("*").alias("n_groups"), F.count_if("hit").alias("n_hit"), F.avg(F.col("hit").cast("int")).alias("recall"), F.bool_and("hit").alias("complete")
    )


def covered(combos: Column, have: Column) -> Column:
    """The same for one group in a row: whether any of its combinations (array of arrays) is within ``have``."""
    return F.exists(combos, lambda c: F.size(F.array_except(c, have)) == 0)


def recall_summary(recalls: DataFrame, kind: str) -> DataFrame:
    """label, n, mean_recall, n_complete, n_none, n_partial for all and for each kind."""
    grouped = recalls.groupingSets([[], [kind]], kind).agg(
        F.grouping(kind).alias("g"), F.count("*").alias("n"), F.avg("recall").alias("mean_recall"), F.count_if("complete").alias("n_complete"),
        F.count_if(F.col("recall") == 0).alias("n_none"), F.count_if((F.col("recall") > 0) & (F.col("recall") < 1)).alias("n_partial"),
    )
    return grouped.select(F.when(F.col("g") == 1, "all").otherwise(F.col(kind)).alias("label"), "n", "mean_recall", "n_complete", "n_none", "n_partial")


def min_cover(evidence: DataFrame) -> DataFrame:
    """question, min_cover: the least size of the union of one combination from each group.

    After each group only distinct unions stay, and of those none that holds another one: a larger union can't end
    smaller. So the work is that of the alternatives that really compete, not of the full product. A question's rows come
    together once, for its combinations, its groups and itself.
    """
    combos = evidence.select("question", "grp", "combo", "chunk").repartition("question").groupBy("question", "grp", "combo").agg(F.array_sort(F.collect_set("chunk")).alias("c"))
    groups = combos.groupBy("question", "grp").agg(F.collect_set("c").alias("cs"))
    rows = groups.groupBy("question").agg(F.collect_list("cs").alias("gs"))

    def least(unions: Column) -> Column:
        # bound by an array of one, else it is worked out anew for each union
        kept = lambda d: F.filter(d, lambda u: ~F.exists(d, lambda v: (F.size(v) < F.size(u)) & (F.size(F.array_except(v, u)) == 0)))
        return F.transform(F.array(F.array_distinct(unions)), kept)[0]

    none = F.array(F.array().cast("array<bigint>"))
    unions = F.aggregate("gs", none, lambda acc, cs: least(F.flatten(F.transform(acc, lambda a: F.transform(cs, lambda c: F.array_sort(F.array_union(a, c)))))))
    return rows.select("question", F.array_min(F.transform(unions, lambda u: F.size(u))).cast("long").alias("min_cover"))


def revised(evidence: DataFrame, added: DataFrame, replaced: DataFrame) -> DataFrame:
    """Evidence (question, grp, combo, chunk) with combinations added and others replaced by new chunks; what is there already is not
    added again."""
    columns = ["question", "grp", "combo", "chunk"]
    kept = evidence.select(*columns).join(replaced.select("question", "grp", "combo").distinct(), ["question", "grp", "combo"], "left_anti")
    return kept.unionByName(replaced.select(*columns)).unionByName(added.select(*columns)).distinct()


def revision(evidence: DataFrame, added: DataFrame, replaced: DataFrame) -> DataFrame:
    """question, before, after, change: the least number of chunks that suffice, before and after, and what was changed. Only
    questions with something added or replaced are worked out again."""
    flags = added.select("question", F.lit(True).alias("is_added"), F.lit(False).alias("is_replaced")).union(replaced.select("question", F.lit(False), F.lit(True)))
    flags = flags.where("question is not null").groupBy("question").agg(F.bool_or("is_added").alias("is_added"), F.bool_or("is_replaced").alias("is_replaced"))
    touched = evidence.join(flags, "question", "left_semi")
    old, new = min_cover(evidence).withColumnRenamed("min_cover", "before"), min_cover(revised(touched, added, replaced)).withColumnRenamed("min_cover", "after")
    both = old.join(new, "question", "left").join(flags, "question", "left")
    change = F.when(F.col("is_added") & F.col("is_replaced"), "ADDED_AND_REPLACED").when(F.col("is_added"), "ADDED").when(F.col("is_replaced"), "REPLACED")
    after = F.when(F.col("is_added").isNotNull(), F.col("after")).when(F.col("question").isNotNull(), F.col("before"))
    return both.select("question", "before", after.alias("after"), change.alias("change"))
