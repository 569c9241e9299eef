"""Reachability in forests of references: doubling instead of one step a round."""

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.io import cut_lineage


def ancestors(edges: DataFrame, depth: int | None = None) -> DataFrame:
    """node, ancestor, distance over edges (child, parent): all pairs, least distance; with ``depth`` only those up to so many steps.

    A fixed point: each round joins the pairs found so far with themselves, so the number of rounds is the logarithm of the
    longest way; rounds end when no pair is new or nearer, so loops end too.
    """
    found = cut_lineage(edges.where("child is not null and parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    if not found.groupBy("node").count().where("count > 1").limit(1).count():
        return _chains(found, depth)
    reach, mark = 1, None
    while (depth is None or reach < depth) and mark != (mark := tuple(found.agg(F.count("*"), F.sum("distance")).first())):
        onward = found.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("far"), F.col("distance").alias("more"))
        longer = found.join(onward, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("distance") + F.col("more")).alias("distance"))
        longer = found.union(longer) if depth is None else found.union(longer).where(F.col("distance") <= depth)
        found = cut_lineage(longer.groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        reach *= 2
    return found


def _chains(single: DataFrame, depth: int | None) -> DataFrame:
    """``ancestors`` where no node has two parents: each has one chain, an array that grows by that of its last ancestor. So a pair
    is one number in it, and is moved in no round but as part of it. A chain that comes to an ancestor again has met a loop and
    ends there; chains that have ended wait aside.
    """
    held = cut_lineage(single.select("node", F.array("ancestor").alias("chain")))
    open_, ended, reach = held, None, 1
    while (depth is None or reach < depth) and open_.limit(1).count():
        onward = held.select(F.col("node").alias("__last"), F.col("chain").alias("__more"))
        met = open_.withColumn("__last", F.element_at("chain", -1)).join(onward, "__last", "left")
        longer = F.concat("chain", "__more")
        once = F.array_distinct(longer)
        # a chain goes on if the one behind was as long as it could be by now
        goes = F.col("__more").isNotNull() & (F.size("__more") == reach) & (F.size(once) == F.size(longer))
        grown = cut_lineage(met.select("node", F.coalesce(once, "chain").alias("chain"), F.coalesce(goes, F.lit(False)).alias("__goes")))
        done = grown.where("not __goes").drop("__goes")
        ended = done if ended is None else ended.unionByName(done)
        open_ = grown.where("__goes").drop("__goes")
        held = open_.unionByName(ended)
        reach *= 2
    every = held if depth is None else held.withColumn("chain", F.slice("chain", 1, depth))
    return every.select("node", F.posexplode("chain").alias("__place", "ancestor")).select("node", "ancestor", (F.col("__place") + 1).alias("distance"))


def components(edges: DataFrame) -> DataFrame:
    """node, component over undirected edges (u, v): the smallest node reachable. Each round every node takes the least label
    of its neighbours and then that label's own, until none changes."""
    both = cut_lineage(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels, mark = cut_lineage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("component"))), None
    while mark != (mark := labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]):
        near = both.join(labels.toDF("v", "label"), "v").groupBy(F.col("u").alias("node")).agg(F.min("label").alias("label"))
        nearer = labels.join(near, "node").select("node", F.least("component", "label").alias("component"))
        jump = nearer.toDF("component", "further")
        labels = cut_lineage(nearer.join(jump, "component", "left").select("node", F.coalesce("further", "component").alias("component")))
    return labels


def resolve(pieces: DataFrame, depth: int = 40) -> DataFrame:
    """node, resolved from pieces (node, status, target): INCLUDED resolves, DUPLICATE_ALTERNATIVE does if any of
    its targets does within ``depth`` steps, anything else does not; loops resolve nothing."""
    ends = pieces.where("status = 'INCLUDED'").select(F.col("node").alias("ancestor"), F.lit(True).alias("good")).distinct()
    steps = pieces.where("status = 'DUPLICATE_ALTERNATIVE' and target is not null").select(F.col("node").alias("child"), F.col("target").alias("parent"))
    reached = ancestors(steps, depth).join(ends, "ancestor").select("node", F.lit(True).alias("via")).distinct()
    own = pieces.groupBy("node").agg(F.bool_or(F.col("status") == "INCLUDED").alias("own"))
    return own.join(reached, "node", "left").select("node", (F.col("own") | F.coalesce("via", F.lit(False))).alias("resolved"))


def first_come(claims: DataFrame) -> DataFrame:
    """Of claims (ref, place, item), the refs that get all their items if refs are served by place and an item is given once.

    In rounds: a ref with no open rival before it on any of its items is served, and open rivals of the served are turned away."""
    open_, served = cut_lineage(claims), None
    while open_.limit(1).count():
        first = F.min(F.struct("place", "ref")).over(W.partitionBy("item"))
        ready = open_.withColumn("mine", F.struct("place", "ref") == first).groupBy("ref").agg(F.bool_and("mine").alias("ready")).where("ready").select("ref")
        won = cut_lineage(ready)
        served = won if served is None else served.union(won)
        taken = open_.join(won, "ref", "left_semi").select("item").distinct()
        lost = open_.join(taken, "item", "left_semi").select("ref").distinct()
        open_ = cut_lineage(open_.join(lost, "ref", "left_anti"))
    return served if served is not None else claims.select("ref")
