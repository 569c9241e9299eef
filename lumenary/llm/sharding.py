"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard. At each level every child draws -ln(u) / weight, u being a
hash of the row's key and the child's name; the smallest draw wins, so a child gets rows in
proportion to its weight. If one child's weight grows, its draws only shrink: rows move into its
subtree and nowhere else. A shard that is added comes as a region of its own, so that no
existing shard receives rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import bucket_count, materialize

REGION, RACK, BASE = 8, 4, 24


def topology(shards: int, base: int = BASE) -> list[list[list[int]]]:
    """Shard numbers as regions of racks. The first ``base`` fill regions of 8 shards in racks of 4; each
    later one is a region of its own. Growth from ``base`` or more therefore moves rows only into the new shard."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    full = min(shards, base)
    regions = [[[*range(r, min(r + RACK, g + REGION, full))] for r in range(g, min(g + REGION, full), RACK)] for g in range(0, full, REGION)]
    return regions + [[[n]] for n in range(full, shards)]


def _size(node) -> int:
    return 1 if isinstance(node, int) else sum(map(_size, node))


def with_shard(rows: DataFrame, key: str, trees: dict[str, list], weight=_size) -> DataFrame:
    """The rows with, for each named tree, the shard of their key (SQL); ``weight`` gives a node's weight, its number of shards
    unless stated.

    Level by level the node's children draw; children are named by level and number, so a subtree that is
    appended leaves the others' draws as they were, and trees share draws. All draws are plain columns, which are compiled;
    then each node's winner; then the way down. The number of columns is that of the trees' nodes.
    """
    draws: dict[str, str] = {}
    winners: dict[str, str] = {}
    ways: list[str] = []
    for name, tree in trees.items():

        def down(node, level: int, number: int, firsts: list[int]) -> str:
            """The shard below a node, from the winners' columns."""
            if isinstance(node, int):
                return str(node)
            first = firsts[level]
            firsts[level] += len(node)
            own = []
            for i, child in enumerate(node):
                w = float(weight(child))
                own.append(f"__draw_{level}_{first + i}_{w:g}".replace(".", "_"))
                draws[own[-1]] = f"-ln((shiftrightunsigned(xxhash64({key}, {level}, {first + i}), 11) + 0.5D) / {float(1 << 53)!r}D) / {w!r}D"
            below = [down(child, level + 1, first + i, firsts) for i, child in enumerate(node)]
            if len(node) == 1:
                return below[0]
            won = f"__won_{name}_{level}_{number}"
            least = f"least({', '.join(own)})"
            winners[won] = f"CASE {' '.join(f'WHEN {d} = {least} THEN {i}' for i, d in enumerate(own))} END"
            out = f"CASE {won} {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(below))} END"
            return out

        ways.append(f"int({down(tree, 0, 0, [0] * 8)}) AS {name}")
    names = [f"`{c}`" for c in rows.columns]
    drawn = rows.selectExpr(*names, *[f"{x} AS {n}" for n, x in draws.items()])
    return drawn.selectExpr(*names, *[f"{x} AS {n}" for n, x in winners.items()]).selectExpr(*names, *ways)


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    Law ``key``: doc_id and the number of shards decide. Size is the text's UTF-8 bytes plus 8; a null
    text has none and crc32 0. Null doc_ids share one shard; repeated rows get slots of their own, in any order; very long
    texts are only measured. An empty table gives an empty result; other columns are ignored.
    The texts are read once; the narrow rows are written with numbers of their own. Slots are ranks by bucket
    and doc_id: a shard's rows are dealt to buckets, identical ones too, whose counts give offsets within
    the shard, and only rows of one bucket are sorted together. Buckets grow as the square root of the rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 8).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = with_shard(rows, "doc_id", {"shard": topology(shards), "grown_shard": topology(shards + 1, max(BASE, shards))})
    dealt = materialize(rows.withColumn("number", F.monotonically_increasing_id()), "shards")
    sizes = {r.shard: r.c for r in dealt.groupBy("shard").agg(F.count("*").alias("c")).collect()}  # one row a shard
    buckets = F.expr(f"element_at(array({','.join(str(bucket_count(sizes.get(i, 0))) for i in range(shards))}), shard + 1)")
    dealt = dealt.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "number"), buckets))
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("shard", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size", "number")) - 1
    placed = dealt.withColumn("rank", rank).join(offsets, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("offset") + F.col("rank")).alias("slot"), "grown_shard")
