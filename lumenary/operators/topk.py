"""Exact top-k by inner product with deterministic ties."""

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from ..sources.io import scratch

ROWS, QUERIES = 1_024, 2_048


def exact_top_k(queries: DataFrame, rows: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """query_id, rank, id, score: of all rows, the k with the largest inner product, ties to the smaller id.

    Both sides have id and v (array). Rows stay where they are: queries come to them in blocks of bounded size, one after
    another, each as matrix products batch by batch, and a task gives k rows a query to the merge. With more than one block each
    one's result is written before the next is read, so the driver holds one block, however many there are. Scores count to
    ``digits`` decimals. Queries without a row, and null vectors, have no result.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark, schema = queries.sparkSession, "query_id long, id long, score double"
    asked = queries.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    own = rows.where("v is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v"))
    blocks = max(1, math.ceil(asked.count() / QUERIES))
    path = scratch(spark, "topk") if blocks > 1 else ""
    for i in range(blocks):
        block = (asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i)).collect()  # about QUERIES vectors
        if not block and blocks > 1:
            continue
        found = own.mapInPandas(_best([r.id for r in block], np.array([r.v for r in block], float), k, digits), schema) if block else spark.createDataFrame([], schema)
        order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        out = found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "score")
        if blocks == 1:
            return out
        out.write.mode("append").parquet(path)  # the block's vectors go before the next ones come
    return spark.read.schema("query_id long, rank long, id long, score double").parquet(path)


def _best(asked: list[int], vectors: np.ndarray, k: int, digits: int):
    """Of a task's rows, the k best of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, scores = np.empty((len(asked), 0), np.int64), np.empty((len(asked), 0))
        for whole in batches:
            for at in range(0, len(whole), ROWS):
                b = whole.iloc[at : at + ROWS]
                new = np.round(vectors @ np.stack(b.v.to_numpy()).astype(float).T, digits)
                scores = np.hstack([scores, new])
                ids = np.hstack([ids, np.broadcast_to(b.id.to_numpy(), new.shape)])
                best = np.lexsort((ids, -scores), axis=1)[:, :k]
                ids, scores = np.take_along_axis(ids, best, 1), np.take_along_axis(scores, best, 1)
        yield pd.DataFrame({"query_id": np.repeat(asked, ids.shape[1]), "id": ids.ravel(), "score": scores.ravel()}).astype({"query_id": "int64"})

    return run


def single_top_k(query: list[float], rows: DataFrame, k: int, digits: int = 9) -> DataFrame:
    """The same for one given vector: one pass, k rows a task."""
    from ..functions.vectors import dot

    norm = math.sqrt(sum(x * x for x in query))
    if k < 1 or not abs(norm - 1) <= 2e-6:
        raise ValueError("k must be 1 or more and the query a finite unit vector")
    return rows.select("id", F.round(dot(F.col("v"), F.lit(query)), digits).alias("score")).orderBy(F.desc("score"), "id").limit(k)
