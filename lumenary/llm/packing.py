"""Packing by minimum bin slack.

Each document's ids are cut into full windows and one rest. Only the number of pieces of each length
is planned: a bitset subset-sum dynamic program finds the multiset of remaining lengths whose sum
comes closest to the capacity, backtracking gives how many pieces of each length it takes, and the
pattern is repeated while its lengths last. The plan is bounded by the capacity, not by the corpus.
Every piece then finds its sequence from its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import bucket_count, materialize, texts

CAPACITY, END_ID = 2048, 1
_MARK = "<|endoftext|>"


@lru_cache(maxsize=2)
def _encoder(path: str | None):
    import base64
    import json
    import os

    import public_tokenizers as P
    import tiktoken

    ranks_path = path or P.path("byte_bpe_50k.tiktoken")
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(os.path.splitext(ranks_path)[0] + ".json", encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens=special), special


def encode(text: str, path: str | None = None) -> np.ndarray:
    """The ids that the byte-level tokenizer file gives; its special token's own string counts as that token."""
    encoding, special = _encoder(path)
    if any(s in text for s in special):
        return np.array(encoding.encode(text, allowed_special="all"), "<u4")
    return np.array(encoding.encode_ordinary(text), "<u4")


def _pieces(capacity: int, end_id: int, path: str | None):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])

    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.append(encode((t.as_py() or b"").decode("utf-8", "replace"), path), np.uint32(end_id)).astype("<u4")
                for at in range(0, len(ids), capacity):
                    piece = ids[at : at + capacity]
                    for column, value in zip(out, (doc, at, len(piece), zlib.crc32(piece.tobytes()), len(ids))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=schema)

    return run


def best_fill(lengths: list[int], counts: list[int], capacity: int) -> list[int]:
    """How many pieces of each length fill a window closest to its capacity.

    Lengths are taken from the longest; bit s of the running bitset says that sum s can be reached.
    Each length is split into 1, 2, 4, ... copies, so it costs a logarithm of its useful count. The bitsets
    kept after each step give the counts back from the best sum down.
    """
    mask, reach = (1 << capacity + 1) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for i, (size, count) in enumerate(zip(lengths, counts)):
        left, take = min(count, capacity // size), 1
        while left > 0 and not reach >> capacity & 1:
            take = min(take, left)
            steps.append((i, take, reach))
            reach |= reach << take * size & mask
            left, take = left - take, take * 2
    total, used = reach.bit_length() - 1, [0] * len(lengths)
    for i, take, before in reversed(steps):
        if not before >> total & 1:
            total -= take * lengths[i]
            used[i] += take
    return used


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, pieces per sequence, first sequence, offset) for every run of ranks.

    The longest length left always takes part, so that each pattern uses up one length; the rest of its
    window is filled as closely as the multiset allows.
    """
    left = {n: c for n, c in histogram.items() if c}
    taken, sequence, out = dict.fromkeys(left, 0), 0, []
    while left:
        top = max(left)
        rest = {n: c - (n == top) for n, c in left.items()}
        lengths = sorted((n for n, c in rest.items() if c and n <= capacity - top), reverse=True)
        used = {n: u for n, u in zip(lengths, best_fill(lengths, [rest[n] for n in lengths], capacity - top)) if u} if lengths else {}
        used[top] = used.get(top, 0) + 1
        times, offset = min(left[n] // u for n, u in used.items()), 0
        for n, u in sorted(used.items(), reverse=True):
            out.append((n, taken[n], taken[n] + u * times, u, sequence, offset))
            taken[n] += u * times
            offset += n * u
            left[n] -= u * times
            if not left[n]:
                del left[n]
        sequence += times
    return out


def _place(runs: list[tuple[int, int, int, int, int, int]]):
    """Sequence and offset from length and rank; the plan's size is bounded by the capacity, not by the corpus."""
    by_length: dict[int, np.ndarray] = {}
    for n in {r[0] for r in runs}:
        by_length[n] = np.array([r[1:] for r in runs if r[0] == n], np.int64)
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(batches):
        for b in batches:
            length, rank = (b.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length):
                at, r = np.flatnonzero(length == n), by_length[int(n)]
                low, _, per, first, start = r[np.searchsorted(r[:, 0], rank[at], "right") - 1].T
                sequence[at] = first + (rank[at] - low) // per
                offset[at] = start + (rank[at] - low) % per * n
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = END_ID, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for every piece of every row.

    A null or empty text is the one end id. Each id of each row lies in exactly one piece; rows with equal
    doc_ids are packed each for itself. Sequences are numbered from 0 without gaps and padded to
    ``capacity`` after their last piece. A very long text is many full pieces and a rest; of pieces of equal length any
    may come first. Pieces of one length, identical ones too, are dealt to as many buckets as that length's count
    asks for and ranked by bucket, so that no length, however common, is sorted in one task. Other columns are
    ignored; an empty table gives an empty result.
    """
    made = texts(docs).mapInArrow(_pieces(capacity, end_id, tokenizer), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(made.withColumn("number", F.monotonically_increasing_id()), "pieces")
    lengths = {r.length: r.c for r in pieces.groupBy("length").agg(F.count("*").alias("c")).collect()}  # at most ``capacity`` rows
    buckets = F.expr(f"element_at(array({','.join(str(bucket_count(lengths.get(n, 0))) for n in range(1, capacity + 1))}), int(length))")
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start", "number"), buckets))
    counts = dealt.groupBy("length", "bucket").agg(F.count("*").alias("c"))
    before = F.sum("c").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("base"))
    order = W.partitionBy("length", "bucket").orderBy("doc_id", "start", "number")
    ranked = dealt.withColumn("rank", F.row_number().over(order) - 1).join(offsets, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "bucket", "number")
    return ranked.mapInArrow(_place(plan(lengths, capacity)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
