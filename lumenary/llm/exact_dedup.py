"""Exact dedup through a sharded minimal perfect hash over historical distinct digests.

The history's distinct digests are dealt to shards by their first bytes. Each shard's digests get a
minimal perfect hash (bit arrays of falling size; a key lives in the first array where it met no
other, its slot is the rank of its bit). A slot holds the full digest, the byte length and the locator of the winner
with the size of its group. A lookup always lands in some slot, so it counts only if all bytes agree.
Rows of a new batch are pre-aggregated by digest, looked up, and merged into the history's group;
nonmembers form groups among themselves.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

KEYS_PER_SHARD = 100_000
NO_ID = -(1 << 63)  # stands for a null id while groups are merged, where a null would turn ids into doubles
_GROUP = "digest binary, keep_id long, keep_row long, group_size long"


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("digest", pa.binary()), ("row", pa.int64())])
    for b in batches:
        found = []
        for t in b.column(1):
            data = (t.as_py() or b"").lower()  # bytes.lower changes A-Z only
            found.append(hashlib.sha256(data).digest() + len(data).to_bytes(8, "big"))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2)], schema=schema)


def digests(docs: DataFrame, row: str | None = None) -> DataFrame:
    """doc_id, digest (SHA-256 and length of the normalised text), row (this row's number), written once."""
    return materialize(texts(docs, row, rows=True).mapInArrow(_digests, "doc_id long, digest binary, row long"), "digests")


def groups(rows: DataFrame) -> DataFrame:
    """One row per distinct digest; the winner has the largest doc_id (null is least), then the largest row."""
    top = F.max(F.struct(F.col("doc_id").isNotNull().alias("some"), "doc_id", "row"))
    return rows.groupBy("digest").agg(top.alias("top"), F.count("*").alias("group_size")).select("digest", F.coalesce(F.col("top.doc_id"), F.lit(NO_ID)).alias("keep_id"), F.col("top.row").alias("keep_row"), "group_size")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys, built and asked with whole arrays."""

    def __init__(self, keys: np.ndarray, gamma: float = 1.5):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.n, base, left = len(keys), 0, np.asarray(keys, np.uint64)
        while len(left):
            m = max(64, int(gamma * len(left)))
            at = self._at(left, len(self.levels), m)
            once = np.bincount(at, minlength=m) == 1
            rank = np.cumsum(once) - 1 + base
            self.levels.append((m, np.packbits(once), rank[::64].astype(np.int64)))
            base += int(once.sum())
            left = left[~once[at]]

    @staticmethod
    def _at(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        return (x % np.uint64(m)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each member; any slot, or -1, for others."""
        keys, out = np.asarray(keys, np.uint64), np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, (m, packed, ranks) in enumerate(self.levels):
            bits = np.unpackbits(packed, count=m)
            at = self._at(keys[left], level, m)
            hit = bits[at].astype(bool)
            block = at[hit] // 64
            before = np.concatenate(([0], np.cumsum(bits)))
            out[left[hit]] = ranks[block] + before[at[hit] + 1] - before[block * 64 + 1]
            left = left[~hit]
            if not len(left):
                break
        return out


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[8:16] for d in digests), np.uint64)


def _shard(n: int):
    return F.pmod(F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long"), F.lit(n))


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = _keys(pdf.digest)
    twice = pd.Series(keys).duplicated(keep="first").to_numpy()  # equal in 64 bits, unlike in full: kept beside the table
    first = pdf[~twice]
    mph = PerfectHash(keys[~twice])
    order = np.argsort(mph.slots(keys[~twice]))
    first = first.iloc[order]
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "mph": [pickle.dumps(mph)], "digests": [b"".join(first.digest)], "locators": [pickle.dumps(first[["keep_id", "keep_row", "group_size"]].reset_index(drop=True))], "beside": [pickle.dumps(pdf[twice].drop(columns="shard"))]})


def build_index(history: DataFrame, shards: int) -> DataFrame:
    """One row per shard of the history's groups: the hash, the slots' digests, the winners' locators."""
    return history.withColumn("shard", _shard(shards)).groupBy("shard").applyInPandas(_build, "shard long, mph binary, digests binary, locators binary, beside binary")


def _merge(batch: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """Both sides' groups after the lookup, one row per distinct digest."""
    columns = ["digest", "keep_id", "keep_row", "group_size"]
    batch = batch[columns].reset_index(drop=True)
    if not len(index):
        return batch
    x = index.iloc[0]
    width = 40
    slots = x.digests
    old = pickle.loads(x.locators)
    old.insert(0, "digest", [slots[i : i + width] for i in range(0, len(slots), width)])
    beside = pickle.loads(x.beside)
    if not len(batch):
        return pd.concat([old, beside], ignore_index=True)[columns]
    at = pickle.loads(x.mph).slots(_keys(batch.digest))
    member = np.array([s >= 0 and slots[s * width : s * width + width] == d for s, d in zip(at, batch.digest)], bool)
    where = {d: i for i, d in enumerate(beside.digest)} if len(beside) else {}
    spare = np.array([where.get(d, -1) for d in batch.digest])
    new = batch[~member & (spare < 0)]
    for table, rows, to in ((old, batch[member], at[member]), (beside, batch[spare >= 0], spare[spare >= 0])):
        if len(rows):
            was = table.iloc[to]
            a, b = was.keep_id.to_numpy(), rows.keep_id.to_numpy()
            wins = (b > a) | ((b == a) & (rows.keep_row.to_numpy() > was.keep_row.to_numpy()))
            for c in ("keep_id", "keep_row"):
                col = table[c].to_numpy(copy=True)
                col[to[wins]] = rows[c].to_numpy()[wins]
                table[c] = col
            size = table.group_size.to_numpy(copy=True)
            size[to] += rows.group_size.to_numpy()
            table["group_size"] = size
    return pd.concat([old, beside, new], ignore_index=True)[columns]


def merge(batch: DataFrame, index: DataFrame, shards: int) -> DataFrame:
    """The groups of history and batch together; only pre-aggregated groups are dealt to the shards."""
    dealt = batch.withColumn("shard", _shard(shards))
    return dealt.groupBy("shard").cogroup(index.groupBy("shard")).applyInPandas(_merge, _GROUP)


def resolve(docs: DataFrame, row: str | None = None) -> DataFrame:
    """One row per input row: row, doc_id, digest, keep_id, keep_row, group_size.

    Rows up to the middle doc_id are the history, later ones (and null ids) the batch. Equal after
    lower-casing A-Z only; null counts as empty. A repeated doc_id within a group is settled by row. The least
    long counts as a null id.
    An empty table gives an empty result; other columns are ignored.
    """
    rows = digests(docs, row)
    spread = rows.agg(F.count("*").alias("n"), F.percentile_approx("doc_id", 0.5, 1000).alias("mid")).first()
    shards = max(1, -(-spread.n // KEYS_PER_SHARD))
    old = F.coalesce(F.col("doc_id") <= F.lit(spread.mid), F.lit(False)) if spread.mid is not None else F.lit(False)
    index = materialize(build_index(groups(rows.where(old)), shards), "index")
    merged = materialize(merge(groups(rows.where(~old)), index, shards), "groups")
    many = merged.where("group_size > 1")
    return rows.join(many, "digest", "left").select(
        "row", "doc_id", "digest", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.nullif(F.col("keep_id"), F.lit(NO_ID))).alias("keep_id"),
        F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
    )


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; see resolve."""
    return resolve(docs).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex(F.substring("digest", 1, 32))).alias("text_sha256"))
