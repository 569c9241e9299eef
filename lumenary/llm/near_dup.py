"""MinHash near-duplicate detection: one-permutation hashing, banded buckets, star-shaped candidates.

Pass 1 turns each whole text into its set of word shingles (64-bit hashes), a one-permutation
signature and band keys. Texts with the same set form one class and go on as one row. Classes that
share a band key meet in a bucket. A bucket proposes the edges of one star, from its hub to each
member, so n members cost n - 1 candidates; the hub of a large bucket is the member nearest to the
consensus of its signatures, which is where a family of copies has its original. Every candidate is
confirmed on the full sets.

What a star can't see is settled exactly afterwards: members that the links so far don't join to
their bucket's hub are compared with all members of the bucket, in small buckets as further
candidates, in large ones in blocks that count common shingles by matrix products and return only links. Where
very many members are open, they are unlike, and pairs that share one of their rarest shingles are the candidates.

Bands can miss a pair, the more easily the smaller its sets. Sets of up to TINY shingles can be similar at 0.8 only if
one is the other less one shingle, so they are joined exactly: a set's key meets the keys of sets less one.
Before full sets are fetched, a parity sketch bounds a pair's difference from below; a pair it excludes can't be similar.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize, texts
from .graph import connected_components

BANDS, ROWS = 30, 5
#: Bits of a set's parity sketch; sets up to TINY shingles are joined without bands.
SKETCH, TINY = 2048, 9
#: Buckets of fewer classes than SMALL take the first one as hub; others find theirs by a consensus of SAMPLE signatures.
SMALL, SAMPLE = 16, 64
#: Members and shingles of a block when a large bucket's rest is compared; with more than WIDE open members it is joined by rarest shingles.
BLOCK, BLOCK_SHINGLES, DENSE, WIDE, SALT = 1024, 1 << 20, 16, 1024, 16
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles, A-Z lower-cased, words cut at ASCII white space.

    With fewer than k words the whole sequence is the one shingle; null or blank text gives the empty set.
    """
    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(k, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - width + 1, width, np.uint64)
        for i in range(width):
            out = _mix(out * _ODD + h[i : len(h) - width + 1 + i])
    return np.unique(out)


@lru_cache(maxsize=4)
def _plan(bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin edges on the 64-bit hash line, and for each bin a fixed random order in which it borrows from others."""
    edges = np.array([(b << 64) // bins for b in range(1, bins)], np.uint64)
    order = np.random.default_rng(20240229).permuted(np.tile(np.arange(bins, dtype=np.int16), (bins, 1)), axis=1)
    return edges, np.argsort(order, axis=1).astype(np.int16)


def signature(hashes: np.ndarray, bins: int) -> np.ndarray:
    """One-permutation MinHash: the smallest hash in each bin; an empty bin takes the value of the first
    non-empty bin in its own random order (optimal densification), so equal picks stay independent."""
    edges, rank = _plan(bins)
    cut = np.concatenate(([0], np.searchsorted(hashes, edges), [len(hashes)]))
    full = np.flatnonzero(cut[1:] > cut[:-1])
    source = np.arange(bins)
    if len(full) < bins:
        empty = np.flatnonzero(cut[1:] == cut[:-1])
        source[empty] = full[rank[np.ix_(empty, full)].argmin(axis=1)]
    return hashes[cut[source]]


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        key, part = _mix(np.arange(1, bands + 1, dtype=np.uint64) * _ODD), sig.reshape(bands, rows)
        for r in range(rows):
            key = _mix(key * _ODD + part[:, r])
    return key.view(np.int64)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the number of shingles in each of SKETCH cells: two sketches differ in at most as many bits as their sets in shingles."""
    return np.packbits(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH) & 1).tobytes()


def tiny_keys(s: np.ndarray, percent: int) -> tuple[int | None, list[int]]:
    """A small set's own key and those of the set less each one of its shingles, as far as such pairs are similar."""
    if len(s) > TINY:
        return None, []
    with np.errstate(over="ignore"):
        each = _mix(s * _ODD)
        total = each.sum(dtype=np.uint64)
        n = np.uint64(len(s))
        own = int(_mix(np.array([total + n], np.uint64)).view(np.int64)[0]) if 100 * len(s) >= percent * (len(s) + 1) and len(s) < TINY else None
        less = _mix(total - each + n - np.uint64(1)).view(np.int64).tolist() if 100 * (len(s) - 1) >= percent * len(s) else []
    return own, less


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


_SIGNED = "doc_id long, n long, set_key binary, sig binary, sketch binary, bands array<long>, own long, less array<long>, row long, at long"


def _signed(k: int, bands: int, rows: int, percent: int):
    longs = pa.list_(pa.int64())
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary()), ("sketch", pa.binary()), ("bands", longs), ("own", pa.int64()), ("less", longs), ("row", pa.int64()), ("at", pa.int64())])

    def run(batches):
        for b in batches:
            made: list[tuple] = []
            for t in b.column(1):
                s = shingle_set(t.as_py(), k)
                if len(s):
                    sig = signature(s, bands * rows)
                    made.append((len(s), _set_key(s), sig.astype(np.uint16).tobytes(), sketch(s), band_keys(sig, bands, rows), *tiny_keys(s, percent)))
                else:
                    made.append((0, _set_key(s), None, None, None, None, None))
            columns = list(zip(*made)) if made else [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:8])), b.column(2), b.column(3)], schema=schema)

    return run


def _sets(k: int):
    schema = pa.schema([("class_id", pa.int64()), ("set", pa.binary())])

    def run(batches):
        done: set[int] = set()  # of this task: a repeated row gives its class's set once
        for b in batches:
            ids, sets = [], []
            for c, key, t in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                if c in done:
                    continue
                s = shingle_set(t.as_py(), k)
                if _set_key(s) == key.as_py():
                    done.add(c)
                    ids.append(c)
                    sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.binary())], schema=schema)

    return run


def _possible(percent: int):
    """Keep the pairs whose sketches leave them similar: a similar pair differs in at most (100 - percent) / (100 + percent) of
    the sum of its sizes, and in no fewer shingles than its sketches in bits."""

    def run(batches):
        for b in batches:
            sizes = b.column(2).to_numpy() + b.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(len(sizes), SKETCH // 8) for c in (4, 5))
            keep = (100 + percent) * np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= (100 - percent) * sizes
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _consensus(pdf: pd.DataFrame) -> pd.DataFrame:
    """The commonest value of each bin among a bucket's sampled signatures."""
    sigs = np.sort(np.stack([np.frombuffer(s, np.uint16) for s in pdf.sig]), axis=0)
    best, out = np.zeros(sigs.shape[1], np.int64), sigs[0].copy()
    run = np.ones(sigs.shape[1], np.int64)
    for before, now in zip(sigs, sigs[1:]):
        run = np.where(before == now, run + 1, 1)
        out, best = np.where(run > best, now, out), np.maximum(run, best)
    return pd.DataFrame({"bucket": pdf.bucket.iloc[:1], "consensus": [out.astype(np.uint16).tobytes()]})


def _agreement(batches):
    for b in batches:
        same = [np.count_nonzero(np.frombuffer(s.as_buffer(), np.uint16) == np.frombuffer(t.as_buffer(), np.uint16)) for s, t in zip(b.column(3), b.column(4))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(same, pa.int64())], names=["bucket", "class_id", "n", "same"])


def _rest(percent: int):
    """Links between two blocks of a bucket: all pairs of different components of which one side is open."""

    def matrix(sets: list[np.ndarray], columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        flat = np.concatenate(sets)
        at = np.minimum(np.searchsorted(columns, flat), max(0, len(columns) - 1))
        keep = columns[at] == flat if len(columns) else np.zeros(len(flat), bool)
        return rows[keep], at[keep]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides = [pdf[pdf["side"] == i] for i in (0, 1)]
        if pdf["i"].iloc[0] == pdf["j"].iloc[0]:
            sides[1] = sides[0]
        sets = [[np.frombuffer(x, np.uint64) for x in side["set"]] for side in sides]
        opened, label, ids = ([side[c].to_numpy() for side in sides] for c in ("open", "label", "class_id"))
        if not len(ids[0]) or not len(ids[1]):
            return pd.DataFrame({"u": np.empty(0, np.int64), "v": np.empty(0, np.int64)})
        seen = [np.unique(np.concatenate(x), return_counts=True) for x in sets]
        columns, i, j = np.intersect1d(seen[0][0], seen[1][0], assume_unique=True, return_indices=True)
        dense = np.maximum(seen[0][1][i], seen[1][1][j]) > DENSE
        common = np.zeros((len(sets[0]), len(sets[1])), np.float32)
        (r0, c0), (r1, c1) = (matrix(x, columns[~dense]) for x in sets)
        o0, o1 = np.argsort(c0, kind="stable"), np.argsort(c1, kind="stable")
        first, last = np.searchsorted(c1[o1], c0[o0], "left"), np.searchsorted(c1[o1], c0[o0], "right")
        times = last - first
        partner = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        np.add.at(common, (np.repeat(r0[o0], times), r1[o1][partner]), 1)
        wide = columns[dense]
        for at in range(0, len(wide), 2048):
            parts = []
            for x in sets:
                part = wide[at : at + 2048]
                r, c = matrix(x, part)
                m = np.zeros((len(x), len(part)), np.float32)
                m[r, c] = 1
                parts.append(m)
            common += parts[0] @ parts[1].T
        sizes = [np.array([len(x) for x in side]) for side in sets]
        union = sizes[0][:, None] + sizes[1][None] - common
        linked = (100 * common >= percent * union) & (opened[0][:, None] | opened[1][None]) & (label[0][:, None] != label[1][None])
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        out = []
        for a, b in zip(*np.nonzero(linked)):
            x, y = find(label[0][a]), find(label[1][b])
            if x != y:
                parent[y] = x
                out.append((ids[0][a], ids[1][b]))
        return pd.DataFrame(out, columns=["u", "v"]).astype(np.int64)

    return run


def _confirm(percent: int):
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches):
        hub, own = None, None
        for b in batches:
            us, vs = [], []
            for h, m, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                other = np.frombuffer(s.as_buffer(), np.uint64)
                if m < 0:  # the hub's own row comes first
                    hub, own = h, other.copy()
                elif h == hub:
                    both = _common(own, other)
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        us.append(h)
                        vs.append(m)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], schema=schema)

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) < len(b):
        a, b = b, a
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int(np.count_nonzero(a[at] == b))


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u hub, v member) whose full sets are similar enough. A hub's members are dealt over
    as many tasks as their number asks for, each with its own copy of the hub's set."""
    of = classes.select("class_id", "n", "sketch")
    both = pairs.join(of.toDF("u", "nu", "su"), "u").join(of.toDF("v", "nv", "sv"), "v").select("u", "v", "nu", "nv", "su", "sv")
    near = materialize(both.mapInArrow(_possible(percent), "u long, v long"), "near")
    many = near.groupBy("u").agg(F.ceil(F.count("*") / 2000).alias("parts"))
    dealt = near.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), "parts").alias("part"))
    s = sets.withColumnRenamed("class_id", "v")
    members = dealt.join(s, "v").select("u", "v", "set", "part")
    hubs = many.select(F.col("u").alias("v"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(s, "v").select(F.col("v").alias("u"), F.lit(-1).cast("long").alias("v"), "set", "part")
    ordered = members.unionByName(hubs).repartition("u", "part").sortWithinPartitions("u", "part", "v")
    return ordered.select("u", "v", "set").mapInArrow(_confirm(percent), "u long, v long").distinct()


def _sized(pairs: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """Sets of too different sizes can't be similar."""
    return pairs.where(100 * F.least(a, b) >= percent * F.greatest(a, b))


def _hubs(large: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, hub, hub_n: the member that agrees best with the consensus of a bounded sample of its bucket."""
    sig = classes.select("class_id", "sig")
    order = F.row_number().over(W.partitionBy("bucket").orderBy(F.xxhash64("class_id"), "class_id"))
    sample = large.select("bucket", "class_id").withColumn("r", order).where(F.col("r") <= SAMPLE).drop("r").join(sig, "class_id")
    consensus = sample.groupBy("bucket").applyInPandas(_consensus, "bucket long, consensus binary")
    scored = large.join(consensus, "bucket").join(sig, "class_id").select("bucket", "class_id", "n", "sig", "consensus")
    scored = scored.mapInArrow(_agreement, "bucket long, class_id long, n long, same long")
    best = scored.groupBy("bucket").agg(F.max(F.struct("same", (-F.col("class_id")).alias("least"), "n")).alias("b"))
    return best.select("bucket", (-F.col("b.least")).alias("hub"), F.col("b.n").alias("hub_n"))


def _blocks(known: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between open members of large buckets and all others; a bucket's members are dealt to blocks
    of bounded size, and each pair of blocks is one task's work. Settled members form blocks of their own, which
    meet open blocks only, so that a bucket costs its open members times its size."""
    blocks = lambda which: F.greatest(F.ceil(F.count(F.when(which, 1)) / BLOCK), F.ceil(F.sum(F.when(which, F.col("n")).otherwise(0)) / BLOCK_SHINGLES))
    load = known.groupBy("bucket").agg(blocks(F.col("open")).alias("opened"), blocks(~F.col("open")).alias("settled"))
    deal = lambda n: F.pmod(F.xxhash64("class_id"), F.greatest(n, F.lit(1)))
    block = F.when(F.col("open"), deal(F.col("opened"))).otherwise(F.col("opened") + deal(F.col("settled")))
    last = F.when(F.col("open"), F.col("opened") + F.col("settled")).otherwise(F.col("opened")) - 1
    salt = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))  # a large bucket's members come to their load from several tasks
    salted = known.withColumn("salt", F.pmod(F.xxhash64("class_id"), F.lit(SALT)).cast("int"))
    dealt = salted.join(load.withColumn("salt", salt), ["bucket", "salt"]).withColumn("block", block).withColumn("last", last)
    other = F.sequence(F.lit(0).cast("long"), "last")
    paired = dealt.withColumn("other", F.explode(other)).select(
        "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "class_id", "label", "open"
    )
    return paired.join(sets, "class_id").groupBy("bucket", "i", "j").applyInPandas(_rest(percent), "u long, v long")


def _exploded(batches):
    for b in batches:
        sets = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column(5)]
        at = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
        for i in range(0, len(flat), 1 << 16):
            part = pa.array(at[i : i + (1 << 16)])
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(part) for c in range(5)), pa.array(flat[i : i + (1 << 16)])], names=["bucket", "class_id", "n", "label", "open", "shingle"])


def _by_rarest(known: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links of open members of buckets with very many of them. Two similar sets share a shingle among the rarest
    n - ceil(percent * n / 100) + 1 of each, rarity being counted within the bucket; so each member is dealt by those, and only
    members that meet are compared. Nothing similar is lost, and unlike members of a bucket, however many, don't meet."""
    rows = known.select("bucket", "class_id", "n", "label", "open").join(sets, "class_id").select("bucket", "class_id", "n", "label", "open", "set")
    each = materialize(rows.mapInArrow(_exploded, "bucket long, class_id long, n long, label long, open boolean, shingle long"), "shingles")
    seen = each.groupBy("bucket", "shingle").agg(F.count("*").alias("times")).where("times > 1")
    length = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    common = each.join(seen, ["bucket", "shingle"], "left").withColumn("times", F.coalesce("times", F.lit(1)))
    ordered = common.groupBy("bucket", "class_id", "n", "label", "open").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("s"))
    rarest = ordered.withColumn("s", F.explode(F.slice("s", F.lit(1), length))).where("s.times > 1")
    rarest = materialize(rarest.select("bucket", F.col("s.shingle").alias("shingle"), "class_id", "n", "label", "open"), "rarest")
    one = rarest.where("open").select("bucket", "shingle", F.col("class_id").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu"))
    two = rarest.select("bucket", "shingle", F.col("class_id").alias("v"), F.col("n").alias("nv"), F.col("label").alias("lv"), "open")
    pairs = one.join(two, ["bucket", "shingle"]).where("lu <> lv and (not open or u < v)")
    return _verified(_sized(pairs, "nu", "nv", percent).select("u", "v").distinct(), classes, sets, percent)


def classify(docs: DataFrame, k: int = 5, percent: int = 80, bands: int = BANDS, per_band: int = ROWS, row: str | None = None) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, set_key, component_id, component_row.

    ``row`` is the column of that name, which must number the rows, or a number given here.
    ``component_id`` is the smallest doc_id reachable over links (100 * common >= percent * union of the
    shingle sets), ``component_row`` the one row of the component that may stand for it. Texts with the
    same set are one class. Null, empty and blank texts have the empty set and are linked with nothing,
    not even with each other. A null doc_id is larger than all others, and null if it stands alone.
    Repeated rows are rows of one class. Other columns are ignored; an empty table gives an empty result. Very long texts are
    sets like others. Two similar texts of more than TINY shingles are missed if no band agrees, which has probability
    (1 - s**per_band)**bands, 7e-6 at s = 0.8 and 2e-8 at 0.85; smaller sets and the members of a bucket are joined without loss.
    """
    spark = docs.sparkSession
    at = F.xxhash64("doc_id", "text").alias("at")  # finds a class's text again, whatever its doc_id
    signed = texts(docs, row, rows=True).select("doc_id", "text", "row", at).mapInArrow(_signed(k, bands, per_band, percent), _SIGNED)
    signed = materialize(signed, "signed")
    groups = signed.where("n > 0").groupBy("set_key").agg(
        F.min("row").alias("class_id"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
        F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("own").alias("own"), F.first("less").alias("less"), F.min_by("at", "row").alias("at"),
    )
    classes = materialize(groups, "classes")
    banded = classes.select("class_id", "n", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("c"), F.min(F.struct("class_id", "n")).alias("hub")).where("c > 1")
    members = materialize(banded.join(shared, "bucket").select("bucket", "class_id", "n", "c", F.col("hub.class_id").alias("hub"), F.col("hub.n").alias("hub_n")), "buckets")
    own = classes.where("own is not null").select(F.col("own").alias("key"), F.col("class_id").alias("u"))
    tiny = classes.where("size(less) > 0").select(F.explode("less").alias("key"), F.col("class_id").alias("v")).join(own, "key").where("u <> v").select("u", "v").distinct()
    tiny = materialize(tiny, "tiny")
    met = members.select("class_id").union(tiny.select("u")).union(tiny.select("v")).distinct()
    wanted = classes.join(met, "class_id").select("class_id", "set_key", "at")
    sets = wanted.join(texts(docs).select(at, "text"), "at").select("class_id", "set_key", "text")
    sets = materialize(sets.mapInArrow(_sets(k), "class_id long, set binary"), "sets")

    # one star a bucket
    small, large = members.where(F.col("c") < SMALL), members.where(F.col("c") >= SMALL).drop("hub", "hub_n")
    hubs = materialize(_hubs(large, classes), "hubs")
    starred = small.unionByName(large.join(hubs, "bucket")).where("class_id <> hub")
    pairs = _sized(starred, "n", "hub_n", percent).select(F.col("hub").alias("u"), F.col("class_id").alias("v")).union(tiny).distinct()
    links = materialize(_verified(pairs, classes, sets, percent), "links")
    comps = materialize(connected_components(links), "components")

    # the rest: members whose component isn't the hub's, against all members
    of = comps.select(F.col("node").alias("class_id"), F.col("component"))
    known = members.drop("hub", "hub_n").join(of, "class_id", "left").withColumn("label", F.coalesce("component", "class_id")).drop("component")
    centre = members.where(F.col("c") < SMALL).select("bucket", "hub").distinct().unionByName(hubs.select("bucket", "hub"))
    centre = centre.join(of.withColumnRenamed("class_id", "hub"), "hub", "left").select("bucket", F.coalesce("component", "hub").alias("centre"))
    known = known.join(centre, "bucket").withColumn("open", F.col("label") != F.col("centre"))
    unsettled = known.where("open").select("bucket").distinct()
    known = materialize(known.join(unsettled, "bucket", "left_semi").select("bucket", "class_id", "n", "c", "label", "open"), "known")
    few = known.where(F.col("c") < SMALL)
    one, two = few.where("open").select("bucket", F.col("class_id").alias("u"), F.col("n").alias("nu"), F.col("label").alias("lu")), few.select("bucket", F.col("class_id").alias("v"), F.col("n").alias("nv"), F.col("label").alias("lv"), "open")
    pairs = _sized(one.join(two, "bucket").where("lu <> lv and (not open or u < v)"), "nu", "nv", percent).select("u", "v").distinct()
    many = known.where(F.col("c") >= SMALL)
    wide = materialize(many.groupBy("bucket").agg(F.count_if("open").alias("opened")).where(F.col("opened") > WIDE).select("bucket"), "wide")
    more = _verified(pairs, classes, sets, percent).union(_blocks(many.join(wide, "bucket", "left_anti"), sets, percent))
    if not wide.isEmpty():
        more = more.union(_by_rarest(many.join(wide, "bucket", "left_semi"), classes, sets, percent))
    links = links.union(materialize(more, "links"))
    comps = materialize(connected_components(links), "components")

    ids = classes.join(comps, classes.class_id == comps.node, "left").select("set_key", "class_id", "doc_id", "copies", "component")
    least = ids.where("component is not null").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class_id")).alias("least"))
    linked = ids.join(least, "component").select("set_key", F.col("least.doc_id").alias("component_id"), F.col("least.class_id").alias("component_row"))
    copies = ids.where("component is null and copies > 1").select("set_key", F.col("doc_id").alias("component_id"), F.col("class_id").alias("component_row"))
    grouped = materialize(linked.union(copies), "grouped")
    alone = F.col("component_row").isNull()
    rows_ = signed.select("row", "doc_id", "n", F.when(F.col("n") > 0, F.col("set_key")).alias("set_key"))
    return rows_.join(grouped, "set_key", "left").select(
        "row", "doc_id", F.col("n").alias("n_shingles"), "set_key",
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("row")).otherwise(F.col("component_row")).alias("component_row"),
    )


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id = component_id; true for a lone null id); see classify."""
    return classify(docs, k, percent).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
