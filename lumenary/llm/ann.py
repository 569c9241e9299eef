"""Approximate nearest neighbours: coarse centroids, product-quantised residuals, exact reranking.

A bounded sample fits the centroids and the residual codebooks. How many lists to probe for the wanted recall is measured over
all rows: a few of the queries themselves are compared with every vector, and the lists that hold their true neighbours are
ranked. Centroids come in two levels: up to LISTS coarse ones, and, once the square root of the vectors is beyond
that, a second codebook of as many centroids of what the first leaves, shared by all, as keeps the number of lists
at the square root. Every vector goes to its nearest centroid's list as a code. Lists are dealt to cells of a few
thousand vectors: long lists (a vector that is repeated a million times) are split, short ones share a
cell. A query visits the cells of its lists, and more lists as long as those hold fewer than k others; asymmetric
distance tables rank each cell's codes, the best are scored again on the original vectors, and so is every other vector whose
code, with what it leaves out at most, allows for as much; only the k best of a cell go on to the merge. So nothing is lost
within the lists that are visited.
"""

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import materialize

#: Bounds of what is fitted on the driver: vectors in the sample, centroids of a level, probe queries.
SAMPLE, LISTS, PROBES = 16_384, 1_024, 256
CELL, BLOCK, VISITS, SHORTLIST, RECALL = 4_096, 2_048, 64, 128, 0.99
#: How much of a list's radius may count for it, from not at all to the bound that no inner product exceeds.
LIFTS = (0.0, 0.1, 0.2, 0.4, 0.7, 1.0)
#: Rounding of an inner product over the product of the lengths, with room to spare.
ROUNDING = 1e-12


@dataclass
class Index:
    centroids: np.ndarray  # coarse x dim
    inner: np.ndarray  # second level x dim, one zero row if there is none
    books: np.ndarray  # parts x codes x width
    probes: int
    dim: int
    k: int = 1
    sizes: np.ndarray | None = None  # vectors of each list
    radii: np.ndarray | None = None  # the longest residual of each list
    lift: float = 0.0

    @property
    def lists(self) -> int:
        return len(self.centroids) * len(self.inner)

    def assign(self, x: np.ndarray) -> np.ndarray:
        coarse = _nearest(x, self.centroids)
        return coarse * len(self.inner) + _nearest(x - self.centroids[coarse], self.inner)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.centroids[lists // len(self.inner)] + self.inner[lists % len(self.inner)]

    def parts(self, x: np.ndarray) -> np.ndarray:
        n, w = self.books.shape[0], self.books.shape[2]
        return np.pad(x, ((0, 0), (0, n * w - x.shape[1]))).reshape(len(x), n, w)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, the length of what each code leaves out (rounding included) and that of the residual."""
        parts = self.parts(x - self.centre(lists))
        codes = np.stack([_nearest(parts[:, j], b) for j, b in enumerate(self.books)], 1).astype(np.uint8)
        left = parts - self.books[np.arange(len(self.books)), codes]
        slack = np.sqrt((left**2).sum((1, 2))) + ROUNDING * (np.sqrt((x**2).sum(1)) + np.sqrt((self.centre(lists) ** 2).sum(1)))
        return codes, slack, np.sqrt((parts**2).sum((1, 2)))

    def scores(self, q: np.ndarray) -> np.ndarray:
        """Queries x lists: the inner products with the lists' centres."""
        return ((q @ self.centroids.T)[:, :, None] + (q @ self.inner.T)[:, None]).reshape(len(q), -1)

    def order(self, q: np.ndarray, scores: np.ndarray, lift: float) -> np.ndarray:
        """For each query, the lists by their centres' inner products and as much of their radii as ``lift`` says."""
        return np.argsort(-(scores + lift * np.sqrt((q**2).sum(1))[:, None] * self.radii), axis=1, kind="stable")

    def probed(self, q: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """For each query, which lists it visits: the first ``probes`` in their order, or as many as hold k vectors beside its
        own."""
        order = self.order(q, scores, self.lift)
        held = np.cumsum(self.sizes[order], axis=1)
        count = np.maximum(self.probes, (held < self.k + 1).sum(axis=1) + 1)
        out = np.zeros(scores.shape, bool)
        np.put_along_axis(out, order, np.arange(scores.shape[1]) < count[:, None], 1)
        return out

    def tables(self, q: np.ndarray) -> np.ndarray:
        """Queries x parts x codes: the inner product of each query part with each codeword."""
        return np.einsum("qpw,pcw->qpc", self.parts(q), self.books)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (x @ centroids.T - 0.5 * (centroids**2).sum(1)).argmax(1)


def k_means(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Lloyd's rounds; a centroid that loses all its vectors stays where it was."""
    rng = np.random.default_rng(seed)
    centroids = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        at = _nearest(x, centroids)
        n = np.bincount(at, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, at, x)
        centroids[n > 0] = sums[n > 0] / n[n > 0, None]
    return centroids


def fit(sample: np.ndarray, total: int, k: int) -> Index:
    """Centroids and codebooks."""
    distinct = np.unique(sample, axis=0)
    dim, wanted = sample.shape[1], math.isqrt(total)
    centroids = k_means(distinct, max(1, min(LISTS, wanted, len(distinct))))
    residuals = distinct - centroids[_nearest(distinct, centroids)]
    second = min(LISTS, -(-wanted // len(centroids)), len(distinct))
    inner = k_means(residuals, second, seed=2) if second > 1 else np.zeros((1, dim))
    width = 2 if dim > 1 else 1
    parts = -(-dim // width)
    index = Index(centroids, inner, np.zeros((parts, 1, width)), 1, dim, k)
    lists = index.assign(distinct)
    cut = index.parts(distinct - index.centre(lists))
    books = [k_means(cut[:, j], 256, 6, j) for j in range(parts)]
    index.books = np.stack([np.pad(b, ((0, 256 - len(b)), (0, 0)), mode="edge") for b in books])
    return index


def tune(index: Index, queries: np.ndarray, held: list[np.ndarray], recall: float = RECALL) -> None:
    """Sets the lift and the number of probes that find ``recall`` of the queries' true neighbours, which lie in the lists
    ``held``: of all lifts the one that visits the fewest vectors."""
    least = None
    for lift in LIFTS:
        needed, sizes = [], []
        for at in range(0, len(queries), step := max(1, (1 << 22) // index.lists)):
            q = queries[at : at + step]
            order = index.order(q, index.scores(q), lift)
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(order.shape[1])[None], 1)
            needed += [rank[i, lists] for i, lists in enumerate(held[at : at + step])]
            sizes.append(index.sizes[order].sum(0))
        ranks = np.concatenate(needed)
        probes = int(np.quantile(ranks, recall, method="higher")) + 1 if len(ranks) else 1
        cost = int(np.sum(sizes, 0)[:probes].sum())
        if least is None or cost < least:
            least, index.lift, index.probes = cost, lift, probes


def vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v (array of doubles) of the vectors that take part: not null, zero, or with null or non-finite parts.

    Of repeated ids the least vector counts; only their rows are grouped, the others stay where they are.
    """
    v = F.col("v")
    rows = table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v")).where("id is not null and v is not null")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = rows.where(F.coalesce(sound, F.lit(False)))
    repeated = materialize(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "repeated")
    return rows.join(repeated, "id", "left_anti").unionByName(rows.join(repeated, "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")))


def _cells(sizes: dict[int, int], lists: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First cell and number of cells of each list; the plan has as many entries as there are lists."""
    first, parts = np.zeros(lists, np.int64), np.ones(lists, np.int64)
    cell = held = 0
    for n in range(lists):
        size = sizes.get(n, 0)
        if size > CELL or held and held + size > CELL:
            cell, held = cell + bool(held), 0
        first[n] = cell
        if size > CELL:
            parts[n] = -(-size // CELL)
            cell += int(parts[n])
        else:
            held += size
    return first, parts, cell + bool(held)


def _search(index: Index, k: int):
    names = ["query_id", "vec_id", "score"]

    def run(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(asked):
            return pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        own = own.sort_values("id")
        ids, lists = own.id.to_numpy(), own.list.to_numpy()
        x = np.frombuffer(b"".join(own.raw), np.float64).reshape(len(own), index.dim)
        codes = np.frombuffer(b"".join(own.codes), np.uint8).reshape(len(own), -1)
        slack = own.slack.to_numpy()
        q_ids = asked.id.to_numpy()
        queries = np.frombuffer(b"".join(asked.raw), np.float64).reshape(len(asked), index.dim)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(asked), 128):
            q = queries[at : at + 128]
            table, scores = index.tables(q), index.scores(q)
            guess = scores[:, lists]
            for j in range(codes.shape[1]):
                guess += table[:, j].take(codes[:, j], axis=1)
            guess[np.isnan(guess)] = np.inf
            guess[~index.probed(q, scores)[:, lists]] = -np.inf
            guess[q_ids[at : at + 128, None] == ids] = -np.inf
            most = guess + np.sqrt((q**2).sum(1))[:, None] * slack
            depth = min(max(SHORTLIST, k), len(ids))
            first = np.argpartition(-guess, depth - 1, axis=1)[:, :depth]
            for i in range(len(q)):
                short = first[i][guess[i, first[i]] > -np.inf]
                least = np.sort((x[short] * q[i]).sum(1))[-k] if len(short) >= k else -np.inf
                found = np.flatnonzero(~(most[i] < least) & (guess[i] > -np.inf))
                exact = (x[found] * q[i]).sum(1)
                best = np.lexsort((ids[found], -exact))[:k]
                out.append((np.full(len(best), q_ids[at + i]), ids[found][best], exact[best]))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, zip(*out)))))

    return run


def _true_lists(rows: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> list[np.ndarray]:
    """For each of a few queries, the lists of its k nearest others among all rows (id, list, raw). A task keeps k a query."""

    def nearest(batches):
        who, lists, scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        for b in batches:
            x = np.frombuffer(b"".join(b.raw), np.float64).reshape(len(b), -1)
            own = queries @ x.T
            own[np.isnan(own)] = -np.inf
            own[ids[:, None] == b.id.to_numpy()] = -np.inf
            keep = np.argpartition(-own, min(k, len(b)) - 1, axis=1)[:, :k]
            who = np.concatenate([who, np.repeat(np.arange(len(ids)), keep.shape[1])])
            lists, scores = np.concatenate([lists, b.list.to_numpy()[keep].ravel()]), np.concatenate([scores, np.take_along_axis(own, keep, 1).ravel()])
            order = np.lexsort((-scores, who))
            begin = np.searchsorted(who[order], np.arange(len(ids)))
            order = order[(np.arange(len(order)) - begin[who[order]] < k) & (scores[order] > -np.inf)]
            who, lists, scores = who[order], lists[order], scores[order]
        yield pd.DataFrame({"who": who, "list": lists, "score": scores})

    found = rows.select("id", "list", "raw").mapInPandas(nearest, "who long, list long, score double")
    best = found.withColumn("rank", F.row_number().over(W.partitionBy("who").orderBy(F.desc("score"), "list"))).where(F.col("rank") <= k).select("who", "list").collect()
    held: list[list[int]] = [[] for _ in ids]
    for r in best:
        held[r["who"]].append(r["list"])
    return [np.array(h, np.int64) for h in held]


def search(table: DataFrame, every: int = 20, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by ``every``, its k nearest others.

    Nearness is the largest inner product in double precision, ties go to the smaller vec_id; fewer than k
    are returned only if there are fewer. Null, zero or non-finite vectors take no part. Vectors are compared with those of
    their own length; each length that has queries is an index of its own. All rows are indexed. Other columns are ignored;
    an empty table gives an empty result.
    """
    spark = table.sparkSession
    rows = materialize(vectors(table).withColumn("dim", F.size("v")), "vectors")
    asked = F.pmod("id", F.lit(every)) == 0
    dims = rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(asked).alias("asked")).where("n > 1 and asked > 0").orderBy("dim").collect()
    out = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for d in dims:
        found = _search_one(rows.where(F.col("dim") == d["dim"]), d["dim"], d["n"], every, k, recall)
        out = found if len(dims) == 1 else out.unionByName(found)
    return out


def _search_one(rows: DataFrame, dim: int, total: int, every: int, k: int, recall: float) -> DataFrame:
    """``search`` over vectors of one length."""
    share = min(1.0, 0.9 * SAMPLE / total)
    drawn = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, int(share * (1 << 20)))).select("v").limit(SAMPLE).collect() or rows.select("v").limit(SAMPLE).collect()
    index = fit(np.array([r.v for r in drawn]), total, k)

    def encoded(batches):
        for b in batches:
            x = np.array(b.v.tolist()).reshape(len(b), dim)
            lists = index.assign(x)
            codes, slack, residual = index.encode(x, lists)
            yield pd.DataFrame({"id": b.id, "list": lists, "codes": [c.tobytes() for c in codes], "slack": slack, "residual": residual, "raw": [r.tobytes() for r in x]})

    index_rows = materialize(rows.select("id", "v").mapInPandas(encoded, "id long, list long, codes binary, slack double, residual double, raw binary"), "codes")
    lists = index_rows.groupBy("list").agg(F.count("*").alias("n"), F.max("residual").alias("radius")).collect()  # one row a list: the square root of the vectors
    sizes = {r["list"]: r["n"] for r in lists}
    first, parts, _ = _cells(sizes, index.lists)
    index.sizes, index.radii = np.zeros(index.lists, np.int64), np.zeros(index.lists)
    for r in lists:
        index.sizes[r["list"]], index.radii[r["list"]] = r["n"], r["radius"]
    asked_rows = index_rows.where(F.pmod("id", F.lit(every)) == 0)
    probes = asked_rows.orderBy(F.xxhash64("id"), "id").select("id", "raw").limit(PROBES).collect()
    probe_ids, probe_q = np.array([r["id"] for r in probes]), np.frombuffer(b"".join(r["raw"] for r in probes), np.float64).reshape(len(probes), dim)
    tune(index, probe_q, _true_lists(index_rows, probe_ids, probe_q, k), recall)

    def placed(batches):
        for b in batches:
            lists = b.list.to_numpy()
            mixed = (b.id.to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            yield b.assign(cell=first[lists] + (mixed % parts[lists].astype(np.uint64)).astype(np.int64))

    def visits(batches):
        for batch in batches:
            for at in range(0, len(batch), VISITS):
                b = batch.iloc[at : at + VISITS]
                q = np.frombuffer(b"".join(b.raw), np.float64).reshape(len(b), dim)
                who, cells = [], []
                for i, lists in enumerate(index.probed(q, index.scores(q))):
                    mine = np.unique(np.concatenate([np.arange(first[n], first[n] + parts[n]) for n in np.flatnonzero(lists)]))
                    who.append(np.full(len(mine), i))
                    cells.append(mine)
                own = np.concatenate(who)
                yield pd.DataFrame({"id": b.id.to_numpy()[own], "raw": b.raw.to_numpy()[own], "cell": np.concatenate(cells)})

    own = index_rows.drop("residual").mapInPandas(placed, "id long, list long, codes binary, slack double, raw binary, cell long")
    asked = asked_rows.select("id", "raw").mapInPandas(visits, "id long, raw binary, cell long")
    blocks = materialize(asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    own = own.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "id", "list", "codes", "slack", "raw")
    asked = asked.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("id"), F.col("blocks")).alias("block"), "id", "raw")
    own = own.toDF(*own.columns)
    found = own.groupBy("cell", "block").cogroup(asked.groupBy("cell", "block")).applyInPandas(_search(index, k), "query_id long, vec_id long, score double")
    order = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
