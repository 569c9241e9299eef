"""Quality scores: random Fourier features over document statistics, ridge, isotonic calibration.

Each whole text gives a short vector of statistics. Random Fourier features approximate a Gaussian
kernel over them. Partitions add up their part of the normal equations; the sums are of fixed size and
are added in two steps, then solved by ridge on the driver. Raw scores of each fold by the other fold's model
are calibrated by isotonic regression over a histogram of fixed size.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, remainder, texts

FOLDS, FEATURES, WIDTH, RIDGE, CELLS, SUMS = 3, 192, 3.0, 1e-3, 2048, 16
_KINDS = np.zeros(256, np.int64)  # of bytes: 0 other, 1 lower, 2 upper, 3 digit, 4 space, 5 line end, 6 . , 7 other sign, 8 non-ASCII
for _b in range(256):
    _c = chr(_b)
    _KINDS[_b] = 8 if _b > 127 else 1 if _c.islower() else 2 if _c.isupper() else 3 if _c.isdigit() else 5 if _c == "\n" else 4 if _c.isspace() else 6 if _c in ".,;:?'\"-()" else 7 if 32 < _b < 127 else 0
STATISTICS = 26


def statistics(text: bytes | None) -> np.ndarray:
    """What the classifier sees of a text: shares of kinds of bytes, words, repeats and lines; all zero but the first if empty."""
    data = text or b""
    out = np.zeros(STATISTICS)
    out[0] = 1.0
    if not data.strip():
        return out
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    kinds = np.bincount(_KINDS, weights=counts, minlength=9) / len(data)
    words = data.split()
    n = len(words)
    seen = Counter(words)
    odd = b"#$%&*!|<>{}[]=\\^~_@/+"
    ends = Counter(w[-1] for w in words)
    starts_upper = sum(1 for w in words if 65 <= w[0] <= 90)
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    half = [words[i] + b" " + words[i + 1] for i in range(0, n - 1)]
    lines = [x for x in data.split(b"\n") if x.strip()]
    out[1] = min(1.0, math.log1p(len(data)) / 14)
    out[2:10] = kinds[1:9]
    out[10] = min(1.0, sum(map(len, words)) / n / 20)
    out[11] = len(seen) / n
    out[12] = len(seen) / (n / math.log(n + 1.72)) / 3 if n > 1 else 0.5
    out[13] = same / max(1, n - 1)
    out[14] = len(set(half)) / len(half) if half else 1.0
    out[15] = starts_upper / n
    out[16] = sum(ends[c] for c in odd) / n
    out[17] = sum(c for w, c in seen.items() if w in (b"|", b"-", b"*", b"#")) / n
    out[18] = max(seen.values()) / n if n > 3 else 0.0
    out[19] = len(set(lines)) / len(lines)
    out[20] = min(1.0, n / len(lines) / 60)
    out[21] = (ends[46] + ends[33] + ends[63]) / n
    out[22] = ends[44] / n
    out[23] = sum(counts[c] for c in odd) / len(data)
    out[24] = sum(counts[c] for c in b"!") / len(data)
    out[25] = sum(counts[c] for c in b"|") / len(data)
    return out


def _projection(dims: int, features: int, width: float, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.standard_normal((dims, features)) / width, rng.uniform(0, 2 * math.pi, features)


class Model:
    """Scale of the statistics, feature weights, and the calibration curve."""

    def __init__(self, mean, scale, weights, curve=None):
        self.mean, self.scale, self.weights, self.curve = mean, scale, weights, curve

    def features(self, stats: np.ndarray) -> np.ndarray:
        return features(stats, self.mean, self.scale)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        at, level = self.curve
        return np.clip(np.interp(self.raw(stats), at, level), 0.0, 1.0)


def features(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """sqrt(2 / D) cos(w x + b) of the scaled statistics, and a constant."""
    x = np.clip((stats - mean) / scale, -6, 6)
    w, b = _projection(STATISTICS, FEATURES, WIDTH * math.sqrt(STATISTICS) / 2)
    return np.column_stack([np.ones(len(x)), math.sqrt(2 / FEATURES) * np.cos(x @ w + b)])


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Pool adjacent violators."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist()):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks[-1]
            blocks[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2]
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, STATISTICS)


def _stats(batches):
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t.as_py()).tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "stats"])


def _added(df: DataFrame, part, size: int) -> dict[int, np.ndarray]:
    """Per fold, the sum over all partitions of what ``part(stats, labels)`` gives, ``size`` doubles, added in two steps."""

    def local(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            fold, label = b.column(0).to_numpy(), b.column(1).to_numpy().astype(float)
            stats = _matrix(b.column(2))
            for f in np.unique(fold):
                sums[int(f)] = sums.get(int(f), 0) + part(stats[fold == f], label[fold == f])
        yield from _sums(sums)

    def total(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for f, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                sums[f] = sums.get(f, 0) + np.frombuffer(x, np.float64)
        yield from _sums(sums)

    def _sums(sums):
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["fold", "sum"])

    local_sums = df.select("fold", "label", "stats").mapInArrow(local, "fold int, sum binary")
    out: dict[int, np.ndarray] = {}
    for r in local_sums.repartition(SUMS).mapInArrow(total, "fold int, sum binary").toLocalIterator():
        out[r.fold] = out.get(r.fold, np.zeros(size)) + np.frombuffer(r.sum, np.float64)
    return out


def _solve(sums: np.ndarray) -> np.ndarray:
    d = FEATURES + 1
    a, b = sums[: d * d].reshape(d, d), sums[d * d :]
    return np.linalg.solve(a + RIDGE * max(1.0, a[0, 0]) * np.diag([1e-9, *[1.0] * FEATURES]), b)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the statistics of every whole text, written once."""
    return materialize(texts(docs).mapInArrow(_stats, "doc_id long, stats binary"), "stats")


def learn(stats: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled rows whose id's crc32 mod 3 is not 1; a constant one half if there are none."""
    wanted = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("label")).where("label in (0, 1)").where(remainder("id", FOLDS) != 1).groupBy("id").agg(F.max("label").alias("label"))
    rows = stats.join(wanted, F.col("doc_id") == F.col("id")).select(remainder("doc_id", FOLDS).cast("int").alias("fold"), "label", "stats")
    known = materialize(rows, "known")

    moments = sum(_added(known, lambda s, y: np.concatenate([[len(s)], s.sum(0), (s * s).sum(0)]), 1 + 2 * STATISTICS).values())
    if np.ndim(moments) == 0 or not moments[0]:
        return Model(np.zeros(STATISTICS), np.ones(STATISTICS), np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([0.5, 0.5])))
    mean = moments[1 : 1 + STATISTICS] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + STATISTICS :] / moments[0] - mean**2, 1e-6))

    def equations(s, y):
        x = features(s, mean, scale)
        return np.concatenate([(x.T @ x).ravel(), x.T @ y])

    d = FEATURES + 1
    sums = _added(known, equations, d * d + d)
    whole = sum(sums.values())
    by_fold = {f: _solve(sum((v for g, v in sums.items() if g != f), np.zeros(d * d + d)) if len(sums) > 1 else whole) for f in sums}

    def histogram(s, y, w):
        cell = np.clip(((features(s, mean, scale) @ w + 0.5) / 2 * CELLS).astype(int), 0, CELLS - 1)
        return np.concatenate([np.bincount(cell, minlength=CELLS), np.bincount(cell, weights=y, minlength=CELLS)])

    cells = sum((_added(known.where(F.col("fold") == f), lambda s, y, w=w: histogram(s, y, w), 2 * CELLS).get(f, np.zeros(2 * CELLS)) for f, w in by_fold.items()), np.zeros(2 * CELLS))
    n, good = cells[:CELLS], cells[CELLS:]
    full = np.flatnonzero(n)
    level = isotonic((good[full] + 0.5 * 0.1) / (n[full] + 0.1), n[full])
    return Model(mean, scale, _solve(whole), ((full + 0.5) / CELLS * 2 - 0.5, level))


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for every row of ``measured``."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))), pa.float64())], names=["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id long, score double")


def score_text(model: Model):
    """A column function from whole text to score; null counts as empty."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            stats = [statistics((t or "").encode("utf-8", "replace")) for t in b]
            yield pd.Series(model.score(np.array(stats, np.float64).reshape(-1, STATISTICS)))

    return run


def predict(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the whole text; null counts as empty.

    Learned only from labels whose id's crc32 mod 3 is not 1; labels, lang, source and doc_id are no inputs
    of a score. Of repeated labels the larger counts. Without labels every score is one half. Texts with equal statistics
    tie and score alike; very long ones give as many statistics as short ones. Repeated rows and null ids pass through; other
    columns are ignored; an empty table gives an empty result.
    """
    stats = measured(docs)
    scored = score(stats, learn(stats, labels))
    return scored.select("doc_id", (remainder("doc_id", FOLDS) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
