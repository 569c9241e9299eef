"""Vector code compression: product codebooks of integers, entries found by Exponion search.

A part x was last coded by entry a. An entry j that is as near to x as a is lies no farther from a than
|x - a| + |x - j| <= 2 |x - a|. So only the beginning of a's list of neighbour entries, sorted by distance, has to be
scanned: those with D(a, j) <= 4 D(x, a) for squared distances D, which are exact integers. Of entries at equal distance
the one with the smaller index wins; the radius holds these too.

Codes of the first round are written beside the integer vectors, once. Later passes start at them: the last one searches
the second codebooks from the first codes and the final ones from what that gives.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integer components are held within these bounds, so that every distance and every error fits a long.
LARGEST = 1 << 24

Codebooks = dict[int, list[np.ndarray]]


def bounds(length: int, parts: int = PARTS) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end: equal ones if the length divides, else as even as can be."""
    return [(p * length // parts, (p + 1) * length // parts) for p in range(parts)]


def integers(table: DataFrame, key: str = "vec_id", column: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, v (integers) of the rows whose vector is there and holds neither nulls nor non-finite components."""
    kept = table.select(F.col(key).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(column).cast("array<double>").alias("x"))
    kept = kept.where(F.col("x").isNotNull() & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))))
    held = lambda c: F.greatest(F.lit(float(-LARGEST)), F.least(F.lit(float(LARGEST)), c * SCALE))
    return kept.select("vec_id", "label", F.transform("x", lambda c: F.floor(held(c)).cast("int")).alias("v"))


def neighbours(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry all entries by distance and index, and those squared distances."""
    between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
    order = np.argsort(between, axis=1, kind="stable")
    return order, np.take_along_axis(between, order, 1)


def exponion(x: np.ndarray, entries: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each row and its squared distance. Every row scans the list of its start entry up to its own
    radius; rows are ordered by the length of their scan, so that those still scanning are the first ones."""
    order, between = neighbours(entries)
    n = len(entries)
    own = ((x - entries[start]) ** 2).sum(1)
    # one sorted array of all lists, each shifted behind the one before, finds the ends of all scans
    far = int(between.max(initial=0)) + 1
    shift = np.arange(n, dtype=np.int64) * far
    ends = np.searchsorted((between + shift[:, None]).ravel(), np.minimum(4 * own, far - 1) + shift[start], side="right") - start * n
    rows = np.argsort(-ends, kind="stable")
    sorted_x, lists, lengths = x[rows], order[start[rows]], -ends[rows]
    best, at = own[rows], start[rows].copy()
    for rank in range(int(ends.max(initial=0))):
        live = int(np.searchsorted(lengths, -rank, side="left"))
        entry = lists[:live, rank]
        distance = ((sorted_x[:live] - entries[entry]) ** 2).sum(1)
        nearer = (distance < best[:live]) | ((distance == best[:live]) & (entry < at[:live]))
        best[:live][nearer], at[:live][nearer] = distance[nearer], entry[nearer]
    code, error = np.empty_like(at), np.empty_like(best)
    code[rows], error[rows] = at, best
    return code, error


def searched(vectors: np.ndarray, books: list[np.ndarray], start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (rows x parts) and errors of all rows, which have one length."""
    codes, error = np.empty((len(vectors), len(books)), np.int64), np.zeros(len(vectors), np.int64)
    for p, (lo, hi) in enumerate(bounds(vectors.shape[1], len(books))):
        codes[:, p], own = exponion(vectors[:, lo:hi], books[p], start[:, p])
        error += own
    return codes, error


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, integer matrix) of a batch, for each length of its vectors."""
    column = batch.column("v")
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False).astype(np.int64)
    lengths = np.diff(offsets)
    for length in np.unique(lengths):
        rows = np.flatnonzero(lengths == length)
        yield int(length), rows, values[offsets[rows][:, None] + np.arange(length)]


def _starts(batch: pa.RecordBatch, rows: np.ndarray) -> np.ndarray:
    """The codes of the rows; entry 0 where there are none yet."""
    if "codes" not in batch.schema.names:
        return np.zeros((len(rows), PARTS), np.int64)
    held = b"".join(batch.column("codes").take(pa.array(rows)).to_pylist())
    return np.frombuffer(held, np.uint8).reshape(len(rows), PARTS).astype(np.int64)


def _coded(batches: Iterator[pa.RecordBatch], chain: list[Codebooks]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with its rows' codes and errors after a search of each of the codebooks in turn."""
    for batch in batches:
        codes, errors = np.zeros((batch.num_rows, PARTS), np.int64), np.zeros(batch.num_rows, np.int64)
        for length, rows, vectors in _by_length(batch):
            codes[rows] = _starts(batch, rows)
            for books in chain:
                codes[rows], errors[rows] = searched(vectors, books[length], codes[rows])
        yield batch, codes, errors


def assigned(rows: DataFrame, chain: list[Codebooks]) -> DataFrame:
    """The rows with their codes, one byte a part, and errors."""
    def run(batches):
        for batch, codes, errors in _coded(batches, chain):
            kept = {n: batch.column(n) for n in batch.schema.names if n != "codes"}
            yield pa.RecordBatch.from_pydict(kept | {"codes": pa.array([c.tobytes() for c in codes.astype(np.uint8)], pa.binary()), "error": pa.array(errors)})

    names = [c for c in rows.columns if c != "codes"]
    ddl = ", ".join(f"`{n}` {rows.schema[n].dataType.simpleString()}" for n in names)
    return rows.mapInArrow(run, f"{ddl}, codes binary, error long")


def updated(rows: DataFrame, chain: list[Codebooks]) -> Codebooks:
    """The last codebooks of the chain with every used entry replaced by the floored mean of its parts. A task sums its rows'
    parts before they are shuffled; sums and counts, of the codebooks' size, come to the driver."""
    books = chain[-1]

    def run(batches):
        totals = {d: [(np.zeros_like(b), np.zeros(len(b), np.int64)) for b in own] for d, own in books.items()}
        for batch, codes, _ in _coded(batches, chain[1:]):  # the rows carry the codes of the first
            for length, at, vectors in _by_length(batch):
                for p, (lo, hi) in enumerate(bounds(length)):
                    np.add.at(totals[length][p][0], codes[at, p], vectors[:, lo:hi])
                    totals[length][p][1][:] += np.bincount(codes[at, p], minlength=len(totals[length][p][1]))
        for d, own in totals.items():
            used = [(p, e, int(count[e]), sums[e].tolist()) for p, (sums, count) in enumerate(own) for e in np.flatnonzero(count).tolist()]
            flat = [(d, p, e, place, value) for p, e, count, sums in used for place, value in enumerate([count, *sums])]
            if flat:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*flat, strict=True)], names=["length", "part", "entry", "place", "value"])

    cells = rows.mapInArrow(run, "length long, part long, entry long, place long, value long").groupBy("length", "part", "entry", "place").agg(F.sum("value").alias("value"))
    sums: dict[tuple[int, int, int], dict[int, int]] = {}
    for r in cells.toLocalIterator():
        sums.setdefault((r.length, r.part, r.entry), {})[r.place] = r.value
    new = {d: [b.copy() for b in own] for d, own in books.items()}
    for (d, p, e), got in sums.items():
        new[d][p][e] = [got[place] // got[0] for place in range(1, new[d][p].shape[1] + 1)]
    return new


def first_books(rows: DataFrame, entries: int = ENTRIES) -> Codebooks:
    """For each length of vectors the parts of those with the smallest ids (null ids last, ties by components)."""
    books: Codebooks = {}
    for (length,) in rows.select(F.size("v")).distinct().collect():  # lengths are a property of the index, not of rows
        least = rows.where(F.size("v") == length).select("vec_id", "v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
        matrix = np.array([r.v for r in least], np.int64).reshape(len(least), length)
        books[length] = [matrix[:, lo:hi].copy() for lo, hi in bounds(length)]
    return books


def spelled(books: Codebooks) -> str:
    """All entries' components by length, part, entry and position."""
    return ",".join(str(x) for d in sorted(books) for own in books[d] for x in own.ravel().tolist())


def train(table: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[Codebooks]]:
    """The integer rows with the codes of the first round, and the codebooks that the later passes search, in order: those
    after round 1, after round 2 and so on."""
    source = integers(table)
    first = first_books(source)
    rows = materialize(assigned(source, [first]), "codes")
    chain = [first]
    for _ in range(rounds):
        chain.append(updated(rows, chain))
    return rows, chain[1:]


def compress(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every row whose vector holds finite components only.

    Vectors of another length have codebooks of their own; with a length that 16 does not divide parts are as even as can
    be, empty ones below 16, coded 0. Null ids are the largest; rows with equal ids and vectors are coded alike, and of
    equal ids the vector with the smaller components begins a codebook. With fewer than 64 rows a codebook has as many
    entries. Null labels are one label. Components beyond 65,536 either way count as that. No row left gives an empty
    result; other columns are ignored.
    """
    rows, chain = train(table)
    digest = hashlib.sha256(spelled(chain[-1]).encode()).hexdigest()
    coded = assigned(rows.drop("error"), chain).select("vec_id", "label", F.lower(F.hex("codes")).alias("code"), "error")
    kept = materialize(coded, "compressed")
    totals = kept.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    whole = kept.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return whole.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
