"""Stateful streams: sessions of samples under a watermark, and attempts up to the first valid one.

Both come with their batch form, whose rows the stream gives too, whatever the order in which its input arrives. They need the
RocksDB state store (``STORE``); state goes to the stream's checkpoint, from which a restart goes on.
"""

import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, Row, Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: What a session that runs these streams has to be set to.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
IDLE, ACTIVE = "idle", "request"
SESSION = "key string, start_us long, end_us long, n long, n_idle long, n_active long, widest_us long, peak double, idle_peak double, valid boolean"
ATTEMPT = "key string, status string, attempt int, parsed string, n_attempts long"
MOST = 3
DONE = -1
#: Keys are dealt to so many groups, whose state is read whole; a checkpoint holds for one number only.
GROUPS = 4_096
#: So many texts of a group's state are written as one.
TEXTS = 16
#: So much input is held to join the texts of its groups.
BYTES = 16 << 20
#: A row to the state holds about so much at most, whatever one key has; Arrow batches have a number of rows.
CELL = 16 << 10


def _begun(at: int) -> dict:
    return {"start_us": at, "end_us": at, "n": 0, "n_idle": 0, "n_active": 0, "widest_us": 0, "peak": None, "idle_peak": None}


def _higher(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else max(a, b)


class Sessions(StatefulProcessor):
    """Of each key's samples (at_us, phase, level), sessions that end where none comes for ``gap_us``.

    Samples wait until the watermark has passed them, then they are taken in order; so what waits is bounded by the watermark's
    delay, and a session is given once no sample can belong to it any more."""

    def __init__(self, gap_us: int):
        self.gap_us = gap_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at_us long, phase string, level double")
        self.open = handle.getValueState("open", "start_us long, end_us long, n long, n_idle long, n_active long, widest_us long, peak double, idle_peak double")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1_000, [(r.at_us, r.phase, r.level) for r in rows])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs() * 1_000)

    def _advance(self, key, until_us: int, new: list[tuple] = []) -> Iterator[Row]:
        """Takes what is ready of the samples that waited and the new ones; the state is read and written once, as every call of it goes
        to the JVM and back."""
        waited = list(self.waiting.get()) if self.waiting.exists() else []
        samples = sorted(((s[0], s[1] or "", s[2]) for s in [*waited, *new]), key=lambda s: (s[0], s[1], s[2] is None, s[2] or 0.0))
        ready, later = [s for s in samples if s[0] < until_us], [s for s in samples if s[0] >= until_us]
        was = self.open.get()
        held = Row(*_begun(0))(*was).asDict() if was is not None else None
        for at, phase, level in ready:
            if held is not None and at - held["end_us"] > self.gap_us:
                yield self._row(key, held)
                held = None
            held = held or _begun(at)
            held |= {"widest_us": max(held["widest_us"], at - held["end_us"]), "end_us": at, "n": held["n"] + 1}
            if phase == IDLE:
                held |= {"n_idle": held["n_idle"] + 1, "idle_peak": _higher(held["idle_peak"], level)}
            if phase == ACTIVE:
                held |= {"n_active": held["n_active"] + 1, "peak": _higher(held["peak"], level)}
        if held is not None and until_us - held["end_us"] > self.gap_us and (not later or later[0][0] - held["end_us"] > self.gap_us):
            yield self._row(key, held)
            held = None
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1_000 + 1)
        elif waited:
            self.waiting.clear()
        if held is not None:
            self.open.update(tuple(held.values()))
            self.handle.registerTimer((held["end_us"] + self.gap_us) // 1_000 + 2)
        elif was is not None:
            self.open.clear()

    def _row(self, key, held: dict) -> Row:
        return Row(key=key[0], **held, valid=held["n_idle"] > 0 and held["n_active"] > 0)

    def close(self) -> None:
        pass


def sessions(samples: DataFrame, gap_us: int, delay: str) -> DataFrame:
    """The closed sessions of a stream (key, ts, phase, level); what comes later than ``delay`` is dropped, as any watermark does."""
    rows = samples.withWatermark("ts", delay).select(F.col("key").cast("string").alias("key"), "ts", F.unix_micros("ts").alias("at_us"), "phase", F.col("level").cast("double").alias("level"))
    return rows.groupBy("key").transformWithState(statefulProcessor=Sessions(gap_us), outputStructType=SESSION, outputMode="Append", timeMode="EventTime")


def sessions_of(samples: DataFrame, gap_us: int) -> DataFrame:
    """The sessions of a table; the last one of a key counts as closed."""
    w = W.partitionBy("key").orderBy("at_us")
    rows = samples.select(F.col("key").cast("string").alias("key"), F.unix_micros("ts").alias("at_us"), "phase", F.col("level").cast("double").alias("level"))
    step = F.col("at_us") - F.lag("at_us").over(w)
    cut = rows.withColumn("step", step).withColumn("session", F.count_if(F.col("step") > gap_us).over(w.rowsBetween(W.unboundedPreceding, 0)))
    idle, active = F.col("phase") == IDLE, F.col("phase") == ACTIVE
    found = cut.groupBy("key", "session").agg(
        F.min("at_us").alias("start_us"), F.max("at_us").alias("end_us"), F.count("*").alias("n"), F.count_if(idle).alias("n_idle"), F.count_if(active).alias("n_active"),
        F.coalesce(F.max(F.when(F.col("step") <= gap_us, F.col("step"))), F.lit(0)).cast("long").alias("widest_us"), F.max(F.when(active, F.col("level"))).alias("peak"), F.max(F.when(idle, F.col("level"))).alias("idle_peak"),
    )
    return found.drop("session").withColumn("valid", (F.col("n_idle") > 0) & (F.col("n_active") > 0))


def _taken(key: str | None, known: dict[int, tuple], new: list[tuple]) -> tuple[list[Row], bool]:
    """Takes a key's new attempts (attempt, status, parsed) into the known ones: the rows to give, and whether the key is done."""
    out = []
    for n, status, parsed in sorted(new, key=lambda a: (a[0], a[1] or "", a[2] or "")):
        if 1 <= n <= MOST and known.setdefault(n, (status, parsed)) != (status, parsed):
            out.append(Row(key=key, status="CACHED_ATTEMPT_CONTENT_CHANGED", attempt=n, parsed=parsed, n_attempts=len(known)))
    for n in range(1, MOST + 1):
        if n not in known:
            break
        if known[n][0] == "OK":
            return [*out, Row(key=key, status="OK", attempt=n, parsed=known[n][1], n_attempts=n)], True
        if n == MOST:
            return [*out, Row(key=key, status="STAGE_ATTEMPTS_EXHAUSTED", attempt=None, parsed=None, n_attempts=n)], True
    return out, False


class Attempts(StatefulProcessor):
    """Of each key's attempts (attempt, status, parsed), the first OK among numbers 1 to 3, once all before it are known, or that they
    are exhausted. An attempt that comes again is the same one; if it says something else, that is reported and the first stays.

    Every call of the state goes to the JVM and back, so a key's is one value: a mask of the numbers known, or that it is done, and
    what they said. It is read once and written once a batch."""

    def init(self, handle) -> None:
        self.held = handle.getValueState("held", "mask int, " + ", ".join(f"s{n} string, p{n} string" for n in range(1, MOST + 1)))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.held.get() or (0, *[None] * 2 * MOST)
        if held[0] == DONE:
            return
        known = {n: (held[2 * n - 1], held[2 * n]) for n in range(1, MOST + 1) if held[0] >> n & 1}
        out, done = _taken(key[0], known, [(r.attempt, r.status, r.parsed) for r in rows])
        if done:
            self.held.update((DONE, *[None] * 2 * MOST))
        elif known:
            self.held.update((sum(1 << n for n in known), *[x for n in range(1, MOST + 1) for x in known.get(n, (None, None))]))
        yield from out

    def close(self) -> None:
        pass


class AttemptsTogether(StatefulProcessor):
    """The same of all keys of a group, whose attempts come as JSON texts (group, said): calls of the state, and of the group, and rows
    cost much more than what an attempt does, so many keys share them.

    The group's state is a list of JSON texts, [keys that are done, [key, its attempts] of the others], a later one before an earlier
    one. A batch reads them all and appends one with the keys that it has changed; from ``TEXTS`` on they are written as one."""

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "said string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict = {}
        for _, said in rows:
            for one, n, status, parsed in json.loads(said):
                new.setdefault(one, []).append((int(n), status, parsed))
        texts = [said for said, in self.held.get()]
        done, known = set(), {}
        for over, begun in map(json.loads, texts):
            done.update(over)
            known |= {one: {n: (status, parsed) for n, status, parsed in said} for one, said in begun}
        ended, changed = [], {}
        for one, attempts in new.items():
            if one in done:
                continue
            now = dict(known.get(one, {}))
            out, over = _taken(one, now, attempts)
            yield from out
            if over:
                ended.append(one)
            elif now != known.get(one, {}):
                changed[one] = now
        if len(texts) + 1 >= TEXTS:
            done.update(ended)
            self.held.put([(_said(done, {one: now for one, now in (known | changed).items() if one not in done}),)])
        elif ended or changed:
            self.held.appendValue((_said(ended, changed),))

    def close(self) -> None:
        pass


def _said(done: Iterable, known: dict) -> str:
    return json.dumps([list(done), [[one, [[n, *said] for n, said in now.items()]] for one, now in known.items()]], separators=(",", ":"))


def _together(batches: Iterator) -> Iterator:
    """Rows (group, said) with the texts of one group as JSON lists of about ``CELL`` bytes at most, out of ``BYTES`` at a time."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    def joined(waiting: list):
        rows = pa.Table.from_batches(waiting)
        groups = rows["group"].to_numpy()
        order = np.argsort(groups, kind="stable")
        said, groups = rows["said"].to_numpy()[order], groups[order]
        cells = np.cumsum(pc.binary_length(rows["said"]).to_numpy()[order], dtype="int64") // CELL
        starts = np.flatnonzero((np.diff(groups, prepend=-1) != 0) | (np.diff(cells, prepend=-1) != 0))
        texts = ["[" + ",".join(said[a:b]) + "]" for a, b in zip(starts, [*starts[1:], len(said)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(groups[starts], pa.int64()), pa.array(texts, pa.string())], names=["group", "said"])

    waiting, size = [], 0
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            size += batch.nbytes
        if size >= BYTES:
            yield joined(waiting)
            waiting, size = [], 0
    if waiting:
        yield joined(waiting)


def first_valid(attempts: DataFrame) -> DataFrame:
    """key, status, attempt, parsed, n_attempts of a stream (key, attempt, status, parsed), each key once."""
    rows = attempts.where(F.col("attempt").between(1, MOST)).select(F.col("key").cast("string").alias("key"), F.col("attempt").cast("int").alias("attempt"), "status", "parsed")
    rows = rows.select(F.pmod(F.xxhash64("key"), F.lit(GROUPS)).alias("group"), F.to_json(F.array("key", F.col("attempt").cast("string"), "status", "parsed")).alias("said"))
    return rows.mapInArrow(_together, "group long, said string").groupBy("group").transformWithState(statefulProcessor=AttemptsTogether(), outputStructType=ATTEMPT, outputMode="Append", timeMode="None")


def first_valid_of(attempts: DataFrame) -> DataFrame:
    """The same of a table, for keys that are decided: the first OK with all attempts before it, or three without."""
    known = attempts.where(F.col("attempt").between(1, MOST)).groupBy(F.col("key").cast("string").alias("key"), F.col("attempt").cast("int").alias("attempt")).agg(F.min(F.struct("status", F.coalesce("parsed", F.lit("")).alias("p"), "parsed")).alias("a"))
    by = known.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("attempt", "a.status", "a.parsed"))).alias("l"))
    run = by.withColumn("l", F.filter("l", lambda x, i: x["attempt"] == i + 1))
    first = F.filter("l", lambda x: x["status"] == "OK")
    out = run.withColumn("ok", F.try_element_at(first, F.lit(1))).where((F.size(first) > 0) | (F.size("l") == MOST))
    return out.select("key", F.when(F.col("ok").isNotNull(), "OK").otherwise("STAGE_ATTEMPTS_EXHAUSTED").alias("status"), F.col("ok.attempt").alias("attempt"), F.col("ok.parsed").alias("parsed"), F.coalesce(F.col("ok.attempt"), F.lit(MOST)).cast("long").alias("n_attempts"))
