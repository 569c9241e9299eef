"""Stateful streams against their batch forms: out of order, late, repeated, and over a restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lumenary.streaming import stateful

SAMPLE = "key string, ts timestamp, phase string, level double"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def store(spark):
    before = {k: spark.conf.get(k) for k in stateful.STORE}
    for k, v in stateful.STORE.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def run(spark, build, schema, batches, folder, restart_after=None):
    """Feeds the batches one by one; the stream is stopped and started again after every one of ``restart_after``."""
    source, sink, state = f"{folder}/in", f"{folder}/out", f"{folder}/state"
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        if restart_after is None or n in restart_after or n == len(batches) - 1:
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            build(stream).writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(sink).awaitTermination()
    return spark.read.parquet(sink)


def rows(df):
    return sorted((tuple(r) for r in df.select(sorted(df.columns)).collect()), key=str)


def test_sessions_out_of_order_late_and_restarted(spark, store, tmp_path):
    rng = random.Random(3)
    at = lambda s: START + timedelta(seconds=s)
    samples = []
    for key in "abc":
        now = 0.0
        for _ in range(60):
            now += rng.choice([0.5, 1.0, 2.5, 2.5, 40.0])
            samples.append((key, at(now), rng.choice(["idle", "request", "request", None]), round(rng.random() * 9, 3) if rng.random() < 0.9 else None))
    samples.sort(key=lambda r: r[1].timestamp() + rng.random() * 15)  # up to fifteen seconds out of order
    size = len(samples) // 5
    batches = [samples[i : i + size] for i in range(0, len(samples), size)]
    late = [("a", at(0.1), "request", 999.0), ("late only", at(0.2), "idle", 1.0)]
    end = [("z", at(10_000), "idle", 1.0)]
    got = run(spark, lambda s: stateful.sessions(s, 10_000_000, "20 seconds"), SAMPLE, [*batches, end, late, [("z", at(10_001), "idle", 1.0)]], tmp_path, restart_after={1, 3, 5, 6})
    want = stateful.sessions_of(spark.createDataFrame(samples, SAMPLE), 10_000_000)
    assert rows(got) == rows(want) and want.count() > 10
    assert got.where("valid").count() > 0 and got.agg(F.max("peak")).first()[0] < 999


def test_attempts_in_any_order(spark, store, tmp_path):
    rng = random.Random(4)
    schema = "key string, attempt int, status string, parsed string"
    attempts = []
    for k in range(80):
        for n in range(1, rng.randrange(1, 5) + 1):
            ok = rng.random() < 0.4
            attempts += [(f"k{k}", n, "OK" if ok else "EVAL_ERROR", f"{k}/{n}" if ok else None)] * rng.choice([1, 1, 2])
    rng.shuffle(attempts)
    batches = [attempts[i::4] for i in range(4)]
    got = run(spark, stateful.first_valid, schema, batches, tmp_path, restart_after={0, 2})
    want = stateful.first_valid_of(spark.createDataFrame(attempts, schema))
    assert rows(got) == rows(want) and {r.status for r in got.collect()} == {"OK", "STAGE_ATTEMPTS_EXHAUSTED"}
    again = run(spark, stateful.first_valid, schema, [[("x", 2, "OK", "p")], [("x", 2, "OK", "q")], [("x", 1, "ERROR", None)], [("x", 3, "OK", "r")]], tmp_path / "changed", restart_after={0, 1, 2})
    assert {(r.status, r.attempt, r.parsed) for r in again.collect()} == {("CACHED_ATTEMPT_CONTENT_CHANGED", 2, "q"), ("OK", 2, "p")}


def test_state_is_called_few_times():
    """One read and at most one write of a key's state a batch: each call goes to the JVM and back."""
    from types import SimpleNamespace

    from lumenary.streaming import stateful

    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def __getattr__(self, name):
            def call(*args):
                self.calls += 1
                if name in ("update", "put"):
                    self.value = args[0]
                if name == "appendList":
                    self.value = [*(self.value or []), *args[0]]
                if name == "clear":
                    self.value = None
                return {"exists": self.value is not None, "get": self.value, "iterator": iter(())}.get(name)

            return call

    states = []
    make = lambda *_: states.append(State()) or states[-1]
    handle = SimpleNamespace(getValueState=make, getMapState=make, getListState=make, registerTimer=lambda at: None)
    attempts = stateful.Attempts()
    attempts.init(handle)
    row = lambda n, status: SimpleNamespace(attempt=n, status=status, parsed=None)
    assert list(attempts.handleInputRows(("k",), iter([row(2, "OK")]), None)) == []
    assert [r.attempt for r in attempts.handleInputRows(("k",), iter([row(1, "RETRY")]), None)] == [2]
    assert list(attempts.handleInputRows(("k",), iter([row(3, "OK")]), None)) == []
    assert sum(s.calls for s in states) <= 5
    states.clear()
    sessions = stateful.Sessions(10)
    sessions.init(handle)
    sample = SimpleNamespace(at_us=5, phase="idle", level=1.0)
    assert list(sessions.handleInputRows(("k",), iter([sample]), SimpleNamespace(getCurrentWatermarkInMs=lambda: 0))) == []
    assert sum(s.calls for s in states) <= 3


class Held:
    """A state of one key in memory, with the number of calls to it."""

    def __init__(self):
        self.value, self.calls = None, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name in ("update", "put"):
                self.value = args[0]
            if name == "appendValue":
                self.value = [*(self.value or []), args[0]]
            return self.value or [] if name == "get" and isinstance(self.value, list | None) else self.value

        return call


def test_keys_share_calls_of_the_state():
    """A batch of many keys costs two calls of the state; over many batches the rows are those of each key for itself."""
    import json
    from types import SimpleNamespace

    rng, together, lists, apart = random.Random(5), stateful.AttemptsTogether(), [], {}
    together.init(SimpleNamespace(getListState=lambda *_: lists.append(Held()) or lists[-1]))
    got, want = [], []
    for _ in range(3 * stateful.TEXTS):
        batch = [(rng.choice([None, *map(str, range(200))]), rng.choice([1, 2, 3, 3]), *rng.choice([("OK", "p"), ("ERROR", None), ("ERROR", None), ("RETRY", "é")])) for _ in range(rng.choice([0, 5, 30]))]
        before = lists[0].calls
        got += [tuple(r) for r in together.handleInputRows((0,), iter([(0, json.dumps(batch[:3])), (0, json.dumps(batch[3:]))]), None)]
        assert lists[0].calls - before <= 2 and len(lists[0].value or []) < stateful.TEXTS
        for key in dict.fromkeys(r[0] for r in batch):
            if key not in apart:
                apart[key], state = stateful.Attempts(), Held()
                apart[key].init(SimpleNamespace(getValueState=lambda *_, s=state: SimpleNamespace(get=lambda: s.value, update=s.update)))
            rows = [SimpleNamespace(attempt=n, status=status, parsed=parsed) for k, n, status, parsed in batch if k == key]
            want += [tuple(r) for r in apart[key].handleInputRows((key,), iter(rows), None)]
    assert got == want and {r[1] for r in got} == {"OK", "STAGE_ATTEMPTS_EXHAUSTED", "CACHED_ATTEMPT_CONTENT_CHANGED"}


def test_attempts_go_to_the_state_by_groups(spark, store, tmp_path):
    """Many keys, odd ones too, give their batch form's rows, and the state has no more entries than groups."""
    schema = "key string, attempt int, status string, parsed string"
    keys = [None, "null", "", 'a"b', "é\n,[", *(f"k{i}" for i in range(3 * stateful.GROUPS))]
    attempts = [(k, n, "OK" if n == 2 else "ERROR", k if n == 2 else None) for k in keys for n in (2, 1)]
    spark.createDataFrame(attempts, schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    out = stateful.first_valid(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    asked = out.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
    asked.awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == rows(stateful.first_valid_of(spark.createDataFrame(attempts, schema)))
    assert 0 < max(p["stateOperators"][0]["numRowsUpdated"] for p in asked.recentProgress) <= stateful.GROUPS


def test_long_cells_are_cut():
    """A group's texts go on in another row beyond some size, none is lost."""
    import json

    import pyarrow as pa

    said = [json.dumps([str(i), "1", "OK", "x" * 1000]) for i in range(100)]
    batch = pa.RecordBatch.from_arrays([pa.array([7, 3] * 50, pa.int64()), pa.array(said)], names=["group", "said"])
    cells = [(r["group"], json.loads(r["said"])) for b in stateful._together(iter([batch, batch])) for r in b.to_pylist()]
    assert max(len(json.dumps(c)) for _, c in cells) < 2 * stateful.CELL and len(cells) > 4
    for group in (3, 7):
        assert sorted(a for g, c in cells if g == group for a in c) == sorted(json.loads(t) for i, t in enumerate([*said, *said]) if (3 if i % 2 else 7) == group)
