"""Small cases with known answers."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lumenary.functions import diffs, text, vectors
from lumenary.operators import checks, closure, evidence, exact, greedy, intervals, ledger, metrics, schedule, topk, windows
from lumenary.sources import io
from lumenary.streaming import rollups


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


def test_ties_go_to_smaller_ids(spark):
    rows = spark.createDataFrame([(i, [0.6, 0.8]) for i in range(9, 0, -1)], "id long, v array<float>")
    assert [r.id for r in topk.exact_top_k(rows.where("id = 9"), rows, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]
    rows = spark.createDataFrame([(0, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [-1.0, 0.0])], "id long, v array<double>")
    assert [tuple(r) for r in topk.single_top_k([1.0, 0.0], rows, 4).collect()] == [(1, 1.0), (2, 0.6), (0, 0.0), (3, -1.0)]
    for bad in ([2.0, 0.0], [float("nan"), 0.0]):
        with pytest.raises(ValueError):
            topk.single_top_k(bad, rows, 1)


def test_evidence(spark):
    rows = spark.createDataFrame([(1, 0, 0, "A"), (1, 0, 1, "B"), (1, 0, 1, "C")], "question int, grp int, combo int, chunk string")
    for have, recall in ((["A"], 1.0), (["B"], 0.0), (["B", "C"], 1.0)):
        got = spark.createDataFrame([(c,) for c in have], "chunk string")
        assert evidence.coverage(rows, got).first().recall == recall
    cover = [(1, 0, 0, 1), (1, 0, 0, 2), (1, 0, 1, 3), (1, 1, 0, 2), (1, 1, 1, 4), (1, 1, 1, 5)]
    assert evidence.min_cover(spark.createDataFrame(cover, "question int, grp int, combo int, chunk long")).first().min_cover == 2
    r = one(spark, a=evidence.covered(F.expr("array(array('A'), array('B', 'C'))"), F.expr("array('C', 'B')")), b=evidence.covered(F.expr("array(array('A'))"), F.expr("array('B')")))
    assert (r.a, r.b) == (True, False)


def test_distribution(spark):
    rows = spark.createDataFrame([("x", 0.0), ("x", 10.0), ("y", None)], "k string, v double")
    got = {r.k: tuple(r)[1:] for r in exact.percentiles(rows, ["k"], "v", {"median": 0.5, "p95": 0.95}).collect()}
    assert got == {"x": (2, 5.0, 9.5), "y": (0, None, None)}


def test_schedule(spark):
    got = schedule.paired_schedule(spark.range(60).select(F.format_string("Q%02d", "id").alias("question_id"))).orderBy("sequence").collect()
    assert [r.sequence for r in got] == list(range(1, 361)) and len({r.key for r in got}) == 360
    order = {n: [r.question_id for r in got if r.round == n][::2] for n in (1, 2, 3)}
    assert order[2] == order[1][::-1] and order[3] == order[1]
    assert all(a.question_id == b.question_id and a.condition != b.condition for a, b in zip(got[::2], got[1::2]))


def test_citations(spark):
    r = spark.range(1).select(F.lit("a [C000123] b [C1] c [C000456].").alias("t")).select(text.citations(F.col("t")).alias("c"), text.strip_citations(F.col("t")).alias("s")).first()
    assert r.c == ["[C000123]", "[C000456]"] and r.s == "a  b [C1] c ."


def test_relevance(spark):
    rows = [(k, -1.0, f) for k, flags in (("a", (1, 1, 1)), ("b", (1, 0, 1)), ("c", (0, 0, 0))) for f in flags]
    got = {r.k: r.value for r in metrics.relevance(spark.createDataFrame(rows, "k string, cos double, flag int"), "k").collect()}
    assert got == {"a": 0.0, "b": -1.0, "c": -1.0}


def test_paired_needs_both(spark):
    rows = spark.createDataFrame([("m", "Q1", "L", 0.2), ("m", "Q1", "R", 0.7), ("m", "Q2", "L", None), ("m", "Q2", "R", 1.0)], "metric string, q string, condition string, value double")
    r = metrics.paired(rows, "q", "L", "R").first()
    assert (r.paired_n, round(r.mean_difference, 12), r.higher, r.equal, r.lower) == (1, 0.5, 1, 0, 0)


def test_cube_keeps_nulls(spark):
    rows = spark.createDataFrame([("R", "s", "m", None, "N/A"), ("R", "t", "m", 0.0, "OK"), ("R", None, "m", 1.0, "OK")], "condition string, type string, metric string, value double, status string")
    got = {r.label: tuple(r)[3:] for r in metrics.cube(rows).collect()}
    assert got == {"all": (0.5, 2, 3, "N/A=1,OK=2"), "s": (None, 0, 1, "N/A=1"), "t": (0.0, 1, 1, "OK=1"), None: (1.0, 1, 1, "OK=1")}


def test_support_without_claims(spark):
    rows = spark.createDataFrame([("a", None), ("b", 1), ("b", 0)], "k string, verdict int")
    for zero, value, status in ((True, 0.0, "NO_FACTUAL_CLAIM_ZERO"), (False, None, "N/A_NO_CLAIM")):
        got = {r.k: (r.value, r.status) for r in metrics.support(rows, "k", zero).collect()}
        assert got == {"a": (value, status), "b": (0.5, "OK")}


def test_abstention(spark):
    for rag, want in ((True, False), (False, True)):
        t, f = F.lit(True), F.lit(False)
        assert one(spark, x=metrics.abstains(t, f, f, F.lit(rag), F.lit(1), t, f, t)).x is want


def test_protected_numbers(spark):
    for t in ("-10", "+10", "10.0", "10-15", "110", "10°F", "10/20", "a10"):
        assert not one(spark, x=text.contains_protected(F.lit(t), "10")).x, t
    assert one(spark, x=text.contains_protected(F.lit("Value:  10 V"), "10")).x


def test_norm(spark):
    r = one(spark, a=text.norm(F.lit(" a  b\n")), b=text.norm(F.lit("A b")), c=text.norm(F.lit("-1")), d=text.norm(F.lit("1")))
    assert r.a == "a b" and r.b != r.a and r.c != r.d
    keys = spark.createDataFrame([("What  is THIS?",), ("what is ｔｈｉｓ!",)], "t string").select(text.question_key("t").alias("k")).collect()
    assert keys[0].k == keys[1].k == "what is this"


def test_decisions(spark):
    rows = spark.createDataFrame([(1, "PREFERRED", "x"), (1, "EXCLUDED_NON_TEXT", "y"), (2, "PREFERRED", "x"), (2, "EXCLUDED_NON_TEXT", "y"), (2, "LAYOUT_ONLY", "a"), (3, "PREFERRED", None)], "k int, state string, reason string")
    got = {r.k: (r.state, r.reasons) for r in ledger.decide(rows, "k").collect()}
    assert got == {1: ("EXCLUDED_NON_TEXT", "x; y"), 2: ("NEEDS_REVIEW", "a; x; y"), 3: ("PREFERRED", "")}


def words():
    spans = lambda s: [m.span() for m in re.finditer(r"\S+", s)]
    return windows.Counter(spans, spans)


def test_body_windows():
    rng, counter = random.Random(0), words()
    count = counter.count
    body = " ".join("".join(rng.choice("abcé漢") for _ in range(rng.randrange(1, 6))) for _ in range(260))
    found = windows.body_windows(body, "title of it ", counter, 60, 12)
    assert len(found) > 2 and found[0][0] == 0 and found[-1][1] == len(body) and found[0][3:] == (0, 0)
    for (s, e, *_), (s2, e2, _, tokens, o2) in zip(found, found[1:]):
        assert s < s2 < e < e2 and o2 == e - s2 and count(body[s2:e]) == tokens >= 12 > count(body[s2 + 1 : e]) - (count(body[s2 + 1 : e]) == 12)
    assert all(count("title of it " + body[s:e]) == n <= 60 for s, e, n, *_ in found)
    assert windows.body_windows("short", "", counter, 60, 12) == [(0, 5, 1, 0, 0)] and windows.body_windows(" \n", "", counter, 60, 12) == []
    with pytest.raises(ValueError):
        windows.body_windows("a b c", "p " * 60, counter, 60, 12)
    with pytest.raises(ValueError):
        windows.body_windows("a b c", "", counter, 60, 60)


def plain_windows(body, prefix, model, size, overlap):
    """The rule by counts of whole texts, character by character."""
    count = lambda s: len(model.encode(s, add_special_tokens=False).ids)
    out, start, shared = [], 0, 0
    if not body.strip():
        return out
    while True:
        end = len(body)
        if count(prefix + body[start:]) > size:
            offsets = model.encode(body[start:], add_special_tokens=False).offsets
            end = max(start + 1, min(start + offsets[min(max(1, size - count(prefix)), len(offsets)) - 1][1], len(body)))
            while end > start and count(prefix + body[start:end]) > size:
                end -= 1
            while end < len(body) and count(prefix + body[start : end + 1]) <= size:
                end += 1
        if end <= start or out and end <= out[-1][1]:
            raise ValueError
        out.append((start, end, count(prefix + body[start:end]), shared, out[-1][1] - start if out else 0))
        if end == len(body):
            return out
        begin = next((a for a in range(end - 1, start - 1, -1) if count(body[a:end]) >= overlap), start)
        if begin == start:
            raise ValueError
        start, shared = begin, count(body[begin:end])


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_windows_of_a_real_tokenizer(name):
    """Equal to the plain rule on words, runs of blanks and symbols, scripts, long words and no words at all."""
    tokens = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = tokens.path(name)
    model, counter = Tokenizer.from_file(path), windows.bpe_counter(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = True
    rng = random.Random(7)
    parts = ["the", " quick", "international", "  ", "\n\n", "\t", " 6.5L", "±25 °C", "압력", "🛠️", "...", "don't", "x" * 40, " ", "Étion", "<|endoftext|>", "漢字", "'s", "-", "1234567"]
    for size, overlap, n in ((20, 5, 60), (40, 15, 150), (12, 3, 80), (30, 25, 100)):
        for _ in range(12):
            body = "".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(n))
            prefix = rng.choice(["", "WARNING\nCondition: stopped.\n\n" if size > 20 else "W "])
            outcomes = []
            for f, args in ((windows.body_windows, (counter,)), (plain_windows, (model,))):
                try:
                    outcomes.append(f(body, prefix, *args, size, overlap))
                except ValueError:
                    outcomes.append("error")
            assert outcomes[0] == outcomes[1], (body, prefix, size, overlap)


def test_token_chunks_of_the_table(spark, sf_dir):
    """The query's chunks of the shorter documents, by the plain rule, and the numbers of all."""
    import hashlib

    tokens = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from lumenary.plans.catalogue import QUERIES

    model = Tokenizer.from_file(tokens.path("byte_bpe_50k.json"))
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = True
    got = QUERIES["token_chunks"](spark, sf_dir).orderBy("chunk").collect()
    assert [r.chunk for r in got] == [f"C{i + 1:06d}" for i in range(len(got))] and [(r.doc_id, r.window) for r in got] == sorted((r.doc_id, r.window) for r in got)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) between 1 and 1800").limit(25).collect()}
    for doc, text in docs.items():
        prefix = f"Document {doc}\n\n"
        want = [(*w, hashlib.sha256((prefix + text[w[0] : w[1]]).encode()).hexdigest()) for w in plain_windows(text, prefix, model, 500, 100)]
        assert [(r.start, r.end, r.token_count, r.overlap_tokens, r.overlap_chars, r.text_sha256) for r in got if r.doc_id == doc] == want


def test_window_time_is_linear():
    """A window costs the same anywhere in a long text: the counter is never given more than a few windows at once."""
    longest, spans = [0], lambda s: [m.span() for m in re.finditer(r"\S+", s)]

    def offsets(s):
        longest[0] = max(longest[0], len(s))
        return spans(s)

    body = "word " * 40_000
    found = windows.body_windows(body, "", windows.Counter(offsets, spans), 50, 10)
    assert len(found) == 1_000 and longest[0] < 2_000


def test_unit_windows(spark):
    units = spark.createDataFrame([("a", "", "x y z"), ("b", "p q r", "x"), ("c", None, None)], "id string, prefix string, body string")
    got = [tuple(r) for r in windows.unit_windows(units, "id", words, 3, 1).drop("text_sha256").orderBy("id").collect()]
    assert got == [("a", 0, 0, 5, 3, 0, 0, None), ("b", *[None] * 6, "the prefix leaves no room")]


def test_patch_errors(spark):
    records = spark.createDataFrame([("r", "abcdef")], "record_id string, text string")
    patches = [(1, "r", 0, 2, "ab", "x"), (1, "r", 1, 3, "bc", "y"), (3, "r", 4, 9, "ef", "z"), (4, "r", 3, 4, "x", "d"), (5, "q", 0, 1, "a", "b"), (6, "r", 5, 6, "f", "f")]
    got = {r.code: r.n for r in ledger.patch_errors(spark.createDataFrame(patches, "id int, record_id string, start int, end int, before string, after string"), records).collect()}
    assert got == {"DUPLICATE_ID": 2, "OVERLAP": 2, "OUT_OF_RANGE": 1, "BEFORE_MISMATCH": 1, "NO_RECORD": 1, "NO_CHANGE": 1}


def test_splice(spark):
    r = spark.createDataFrame([("a12b345c",), ("none",), ("7",)], "t string").select(text.splice(F.col("t"), text.hits(F.col("t"), "[0-9]+", "<n>")).alias("s")).collect()
    assert [x.s for x in r] == ["a<n>b<n>c", "none", "<n>"]


def test_first_valid(spark):
    rows = spark.createDataFrame([("a", 1, "ERROR", "x"), ("a", 2, "OK", "y"), ("a", 3, "OK", "z"), ("b", 1, "ERROR", "x"), ("b", 4, "OK", "w")], "k string, attempt int, status string, parsed string")
    assert {r.k: tuple(r)[1:] for r in schedule.first_valid(rows, "k").collect()} == {"a": (2, "y", 3), "b": (None, None, 1)}


def test_intervals(spark):
    a = spark.createDataFrame([(1, 0, 10), (1, 10, 20), (1, 95, 310)], "k int, a0 int, a1 int")
    b = spark.createDataFrame([(1, 10, 11), (1, 5, 10), (1, 100, 300), (2, 0, 9)], "k int, b0 int, b1 int")
    assert sorted((r.a0, r.b0) for r in intervals.overlap_join(a, b, ["k"], 7).collect()) == [(0, 5), (10, 10), (95, 100)]
    rows = spark.createDataFrame([(1, 0, 4), (1, 2, 3), (1, 6, 9), (1, 9, 9)], "k int, s int, e int")
    assert intervals.union_length(rows, "k", "s", "e").first().covered == 7
    parts = spark.createDataFrame([(1, 0, 4, 6), (1, 4, 6, 6), (2, 0, 4, 6), (2, 5, 6, 6)], "k int, start int, end int, length int")
    assert {r.k: r.gap_free for r in intervals.is_partition(parts, "k", "length").collect()} == {1: True, 2: False}
    clusters = spark.createDataFrame([(1, x) for x in (0.0, 2.0, 2.9, 3.0, 5.0, 6.0)], "k int, v double")
    assert [tuple(r) for r in greedy.clusters(clusters, "k", "v", 3.0).orderBy("anchor").collect()] == [(1, 0.0, 3), (1, 3.0, 2), (1, 6.0, 1)]


def test_checks(spark):
    a, b = spark.createDataFrame([("x", "1"), ("y", None), ("z", "3")], "k string, m string"), spark.createDataFrame([("y", None), ("z", "4"), ("w", "1")], "k string, m string")
    assert {r.status: r.n for r in checks.inventory_diff(a, b, "k", "m").collect()} == {"MISSING": 1, "UNEXPECTED": 1, "CHANGED": 1, "SAME": 1}
    assert checks.same_rows(a, a) and not checks.same_rows(a, b)
    assert checks.multiset_overlap(a.union(a), b, "k").first().overlap == 2
    assert checks.unique_match(a.union(b), "k").count() == 2
    assert [tuple(r) for r in checks.report({"M": (a, F.col("m") > "1")}).collect()] == [("M", 3, 2, "FAIL")]


def test_closure(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (5, 4)], "child int, parent int")
    assert {(r.node, r.ancestor) for r in closure.ancestors(edges).collect()} == {(x, y) for x in (1, 2, 3) for y in (1, 2, 3)} | {(5, 4)}
    dup = "DUPLICATE_ALTERNATIVE"
    pieces = spark.createDataFrame([(1, dup, 2), (2, dup, 1), (3, dup, 4), (3, dup, 1), (4, "INCLUDED", None), (5, "NEEDS_REVIEW", 4)], "node int, status string, target int")
    assert {r.node: r.resolved for r in closure.resolve(pieces).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_vectors(spark):
    r = one(spark, a=vectors.dot(F.expr("array(1f, 2f)"), F.expr("array(3f, 4f)")), b=vectors.dot(F.expr("array(1f)"), F.expr("array(1f, 2f)")), c=vectors.cosine(F.expr("array(0d)"), F.expr("array(1d)")), d=vectors.unit(F.expr("array(0.6d, 0.8d)")), e=vectors.normalise(F.expr("array(3d, 4d)")))
    assert (r.a, r.b, r.c, r.d, r.e) == (11.0, None, None, True, [0.6, 0.8])


def test_diffs(spark):
    rows = spark.createDataFrame([("abcdef", "abXdef"), ("same", "same")], "a string, b string")
    r = rows.select(diffs.similarity("a", "b").alias("s"), diffs.changed_span("a", "b").alias("c")).collect()
    assert round(r[0].s, 3) == 0.833 and tuple(r[0].c) == (2, 3, 3) and r[1].s == 1.0
    source = "first line of it\nnoise\nsecond line of it\nfirst line of it second line of it"
    q = spark.createDataFrame([("first line of it\nsecond line of it", source), ("a\nb", source)], "q string, s string").select(diffs.repaired_quote("q", "s").alias("r")).collect()
    assert [x.r for x in q] == ["first line of it\nsecond line of it", None]  # the source has it, white space aside: unchanged
    assert [tuple(r) for r in diffs.Opcodes(F.lit("abc"), F.lit("axc")).collect()] == [("replace", 1, 2, 1, 2)]


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, t string")
    at = str(tmp_path / "x")
    io.write_new(df, at, "json")
    with pytest.raises(Exception, match="(?i)exist"):
        io.write_new(df, at, "json")
    assert io.read_jsonl(spark, at, "id int, t string").count() == 2
    assert set(io.read_json_folder(spark, at, "id int").columns) == {"id", "file_name"}
    assert sorted(r.id for r in io.extend(df, spark.createDataFrame([(2, "b"), (3, "c")], "id int, t string"), "id").collect()) == [1, 2, 3]
    assert [r.value for r in io.markdown(df, ["id", "t"]).collect()] == ["| 1 | a |", "| 2 | — |"]


def test_stream_matches_batch(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type", "value")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    job = rollups.tumbling(stream, "ts", "1 hour", "event_type").writeStream.outputMode("complete").format("memory").queryName("rolled").trigger(availableNow=True).start()
    job.awaitTermination(120)
    rounded = F.round("total", 6).alias("total")
    batch = rollups.tumbling(events, "ts", "1 hour", "event_type").select("window_start", "event_type", "n", rounded)
    assert checks.same_rows(spark.table("rolled").select("window_start", "event_type", "n", rounded), batch)


def test_touching_components_of_crowds(spark):
    """Equal boxes, islands of boxes with the same sides, and sides that only nearly agree, against all pairs."""
    from lumenary.operators import closure, layout

    rng = random.Random(4)
    rows = []
    for i in range(700):
        x, y = rng.randrange(4) * 1.5, rng.randrange(400) * 1.0
        rows.append((rng.randrange(3), i, x, y, x + rng.randrange(3), y + rng.choice([0.5, 4.0, 30.0, -1.0, -9.0])))
    rows += [(9, 1000 + i, 0.0, 0.0, 1.0, 1.0) for i in range(20_000)] + [(9, 50_000, 100.0, 0.0, 101.0, 1.0), (0, 50_001, float("nan"), 0.0, 1.0, 1.0)]
    boxes = spark.createDataFrame(rows, "page long, id long, x0 double, y0 double, x1 double, y1 double")
    few = boxes.where("id < 1000 or id >= 50000")
    want = {tuple(r) for r in closure.components(layout.touching(few, "page", 2.5, 3.0)).select("node", "component").collect()}
    got = {tuple(r) for r in layout.touching_components(boxes, "page", 2.5, 3.0).select("node", "component").collect()}
    assert got == want | {(1000 + i, 1000) for i in range(20_000)} and len(want) > 100


def test_chunk_ids_beyond_six_digits(spark):
    import duckdb

    from lumenary.operators.schedule import chunk_id

    numbers = [1, 999_999, 1_000_000, 1_234_567, 12_345_678]
    want = [duckdb.execute("SELECT 'C' || lpad(?::BIGINT::VARCHAR, 6, '0')", [n]).fetchone()[0] for n in numbers]
    assert [r[0] for r in spark.createDataFrame([(n,) for n in numbers], "n long").select(chunk_id(F.col("n"))).collect()] == want


def test_windows_tokenize_a_text_few_times():
    """The characters that are tokenized for all windows stay within a small multiple of the text."""
    words = re.compile(r" ?[a-z]+|\s+")
    seen = [0]

    def spans(part):
        seen[0] += len(part)
        return [m.span() for m in words.finditer(part)]

    body = " ".join("abcdefghij"[: 1 + i * 7 % 10] + "klmn"[i % 4] for i in range(20_000))
    found = windows.body_windows(body, "title ", windows.Counter(spans, spans), 500, 100)
    assert len(found) == 50 and found[-1][1] == len(body)
    assert seen[0] < 6 * len(body)


def test_ancestors_of_chains(spark):
    """Nodes with one parent each: long chains, loops, ways into loops, with and without a depth."""
    rng = random.Random(8)
    parent = {i: i // 2 for i in range(1, 40)} | {100 + i: 101 + i for i in range(37)} | {i: rng.randrange(200, 260) for i in range(200, 260)} | {300: 300}
    want = set()
    for node in parent:
        at, distance, met = parent[node], 1, set()
        while at is not None and at not in met:
            want.add((node, at, distance))
            met.add(at)
            at, distance = parent.get(at), distance + 1
    edges = spark.createDataFrame(list(parent.items()), "child long, parent long")
    assert closure._chains(edges.toDF("node", "ancestor"), None).where("node = 300").count() == 1
    got = [tuple(r) for r in closure.ancestors(edges).collect()]
    assert len(got) == len(want) and set(got) == want
    got = [tuple(r) for r in closure.ancestors(edges, 5).collect()]
    assert len(got) == len(set(got)) and set(got) == {w for w in want if w[2] <= 5}


def test_points_at_one_place_are_looked_for_once(spark, monkeypatch):
    from lumenary.operators import grid

    asked, holding = [], grid.smallest_holding
    monkeypatch.setattr(grid, "smallest_holding", lambda points, *more: asked.append(points.count()) or holding(points, *more))
    points = spark.createDataFrame([(i, float(i % 4), 1.0) for i in range(2000)] + [(5000, None, 1.0), (5001, 99.0, 1.0)], "id long, x double, y double")
    boxes = spark.sql("SELECT 'b' AS box_id, struct(0.0D AS x0, 0.0D AS y0, 3.0D AS x1, 2.0D AS y1) AS box UNION ALL SELECT 'a', struct(2.0D, 0.0D, 3.0D, 2.0D)")
    got = {r.id: (r.box_id, r.area) for r in checks.smallest_container(points, boxes, "id", F.col("x"), F.col("y")).collect()}
    assert got == {i: ("a", 2.0) if i % 4 >= 2 else ("b", 6.0) for i in range(2000)} | {5000: (None, None), 5001: (None, None)}
    assert asked == [5]


def test_exact_sums_copy_no_row(spark, tmp_path):
    """Rows are read once and not exploded into their digits; without keys and rows there is one row with n = 0."""
    spark.range(100).selectExpr("id % 3 AS k", "id / 7D AS v").write.parquet(str(tmp_path / "t"))
    rows = spark.read.parquet(str(tmp_path / "t"))
    summed = exact.exact_sum(rows, ["k"], "v")
    plan = summed._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("parquet") == 1
    assert {r.k: r.total for r in summed.collect()} == {k: math.fsum(i / 7 for i in range(100) if i % 3 == k) for k in range(3)}
    assert [(r.n, r.odd) for r in exact.place_sums(rows.where("v < 0"), [], "v").collect()] == [(0, None)]


def test_normalise_reads_its_vector_once(spark):
    """A vector that is worked out from a text is not worked out again for its norm or for each component."""
    found = spark.createDataFrame([([4.0, 3.0],), ([0.0, 0.0],), (None,), ([1.0, None],)], "v array<double>").select(vectors.normalise(F.reverse("v")).alias("v"))
    assert [r.v for r in found.collect()] == [[0.6, 0.8], None, None, None]
    assert found._jdf.queryExecution().analyzed().toString().count("reverse(") == 1
