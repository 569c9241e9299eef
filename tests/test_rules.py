"""Operators without SQL, and rules that raise, against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lumenary.functions import classify, diffs, text
from lumenary.operators import audits, build, checks, closure, evidence, exact, layout
from lumenary.operators.passages import contained
from lumenary.sources import io
from lumenary.sources.io import cut_lineage


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quote_repair(spark):
    source = "The valve opens at ten bar.\nIt closes   again when the pressure falls.\nEnd. Then more text. It closes again when the pressure falls. End."
    cases = [
        ("opens at  ten bar.", "opens at  ten bar."),  # there, white space aside: unchanged
        ("The valve opens at\ncloses again when the\nEnd.", "The valve opens at ten bar. It closes again when the pressure falls. End."),  # a short last line is a line too
        ("short\nlines\nonly", None), ("closes again when the\nThe valve opens at", None), (None, None), ("", None),
        ("It closes again when\nthe pressure falls. End.", "It closes again when\nthe pressure falls. End."),
        ("It closes again when\npressure falls. End.", "It closes again when the pressure falls. End."),  # the shorter of two spans
    ]
    df = spark.createDataFrame([(i, q, source) for i, (q, _) in enumerate(cases)], "i int, q string, s string")
    assert [r.r for r in df.select("i", diffs.repaired_quote("q", "s").alias("r")).orderBy("i").collect()] == [w for _, w in cases]
    far = "first line of twelve " + "x" * 400 + " second line of twelve"
    assert diffs._repair("first line of twelve\nsecond line of twelve", far) is None


def test_norm_positions(spark):
    cases = ["  a\u00a0 b\n", "", " ", None, "x", "a  b"]
    got = spark.createDataFrame([(c,) for c in cases], "t string").select(diffs.norm_positions("t").alias("n"), "t").collect()
    for r in got:
        if r.t is None:
            assert r.n.text is None
        else:
            assert r.n.text == " ".join(r.t.split()) and all(c == " " or r.t[i] == c for c, i in zip(r.n.text, r.n.starts)) and len(r.n.text) == len(r.n.starts)


def test_folds_and_boxes(spark):
    assert layout.averaged([(v, 1) for v in (1, 3, 6, 20, 21, 40)], 4) == [(2, 2), (6, 1), (20.5, 2), (40, 1)]
    assert layout.averaged([(1, 1), (4, 2)], 4) == [(3.25, 3)]
    boxes = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 10.0), ("p", 2, 3.0, 1.0, 10.0, 12.0), ("p", 3, 4.0, 0.0, 10.0, 10.0), ("q", 4, 0.0, 0.0, 10.0, 10.0)], "page string, id int, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.distinct_boxes(boxes, "page")) == [("p", 1), ("p", 3), ("q", 4)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (7, 6), (6, 9), (20, 21)] + [(i, i + 1) for i in range(100, 140)], "u long, v long")
    got = {r.node: r.component for r in closure.components(edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 6: 6, 7: 6, 9: 6, 20: 20, 21: 20} | {i: 100 for i in range(100, 141)}


def test_crowded_boxes_meet_no_pairs(spark, monkeypatch):
    rng = random.Random(5)
    found = [("p" if i % 3 else "q", i, *(rng.choice([0.0, 40.0, -7.5]) + rng.random() * spread for spread in (6.0, 9.0, 2.0, 30.0))) for i in rng.sample(range(900), 900)]
    found += [("p", 900 + i, 1.0, float("inf"), 2.0 + 9 * i, 3.0) for i in range(3)] + [("p", 910, float("nan"), 0.0, 1.0, 1.0), ("p", 911, None, 0.0, 1.0, 1.0), (None, 912, 0.0, 0.0, 1.0, 1.0)]
    kept = []
    for box in sorted(found, key=lambda b: b[1]):
        if None in box or not any(k[0] == box[0] and all(abs(x - y) < 4 for x, y in zip(k[2:], box[2:])) for k in kept if None not in k):
            kept.append(box)
    written = []

    def counted(df):
        out = cut_lineage(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(layout, "cut_lineage", counted)
    boxes = spark.createDataFrame(found, "page string, id int, x0 double, y0 double, x1 double, y1 double")
    assert {tuple(r) for r in layout.distinct_boxes(boxes, "page").collect()} == {k[:2] for k in kept}
    assert max(written) <= len(found)


def test_closure_is_a_fixed_point(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(100)] + [(200, 201), (201, 200)], "child long, parent long")
    got = {(r.node, r.ancestor): r.distance for r in closure.ancestors(chain).collect()}
    assert got[0, 100] == 100 and got[200, 200] == 2 and len(got) == 100 * 101 // 2 + 4
    assert closure.ancestors(chain, 40).where("node = 0").count() == 40


def test_required_join(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    assert rows(audits.required_join(a.where("k = 1"), b, "k")) == [(1, "x")]
    with pytest.raises(Exception, match="missing key 2"):
        audits.required_join(a, b, "k").collect()


def test_exact_sum(spark):
    rng = random.Random(4)
    values = [(i % 3, rng.choice([1e16, 1.0, -1e16, 1e-8, 3.7, 1e300, -1e300])) for i in range(3000)] + [(1, None)]
    for k in range(3, 60):  # all sizes and signs, near ties, numbers too small to be normal
        n, scale = rng.randrange(1, 12), rng.choice([-1074, -1060, -500, -30, 0, 40, 900])
        values += [(k, math.ldexp(rng.choice([rng.random() - 0.5, rng.randrange(-9, 10), 1.0, -1.0]), max(-1074, min(1000, scale + rng.randrange(-60, 60))))) for _ in range(n)]
    values += [(60, 1.0), (60, 2.0**-53), (61, 1.0), (61, 2.0**-53), (61, 5e-324), (62, 1.0 + 2**-52), (62, 2.0**-53), (63, 1e308), (63, -1e308), (64, 0.0), (64, -0.0), (65, float("inf")), (65, 1.0), (66, 1.7e308), (66, 1.7e308), (66, -1.7e308), (None, 0.1), (None, 0.2)]
    got = {r.k: r.total for r in exact.exact_sum(spark.createDataFrame(values, "k int, v double").repartition(7), ["k"], "v").collect()}
    assert got.pop(66) == 1.7e308  # beyond the largest double on the way
    assert got == {k: math.fsum(v for i, v in values if i == k and v is not None) for k in {k for k, _ in values} - {66}}
    odd = spark.createDataFrame([(1, float("inf")), (1, float("-inf")), (2, float("nan")), (3, 1.7e308), (3, 1.7e308), (4, -1.7e308), (4, -1.7e308), (5, None)], "k int, v double")
    got = {r.k: r.total for r in exact.exact_sum(odd, ["k"], "v").collect()}
    assert math.isnan(got[1]) and math.isnan(got[2]) and got[3] == math.inf and got[4] == -math.inf and 5 not in got
    units = {r.k: r.units for r in exact.exact_units(spark.createDataFrame([(1, 0.1), (1, 0.2), (2, -1.5), (3, 1e300), (4, 5e-324)], "k int, v double"), ["k"], "v").collect()}
    assert units == {1: int(math.ldexp(0.1, 60)) + int(math.ldexp(0.2, 60)), 2: -3 << 59, 3: None, 4: None}
    assert exact.exact_sum(odd.limit(0), ["k"], "v").count() == 0 and exact.exact_sum(odd.where("k = 3").limit(1), [], "v").first().total == 1.7e308


def test_distribution(spark):
    rng = random.Random(2)
    values = [(k, rng.choice([0.0, 10.0, rng.random() * 100])) for k in "abc" for _ in range({"a": 1, "b": 2, "c": 500}[k])] + [("b", None), ("d", None)]
    df = spark.createDataFrame(values, "k string, v double")
    want = {r.k: (r.n, r.p) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(F.lit(0.5), F.lit(0.95))).alias("p")).collect()}
    assert want.pop("d") == (0, None)
    got = {r.k: (r.n, [r.median, r.p95]) for r in exact.percentiles(df, ["k"], "v", POINTS).collect()}
    assert got.pop("d") == (0, [None, None])
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1]) for k in want)
    two = spark.createDataFrame([("x", 0.0), ("x", 10.0)], "k string, v double")
    assert exact.percentiles(two, ["k"], "v", POINTS).first().p95 == pytest.approx(9.5)


POINTS = {"median": 0.5, "p95": 0.95}


def test_percentiles_of_strays_and_crowds(spark):
    """Cells follow the values: one far stray, one value that most rows have, and many different values in one key, of which no
    more than 50 are ever ordered together."""
    rng = random.Random(9)
    rows = [("stray", rng.random()) for _ in range(3_000)] + [("stray", 1e300)] + [("crowd", 7.0)] * 4_000 + [("crowd", rng.random() * 14) for _ in range(1_000)]
    rows += [("wide", rng.gauss(0, 1) * 10 ** rng.randrange(-5, 6)) for _ in range(5_000)] + [(None, float(i)) for i in range(400)] + [("two", 1.0), ("two", 2.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(6)
    points = {"least": 0.0, "median": 0.5, "p95": 0.95, "most": 1.0}
    want = {r.k: (r.n, r.p) for r in df.groupBy("k").agg(F.count("v").alias("n"), F.percentile("v", F.array(*map(F.lit, points.values()))).alias("p")).collect()}
    plan = exact.percentiles(df, ["k"], "v", points, cells=8, most=50)
    got = {r.k: tuple(r)[1:] for r in plan.collect()}
    assert got.pop("none") == (0, *[None] * 4) and want.pop("none")[0] == 0
    assert got.keys() == want.keys() and all(got[k] == (want[k][0], *[pytest.approx(x) for x in want[k][1]]) for k in want)
    assert exact.percentiles(df, [], "v", {"m": 0.5}, most=50).first().m == pytest.approx(df.agg(F.percentile("v", 0.5)).first()[0])
    assert exact.percentiles(df.limit(0), ["k"], "v", points).count() == 0


def test_smallest_container_and_containment(spark):
    rng = random.Random(3)
    pts = [(i, rng.random() * 100, rng.random() * 100) for i in range(200)]
    boxes = [(f"b{i}", *sorted(rng.random() * 110 for _ in range(2)), *sorted(rng.random() * 110 for _ in range(2))) for i in range(40)]
    b = spark.createDataFrame([(n, (x0, y0, x1, y1)) for n, x0, x1, y0, y1 in boxes], "box_id string, box struct<x0:double,y0:double,x1:double,y1:double>")
    p = spark.createDataFrame(pts, "p int, x double, y double")
    got = {r.p: r.box_id for r in checks.smallest_container(p, b, "p", F.col("x"), F.col("y")).collect()}
    for i, x, y in pts:
        held = [((x1 - x0) * (y1 - y0), n) for n, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1]
        assert got[i] == (min(held)[1] if held else None)
    texts = spark.createDataFrame([(1, "a b  c"), (1, "b c d"), (None, "b\nc"), (2, None), (3, "xbc")], "doc long, text string")
    items = spark.createDataFrame([(10, "b c"), (11, " "), (12, None), (13, "c d"), (14, "b  c")], "item long, text string")
    assert rows(contained(texts, items, "doc", "item")) == sorted([(1, 10), (1, 14), (1, 10), (1, 14), (1, 13), (None, 10), (None, 14)], key=str)
    assert contained(texts, items.limit(0), "doc", "item").count() == 0


def test_containment_in_passes(spark, monkeypatch):
    """Literals of all lengths, cut within words, repeated and nearly the same, in one pass and in several."""
    from lumenary.operators import passages

    rng = random.Random(8)
    words = ["a", "bb", "é", "pump", "valve", "international", "x-1"]
    texts = [(i, rng.choice(["  ", ""]) + rng.choice([" ", "\n", " \t"]).join(rng.choice(words) for _ in range(rng.randrange(0, 60)))) for i in range(120)] + [(500, None), (501, "")]
    plain = {i: " ".join((t or "").split()) for i, t in texts}
    items = []
    for j in range(150):
        t = plain[rng.randrange(120)]
        a = rng.randrange(len(t) + 1)
        piece = t[a : a + rng.choice([1, 3, 8, 20, 60])]
        items.append((j, piece if rng.random() < 0.8 else piece + "!"))
    items += [(900, items[0][1]), (901, ""), (902, None)]
    want = sorted((i, j) for i, t in texts if t is not None for j, p in items if p is not None and " ".join(p.split()) and " ".join(p.split()) in plain[i])
    d, p = spark.createDataFrame(texts, "doc long, text string").repartition(3), spark.createDataFrame(items, "item long, text string")
    assert sorted(map(tuple, contained(d, p, "doc", "item").collect())) == want and len(want) > 500
    monkeypatch.setattr(passages, "PASS_ITEMS", 30)
    monkeypatch.setattr(passages, "SHORT_CHARS", 100)
    assert sorted(map(tuple, contained(d, p, "doc", "item").collect())) == want


def test_top_k_in_blocks(spark, monkeypatch):
    from lumenary.operators import topk

    rng = random.Random(6)
    vectors = [(i, [round(rng.gauss(0, 1), 1) for _ in range(3)]) for i in range(120)]
    df = spark.createDataFrame(vectors, "id long, v array<double>").repartition(3)
    one = sorted(map(tuple, topk.exact_top_k(df, df, 4).collect()))
    monkeypatch.setattr(topk, "QUERIES", 25)
    assert sorted(map(tuple, topk.exact_top_k(df, df, 4).collect())) == one and len(one) == 480
    want = sorted(((-round(sum(a * b for a, b in zip(vectors[7][1], v)), 9), i) for i, v in vectors))[:4]
    assert [(q, r, i) for q, r, i, _ in one if q == 7] == [(7, n + 1, i) for n, (_, i) in enumerate(want)]


def test_min_cover(spark):
    import itertools

    rng, data = random.Random(7), []
    for q in range(30):
        for g in range(rng.randrange(1, 5)):
            for c in range(rng.randrange(1, 4)):
                data += [(q, g, c, rng.randrange(8)) for _ in range(rng.randrange(1, 4))]
    got = {r.question: r.min_cover for r in evidence.min_cover(spark.createDataFrame(data, "question long, grp long, combo long, chunk long")).collect()}
    for q in range(30):
        groups = {}
        for a, g, c, x in data:
            if a == q:
                groups.setdefault(g, {}).setdefault(c, set()).add(x)
        assert got[q] == min(len(set().union(*pick)) for pick in itertools.product(*(list(cs.values()) for cs in groups.values())))


def test_rules(spark):
    one = spark.range(1)
    value = lambda c: one.select(c.alias("x")).first().x
    lit = F.lit
    assert value(classify.section_number(lit("2-31.4 . NOT"), lit(False))) is None and value(classify.section_number(lit("2-31A. FUEL"), lit(False))) == "2-31A"
    assert value(classify.section_number(lit("2-31. Fuel"), lit(False))) is None and value(classify.section_number(lit("2-31. Fuel"), lit(True))) == "2-31"
    assert value(classify.margin_label(lit(" 2 - 2 6\x07Change1"))) == "2-26" and value(classify.margin_label(lit("2-26/(2-27blank)"))) == "2-26" and value(classify.margin_label(lit("4-2"))) is None
    assert value(classify.outcome(lit(True), lit("  "), lit(None).cast("string"))) == "GEN_EMPTY" and value(classify.budget(lit(61), 40, 100)) == "INPUT_EXCEEDS_CONTEXT"
    assert value(text.canonical({"b": lit('x"y'), "a": lit(None).cast("string"), "c": lit(3)})) == '{"a": null, "b": "x\\"y", "c": 3}'
    assert value(text.quoted(lit("a  b c"), lit("b\nc"))) and not value(text.quoted(lit("a"), lit(" ")))
    with pytest.raises(ValueError):
        audits.page_of(one, ["id"], -1)


def test_runs_and_migration(spark):
    """Corrected and raw text agree through the runs, for random patches."""
    rng = random.Random(8)
    docs, patches, fixed = [], [], {}
    for d in range(20):
        raw = "".join(rng.choice("abcdef ") for _ in range(60))
        cuts = sorted(rng.sample(range(61), 8))
        own = [(a, b, rng.choice(["", "X", "YYY"])) for a, b in zip(cuts[::2], cuts[1::2])]
        out, at = "", 0
        for a, b, new in own:
            out += raw[at:a] + new
            at = b
        fixed[d] = out + raw[at:]
        docs.append((d, raw, len(raw)))
        patches += [(d, f"{d}:{a}", a, b, new) for a, b, new in own]
    docs_df = spark.createDataFrame(docs, "doc long, text string, length int")
    patches_df = spark.createDataFrame(patches, "doc long, id string, start int, end int, after string")
    after = {p[1]: p[4] for p in patches}
    rebuilt = {}
    for r in build.runs(docs_df, patches_df, "doc").orderBy("doc", "c0", "r0").collect():
        piece = after[r.patch] if r.patch else docs[r.doc][1][r.r0 : r.r1]
        assert len(piece) == r.c1 - r.c0
        rebuilt[r.doc] = rebuilt.get(r.doc, "") + piece
    assert rebuilt == fixed
    points = spark.createDataFrame([(d, i) for d in range(20) for i in range(0, 60, 7)], "doc long, at long")
    for r in build.migrated(points, patches_df, "doc", "at").collect():
        assert r.moved == r.at + sum(len(n) - (b - a) for d, _, a, b, n in patches if d == r.doc and b <= r.at)


def test_sources(spark, tmp_path):
    now = spark.createDataFrame([(1, "h1"), (2, "h2")], "k long, mark string")
    assert io.replayed(now.where("k = 1"), now, "k", "mark").count() == 1
    with pytest.raises(Exception, match="has changed: 2"):
        io.replayed(now.withColumn("mark", F.lit("h1")), now, "k", "mark").collect()
    io.freeze(now, F.col("k") > 1, str(tmp_path / "frozen"))
    kept = spark.read.parquet(str(tmp_path / "frozen"))
    assert kept.count() == 1 and len(kept.first().row_sha256) == 64
    io.write_report(now.withColumn("mark", F.lit("<a & b>")), str(tmp_path / "report"))
    assert "<td>&lt;a &amp; b&gt;</td>" in spark.read.text(str(tmp_path / "report")).first().value
    io.write_text(now, str(tmp_path / "text"), "k", "mark")
    assert {r.value for r in spark.read.text(str(tmp_path / "text")).collect()} == {"1", "h1", "2", "h2"}
    with pytest.raises(Exception):
        io.write_new(now, str(tmp_path / "text"))
