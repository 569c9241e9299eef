"""Priority rules against plain versions, on cases for every branch."""

import random
import re

import pytest
from pyspark.sql import functions as F

from lumenary.functions import classify, diffs
from lumenary.functions.text import covers, hits, matches, tiles
from lumenary.operators import audits, evidence, layout, recovery
from lumenary.plans.catalogue import QUERIES


def test_section_headings(spark):
    cases = ["2-31. FUEL", "2-31.\tFUEL", " 12-345.1.2a.  ENGINE ", "2-31a. FUEL", "1234-9. 77", "2-31. Fuel", "2-31 FUEL", "2-31.", "2-31. ", "2-3. 12", "2-1234. X", "2-31. ÉCRAN", "x 2-31. FUEL", None, "２-31. FUEL", "2-31. STRASSE ß"]
    pattern = re.compile(r"^(\d{1,2}-\d{1,3}(?:\.\d+)*[A-Za-z]?)\.\s+(.+)")

    def plain(text, bold):
        match = pattern.match(text.strip()) if text is not None else None
        return match[1] if match and (text.strip().isupper() or bold) else None

    df = spark.createDataFrame([(i, t, b) for i, t in enumerate(cases) for b in (False, True)], "i int, t string, b boolean")
    got = {(r.i, r.b): r.s for r in df.select("i", "b", classify.section_number(F.col("t"), F.col("b")).alias("s")).collect()}
    assert got == {(i, b): plain(t, b) for i, t in enumerate(cases) for b in (False, True)}


def test_safe_names(spark):
    cases = ["ab", "a", "a" * 81, "a" * 82, "A1", "-a", "a-b9", "a_b", "", "ab\n"]
    got = [r.s for r in spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string").orderBy("i").select(F.col("c").rlike(classify.SAFE_NAME).alias("s")).collect()]
    assert got[:-1] == [bool(re.fullmatch(r"[a-z0-9][a-z0-9-]{1,80}", c)) for c in cases[:-1]]


def test_margins(spark):
    """Recognized lines go by their near edge: a tall line that reaches into the page stays."""
    lines = [(1, "TM 9-2320-280-20-1", 10.0, 20.0), (2, "TM 9-2320-280-20-1", 10.0, 90.0), (3, " Change 1 ", 10.0, 20.0), (4, "2-31", 690.0, 700.0), (5, "2-31", 660.0, 700.0), (6, "2-31", 300.0, 310.0), (7, "text", 10.0, 20.0), (8, "  text ", 300.0, 310.0), (9, "  ", 10.0, 20.0), (10, "2-1/(2-2 blank)", 700.0, 710.0)]
    kept, changes = layout.cleaned(spark.createDataFrame(lines, "i int, text string, y0 double, y1 double"), F.lit(792.0))
    assert sorted((r.i, r.text) for r in kept.collect()) == [(2, "TM 9-2320-280-20-1"), (5, "2-31"), (6, "2-31"), (7, "text"), (8, "text")]
    assert sorted((r.i, r.rule, r.before, r.after) for r in changes.collect()) == [
        (1, "recognized_margin", "TM 9-2320-280-20-1", ""), (3, "recognized_margin", " Change 1 ", ""), (4, "recognized_margin", "2-31", ""), (8, "outer_whitespace", "  text ", "text"), (9, "outer_whitespace", "  ", ""), (10, "recognized_margin", "2-1/(2-2 blank)", ""),
    ]


def test_word_classes(spark):
    rng = random.Random(1)
    texts = {i: "".join(rng.choice("ab  ") for _ in range(8)) for i in range(200)}
    refs, words, want = [], [], {}
    for i, t in texts.items():
        own = [(m.start(), m.end()) for m in re.finditer(r"\S+", t)]
        if rng.random() < 0.3 and own:
            own = own[1:] if rng.random() < 0.5 else [(a, min(len(t), b + 1)) for a, b in own]
        own = [(a, b, rng.choice(["x", "x", "x", "y", None])) for a, b in own]
        corrected = rng.random() < 0.1
        refs.append((i, t, corrected))
        words += [(i, *w) for w in own]
        covered = {p for a, b, _ in own for p in range(a, b)}
        boxes, loose = {b for *_, b in own if b}, [b for *_, b in own if not b]
        complete = covered == {p for p, c in enumerate(t) if not c.isspace()}
        want[i] = classify.REVIEW_CLASSES[0 if corrected else 1 if not complete else 2 if not boxes else 3 if loose else 4 if len(boxes) > 1 else 5]
    got = layout.word_classes(spark.createDataFrame(refs, "ref int, text string, corrected boolean"), spark.createDataFrame(words, "ref int, start int, end int, box string"))
    assert {r.ref: r["class"] for r in got.collect()} == want and set(want.values()) == set(classify.REVIEW_CLASSES)


def test_covers(spark):
    cases = [("a b", [(0, 1), (2, 3)], True), ("a b", [(0, 1)], False), ("a b", [(2, 3), (0, 2)], True), ("  ", [], True), ("", [], True), ("x", [], False), ("a b c", [(0, 5)], True), (" a ", [(1, 2)], True), ("ab", [(0, 2), (0, 1)], True)]
    df = spark.createDataFrame([(i, t, s) for i, (t, s, _) in enumerate(cases)], "i int, t string, s array<struct<start: int, end: int>>")
    assert [r.c for r in df.orderBy("i").select(covers(F.col("t"), F.col("s")).alias("c")).collect()] == [w for *_, w in cases]


def test_anchor_states(spark):
    cases = [(True, "A-1", "xa1", "", ""), (True, "A-1", "", "(a) 1", ""), (True, "A1", None, None, "a1"), (True, "A1", "b", "b", "b"), (True, " - ", "x", "x", "x"), (False, "A1", "a1", "", "")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, s boolean, a string, n string, t string, o string")
    got = [r.x for r in df.orderBy("i").select(classify.anchor_status(*[F.col(c) for c in "santo"]).alias("x")).collect()]
    assert got == [classify.ANCHOR_STATES[i] for i in (1, 2, 3, 4, 4, 0)]


def test_positions_have_ends(spark):
    cases = ["  a  b\n", "x", " \t", "", "a  b c ", " a"]
    pattern = re.compile(r"\s+|\S")
    for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", diffs.norm_positions("t").alias("n")).collect():
        found = [(" " if m[0].isspace() else m[0], *m.span()) for m in pattern.finditer(r.t)]
        while found and found[0][0] == " ":
            del found[0]
        while found and found[-1][0] == " ":
            del found[-1]
        assert list(zip(r.n.text, r.n.starts, r.n.ends)) == found


def test_fixed_fields_are_demanded(spark):
    base = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "k int, fixed string, text string")
    good, bad = spark.createDataFrame([(1, "a", "new")], base.schema), spark.createDataFrame([(1, "other", "new")], base.schema)
    got = audits.demanded(audits.override(base, good, "k", ["text"], ["fixed"]), "k")
    assert sorted((r.k, r.fixed, r.text) for r in got.collect()) == [(1, "a", "new"), (2, "b", "y")]
    with pytest.raises(Exception, match="a fixed field differs for 1"):
        audits.demanded(audits.override(base, bad, "k", ["text"], ["fixed"]), "k").collect()


# recovery

ATTEMPT = "key string, stage string, attempt int, error string, complete boolean, intact boolean, statements array<struct<statement: string, verdict: int, evidence_ids: array<string>, evidence_quotes: array<string>>>"
SOURCE = "INTERVAL: Annually\nITEM NO.: 29\nPROCEDURES: Inspect the case."
CUT = "INTERVAL: Annually\nPROCEDURES: Inspect the case."


def test_stages_are_recovered(spark):
    def attempt(key, n, quotes, ids=("s",), statement="c", error=recovery.ERROR, complete=True, intact=True, verdict=1):
        return (key, "faith", n, error, complete, intact, [(statement, verdict, list(ids), list(quotes)), ("d", 0, ["s"], ["Inspect the case."])])

    attempts = [
        attempt("ok", 1, [CUT]), attempt("second", 1, ["PROCEDURES: Inspect the case.\nINTERVAL: Annually"]), attempt("second", 2, [CUT]), attempt("second", 3, [CUT]), attempt("unchanged", 1, ["Inspect the case."]),
        attempt("unknown", 1, [CUT], ids=("t",)), attempt("claims", 1, [CUT], statement="C"), attempt("counts", 1, [CUT, CUT]), attempt("other", 1, [CUT], error="OTHER"), attempt("cut off", 1, [CUT], complete=False), attempt("one bad", 1, [CUT, "ITEM NO.: 30\nPROCEDURES: Inspect the case."], ids=("s", "s")),
    ]
    keys = sorted({a[0] for a in attempts})
    claims = spark.createDataFrame([(k, ["c", "d"]) for k in keys], "key string, claims array<string>")
    sources = spark.createDataFrame([(k, "faith", "s", SOURCE) for k in keys], "key string, stage string, source_id string, text string")
    df = spark.createDataFrame(attempts, ATTEMPT)
    stages, changes = recovery.recover(df, claims, sources)
    whole = " ".join(SOURCE.split())
    assert sorted((r.key, r.attempt, r.score, r.n_changes, r.statements[0].evidence_quotes) for r in stages.collect()) == [("ok", 1, 0.5, 1, [whole]), ("second", 2, 0.5, 1, [whole])]
    assert all(r.statements[1].evidence_quotes == ["Inspect the case."] and r.statements[0].statement == "c" for r in stages.collect())
    assert sorted((r.key, r.statement, r.quote, r.source_id, r.before, r.after) for r in changes.collect()) == [(k, 0, 0, "s", CUT, whole) for k in ("ok", "second")]
    metrics = spark.createDataFrame([("ok", "faith", None, "ERROR"), ("ok", "other", 0.25, "OK"), ("claims", "faith", None, "ERROR")], "key string, metric string, value double, status string")
    assert sorted(map(tuple, recovery.corrected(metrics, stages).collect())) == [("claims", "faith", None, "ERROR"), ("ok", "faith", 0.5, recovery.RECOVERED), ("ok", "other", 0.25, "OK")]
    with pytest.raises(Exception, match="a stored attempt was changed: ok/1"):
        recovery.recover(spark.createDataFrame([attempt("ok", 1, [CUT], intact=False)], ATTEMPT), claims, sources)[0].collect()


def test_recovered_stages_of_the_table(spark, sf_dir):
    """Row by row: the first attempt whose quotes all stand in their turns once repaired."""
    turns = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.text))
    want = {}
    for key, own in turns.items():
        want[key, "relevance"] = (0.5, "OK", None, None)
        want[key, "faithfulness"] = (None, "ERROR", None, None)
        if key % 10 == 9 or key % 11 == 5:
            continue
        for n in (2, 3):  # the first names sources that aren't there
            if key % 7 == 3 and n == 2:
                continue
            fixed = []
            for turn, text in own:
                w = re.split(r"\s+", text)
                a, b = " ".join(w[1:5]), " ".join(w[8:12])
                quote = (f"{a}\n{b}" if n == 2 else f"{b}\n{a}") if turn % 3 == 0 else " ".join(w[:3])
                new = diffs._repair(quote, text)
                stands = new is not None and " ".join(new.split()) != "" and " ".join(new.split()) in " ".join(text.split())
                fixed.append((quote, new if stands else None))
            if all(x is not None for _, x in fixed) and any(q != x for q, x in fixed):
                want[key, "faithfulness"] = (sum(t % 2 == 0 for t, _ in own) / len(own), recovery.RECOVERED, n, sum(q != x for q, x in fixed))
                break
    got = {(r.key, r.metric): (r.value, r.status, r.attempt, r.n_changes) for r in QUERIES["recovered_stages"](spark, sf_dir).collect()}
    assert got == want and recovery.RECOVERED in {v[1] for v in got.values()}


def test_revised_evidence(spark):
    old = spark.createDataFrame([("q", 1, 0, "a"), ("q", 1, 0, "b"), ("q", 1, 1, "c"), ("q", 2, 0, "c"), ("r", 1, 0, "a"), ("r", 1, 0, "b")], "question string, grp int, combo int, chunk string")
    added, replaced = spark.createDataFrame([("r", 1, 7, "z"), ("q", 2, 0, "c")], old.schema), spark.createDataFrame([("q", 1, 1, "x"), ("q", 1, 1, "y")], old.schema)
    assert sorted(map(tuple, evidence.revised(old, added, replaced).collect())) == sorted([("q", 1, 0, "a"), ("q", 1, 0, "b"), ("q", 1, 1, "x"), ("q", 1, 1, "y"), ("q", 2, 0, "c"), ("r", 1, 0, "a"), ("r", 1, 0, "b"), ("r", 1, 7, "z")])
    covers_ = spark.createDataFrame([("q", 1, 0, 1), ("q", 1, 0, 2), ("q", 1, 1, 3), ("q", 2, 0, 3), ("r", 1, 0, 1), ("r", 1, 0, 2)], "question string, grp int, combo int, chunk long")
    more, other = spark.createDataFrame([("r", 1, 7, 9)], covers_.schema), spark.createDataFrame([("q", 1, 1, 8)], covers_.schema)
    assert sorted(map(tuple, evidence.revision(covers_, more, other).collect())) == [("q", 1, 2, "REPLACED"), ("r", 2, 1, "ADDED")]


def test_matches_of_a_long_text_are_not_copied_for_each(spark):
    """Starts are summed by doubling; spans and the text's runs meet in one order."""
    text = " ".join(f"é{'x' * (i % 7)}{i}" for i in range(3_000))
    spans = [m.span() for m in re.finditer(r"\S+", text)]
    df = spark.createDataFrame([(0, text, spans), (1, text, spans[:-1]), (2, text, [*spans, (0, 9)]), (3, " \t", []), (4, "", []), (5, "ab c", [(1, 2), (0, 1), (3, 4), (2, 2)])], "i int, t string, s array<struct<start:int,end:int>>")
    got = df.select("i", "s", matches(F.col("t"), r"\S+").alias("m"), hits(F.col("t"), r"\S+", "#").alias("h"), tiles(F.col("t"), F.col("s")).alias("c"))
    assert "array_append" not in got._jdf.queryExecution().analyzed().toString()
    rows = got.orderBy("i").collect()
    assert [m.start for m in rows[0].m] == [a for a, _ in spans] and [m.token for m in rows[0].m] == text.split() and [(h.start, h.end) for h in rows[0].h] == spans
    assert [r.c for r in rows] == [True, False, False, True, True, True]


def test_a_question_comes_together_once(spark):
    rows = spark.createDataFrame([("q", 1, 0, 1), ("q", 1, 1, 2), ("q", 1, 1, 3), ("q", 2, 0, 2), ("q", 2, 0, 3), (None, 1, 0, 1), ("s", 1, 0, 4)], "question string, grp int, combo int, chunk long")
    cover = evidence.min_cover(rows)
    assert cover._jdf.queryExecution().sparkPlan().toString().count("collect_set") > 0 and cover._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 1
    assert {tuple(r) for r in cover.collect()} == {("q", 2), (None, 1), ("s", 1)}
    more, other = spark.createDataFrame([("s", 2, 9, 5), (None, 1, 5, 5)], rows.schema), spark.createDataFrame([("q", 1, 1, 8)], rows.schema)
    assert {tuple(r) for r in evidence.revision(rows, more, other).collect()} == {("q", 2, 3, "REPLACED"), ("s", 1, 2, "ADDED"), (None, 1, None, None)}
