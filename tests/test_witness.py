"""Projections, pieces of text by reference, and choice by witnesses, against plain versions."""

import base64
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lumenary.operators import closure, grid, ledger, projection, witness
from lumenary.plans import pages
from lumenary.plans.registry import Tables


def norm(text):
    return re.sub(r"\s+", " ", text).strip()


def test_exact_texts_over_blocks(spark):
    rng = random.Random(1)
    texts = {1: "".join(rng.choice("aé🛠\n ß") for _ in range(13_000)), 2: "", 3: "x" * projection.BLOCK, 4: None}
    refs = [(i, rng.choice([1, 1, 1, 3]), a := rng.randrange(13_000), a + rng.choice([0, 1, 5, 4_096, 9_000])) for i in range(200)]
    refs += [(900, 1, 0, 13_000), (901, 1, 12_999, 20_000), (902, 2, 0, 4), (903, 9, 0, 4), (904, 3, 4_095, 4_097), (905, 1, 8, 3), (906, 4, 0, 2)]
    r = spark.createDataFrame(refs, "ref int, rec int, start int, end int").repartition(3)
    t = spark.createDataFrame(list(texts.items()), "rec int, text string")
    got = {x.ref: x.exact for x in projection.exact(r, t, "ref", "rec").collect()}
    assert got == {i: None if k not in texts else (texts[k] or "")[a:b] for i, k, a, b in refs}


def test_projection_errors_all_planted(spark):
    records = spark.createDataFrame([("r", 1, "one\ntwo\nthree"), ("s", 2, "other")], "record string, page int, text string")
    units = spark.createDataFrame([("u1", 1, 1, "left", "one\ntwo"), ("u2", 2, 1, "right", "three"), ("u3", 3, 1, "none", "one"), ("u4", 4, 1, "left", ""), ("u5", 5, 1, "left", "other!")], "unit string, seq int, page int, half string, text string")
    refs = [("a", "u1", 1, "r", 0, 3, "one", 0.0, 100.0), ("b", "u1", 2, "r", 4, 7, "two", 320.0, 320.0), ("c", "u2", 1, "r", 8, 13, "Three", 0.0, 640.0), ("d", "u3", 1, "r", 0, 3, "one", 0.0, 0.0), ("e", "u5", 1, "s", 0, 5, "other", 0.0, 0.0), ("f", "u5", 2, "gone", 0, 5, "x", 0.0, 0.0)]
    df = spark.createDataFrame(refs, "ref string, unit string, place int, record string, start int, end int, text string, x0 double, x1 double")
    got = sorted(tuple(r) for r in projection.errors(units, df, records).collect())
    assert got == [("u1", "cross_column_mixing", 1), ("u2", "altered_source_text", 1), ("u3", "duplicated_source_span", 1), ("u5", "missing_record", 1), ("u5", "unrecorded_projection_change", 1), ("u5", "wrong_source_page", 1)]


REFS = "ref string, unit string, place int, record string, start int, end int, text string, x0 double, x1 double"


def test_projection_errors_of_odd_references(spark):
    """Spans that are empty, begin before the text, end beyond it or lie over blocks, texts with line ends, null ones and missing records."""
    rng = random.Random(3)
    records = {f"r{k}": "".join(rng.choice("ab\n🛠é") if rng.random() < 0.03 else rng.choice("cdefgh ") for _ in range(n)) for k, n in enumerate([0, 5, 9_000, 8_192, 30])} | {"r5": None}
    cut = lambda r, a, b: None if r not in records else (records[r] or "")[max(a, 0) : max(b, 0)] if b > max(a, 0) else ""
    refs, units = [], []
    for u in range(120):
        mine = []
        for place in range(rng.randrange(5)):
            r, a = rng.choice(["r0", "r1", "r2", "r2", "r3", "r4", "r5", "gone"]), rng.choice([-3, 0, 2, 4_095, 8_191, 8_192, 20_000])
            b = a + rng.choice([-2, 0, 1, 3, 60, 4_097, 9_000])
            there = cut(r, a, b)
            mine.append((f"f{u}/{place}", f"u{u}", place, r, a, b, rng.choice([there, there, there, "", "x", None]), 0.0, rng.choice([9.0, 900.0, None])))
        refs += mine
        text = "\n".join(cut(*m[3:6]) or "" for m in mine)
        units.append((f"u{u}", u, u % 2, rng.choice(["left", "right", "none"]), rng.choice([text, text, text, text + "!", "\n" + text, None])))
    page, first, want = {r: k % 2 for k, r in enumerate(records)}, {}, Counter()
    for f in refs:
        (_, u, _, r, a, b, text, x0, x1), there = f, cut(*f[3:6])
        _, _, unit_page, half, _ = units[int(u[1:])]
        said = {
            "duplicated_source_span": (r, a, b) in first, "wrong_source_page": r in records and page[r] != unit_page, "missing_record": there is None, "altered_source_text": None not in (there, text) and there != text,
            "cross_column_mixing": x1 is not None and (half == "left" and x0 + x1 >= 640 or half == "right" and x0 + x1 < 640),
        }
        first[r, a, b] = True
        want.update((u, code) for code, wrong in said.items() if wrong)
    for u, _, _, _, text in units:
        want.update([(u, "unrecorded_projection_change")] * (text is not None and text != "\n".join(cut(*f[3:6]) or "" for f in refs if f[1] == u)))
    got = projection.errors(
        spark.createDataFrame(units, "unit string, seq int, page int, half string, text string"), spark.createDataFrame(refs, REFS).repartition(3), spark.createDataFrame([(r, page[r], t) for r, t in records.items()], "record string, page int, text string")
    ).collect()
    assert len(want) > 100 and len({c for _, c in want}) == 6
    assert {(r.unit, r.code): r.n for r in got} == want


def test_short_forms(spark):
    """Of texts joined by line ends the short form is theirs, joined alike; none is longer than its text."""
    texts = ["", "\n", "a\n" + "b" * 43, "é" * 44, "x" * 900 + "\n\n" + "y" * 44 + "\n"]
    rows = spark.createDataFrame([(t, "\n".join([t, u])) for t in texts for u in texts] + [(None, None)], "one string, both string")
    got = {r.both: (r.one, r.a, r.b) for r in rows.select("one", "both", projection.short(F.col("one")).alias("a"), projection.short(F.col("both")).alias("b")).collect()}
    form = {one: a for one, a, _ in got.values()}
    assert got[None] == (None, None, None) and form["\n"] == "\n" and form["a\n" + "b" * 43] == "a\n" + "b" * 43 and len(form["é" * 44]) == 44 and "é" not in form["é" * 44]
    assert all(got["\n".join([t, u])][2] == "\n".join([form[t], form[u]]) for t in texts for u in texts) and all(len(a) <= len(t) for t, a in form.items() if t)


def test_projection_shuffles_its_texts_once(spark):
    """Of incompressible texts, that references and units repeat, one copy is shuffled."""
    rng = random.Random(4)
    line = lambda: base64.b64encode(rng.randbytes(750)).decode()
    texts = {f"r{k}": "\n".join(line() for _ in range(30)) for k in range(40)}
    refs = [(f"{r}/{i}", r, i, r, i * 1_001, i * 1_001 + 1_000, text[i * 1_001 : i * 1_001 + 1_000], 0.0, 0.0) for r, text in texts.items() for i in range(30)]
    units, sources = spark.createDataFrame([(r, 1, 1, "left", text) for r, text in texts.items()], "unit string, seq int, page int, half string, text string"), spark.createDataFrame([(r, 1, text) for r, text in texts.items()], "record string, page int, text string")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        return sum(sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(sc.statusStore().executorList(False).size()))

    key, before = "spark.sql.autoBroadcastJoinThreshold", written()
    spark.conf.set(key, "-1")
    try:
        assert projection.errors(units, spark.createDataFrame(refs, REFS), sources).collect() == []
    finally:
        spark.conf.unset(key)
    assert 1_000_000 < written() - before < 2_400_000


def test_places_of_lines_need_no_shuffle(spark):
    texts = {1: "", 2: "\n", 3: "a🛠\n\né b", 4: None, 5: "".join(f"{'x' * (i % 7)}\n" for i in range(300))}
    rows = ledger.lines(spark.createDataFrame([(k, t, "m") for k, t in texts.items()], "k int, t string, m string"), "k", "t", "m")
    want = []
    for k, t in texts.items():
        at = 0
        for i, x in enumerate(t.split("\n") if t is not None else []):
            want.append((k, "m", len(t), i, x, at, min(at + len(x) + 1, len(t))))
            at += len(x) + 1
    assert sorted(map(tuple, rows.select("k", "m", "length", "line_no", "line", "start", "end").collect())) == want
    assert dict(rows.dtypes)["start"] == dict(rows.dtypes)["end"] == "bigint" and "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_projection_query_has_every_code(spark, sf_dir):
    from lumenary.plans.catalogue import QUERIES

    codes = {r.code for r in QUERIES["projection_errors"](spark, sf_dir).select("code").distinct().collect()}
    assert codes >= {"duplicated_source_span", "wrong_source_page", "altered_source_text", "cross_column_mixing", "missing_record", "unrecorded_projection_change"}


def target(text, record="r", start=0, before="", behind=""):
    return record, start, text, before, behind


def test_witness_cuts_no_value():
    assert witness.find("10", [target("pump -10 or 10.0 and 10 bar")]) == [("r", 21, 23)]
    assert witness.find("10", [target("10", before="-")]) is None and witness.find("10", [target("10", behind="%")]) is None
    assert witness.find("a  b", [target("x a"), target("b y", "s", 5)]) == [("r", 2, 3), ("s", 5, 6)]
    assert witness.find("a b", [target("x a\t \nb")]) == [("r", 2, 7)]
    assert witness.find(" ", [target("a")]) is None and witness.find("(a)", [target("x(a)y")]) == [("r", 1, 4)]
    assert witness.find("ab", [target("a"), target("b")]) is None


def test_overlapping_boxes_of_all_sizes(spark):
    rng = random.Random(2)
    boxes = []
    for i in range(240):
        x, y = rng.random() * 100 - 30, rng.random() * 100 - 30
        boxes.append((i % 2, i, x, y, x + rng.choice([0.0, 0.5, 4, 30, 120]), y + rng.choice([0.0, 2, 9, 60])))
    cols = lambda p: f"page int, {p} int, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double"
    pairs = grid.overlapping(spark.createDataFrame(boxes[:120], cols("a")), spark.createDataFrame(boxes[120:], cols("b")), ["page"], 0.45, 0.5).collect()

    def share(a, b, lo, hi):
        return max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo])) / max(1.0, min(a[hi] - a[lo], b[hi] - b[lo]))

    want = sorted((a[1], b[1]) for a in boxes[:120] for b in boxes[120:] if a[0] == b[0] and share(a, b, 2, 4) > 0.45 and share(a, b, 3, 5) > 0.5)
    assert sorted((r.a, r.b) for r in pairs) == want and len(want) > 50


def plain_selection(pieces, claims, represented, decisions):
    """ref -> outcome, piece by piece and page by page."""
    holds = lambda spans, r: any(s.start <= r.start and r.end <= s.end for s in spans.get(r.record, ()))
    by = lambda rows: {k: [r for r in rows if r.record == k] for k in {r.record for r in rows}}
    claim_of, rep_of, dec_of = by(claims), by(represented), by(decisions)
    share = lambda a, b, lo, hi: max(0.0, min(a[hi], b[hi]) - max(a[lo], b[lo])) / max(1.0, min(a[hi] - a[lo], b[hi] - b[lo]))
    near = lambda r, others: [n for n in others if n.record != r.record and share(r, n, "x0", "x1") > 0.45 and share(r, n, "y0", "y1") > 0.5]
    look = lambda r, targets: witness.first_found(r.text, [t.asDict() for t in targets])
    out, proved = {}, set()
    on_page = defaultdict(lambda: ([], [], []))
    for r in pieces:
        on_page[r.page][r.layer == "ocr"].append(r)
    for c in claims:
        on_page[c.page][2].append(c)
    for natives, ocr, used in on_page.values():
        left = []
        for r in sorted(natives, key=lambda r: (r.record, r.start)) + sorted(ocr, key=lambda r: (r.record, r.start)):
            states = {d.state for d in dec_of.get(r.record, ()) if d.start <= r.start and r.end <= d.end}
            final = states - {"PREFERRED"}
            if not norm(r.text):
                out[r.ref] = "BLANK"
            elif holds(claim_of, r):
                out[r.ref] = "CLAIMED"
            elif holds(rep_of, r):
                out[r.ref] = "REPRESENTED"
            elif final:
                out[r.ref] = next(iter(final)) if len(final) == 1 else "SELECTION_CONFLICT"
            elif (some := near(r, used)) and look(r, some):
                out[r.ref] = "REPRESENTED_BY_STRUCTURED_SOURCE"
            else:
                left.append((r, bool(states)))
        for r, preferred in left:
            if r.layer == "native":
                continue
            some = near(r, [n for n in natives if norm(n.text)])
            if preferred or not some:
                out[r.ref] = "SELECTED"
            elif look(r, some):
                out[r.ref] = "EXACT_ALTERNATIVE_TEXT"
            else:
                free = [n for n in some if len(norm(n.text)) >= 4 and not holds(claim_of, n) and not holds(rep_of, n) and out.get(n.ref) != "REPRESENTED_BY_STRUCTURED_SOURCE" and n.ref not in proved]
                if len(free) == len(some) and all(witness.find(n.text, [target(r.text, r.record, r.start, r.before, r.behind)]) for n in some):
                    out[r.ref] = "SELECTED_WITH_FRAGMENTS"
                    proved |= {n.ref for n in some}
                else:
                    out[r.ref] = "UNALIGNED_OVERLAPPING_OCR"
        for r in natives:
            out.setdefault(r.ref, "NATIVE_FRAGMENT_IN_IMAGE_TEXT" if r.ref in proved else "SELECTED")
    return out


def test_selection_equals_the_plain_rule(spark, sf_dir):
    tables = pages.layers(Tables(spark, sf_dir))
    done, proofs = witness.select(*tables)
    got = {r.ref: r.outcome for r in done.select("ref", "outcome").collect()}
    assert got == plain_selection(*(t.collect() for t in tables))
    assert set(got.values()) == {
        "BLANK", "CLAIMED", "REPRESENTED", "EXCLUDED_NON_TEXT", "SELECTION_CONFLICT", "REPRESENTED_BY_STRUCTURED_SOURCE", "SELECTED", "EXACT_ALTERNATIVE_TEXT", "SELECTED_WITH_FRAGMENTS", "NATIVE_FRAGMENT_IN_IMAGE_TEXT", "UNALIGNED_OVERLAPPING_OCR",
    }
    texts = {r.record: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("concat('N', doc_id) AS record", "text").collect()}
    pieces = {r.ref: r.text for r in tables[0].collect()}
    for p in proofs.where("reason = 'EXACT_ALTERNATIVE_TEXT'").collect():
        assert norm(" ".join(texts[x.record][x.start : x.end] for x in p.parts)) == norm(pieces[p.ref])


def test_first_come_in_a_chain(spark):
    """Rivals in a long chain: every second one is served."""
    claims = [(f"r{i:03d}", i, item) for i in range(41) for item in (i, i + 1)]
    got = {r.ref for r in closure.first_come(spark.createDataFrame(claims, "ref string, place int, item int")).collect()}
    assert got == {f"r{i:03d}" for i in range(0, 41, 2)}


def test_places_are_looked_up_only_where_a_text_is_found(monkeypatch):
    """A text without the witness is searched as a whole; characters' places, white space of all kinds aside, are those of the plain rule."""
    asked, places = [], witness._places
    monkeypatch.setattr(witness, "_places", lambda text, *at: asked.append(at) or places(text, *at))
    target = ("r", 100, " \t\x1c a  b \nc-1 de  ", "", "")
    assert witness.find("not there", [target]) is None and asked == []
    assert witness.find("b  c-1", [target]) == [("r", 107, 113)] and len(asked) == 1
    text = target[2]
    kept = [i for i, c in enumerate(text) if not c.isspace()]
    plain = " ".join(text.split())
    assert places(text, *[i for i, c in enumerate(plain) if c != " "]) == kept
    assert witness.find("d", [target]) is None
