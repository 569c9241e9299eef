"""Greedy sequences, regions and spatial groups against plain versions."""

import random
from collections import defaultdict

from lumenary.operators import greedy, grid, regions, schedule
from pyspark.sql import functions as F

from lumenary.plans import pages
from lumenary.plans.registry import Tables

# greedy sequences


def thinned(values, apart, inclusive):
    out = []
    for v in sorted(set(values)):
        if not out or (v - out[-1] >= apart if inclusive else v - out[-1] > apart):
            out.append(v)
    return out


def test_greedy_equals_the_fold(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([round(rng.random() * 400, 1), rng.randrange(0, 60) * 5.0])) for k in "abc" for _ in range({"a": 3, "b": 120, "c": 400}[k])]
    rows += [("d", i * 15.0) for i in range(80)] + [("e", i * 0.5) for i in range(900)]  # just apart, and one long chain
    rows += [("f", -7.5), ("f", -22.5), ("f", 0.0), ("g", None), ("h", 3.0), ("h", 3.0), ("i", float("nan")), ("i", 1.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    for inclusive in (False, True):
        got = defaultdict(list)
        for r in greedy.starts(df, "k", "v", 15.0, inclusive).collect():
            got[r.k].append(r.v)
        want = {k: thinned([v for kk, v in rows if kk == k and v is not None and v == v], 15.0, inclusive) for k in "abcdefhi"}
        assert {k: sorted(v) for k, v in got.items()} == want
    assert greedy.starts(df.limit(0), "k", "v", 15.0).count() == 0


def test_clusters_equal_the_fold(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(0, 300)) for k in (1, 2) for _ in range(200)] + [(3, 5)] * 50
    want = {}
    for k in (1, 2, 3):
        anchors = thinned([v for kk, v in rows if kk == k], 7, True)
        for kk, v in rows:
            if kk == k:
                a = max(x for x in anchors if x <= v)
                want[k, a] = want.get((k, a), 0) + 1
    got = {(r.k, r.anchor): r.n for r in greedy.clusters(spark.createDataFrame(rows, "k int, v long"), "k", "v", 7).collect()}
    assert got == want


def test_numbers_are_dense_for_ties(spark):
    """One value holds most rows; they're numbered over several parts."""
    rows = spark.createDataFrame([(1 if i % 10 else i, i) for i in range(5_000)], "k long, i long").repartition(7)
    got = schedule.numbered(rows, [F.desc("k")], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(5_000)) and [r.k for r in got] == sorted((r.k for r in got), reverse=True) and len({r.i for r in got}) == 5_000
    assert schedule.numbered(rows.limit(0), ["k"]).count() == 0


def test_smallest_holding_boxes_of_all_sizes(spark):
    rng = random.Random(3)
    boxes = []
    for i in range(150):
        side = 2.0 ** rng.randrange(-2, 9)
        x, y = rng.random() * 300 - 50, rng.random() * 300 - 50
        boxes.append((i % 2, f"b{i:03d}", x, y, x + side, y + side * rng.choice([0, 0.5, 1])))
    points = [(i % 2, i, rng.random() * 320 - 60, rng.random() * 320 - 60) for i in range(400)] + [(0, 900, boxes[0][2], boxes[0][3])]
    b = spark.createDataFrame(boxes, "page int, box string, x0 double, y0 double, x1 double, y1 double")
    p = spark.createDataFrame(points, "page int, i int, px double, py double")
    got = {r.i: r.box for r in grid.smallest_holding(p, b, ["page"], "i", F.col("px"), F.col("py"), 3.0, 2.0, F.col("px") < 250, "box").collect()}
    for page, i, x, y in points:
        held = [((x1 - x0) * (y1 - y0), n) for g, n, x0, y0, x1, y1 in boxes if g == page and x0 - 3 <= x <= x1 + 3 and y0 - 2 <= y <= y1 + 2 and x < 250]
        assert got.get(i) == (min(held)[1] if held else None)


# regions


def test_regions_are_never_interleaved(spark, sf_dir):
    """Every region is a run of the page's order, and its lines share column and band."""
    t = Tables(spark, sf_dir)
    rows = regions.grouped(pages.lines(t)).collect()
    by_page = defaultdict(list)
    for r in rows:
        by_page[r.page].append(r)
    assert len(rows) == t.part.count() and {"left", "centre", "right", "wide", "body", "unknown", "cross_column"} <= {r.column for r in rows}
    for own in by_page.values():
        assert sorted({r.region for r in own}) == list(range(1, len({r.region for r in own}) + 1))
        for region in {r.region for r in own}:
            lines = [r for r in own if r.region == region]
            assert len({(r.column, r.band) for r in lines}) == 1 and sorted(r.place for r in lines) == list(range(1, len(lines) + 1))
            assert all(len(lines) == 1 for r in lines if r.column in ("unknown", "cross_column"))


# spatial groups


def heading(value):
    return value.isupper() and len(value) <= 85 and ("TEST" in value or value in regions.PANEL_HEADINGS)


def around(lines):
    return min(r.x0 for r in lines), min(r.y0 for r in lines), max(r.x1 for r in lines), max(r.y1 for r in lines)


def plain_join(groups):
    """[(name, lines)] of a page in order, headings joined one by one to the panel right below."""
    out, gone = list(groups), set()
    for i, (_, lines) in enumerate(out):
        if not heading(" ".join(r.text.strip() for r in lines)):
            continue
        box, near = around(lines), []
        for j, (_, others) in enumerate(out):
            other = around(others)
            if j != i and j not in gone and 0 <= other[1] - box[3] < 18 and abs(box[0] + box[2] - other[0] - other[2]) / 2 < 55 and other[2] - other[0] > 50:
                near.append((other[1] - box[3], j))
        if near:
            j = min(near)[1]
            out[j] = (out[j][0], lines + out[j][1])
            gone.add(i)
    return [g for i, g in enumerate(out) if i not in gone]


def check_groups(named, got):
    """``named`` lines with group and segment before headings join; ``got`` the operator's lines."""
    by_page = defaultdict(lambda: defaultdict(list))
    first = {}
    for r in sorted(named, key=lambda r: r.seq):
        first.setdefault((r.page, r.group), len(first))
        by_page[r.page][r.group, r.segment].append(r)
    moved = 0
    for page, groups in by_page.items():
        inside = [(k, sorted(v, key=lambda r: (round((r.y0 or 0) / 3), r.x0 or 0, r.start))) for k, v in sorted(groups.items(), key=lambda g: (first[page, g[0][0]], g[0][1]))]
        joined = plain_join([g for g in inside if all(r.x0 is not None for r in g[1])]) + [g for g in inside if any(r.x0 is None for r in g[1])]
        moved += len(inside) - len(joined)
        want = sorted((min(r.y0 or 0 for r in lines), *key) for key, lines in joined)
        rank = {key: i + 1 for i, (_, *key) in enumerate(map(lambda w: (w[0], (w[1], w[2])), want)) for key in key}
        assert {r.line: (r.group, r.segment, r.rank) for r in got if r.page == page} == {r.line: (*key, rank[key]) for key, lines in joined for r in lines}
    return moved


LINE = "page int, line int, seq int, kind string, layer string, test_card boolean, audited boolean, reviewed boolean, record string, start int, end int, block int, text string, x0 double, y0 double, x1 double, y1 double"


def no_tables(spark):
    return (
        spark.createDataFrame([], "page int, layer string, zone string, zx0 double, zx1 double, zy0 double, zy1 double"), spark.createDataFrame([], "record string, name string, s int, e int"),
        spark.createDataFrame([], "page int, rect_id string, x0 double, y0 double, x1 double, y1 double"),
    )


def test_spatial_groups_equal_the_plain_rule(spark):
    """Chains of headings, headings side by side, and panels that grow."""
    rng = random.Random(4)
    texts = ["KNOWN INFO", "TEST 1", "POSSIBLE PROBLEMS", "Check the pump.", "NO TEST of it", "12", "ENGINE TEST " + "X" * 80]
    rows = []
    for page in range(40):
        for i in range(14):
            x, y = rng.choice([0.0, 20.0, 60.0, 300.0]), rng.randrange(0, 160) * 1.0
            rows.append((page, page * 100 + i, page * 100 + i, "other", "native", False, False, False, f"{page}:native", i * 10, i * 10 + 5, i, rng.choice(texts), x, y, x + rng.choice([40.0, 80.0, 120.0]), y + 9))
    df = spark.createDataFrame(rows, LINE).repartition(4)
    tables = no_tables(spark)
    named = regions.segments(regions.spatial_names(df, *tables)).collect()
    got = regions.spatial_groups(df, *tables).collect()
    assert check_groups(named, got) > 30
    assert regions.spatial_groups(df.limit(0), *tables).count() == 0


def test_spatial_groups_of_the_table(spark, sf_dir):
    args = pages._spatial(Tables(spark, sf_dir))
    named = regions.segments(regions.spatial_names(*args)).collect()
    check_groups(named, regions.spatial_groups(*args).collect())
    assert {g.split("-")[0] for g in {r.group for r in named}} >= {"callout", "span", "reviewed", "card", "rect", "native", "unboxed"}


# references on pages, and units


def test_references_resolve_to_boxes(spark):
    """Reviewed regions before words before lines; a region that leaves a letter uncovered doesn't count; no line has no box."""
    from lumenary.operators import build

    refs = [("plain", "r", 0, 5, "one a"), ("fixed", "r", 6, 11, "two #"), ("region", "r", 12, 17, "three"), ("half", "r", 18, 22, "four"), ("words", "r", 23, 28, "f ive"), ("both", "r", 0, 11, "one a\ntwo #"), ("none", "s", 0, 3, "far")]
    runs = [("r", 0, 10, 0, 10, None), ("r", 10, 11, 10, 14, "p1"), ("r", 11, 28, 14, 31, None), ("s", 0, 3, 0, 3, None)]
    lines = [("r", 0, 5, 1.0, 10.0, 50.0, 20.0, 1), ("r", 6, 14, 1.0, 20.0, 60.0, 30.0, 2), ("r", 15, 20, 1.0, 30.0, 50.0, 40.0, 3), ("r", 21, 25, 1.0, 40.0, 50.0, 50.0, 4), ("r", 26, 31, 1.0, 50.0, 50.0, 60.0, 4)]
    box = "x0 double, y0 double, x1 double, y1 double"
    frames = [
        (refs, "ref string, k string, s int, e int, text string"), (runs, "k string, c0 int, c1 int, r0 int, r1 int, patch string"), (lines, f"k string, r0 int, r1 int, {box}, block int"),
        ([("r", 12, 17, 5.0, 5.0, 6.0, 6.0), ("r", 18, 21, 7.0, 7.0, 8.0, 8.0)], f"k string, start int, end int, {box}"), ([("r", 23, 24, 2.0, 2.0, 3.0, 3.0), ("r", 25, 28, 4.0, 1.0, 9.0, 3.0)], f"k string, start int, end int, {box}"),
    ]
    got = {r.ref: (r.precision, r.n_patches, r.n_blocks, len(r.boxes), tuple(r.box) if r.box else None) for r in build.resolved(*[spark.createDataFrame(*f) for f in frames], "k", 8).collect()}
    assert got == {
        "plain": ("line_or_cell", 0, 1, 1, (1, 10, 50, 20)), "fixed": ("correction_region", 1, 1, 1, (1, 20, 60, 30)), "region": ("reviewed_pdf_region", 0, 1, 1, (5, 5, 6, 6)), "half": ("line_or_cell", 0, 1, 1, (1, 40, 50, 50)),
        "words": ("frozen_word_coordinates", 0, 1, 2, (2, 1, 9, 3)), "both": ("correction_region", 1, 2, 2, (1, 10, 60, 30)), "none": ("line_or_cell", 0, 0, 0, None),
    }


def test_prose_units(spark):
    """A heading without lines is a unit, a line across columns is none, and sections don't share regions."""
    kind = "diagnostic_flowchart"
    rows = [
        (1, kind, "r", "native", 0, "before", False, 10.0, 5.0, 100.0, 9.0), (1, kind, "r", "native", 1, "1-1. FIRST", False, 10.0, 10.0, 100.0, 19.0), (1, kind, "r", "ocr", 2, "left", False, 10.0, 20.0, 100.0, 29.0),
        (1, kind, "r", "native", 3, "across", False, 10.0, 30.0, 400.0, 39.0), (1, kind, "r", "native", 4, "1-2. EMPTY", False, 10.0, 40.0, 100.0, 49.0), (1, kind, "r", "native", 5, "1-3. Third", True, 10.0, 50.0, 100.0, 59.0), (1, kind, "r", "native", 6, "left", False, 10.0, 60.0, 100.0, 69.0),
        (2, "other", "q", "native", 0, "no box", False, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "page int, kind string, record string, layer string, start int, text string, bold boolean, x0 double, y0 double, x1 double, y1 double")
    got = sorted(((r.page, r.section, r.kind, r.column, r.first_start, r.n_lines, r.reviews) for r in regions.prose_units(df).collect()), key=str)
    assert got == sorted([
        (1, None, "prose", "left", 0, 1, "STRUCTURE_BOUNDARY"), (1, "1-1", "prose", "left", 2, 1, "STRUCTURE_BOUNDARY,OCR_REGION_STRUCTURE"), (1, "1-1", "none", "cross_column", 3, 1, "CROSS_REGION_TEXT"),
        (1, "1-2", "heading", None, 4, 1, None), (1, "1-3", "prose", "left", 6, 1, "STRUCTURE_BOUNDARY"), (2, None, "none", "unknown", 0, 1, "CROSS_REGION_TEXT"),
    ], key=str)


def test_figures_leave_captions(spark):
    figures = spark.createDataFrame([(1, "big", 0.0, 0.0, 200.0, 200.0), (1, "small", 0.0, 0.0, 100.0, 100.0), (2, "other", 0.0, 0.0, 100.0, 100.0)], "page int, figure_id string, x0 double, y0 double, x1 double, y1 double")
    lines = [(1, 1, "label", 10.0, 10.0, 50.0, 20.0), (1, 2, "figure 3. It", 10.0, 10.0, 50.0, 20.0), (1, 3, "When CHECKING it", 10.0, 10.0, 50.0, 20.0), (1, 4, " ", 10.0, 10.0, 50.0, 20.0), (1, 5, "wide", 90.0, 10.0, 104.0, 20.0), (1, 6, "claimed", 10.0, 10.0, 50.0, 20.0), (1, 7, "out", 190.0, 10.0, 206.0, 20.0), (1, 8, "edge", -3.0, 10.0, 103.0, 20.0), (3, 9, "label", 10.0, 10.0, 50.0, 20.0), (1, 10, "no box", None, None, None, None)]
    df = spark.createDataFrame(lines, "page int, line int, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.line: r.figure_id for r in regions.in_figures(df, figures, df.where("line = 6")).collect()}
    assert got == {1: "small", 5: "big", 8: "small"}
