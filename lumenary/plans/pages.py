"""Regions and spatial groups of pages, whose lines stand for parts."""

from pyspark.sql import functions as F

from ..operators import greedy, ledger, projection, regions, witness
from .registry import Tables, query

#: Lines of pages of forty, in both engines' SQL: boxes, layers and texts follow from the part's columns.
_LINES = """SELECT p_partkey AS line, p_partkey AS seq, {div} AS page, concat({div}, ':', CASE WHEN p_partkey % 3 = 0 THEN 'ocr' ELSE 'native' END) AS record, CASE WHEN p_partkey % 3 = 0 THEN 'ocr' ELSE 'native' END AS layer,
 CASE {div} % 4 WHEN 0 THEN 'diagnostic_flowchart' WHEN 1 THEN 'reference_information' WHEN 2 THEN 'reviewed_two_column' ELSE 'numbered_section' END AS kind,
 {div} % 7 = 3 AS test_card, {div} % 2 = 0 AS audited, p_partkey % 31 = 0 AS reviewed, p_partkey % 6 AS block, p_partkey * 10 AS start, p_partkey * 10 + 8 AS {end},
 CASE WHEN p_partkey % 7 = 0 THEN 'KNOWN INFO' WHEN p_partkey % 11 = 0 THEN 'TEST OPTIONS' WHEN p_partkey % 13 = 0 THEN 'NOTES' WHEN p_partkey % 17 = 0 THEN 'Step:' ELSE p_name END AS text,
 CASE WHEN p_partkey % 97 <> 5 THEN CAST((p_partkey * 37) % 560 AS DOUBLE) END AS x0, CASE WHEN p_partkey % 97 <> 5 THEN CAST((p_partkey * 37) % 560 + 20 + p_size * 2 AS DOUBLE) END AS x1,
 CASE WHEN p_partkey % 97 <> 5 THEN CAST((p_partkey * 7919) % 7600 AS DOUBLE) / 10 END AS y0, CASE WHEN p_partkey % 97 <> 5 THEN CAST((p_partkey * 7919) % 7600 AS DOUBLE) / 10 + 9 END AS y1"""
_DUCK = _LINES.format(div="(p_partkey // 40)", end='"end"') + " FROM part"
_BUCKET = """CASE WHEN x0 IS NULL THEN 'unknown' WHEN kind = 'diagnostic_flowchart' THEN CASE WHEN x0 < 165 AND x1 <= 168 THEN 'left' WHEN x0 >= 165 AND x0 < 355 AND x1 <= 360 THEN 'centre' WHEN x0 >= 350 THEN 'right' ELSE 'cross_column' END
 WHEN kind IN ('reference_information', 'reviewed_two_column') THEN CASE WHEN x0 < 320 AND x1 <= 335 THEN 'left' WHEN x0 >= 320 THEN 'right' ELSE 'wide' END ELSE 'body' END"""
_BANDS = f"""RECURSIVE l AS ({_DUCK}), m AS (SELECT DISTINCT page, round(y0, 1) AS y FROM l WHERE text IN ('KNOWN INFO', 'TEST OPTIONS') AND y0 IS NOT NULL),
b AS (SELECT page, min(y) AS y FROM m GROUP BY page UNION ALL SELECT b.page, (SELECT min(y) FROM m WHERE m.page = b.page AND m.y - b.y > 15) FROM b WHERE b.y IS NOT NULL)"""


def lines(t: Tables):
    return t.part.selectExpr(*_columns(_LINES.format(div="(p_partkey div 40)", end="end")))


def _columns(select: str) -> list[str]:
    """The expressions of a SELECT list: commas outside of brackets and quotes part them."""
    out, depth, quoted, at = [], 0, False, len("SELECT ")
    for i, c in enumerate(select):
        quoted ^= c == "'"
        depth += 0 if quoted else (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(select[at:i])
            at = i + 1
    return [*out, select[at:]]


@query(f"WITH {_BANDS} SELECT page, y AS band_y, row_number() OVER (PARTITION BY page ORDER BY y) AS band FROM b WHERE y IS NOT NULL")
def region_bands(t: Tables):
    return regions.band_starts(lines(t))


@query(f"""WITH {_BANDS}, c AS (SELECT *, {_BUCKET} AS bucket FROM l),
k AS (SELECT *, bucket IN ('unknown', 'cross_column') AS alone, CASE WHEN kind = 'diagnostic_flowchart' AND NOT bucket IN ('unknown', 'cross_column') AND y0 <> 0 THEN (SELECT count(*) FROM b WHERE b.page = c.page AND b.y <= c.y0 + 6) ELSE 0 END AS band FROM c),
o AS (SELECT *, concat(bucket, '/', band, CASE WHEN alone THEN concat('/', record, '/', start) ELSE '' END) AS region_key, coalesce(y0, 0) AS y, coalesce(x0, 0) AS x,
 CASE bucket WHEN 'left' THEN 0 WHEN 'centre' THEN 1 WHEN 'right' THEN 2 WHEN 'wide' THEN 3 WHEN 'unknown' THEN 4 WHEN 'cross_column' THEN 5 ELSE 0 END AS rank FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY page, region_key ORDER BY y, x, start) AS place FROM o),
r AS (SELECT page, region_key, row_number() OVER (PARTITION BY page ORDER BY min(y), min(rank), min(start) FILTER (place = 1)) AS region FROM p GROUP BY page, region_key)
SELECT line, bucket AS "column", band, region, place FROM p JOIN r USING (page, region_key)""")
def region_groups(t: Tables):
    """Lines in columns and bands: a region's lines are never interleaved with its neighbour's."""
    return regions.grouped(lines(t)).select("line", "column", "band", "region", "place")


_ZONES = [("callout-left", -1e9, 205.0), ("callout-middle", 205.0, 435.0), ("callout-right", 435.0, 1e9)]


def _spatial(t: Tables):
    zones = lines(t).where("page % 5 = 0").select("page").distinct().select("page", F.lit("native").alias("layer"), F.inline(F.array(*[F.struct(F.lit(n).alias("zone"), F.lit(a).alias("zx0"), F.lit(b).alias("zx1")) for n, a, b in _ZONES])), F.lit(150.0).alias("zy0"), F.lit(215.0).alias("zy1"))
    spans = lines(t).where("line % 9 = 0").select("record", F.concat(F.lit("span-"), F.col("line") % 3).alias("name"), (F.col("start") - 40).alias("s"), (F.col("start") + 60).alias("e"))
    rectangles = lines(t).where("line % 5 = 0 and x0 is not null").select("page", F.concat(F.lit("rect-"), "line").alias("rect_id"), (F.col("x0") - 5).alias("x0"), "y0", (F.col("x0") + 60 + F.col("line") % 120).alias("x1"), (F.col("y0") + 80).alias("y1"))
    return lines(t), zones, spans, rectangles


@query(f"""WITH l AS ({_DUCK}), z AS (SELECT DISTINCT page, unnest([{', '.join(f"{{'zone': '{n}', 'a': {a}, 'b': {b}}}" for n, a, b in _ZONES)}], recursive := true) FROM l WHERE page % 5 = 0),
s AS (SELECT record, 'span-' || line % 3 AS name, start - 40 AS s, start + 60 AS e FROM l WHERE line % 9 = 0),
r AS (SELECT page, 'rect-' || line AS rect_id, x0 - 5 AS a0, y0 AS b0, x0 + 60 + line % 120 AS a1, y0 + 80 AS b1 FROM l WHERE line % 5 = 0 AND x0 IS NOT NULL),
c AS (SELECT *, coalesce((x0 + x1) / 2, 0) AS cx, coalesce((y0 + y1) / 2, 0) AS cy FROM l),
f AS (SELECT c.*, (SELECT min(zone) FROM z WHERE z.page = c.page AND layer = 'native' AND cx >= a AND cx < b AND coalesce(y0, 0) > 150 AND coalesce(y0, 0) < 215) AS zone,
 (SELECT arg_min(name, {{'s': s, 'e': e, 'n': name}}) FROM s WHERE s.record = c.record AND s <= start AND "end" <= e) AS span,
 (SELECT arg_min(rect_id, {{'a': (a1 - a0) * (b1 - b0), 'r': rect_id}}) FROM r WHERE r.page = c.page AND layer = 'native' AND audited AND NOT test_card AND cx BETWEEN a0 - 3 AND a1 + 3 AND cy BETWEEN b0 - 2 AND b1 + 2 AND x0 >= a0 - 3 AND x1 <= a1 + 3) AS rect FROM c),
g AS (SELECT *, CASE WHEN zone IS NOT NULL THEN zone WHEN span IS NOT NULL THEN span WHEN reviewed THEN 'reviewed-' || concat_ws(',', x0::DECIMAL(18, 2), y0::DECIMAL(18, 2), x1::DECIMAL(18, 2), y1::DECIMAL(18, 2)) WHEN layer = 'native' AND test_card THEN CASE WHEN cx < 340 THEN 'card-left' ELSE 'card-right' END
 WHEN layer = 'native' THEN coalesce(rect, 'native-block-' || block) WHEN kind = 'reference_information' THEN CASE WHEN cx < 335 THEN 'unboxed-left' ELSE 'unboxed-right' END ELSE 'unboxed-body' END AS grp FROM f),
n AS (SELECT *, (starts_with(grp, 'unboxed') OR starts_with(grp, 'card-')) AND row_number() OVER w > 1 AND (y0 - lag(y1) OVER w > 15 OR test_card AND (ends_with(text, ':') OR text = 'NOTES')) AS new
 FROM g WINDOW w AS (PARTITION BY page, grp ORDER BY round_even(coalesce(y0, 0) / 3, 0), coalesce(x0, 0), start, line))
SELECT line, grp AS "group", (coalesce(sum(coalesce(new, false)::INT) OVER (PARTITION BY page, grp ORDER BY round_even(coalesce(y0, 0) / 3, 0), coalesce(x0, 0), start, line), 0))::INT AS segment FROM n""")
def spatial_segments(t: Tables):
    """Each line's group (zone, span, reviewed region, card half, smallest rectangle, block, unboxed half) and segment."""
    return regions.segments(regions.spatial_names(*_spatial(t))).select("line", "group", "segment")


@query()
def spatial_groups(t: Tables):
    """The groups once short headings have joined the panel right below them; heading by heading, which SQL can't say."""
    return regions.spatial_groups(*_spatial(t)).select("line", "page", "group", "segment", "rank")


@query("""WITH RECURSIVE v AS (SELECT DISTINCT user_id, epoch_us(ts) AS v FROM events), b AS (SELECT user_id, min(v) AS v FROM v GROUP BY user_id
 UNION ALL SELECT b.user_id, (SELECT min(v.v) FROM v WHERE v.user_id = b.user_id AND v.v - b.v >= 21600000000) FROM b WHERE b.v IS NOT NULL)
SELECT user_id, v FROM b WHERE v IS NOT NULL""")
def spaced_events(t: Tables):
    """A user's events at least six hours after the last one kept."""
    return greedy.starts(t.events.select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("v")), "user_id", "v", 21_600_000_000, inclusive=True)


_REFS = """d AS (SELECT doc_id, string_split(text, chr(10)) AS h, text FROM documents), e AS (SELECT doc_id, unnest(h) AS line, generate_subscripts(h, 1) - 1 AS n FROM d),
f AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM e),
g AS (SELECT doc_id, n, line, start, start + length(line) AS stop, CASE WHEN n % 2 = 0 THEN 'left' ELSE 'right' END AS half FROM f WHERE line <> ''),
r AS (SELECT doc_id, half, n, 0 AS again, CASE WHEN doc_id % 29 = 0 AND n = 2 THEN -1 ELSE doc_id END AS record, start, stop, CASE WHEN doc_id % 17 = 0 AND n = 1 THEN line || '!' ELSE line END AS ref_text, CASE WHEN half = 'left' AND NOT (doc_id % 19 = 0 AND n = 0) THEN 40.0 ELSE 340.0 END AS x0 FROM g
 UNION ALL SELECT doc_id, half, n, 1, doc_id, start, stop, line, CASE WHEN half = 'left' THEN 40.0 ELSE 340.0 END FROM g WHERE doc_id % 11 = 0 AND n < 2),
u AS (SELECT doc_id, half, string_agg(line, chr(10) ORDER BY n, k) || CASE WHEN doc_id % 23 = 0 THEN ' x' ELSE '' END AS unit_text FROM (SELECT *, unnest(CASE WHEN doc_id % 11 = 0 AND n < 2 THEN [0, 1] ELSE [0] END) AS k FROM g) GROUP BY doc_id, half)"""


@query(f"""WITH {_REFS}, x AS (SELECT r.*, length(line_text) AS z, line_text FROM (SELECT r.*, substr(t.text, r.start + 1, r.stop - r.start) AS line_text FROM r LEFT JOIN documents t ON t.doc_id = r.record) r),
c AS (SELECT doc_id, half, unnest([CASE WHEN count(*) OVER (PARTITION BY record, start, stop) > 1 AND row_number() OVER (PARTITION BY record, start, stop ORDER BY doc_id, half, n, again) > 1 THEN 'duplicated_source_span' END,
 CASE WHEN record >= 0 AND doc_id % 13 = 0 THEN 'wrong_source_page' END, CASE WHEN line_text <> ref_text THEN 'altered_source_text' END, CASE WHEN half = 'left' AND x0 > 100 THEN 'cross_column_mixing' END, CASE WHEN line_text IS NULL THEN 'missing_record' END]) AS code FROM x),
b AS (SELECT doc_id, half, string_agg(coalesce(line_text, ''), chr(10) ORDER BY n, again) AS rebuilt FROM x GROUP BY ALL),
w AS (SELECT doc_id, half, code FROM c WHERE code IS NOT NULL UNION ALL SELECT doc_id, half, 'unrecorded_projection_change' FROM u JOIN b USING (doc_id, half) WHERE unit_text <> rebuilt)
SELECT doc_id || ':' || half AS unit, code, count(*) AS n FROM w GROUP BY ALL""")
def projection_errors(t: Tables):
    """Units of a document's even and odd lines against their sources, with every fault planted."""
    c = F.col
    half = F.when(c("line_no") % 2 == 0, "left").otherwise("right")
    g = ledger.lines(t.documents, "doc_id", "text").where("line <> ''").select("doc_id", c("line_no").alias("n"), "line", "start", (c("start") + F.length("line")).alias("end"), half.alias("half"))
    twice = (c("doc_id") % 11 == 0) & (c("n") < 2)
    left = c("half") == "left"
    own = g.select("*", F.explode(F.when(twice, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))
    first = c("again") == 0
    refs = own.select(
        F.concat_ws("/", "doc_id", "n", "again").alias("ref"), F.concat_ws(":", "doc_id", "half").alias("unit"), (c("n") * 2 + c("again")).alias("place"), F.when(first & (c("doc_id") % 29 == 0) & (c("n") == 2), -1).otherwise(c("doc_id")).alias("record"),
        "start", "end", F.when(first & (c("doc_id") % 17 == 0) & (c("n") == 1), F.concat("line", F.lit("!"))).otherwise(c("line")).alias("text"),
        F.when(left & ~(first & (c("doc_id") % 19 == 0) & (c("n") == 0)), 40.0).otherwise(340.0).alias("x0"),
    ).withColumn("x1", c("x0") + 100)
    times = lambda x, i, side: F.when((x == "") | (i % 2 != side), 0).when((c("doc_id") % 11 == 0) & (i < 2), 2).otherwise(1)
    of = lambda side: F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.array_repeat(x, times(x, i, side))))
    sides = F.array(*[F.struct(F.lit(name).alias("half"), of(side).alias("l")) for side, name in enumerate(("left", "right"))])
    texts = t.documents.select("doc_id", F.inline_outer(sides)).where("size(l) > 0")
    text = F.concat(F.array_join("l", "\n"), F.when(c("doc_id") % 23 == 0, " x").otherwise(""))
    page = F.floor(c("doc_id") / 4) + (c("doc_id") % 13 == 0).cast("int")
    units = texts.select(F.concat_ws(":", "doc_id", "half").alias("unit"), F.struct("doc_id", "half").alias("seq"), page.alias("page"), "half", text.alias("text"))
    return projection.errors(units, refs, t.documents.select(c("doc_id").alias("record"), F.floor(c("doc_id") / 4).alias("page"), "text"))


def layers(t: Tables):
    """(pieces, claims, represented, decisions) of two layers. A document is a page, its lines are the native layer. Of each pair of
    lines the other layer has, in turn: both with other blanks, both as one, both within more text, a misreading, something
    elsewhere on the page and blanks, one that decisions are about, and two that claim the same lines."""
    c = F.col
    lines = ledger.lines(t.documents, "doc_id", "text").withColumn("line", F.regexp_replace("line", r"\n$", "")).withColumn("pair", F.floor(c("line_no") / 2)).withColumn("side", c("line_no") % 2)
    y = c("line_no") * 12.0
    native = lines.select(
        c("doc_id").alias("page"), F.lit("native").alias("layer"), F.concat(F.lit("N"), "doc_id").alias("record"), c("start").cast("long").alias("start"), (c("start") + F.length("line")).cast("long").alias("end"), c("line").alias("text"),
        F.lit(40.0).alias("x0"), y.alias("y0"), F.lit(240.0).alias("x1"), (y + 10).alias("y1"), c("line_no"), c("pair"),
    )
    pair = lines.groupBy("doc_id", "pair").agg(F.max(F.when(c("side") == 0, c("line"))).alias("one"), F.max(F.when(c("side") == 1, c("line"))).alias("two")).where("two is not null")
    what = c("pair") % 7
    part = lambda text, from_, to, x=0.0: F.struct(text.alias("text"), F.lit(x + 40.0).alias("x0"), F.lit(x + 240.0).alias("x1"), F.lit(from_).alias("from"), F.lit(to).alias("to"))
    wide = F.concat(F.lit("Figure "), c("one"), F.lit(" with "), c("two"), F.lit(" below"))
    spaced = lambda x: F.regexp_replace(x, " ", "  ")
    shapes = (
        F.when(what == 0, F.array(part(spaced(c("one")), 0.0, 10.0), part(spaced(c("two")), 12.0, 22.0))).when(what == 1, F.array(part(F.concat_ws(" ", "one", "two"), 0.0, 22.0))).when(what == 2, F.array(part(wide, 0.0, 22.0)))
        .when(what == 3, F.array(part(F.translate("one", "e", "c"), 0.0, 22.0))).when(what == 4, F.array(part(c("one"), 0.0, 10.0, 600.0), part(F.lit(" \t "), 0.0, 10.0, 300.0))).when(what == 5, F.array(part(c("one"), 0.0, 10.0)))
        .otherwise(F.array(part(wide, 0.0, 22.0), part(F.concat(wide, F.lit(" again")), 0.5, 22.5)))
    )
    ocr = pair.select("doc_id", "pair", F.posexplode(shapes).alias("k", "s"))
    ocr = ocr.select(
        c("doc_id").alias("page"), F.lit("ocr").alias("layer"), F.concat_ws("/", F.lit("O"), "doc_id", "pair", "k").alias("record"), F.lit(0).cast("long").alias("start"), F.length("s.text").cast("long").alias("end"), c("s.text").alias("text"), "s.x0", (c("pair") * 24 + c("s.from")).alias("y0"), "s.x1",
        (c("pair") * 24 + c("s.to")).alias("y1"), (c("pair") * 2).alias("line_no"), "pair",
    )
    pieces = native.unionByName(ocr).withColumn("ref", F.concat_ws(":", "record", "start")).withColumn("before", F.when(c("start") > 0, "\n").otherwise("")).withColumn("behind", F.when(c("layer") == "native", "\n").otherwise(""))
    own = native.where("line_no % 11 = 3 and end > start").select("page", "record", "start", "end", "text", "x0", "y0", "x1", "y1")
    table = native.where("line_no % 13 = 5 and end > start").select("page", F.concat_ws("/", F.lit("T"), "page", "line_no").alias("record"), F.lit(0).cast("long").alias("start"), (F.length("text") + 10).cast("long").alias("end"), F.concat(F.lit("Row 1: "), c("text"), F.lit(" |")).alias("text"), "x0", "y0", "x1", "y1")
    claims = own.unionByName(table).withColumn("ref", F.concat_ws(":", F.lit("C"), "record", "start")).withColumn("before", F.lit("")).withColumn("behind", F.lit(""))
    represented = native.where("line_no % 17 = 4").select("record", "start", "end")
    asked = ocr.where("pair % 7 = 5")
    turn = F.floor(c("pair") / 7) % 3
    state = F.when(turn == 0, F.array(F.lit("PREFERRED"))).when(turn == 1, F.array(F.lit("PREFERRED"), F.lit("EXCLUDED_NON_TEXT"))).otherwise(F.array(F.lit("EXCLUDED_NON_TEXT"), F.lit("LAYOUT_ONLY")))
    decisions = asked.select("record", "start", "end", F.explode(state).alias("state")).withColumn("reason", F.lower("state"))
    return pieces.drop("line_no", "pair"), claims, represented, decisions


@query()
def layer_selection(t: Tables):
    """What becomes of each piece of two layers, with the number of parts that prove it; the search for witnesses isn't SQL."""
    done, proofs = witness.select(*layers(t))
    return done.join(proofs.select("ref", F.size("parts").alias("n_parts")), "ref", "left").select("page", "layer", "record", "start", "outcome", "n_parts")


_CAPTION = "CASE p_partkey % 9 WHEN 0 THEN concat('figure  ', p_size, '. of it') WHEN 1 THEN concat('When checking ', p_name) WHEN 2 THEN '  ' ELSE p_name END"


@query(f"""WITH l AS (SELECT l.* REPLACE ({_CAPTION} AS text) FROM ({_DUCK}) l JOIN part ON p_partkey = line), f AS (SELECT page, 'F' || line AS figure_id, x0 - 20 AS a0, y0 - 30 AS b0, x0 + 200 AS a1, y0 + 120 AS b1 FROM l WHERE line % 10 = 3 AND x0 IS NOT NULL)
SELECT line, (SELECT arg_min(figure_id, {{'a': (a1 - a0) * (b1 - b0), 'f': figure_id}}) FROM f WHERE f.page = l.page AND (x0 + x1) / 2 BETWEEN a0 AND a1 AND (y0 + y1) / 2 BETWEEN b0 AND b1 AND x0 >= a0 - 3 AND x1 <= a1 + 3) AS figure_id
FROM l WHERE trim(text) <> '' AND line % 12 <> 0 AND NOT regexp_matches(text, '(?i)when checking|figure\\s+[0-9]+\\.') AND figure_id IS NOT NULL""")
def figure_exclusion(t: Tables):
    """Lines that are labels within figures, but for captions, warnings and what is claimed."""
    rows = lines(t).join(t.part.select(F.col("p_partkey").alias("line"), F.expr(_CAPTION).alias("caption")), "line").withColumn("text", F.col("caption")).drop("caption")
    figures = rows.where("line % 10 = 3 and x0 is not null").select("page", F.concat(F.lit("F"), "line").alias("figure_id"), (F.col("x0") - 20).alias("x0"), (F.col("y0") - 30).alias("y0"), (F.col("x0") + 200).alias("x1"), (F.col("y0") + 120).alias("y1"))
    return regions.in_figures(rows, figures, rows.where("line % 12 = 0"))


_SECTIONED = "CASE WHEN p_partkey % 23 = 4 THEN concat('2-', p_size, '. CHECK THE PUMP') WHEN p_partkey % 29 = 3 THEN concat('3-', p_size, '.1. Bold heading') WHEN p_partkey % 7 = 0 THEN 'KNOWN INFO' WHEN p_partkey % 11 = 0 THEN 'TEST OPTIONS' ELSE p_name END"
_NUMBER = "regexp_extract(text, '^([0-9]{1,2}-[0-9]{1,3}(?:\\.[0-9]+)*)\\. ', 1)"


@query(f"""WITH RECURSIVE l AS (SELECT l.* REPLACE ({_SECTIONED} AS text) FROM ({_DUCK}) l JOIN part ON p_partkey = line), n AS (SELECT *, nullif({_NUMBER}, '') AS number, coalesce(y0, 0) AS y, coalesce(x0, 0) AS x FROM l),
h AS (SELECT page, number, y, start FROM n WHERE number IS NOT NULL), d AS (SELECT n.*, (SELECT arg_max(h.number, {{'y': h.y, 's': h.start}}) FROM h WHERE h.page = n.page AND h.y <= n.y) AS section FROM n WHERE number IS NULL),
g AS (SELECT *, page || '/' || coalesce(section, '-') AS part FROM d), m AS (SELECT DISTINCT part, round(y0, 1) AS y FROM g WHERE text IN ('KNOWN INFO', 'TEST OPTIONS') AND y0 IS NOT NULL),
b AS (SELECT part, min(y) AS y FROM m GROUP BY part UNION ALL SELECT b.part, (SELECT min(y) FROM m WHERE m.part = b.part AND m.y - b.y > 15) FROM b WHERE b.y IS NOT NULL),
c AS (SELECT *, {_BUCKET} AS bucket FROM g),
k AS (SELECT *, CASE WHEN kind = 'diagnostic_flowchart' AND NOT bucket IN ('unknown', 'cross_column') AND y0 <> 0 THEN (SELECT count(*) FROM b WHERE b.part = c.part AND b.y <= c.y0 + 6) ELSE 0 END AS band FROM c),
o AS (SELECT *, concat(bucket, '/', band, CASE WHEN bucket IN ('unknown', 'cross_column') THEN concat('/', record, '/', start) ELSE '' END) AS region_key,
 CASE bucket WHEN 'left' THEN 0 WHEN 'centre' THEN 1 WHEN 'right' THEN 2 WHEN 'wide' THEN 3 WHEN 'unknown' THEN 4 WHEN 'cross_column' THEN 5 ELSE 0 END AS rank FROM k),
p AS (SELECT *, row_number() OVER (PARTITION BY part, region_key ORDER BY y, x, start) AS place FROM o),
r AS (SELECT page, section, bucket, band, min(start) FILTER (place = 1) AS first_start, count(*) AS n_lines, bool_or(layer = 'ocr') AS ocr, row_number() OVER (PARTITION BY part ORDER BY min(y), min(rank), min(start) FILTER (place = 1)) AS region FROM p GROUP BY part, page, section, bucket, band, region_key)
SELECT page, section, CASE WHEN bucket IN ('unknown', 'cross_column') THEN 'none' ELSE 'prose' END AS kind, bucket AS "column", band, region, first_start, n_lines,
 CASE WHEN bucket IN ('unknown', 'cross_column') THEN 'CROSS_REGION_TEXT' WHEN ocr THEN 'STRUCTURE_BOUNDARY,OCR_REGION_STRUCTURE' ELSE 'STRUCTURE_BOUNDARY' END AS reviews FROM r
UNION ALL SELECT page, number, 'heading', NULL, NULL, NULL, start, 1, NULL FROM h WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.page = h.page AND r.section = h.number)""")
def sectioned_units(t: Tables):
    """Units of prose by section and region, with what is for review."""
    texts = t.part.select(F.col("p_partkey").alias("line"), F.expr(_SECTIONED).alias("said"), (F.col("p_partkey") % 29 == 3).alias("bold"))
    return regions.prose_units(lines(t).join(texts, "line").withColumn("text", F.col("said")).drop("said"))
