"""Page geometry, grids, anchors, blocks, and rule classifiers."""

from pyspark.sql import functions as F

from ..functions import classify
from ..operators import greedy, layout, ledger
from .corpus import _DAYS, _spans
from .registry import Tables, query


@query(f"WITH i AS ({_DAYS}) SELECT a.l_suppkey, count(*) AS n_pairs, sum(b.e - b.s)::BIGINT AS days FROM i a JOIN i b ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND a.s <= b.s AND b.e <= a.e GROUP BY a.l_suppkey")
def interval_containment_join(t: Tables):
    i = _spans(t)
    a, b = i.where("l_returnflag = 'A'").select("l_suppkey", F.col("s").alias("a0"), F.col("e").alias("a1")), i.where("l_returnflag = 'R'").select("l_suppkey", F.col("s").alias("b0"), F.col("e").alias("b1"))
    return layout.contain_join(a, b, ["l_suppkey"], 30).groupBy("l_suppkey").agg(F.count("*").alias("n_pairs"), F.sum(F.col("b1") - F.col("b0")).alias("days"))


@query("""WITH c AS (SELECT c_custkey AS id, s_suppkey, count(*) OVER (PARTITION BY c_custkey) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey AND c_acctbal - s_acctbal BETWEEN -180 AND 480)
SELECT c_custkey AS id, (SELECT min(s_suppkey) FROM c WHERE c.id = c_custkey AND n = 1) AS anchor_id FROM customer""")
def nearest_anchor(t: Tables):
    points = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("page"), F.col("c_acctbal").alias("y"))
    anchors = t.supplier.select(F.col("s_suppkey").alias("anchor_id"), F.col("s_nationkey").alias("page"), F.col("s_acctbal").alias("ay"))
    return layout.unique_anchor(points, anchors, ["page"], -180.0, 480.0).select("id", "anchor_id")


@query("""WITH g AS (SELECT p_brand, p_retailprice - 3 AS y, max(p_partkey) AS row FROM part WHERE p_partkey % 20 = 0 GROUP BY ALL)
SELECT p.p_partkey, g.row AS last_row FROM part p ASOF LEFT JOIN g ON p.p_brand = g.p_brand AND p.p_retailprice >= g.y""")
def line_to_grid(t: Tables):
    rows = t.part.where("p_partkey % 20 = 0").select("p_brand", F.col("p_retailprice").alias("top"), F.col("p_partkey").alias("row"))
    lines = t.part.select("p_brand", "p_partkey", F.col("p_retailprice").alias("y"))
    return layout.to_grid(lines, rows, "p_brand", "y").select("p_partkey", "last_row")


@query("""SELECT p_brand, p_type, min(p_size)::DOUBLE AS x0, min(p_retailprice) AS y0, max(p_size) + 10.0::DOUBLE AS x1, max(p_retailprice) + 8 AS y1, sha256(string_agg(p_name, chr(10) ORDER BY p_retailprice, p_size, p_partkey)) AS sha FROM part GROUP BY ALL""")
def block_assembly(t: Tables):
    x, y = F.col("p_size").cast("double"), F.col("p_retailprice")
    lines = t.part.select("p_brand", "p_type", x.alias("x0"), y.alias("y0"), (x + 10).alias("x1"), (y + 8).alias("y1"), F.col("p_partkey").alias("line"), F.col("p_name").alias("text"))
    return layout.blocks(lines, ["p_brand", "p_type"]).withColumn("sha", F.sha2("text", 256)).drop("text")


_BOXES = "SELECT p_brand AS page, p_partkey AS id, (p_size // 5) * 5.0::DOUBLE AS x0, (p_size // 5) * 5.0::DOUBLE + p_partkey % 3 AS x1, p_retailprice::DOUBLE AS y0, p_retailprice::DOUBLE + 12 AS y1 FROM part"


def _box_rows(t: Tables):
    x = F.floor(F.col("p_size") / 5) * 5.0
    return t.part.select(
        F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), x.alias("x0"), (x + F.col("p_partkey") % 3).alias("x1"), F.col("p_retailprice").cast("double").alias("y0"), (F.col("p_retailprice") + 12).cast("double").alias("y1")
    )


@query(f"""WITH RECURSIVE b AS ({_BOXES}), e AS (SELECT a.id AS u, c.id AS v FROM b a JOIN b c ON a.page = c.page AND a.id <> c.id AND abs(a.x0 - c.x0) < 2.5 AND abs(a.x1 - c.x1) < 2.5 AND greatest(a.y0, c.y0) - least(a.y1, c.y1) < 3),
r AS (SELECT u AS node, u AS reached FROM e UNION SELECT r.node, e.v FROM r JOIN e ON e.u = r.reached)
SELECT node, min(reached) AS component FROM r GROUP BY node""")
def touching_components(t: Tables):
    return layout.touching_components(_box_rows(t), "page", 2.5, 3.0)


@query("""SELECT p_partkey, lag(p_partkey) OVER w AS previous, lead(p_partkey) OVER w AS next FROM part WINDOW w AS (PARTITION BY p_brand, p_type ORDER BY p_retailprice, p_partkey)""")
def neighbour_links(t: Tables):
    rows = t.part.withColumn("item", F.concat_ws("/", "p_brand", "p_type"))
    return layout.linked(rows, "item", ["p_retailprice", "p_partkey"], "p_partkey").select("p_partkey", "previous", "next")


@query(r"""WITH d AS (SELECT conv_id, turn, role, regexp_extract_all(text, '[A-Za-z]+|[0-9]+') AS h, string_split_regex(text, '[A-Za-z]+|[0-9]+') AS g FROM conversations),
e AS (SELECT conv_id, turn, role, unnest(h) AS w, unnest(g[1:len(h)]) AS gap, generate_subscripts(h, 1) AS i FROM d),
f AS (SELECT *, regexp_matches(w, '[0-9]') AS kind FROM e),
k AS (SELECT *, i = 1 OR kind <> lag(kind) OVER (PARTITION BY conv_id, turn, role ORDER BY i) OR NOT regexp_full_match(gap, '[ \t]+') AS starts FROM f)
SELECT conv_id, turn, role, count(*) AS n_words, count(*) FILTER (starts) AS n_runs FROM k GROUP BY ALL""")
def adjacent_runs(t: Tables):
    """Words of one kind that only blanks part, and no line end, are one run; counted within each row, whose text goes nowhere."""
    pattern = "[A-Za-z]+|[0-9]+"
    hits, between = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), F.split("text", pattern)
    words = F.transform(F.arrays_zip(hits.alias("word"), F.slice(between, 1, F.size(hits)).alias("gap")), lambda x: F.struct(x["word"].rlike("[0-9]").alias("kind"), x["gap"].rlike(r"^[ \t]+$").alias("near")))
    return t.conversations.select("conv_id", "turn", "role", words.alias("w")).where("size(w) > 0").select("conv_id", "turn", "role", F.size("w").alias("n"), layout.adjacent_runs(F.col("w")).alias("runs")).groupBy("conv_id", "turn", "role").agg(
        F.sum("n").alias("n_words"), F.sum("runs").alias("n_runs")
    )


@query("""WITH RECURSIVE c AS (SELECT p_brand, min(p_retailprice) AS anchor FROM part GROUP BY p_brand
 UNION ALL SELECT c.p_brand, (SELECT min(p_retailprice) FROM part p WHERE p.p_brand = c.p_brand AND p.p_retailprice - c.anchor > 75) FROM c WHERE c.anchor IS NOT NULL)
SELECT p_brand, anchor AS p_retailprice FROM c WHERE anchor IS NOT NULL""")
def band_starts(t: Tables):
    return greedy.starts(t.part, "p_brand", "p_retailprice", 75.0)


@query("""WITH RECURSIVE r AS (SELECT p_brand, x, y0, y1, n, row_number() OVER (PARTITION BY p_brand ORDER BY x) AS i FROM (
  SELECT p_brand, p_retailprice::DOUBLE AS x, min(p_size) AS y0, max(p_size + 20) AS y1, count(*) AS n FROM part GROUP BY ALL)),
e AS (SELECT p_brand, x, y0, y1, n, row_number() OVER (PARTITION BY p_brand ORDER BY x, k) AS i FROM (SELECT p_brand, x, y0, y1, 1 AS n, unnest(range(n)) AS k FROM r)),
f AS (SELECT p_brand, i, x AS mean, 1 AS run FROM e WHERE i = 1
 UNION ALL SELECT e.p_brand, e.i, CASE WHEN abs(e.x - f.mean) < 4 THEN (f.mean + e.x) / 2 ELSE e.x END, f.run + (abs(e.x - f.mean) >= 4)::INT FROM f JOIN e ON e.p_brand = f.p_brand AND e.i = f.i + 1)
SELECT p_brand, arg_max(mean, i) AS x, min(y0) AS y0, max(y1) AS y1, count(*) AS n FROM f JOIN e USING (p_brand, i) GROUP BY p_brand, run""")
def merged_rules(t: Tables):
    """Vertical rules that are nearly the same one, averaged as they come, repeated ones too."""
    return layout.merged_rules(t.part.select("p_brand", F.col("p_retailprice").alias("x"), F.col("p_size").alias("y0"), (F.col("p_size") + 20).alias("y1")), "p_brand", 4.0)


@query()
def distinct_rectangles(t: Tables):
    return layout.distinct_boxes(_box_rows(t), "page", 4.0)


_KIND = "CASE WHEN p_partkey % 9 = 0 THEN 'reviewed_two_column' WHEN p_type LIKE '%STANDARD%' THEN 'diagnostic_flowchart' WHEN p_type LIKE '%SMALL%' THEN 'reference_information' WHEN p_size % 2 = 0 THEN 'numbered_section' ELSE 'other' END"


@query(f"""WITH r AS (SELECT p_size * 10 AS x0, p_size * 10 + p_partkey % 150 AS x1, {_KIND} AS kind FROM part)
SELECT kind, CASE WHEN kind = 'diagnostic_flowchart' THEN CASE WHEN x0 < 165 AND x1 <= 168 THEN 'left' WHEN x0 >= 165 AND x0 < 355 AND x1 <= 360 THEN 'centre' WHEN x0 >= 350 THEN 'right' ELSE 'cross_column' END
 WHEN kind IN ('reference_information', 'reviewed_two_column') THEN CASE WHEN x0 < 320 AND x1 <= 335 THEN 'left' WHEN x0 >= 320 THEN 'right' ELSE 'wide' END ELSE 'body' END AS bucket, count(*) AS n FROM r GROUP BY ALL""")
def page_columns(t: Tables):
    header = F.when(F.col("p_type").like("%STANDARD%"), "DIAGNOSTIC FLOWCHART").when(F.col("p_type").like("%SMALL%"), "REFERENCE INFORMATION").otherwise("")
    kind = classify.page_kind(header, F.col("p_partkey") % 9 == 0, F.col("p_size") % 2 == 0)
    rows = t.part.select((F.col("p_size") * 10).alias("x0"), (F.col("p_size") * 10 + F.col("p_partkey") % 150).alias("x1"), kind.alias("kind"))
    return rows.groupBy("kind", classify.column_bucket(F.col("kind"), F.col("x0"), F.col("x1")).alias("bucket")).agg(F.count("*").alias("n"))


_HEADING = "(CAST(p_partkey % 4 AS VARCHAR(9)) || '-' || CAST(p_size AS VARCHAR(9)) || CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE '. ' END || CASE WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE 'Name of ' || lower(p_name) END)"


@query(r"""SELECT section, count(*) AS n FROM (SELECT CASE WHEN (upper(h) = h AND lower(h) <> h) OR p_size > 40 THEN nullif(regexp_extract(trim(h), '^([0-9]{1,2}-[0-9]{1,3}(?:\.[0-9]+)*[A-Za-z]?)\.[ \t]+(.+)', 1), '') END AS section FROM (SELECT """ + _HEADING + """ AS h, p_size FROM part)) GROUP BY section""")
def section_headings(t: Tables):
    return t.part.select(classify.section_number(F.expr(_HEADING), F.col("p_size") > 40).alias("section")).groupBy("section").agg(F.count("*").alias("n"))


_PATTERN = "CASE WHEN doc_id % 5 = 0 THEN '[A-Za-z]+' ELSE '[^ ]+' END"
_BOX = "CASE doc_id % 4 WHEN 0 THEN CASE WHEN (start {div} 24) % 3 < 2 THEN concat('b', (start {div} 24) % 3) END WHEN 1 THEN 'b0' WHEN 3 THEN concat('b', start {div} 24) END"


@query(f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), e AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) - 1 AS n FROM d),
r AS (SELECT doc_id, n, line, doc_id % 7 = 0 AND n % 4 = 0 AS corrected FROM e WHERE line <> ''),
h AS (SELECT *, CASE WHEN doc_id % 5 = 0 THEN regexp_extract_all(line, '[A-Za-z]+') ELSE regexp_extract_all(line, '[^ ]+') END AS h, CASE WHEN doc_id % 5 = 0 THEN string_split_regex(line, '[A-Za-z]+') ELSE string_split_regex(line, '[^ ]+') END AS g FROM r),
w AS (SELECT doc_id, n, line, corrected, unnest(h) AS word, generate_subscripts(h, 1) AS i, h, g FROM h),
s AS (SELECT *, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT AS start FROM w),
b AS (SELECT *, {_BOX.format(div='//')} AS box FROM s),
c AS (SELECT doc_id, n, any_value(corrected) AS corrected, any_value(length(regexp_replace(line, '[ \t]', '', 'g'))) = sum(length(word)) AND any_value(line) NOT SIMILAR TO '.*[\x0b\f\r].*' AS complete, count(DISTINCT box) AS boxes, count(*) FILTER (box IS NULL) AS unboxed FROM b GROUP BY doc_id, n)
SELECT r.doc_id, CASE WHEN r.corrected THEN 'CORRECTION_REGION_REQUIRES_REVIEWED_COORDINATES' WHEN NOT coalesce(complete, trim(r.line) = '') THEN 'INCOMPLETE_EXACT_WORD_MAPPING' WHEN coalesce(boxes, 0) = 0 THEN 'NO_CLOSED_RECTANGLE_MATCH' WHEN unboxed > 0 THEN 'BOX_AND_UNBOXED_TEXT'
 WHEN boxes > 1 THEN 'MULTIPLE_RECTANGLES' ELSE 'SINGLE_RECTANGLE' END AS class, count(*) AS n FROM r LEFT JOIN c USING (doc_id, n) GROUP BY ALL""")
def review_classes(t: Tables):
    """Lines by how their words lie in rectangles, worked out from the words."""
    from ..functions.text import matches

    lines = ledger.lines(t.documents, "doc_id", "text").withColumn("line", F.regexp_replace("line", r"\n$", "")).where("line <> ''").select("doc_id", F.concat_ws(":", "doc_id", "line_no").alias("ref"), F.col("line").alias("text"), ((F.col("doc_id") % 7 == 0) & (F.col("line_no") % 4 == 0)).alias("corrected"))
    found = F.when(F.col("doc_id") % 5 == 0, matches(F.col("text"), "[A-Za-z]+")).otherwise(matches(F.col("text"), "[^ ]+"))
    words = lines.select("doc_id", "ref", F.inline(found)).select("ref", "start", (F.col("start") + F.length("token")).alias("end"), F.expr(_BOX.format(div="div")).alias("box"))
    classes = layout.word_classes(lines, words)
    return lines.select("doc_id", "ref").join(classes, "ref").groupBy("doc_id", "class").agg(F.count("*").alias("n"))


_C = "regexp_replace(lower({}), '[^a-z0-9]', '', 'g')"


@query(f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN 'OUTSIDE_INDEX_SCOPE' WHEN a <> '' AND contains({_C.format('p_name')}, a) THEN 'NATIVE_ANCHOR_FOUND' WHEN a <> '' AND contains({_C.format('p_type')}, a) THEN 'TABLE_ANCHOR_FOUND' WHEN a <> '' AND contains({_C.format('p_brand')}, a) THEN 'OCR_ANCHOR_FOUND_REVIEW_REQUIRED' ELSE 'ANCHOR_NOT_FOUND_REVIEW_REQUIRED' END AS status
 FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g')[1:4] WHEN 1 THEN regexp_replace(lower(p_type), '[^a-z0-9]', '', 'g')[2:6] WHEN 2 THEN regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') ELSE CASE WHEN p_size % 2 = 0 THEN 'zzz' ELSE '' END END AS a FROM part)) GROUP BY status""")
def anchor_statuses(t: Tables):
    from ..functions.text import compact

    c = F.col
    anchor = F.when(c("p_partkey") % 4 == 0, F.substring(compact(c("p_name")), 1, 4)).when(c("p_partkey") % 4 == 1, F.substring(compact(c("p_type")), 2, 5)).when(c("p_partkey") % 4 == 2, c("p_brand")).otherwise(F.when(c("p_size") % 2 == 0, "Z.Z z").otherwise(" - "))
    return t.part.select(classify.anchor_status(c("p_partkey") % 11 != 0, anchor, c("p_name"), c("p_type"), c("p_brand")).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


_MARGIN = "CASE p_partkey % 7 WHEN 0 THEN 'TM 9 -2320- 280-20-1' WHEN 1 THEN concat(' 2-', p_size, ' ') WHEN 2 THEN 'Change 1' WHEN 3 THEN concat('  ', p_name) WHEN 4 THEN '   ' WHEN 5 THEN concat('3-', p_size, '/(3-', p_size, ' Blank)') ELSE p_name END"


@query(rf"""WITH l AS (SELECT p_partkey, {_MARGIN} AS t, p_retailprice * 7 % 792 AS y FROM part),
r AS (SELECT *, trim(t) AS b, y + 10 < 792 * 0.09::DOUBLE OR y > 792 * 0.85::DOUBLE AS margin FROM l),
k AS (SELECT *, CASE WHEN margin AND b <> '' AND (regexp_matches(b, '^TM\s+9\s*-\s*2320\s*-\s*280\s*-\s*20\s*-\s*1$') OR regexp_matches(regexp_replace(b, '\s', '', 'g'), '^Change[12]$') OR regexp_matches(regexp_replace(b, '\s', '', 'g'), '^[123]-[0-9]+(/\([123]-[0-9]+Blank\))?$')) THEN 'recognized_margin' WHEN b <> t THEN 'outer_whitespace' END AS rule FROM r)
SELECT coalesce(rule, 'KEPT') AS rule, count(*) AS n, count(*) FILTER (b <> '' AND rule IS DISTINCT FROM 'recognized_margin') AS kept FROM k GROUP BY 1""")
def margin_removal(t: Tables):
    """Lines that go from the margins, lines that lose blanks, and the others."""
    y = F.col("p_retailprice") * 7 % 792
    lines = t.part.select("p_partkey", F.expr(_MARGIN).alias("text"), y.alias("y0"), (y + 10).alias("y1"))
    kept, changes = layout.cleaned(lines, F.lit(792))
    every = lines.select("p_partkey").join(changes.select("p_partkey", "rule"), "p_partkey", "left").join(kept.select("p_partkey", F.lit(1).alias("kept")), "p_partkey", "left")
    return every.groupBy(F.coalesce("rule", F.lit("KEPT")).alias("rule")).agg(F.count("*").alias("n"), F.count("kept").alias("kept"))


@query("""SELECT doc_id, length(regexp_replace(text, '[A-Za-z]+|[ \t\n\r\f\x0b]', '', 'g')) AS uncovered FROM documents""")
def uncovered_characters(t: Tables):
    return t.documents.select("doc_id", layout.uncovered(F.col("text"), "[A-Za-z]+").alias("uncovered"))


@query("""WITH c AS (SELECT l_orderkey AS box, count(*) FILTER (l_returnflag = 'N') AS sel, count(*) AS n, count(DISTINCT l_suppkey) AS owners, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1)
SELECT array_to_string(list_filter([CASE WHEN sel > 0 AND sel < n THEN 'PARTIALLY_SELECTED' END, CASE WHEN owners > 1 THEN 'MULTIPLE_OWNERS' END, CASE WHEN pending > 0 THEN 'PENDING' END], lambda x: x IS NOT NULL), ',') AS flags, count(*) AS n FROM c GROUP BY 1""")
def box_flags(t: Tables):
    c = t.lineitem.groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "N").alias("sel"), F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("owners"), F.count_if(F.col("l_linestatus") == "O").alias("pending"))
    flags = F.array_compact(F.array(F.when((F.col("sel") > 0) & (F.col("sel") < F.col("n")), "PARTIALLY_SELECTED"), F.when(F.col("owners") > 1, "MULTIPLE_OWNERS"), F.when(F.col("pending") > 0, "PENDING")))
    return c.select(F.array_join(flags, ",").alias("flags")).groupBy("flags").agg(F.count("*").alias("n"))


@query("""SELECT count(*) AS wanted, count(*) FILTER (page_id IN (SELECT doc_id FROM labels)) AS cached FROM pages WHERE contains(html, '<b>') OR contains(html, 'ß') OR (length(html) > 2000 AND length(html) - 1700 < 350) OR page_id IN (SELECT doc_id FROM labels)""")
def ocr_selection(t: Tables):
    cached = t.labels.select(F.col("doc_id").alias("page_id")).distinct().withColumn("cached", F.lit(True))
    rows = t.pages.join(cached, "page_id", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    html = F.col("html")
    return rows.where(classify.ocr_wanted(html.contains("<b>"), html.contains("ß"), F.length(html) > 2000, F.length(html) - 1700, F.col("cached"))).agg(F.count("*").alias("wanted"), F.count_if("cached").alias("cached"))


@query("""SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL AND n_chars > 0 AND NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id AND quality = 1) GROUP BY lang""")
def unmatched_lines(t: Tables):
    """Records that no claim uses."""
    return ledger.unclaimed(t.documents.where("text is not null and n_chars > 0"), t.labels.where("quality = 1"), "doc_id").groupBy("lang").agg(F.count("*").alias("n"))
