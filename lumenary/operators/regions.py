"""Regions of a page: columns and bands whose lines never interleave, and spatial groups."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions import classify
from . import greedy, grid
from .intervals import as_of
from .schedule import numbered

# Labels that begin a band and how far apart bands are, columns by rank, headings of panels, distances in points.
BAND_LABELS, BAND_APART, BAND_SLACK = ["KNOWN INFO", "TEST OPTIONS"], 15.0, 6.0
COLUMN_RANK = ["left", "centre", "right", "wide", "unknown", "cross_column"]
PANEL_HEADINGS = ["KNOWN INFO", "POSSIBLE PROBLEMS", "CONTINUITY (RESISTANCE)", "BATTERY VOLTAGE", "MULTIMETER"]
HEADING_LENGTH, HEADING_GAP, HEADING_SHIFT, PANEL_WIDTH = 85, 18.0, 55.0, 50.0
PROTECTED_CAPTION = r"(?i)WHEN CHECKING|DISCONNECT NEGATIVE|MAKING CONTINUITY|ALL CIRCUITS MUST RETURN|Figure\s+\d+\."
CARD_MIDDLE, UNBOXED_MIDDLE, SEGMENT_GAP = 340.0, 335.0, 15.0


def _or_zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def band_starts(lines: DataFrame) -> DataFrame:
    """page, band_y, band: tops of band labels (one decimal), each more than 15 below the last one kept, numbered from 1."""
    labels = lines.where(F.trim("text").isin(BAND_LABELS) & F.col("y0").isNotNull()).select("page", F.round("y0", 1).alias("band_y"))
    kept = greedy.starts(labels, "page", "band_y", BAND_APART)
    return kept.withColumn("band", F.row_number().over(W.partitionBy("page").orderBy("band_y")))


def grouped(lines: DataFrame) -> DataFrame:
    """The lines (page, kind, record, start, text, x0, y0, x1, y1) with column, band, region and place.

    Lines of a flowchart's column go by bands, those of a page in two columns by column, others to one section; a line
    across columns or without a box is a region of its own. Regions come by their top, their column's rank and their first
    line; within a region lines come by y, x and start. Places are counted over all lines in one order, so neither a page nor
    a region has to fit a task.
    """
    column = classify.column_bucket(F.col("kind"), F.col("x0"), F.col("x1"))
    rows = lines.withColumn("column", column).withColumn("__at", F.col("y0") + BAND_SLACK)
    starts = band_starts(lines)
    banded = greedy.last_at(rows, starts.select("page", "band_y"), "page", "__at", "band_y", BAND_APART).join(starts, ["page", "band_y"], "left")
    apart = F.col("column").isin("cross_column", "unknown")
    node = (F.col("kind") == "diagnostic_flowchart") & ~apart & (F.col("y0") != 0)
    keyed = banded.drop("band_y", "__at").withColumn("band", F.when(node, F.coalesce("band", F.lit(0))).otherwise(F.lit(0)))
    own = F.when(apart, F.concat_ws("/", F.col("record").cast("string"), F.col("start").cast("string")))
    keyed = keyed.withColumn("__key", F.concat_ws("/", F.col("page").cast("string"), "column", F.col("band").cast("string"), own))
    first = F.min(F.struct(_or_zero("y0").alias("y"), _or_zero("x0").alias("x"), F.col("start").alias("start"))).alias("first")
    rank = F.coalesce(*[F.when(F.col("column") == c, r) for r, c in enumerate(COLUMN_RANK)], F.lit(0))
    tops = keyed.groupBy("__key", "column").agg(first).select("__key", F.col("first.y").alias("__top"), rank.alias("__rank"), F.col("first.start").alias("__first"))
    placed = numbered(keyed.join(tops, "__key"), ["page", "__top", "__rank", "__first", "__key", _or_zero("y0"), _or_zero("x0"), "start"], "__n")
    begins = placed.groupBy("page", "__key").agg(F.min("__n").alias("__begin")).withColumn("region", F.row_number().over(W.partitionBy("page").orderBy("__begin"))).drop("page")
    kept = [c for c in placed.columns if not c.startswith("__")]
    return placed.join(begins, "__key").select(*kept, "region", (F.col("__n") - F.col("__begin") + 1).alias("place"))


# spatial groups


def spatial_names(lines: DataFrame, zones: DataFrame, spans: DataFrame, rectangles: DataFrame) -> DataFrame:
    """The lines (page, line, seq, kind, layer, test_card, audited, reviewed, record, start, end, block, x0, y0, x1, y1) with ``group``, by priority:

    a zone of the page and layer (zone, zx0, zx1, zy0, zy1) that holds the middle in x and the top in y; a span of the record
    (name, s, e) that holds the line; a reviewed region by its box; on a test card its half; on an audited page the smallest
    rectangle (rect_id, x0, y0, x1, y1) that holds the line; its native block; for OCR the half of a reference page, or the
    body. Of several zones or spans the first by place, then name; of rectangles of equal size the first by id.
    """
    middle = (F.col("x0") + F.col("x1")) / 2
    rows = lines.withColumn("cx", F.coalesce(middle, F.lit(0.0))).withColumn("cy", F.coalesce((F.col("y0") + F.col("y1")) / 2, F.lit(0.0)))
    inside = rows.join(zones.withColumnRenamed("layer", "zone_layer"), ["page"]).where((F.col("layer") == F.col("zone_layer")) & (F.col("cx") >= F.col("zx0")) & (F.col("cx") < F.col("zx1")) & (_or_zero("y0") > F.col("zy0")) & (_or_zero("y0") < F.col("zy1")))
    zoned = inside.groupBy("line").agg(F.min(F.struct("zy0", "zx0", "zone")).alias("z")).select("line", F.col("z.zone").alias("zone"))
    held = rows.select("line", "record", F.col("start").alias("b0"), F.col("end").alias("b1")).join(spans.select("record", "name", "s", "e"), "record").where("s <= b0 and b1 <= e")
    named = held.groupBy("line").agg(F.min(F.struct("s", "e", "name")).alias("s")).select("line", F.col("s.name").alias("span"))
    boxed = rows.where((F.col("layer") == "native") & F.col("audited") & ~F.col("test_card") & F.col("x0").isNotNull())
    smallest = grid.smallest_holding(
        boxed.select("page", "line", "cx", "cy", F.col("x0").alias("lx0"), F.col("x1").alias("lx1")), rectangles, ["page"], "line", F.col("cx"), F.col("cy"), 3.0, 2.0,
        (F.col("lx0") >= F.col("x0") - 3) & (F.col("lx1") <= F.col("x1") + 3), "rect_id",
    ).drop("area")
    found = rows.join(zoned, "line", "left").join(named, "line", "left").join(smallest, "line", "left")
    block = F.concat(F.lit("native-block-"), F.col("block").cast("string"))
    box = F.concat(F.lit("reviewed-"), F.concat_ws(",", *[F.col(c).cast("decimal(18,2)").cast("string") for c in ("x0", "y0", "x1", "y1")]))
    native = F.when(F.col("test_card"), F.when(F.col("cx") < CARD_MIDDLE, "card-left").otherwise("card-right")).otherwise(F.coalesce("rect_id", block))
    ocr = F.when(F.col("kind") == "reference_information", F.when(F.col("cx") < UNBOXED_MIDDLE, "unboxed-left").otherwise("unboxed-right")).otherwise("unboxed-body")
    name = F.when(F.col("zone").isNotNull(), F.col("zone")).when(F.col("span").isNotNull(), F.col("span")).when(F.col("reviewed"), box).when(F.col("layer") == "native", native).otherwise(ocr)
    return found.withColumn("group", name).drop("cx", "cy", "zone", "span", "rect_id")


def segments(named: DataFrame) -> DataFrame:
    """The lines with ``segment``: unboxed groups and card halves are cut where the gap to the line above is over 15, and on test
    cards at headings; other groups are one segment."""
    loose = F.col("group").startswith("unboxed") | F.col("group").startswith("native-unboxed") | F.col("group").startswith("card-")
    w = W.partitionBy("page", "group").orderBy(F.rint(_or_zero("y0") / 3), _or_zero("x0"), "start", "line")
    heading = F.col("test_card") & (F.trim("text").endswith(":") | (F.trim("text") == "NOTES"))
    above = F.lag("y1").over(w)
    new = loose & (F.row_number().over(w) > 1) & ((F.col("y0") - above > SEGMENT_GAP) | heading)
    cut = named.withColumn("__new", F.coalesce(new, F.lit(False)).cast("int"))
    return cut.withColumn("segment", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("__new")


def _is_heading(value: str | None) -> bool:
    return value is not None and value.isupper() and len(value) <= HEADING_LENGTH and ("TEST" in value or value in PANEL_HEADINGS)


def _adopted(parts: list[dict]) -> dict[int, int]:
    """Heading -> the group that takes it, among groups (at, x0, y0, x1, y1, value) in order. A group grows by what it takes,
    and a heading that has been taken by another heading goes where that one goes."""
    taken: dict[int, int] = {}
    for i, part in enumerate(parts):
        if not _is_heading(part["value"]):
            continue
        near = []
        for j, other in enumerate(parts):
            gap = other["y0"] - part["y1"]
            if j != i and j not in taken and 0 <= gap < HEADING_GAP and abs((part["x0"] + part["x1"]) - (other["x0"] + other["x1"])) / 2 < HEADING_SHIFT and other["x1"] - other["x0"] > PANEL_WIDTH:
                near.append((gap, j))
        if near:
            to = parts[min(near)[1]]
            taken[i] = min(near)[1]
            to |= {"x0": min(to["x0"], part["x0"]), "y0": min(to["y0"], part["y0"]), "x1": max(to["x1"], part["x1"]), "y1": max(to["y1"], part["y1"])}
            to["value"] = None if to["value"] is None else f"{part['value']} {to['value']}"
    return taken


def adopted(groups: DataFrame) -> DataFrame:
    """page, group, segment, into_group, into_segment, depth for short printed headings that the panel right below takes.

    groups: page, group, segment, seq, x0, y0, x1, y1, value (the joined text where it is short). What a heading meets starts
    less than 18 below it, so a page falls apart where that much is empty from side to side, and only the groups between
    two such gaps come together, as boxes and short texts; the rule itself goes heading by heading, since groups grow.
    """
    w = W.partitionBy("page").orderBy("y0", "y1", "group", "segment")
    reach = F.max("y1").over(w.rowsBetween(W.unboundedPreceding, -1))
    apart = groups.withColumn("__new", F.coalesce(F.col("y0") - reach >= HEADING_GAP, F.lit(True)).cast("int")).withColumn("island", F.sum("__new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    kinds = {c: groups.schema[c].dataType.simpleString() for c in ("page", "group", "segment")}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["seq", "segment"], ignore_index=True)
        boxes = pdf[["x0", "y0", "x1", "y1", "value"]].to_dict("records")
        taken = _adopted([r | {"value": r["value"] if isinstance(r["value"], str) else None} for r in boxes])
        out = []
        for i, to in taken.items():
            depth = 1
            while to in taken:
                to, depth = taken[to], depth + 1
            out.append((pdf.page[i], pdf.group[i], pdf.segment[i], pdf.group[to], pdf.segment[to], depth))
        return pd.DataFrame(out, columns=["page", "group", "segment", "into_group", "into_segment", "depth"])

    ddl = f"page {kinds['page']}, group {kinds['group']}, segment {kinds['segment']}, into_group {kinds['group']}, into_segment {kinds['segment']}, depth int"
    return apart.select("page", "island", "group", "segment", "seq", "x0", "y0", "x1", "y1", "value").groupBy("page", "island").applyInPandas(run, ddl)


def spatial_groups(lines: DataFrame, zones: DataFrame, spans: DataFrame, rectangles: DataFrame) -> DataFrame:
    """The lines with group, segment and rank (the order of the groups of a page, from 1): named, cut into segments, headings
    joined to the panel below. Groups come by their top, then name and segment."""
    cut = segments(spatial_names(lines, zones, spans, rectangles))
    totals = cut.groupBy("page", "group").agg(F.min("seq").alias("seq"))
    size = F.sum(F.length(F.trim("text")) + 1).alias("size")
    boxes = cut.groupBy("page", "group", "segment").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), size, F.count("*").alias("n"))
    brief = boxes.where(F.col("size") <= HEADING_LENGTH + 1).select("page", "group", "segment")
    item = F.struct(F.rint(_or_zero("y0") / 3).alias("y"), _or_zero("x0").alias("x"), "start", "line", F.trim("text").alias("text"))
    values = cut.join(brief, ["page", "group", "segment"]).groupBy("page", "group", "segment").agg(F.array_sort(F.collect_list(item)).alias("l"))
    values = values.select("page", "group", "segment", F.array_join(F.transform("l", lambda x: x["text"]), " ").alias("value"))
    groups = boxes.where("x0 is not null").join(totals, ["page", "group"]).join(values, ["page", "group", "segment"], "left")
    into = adopted(groups)
    moved = cut.join(into.drop("depth"), ["page", "group", "segment"], "left").withColumn("group", F.coalesce("into_group", "group")).withColumn("segment", F.coalesce("into_segment", "segment")).drop("into_group", "into_segment")
    tops = moved.groupBy("page", "group", "segment").agg(F.min(_or_zero("y0")).alias("__top"))
    ranked = tops.withColumn("rank", F.row_number().over(W.partitionBy("page").orderBy("__top", "group", "segment"))).drop("__top")
    return moved.join(ranked, ["page", "group", "segment"])


def in_figures(lines: DataFrame, figures: DataFrame, claimed: DataFrame) -> DataFrame:
    """line, figure_id of the lines (page, line, text, x0, y0, x1, y1) that are parts of a figure (page, figure_id, x0, y0, x1, y1): the
    middle lies in it, the sides at most 3 outside; of several the smallest. Blank lines, warnings and captions, lines
    without a box and claimed lines are none."""
    asked = lines.where((F.trim("text") != "") & F.col("x0").isNotNull() & ~F.col("text").rlike(PROTECTED_CAPTION)).join(claimed.select("line").distinct(), "line", "left_anti")
    points = asked.select("page", "line", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"), F.col("x0").alias("lx0"), F.col("x1").alias("lx1"))
    inside = (F.col("lx0") >= F.col("x0") - 3) & (F.col("lx1") <= F.col("x1") + 3)
    return grid.smallest_holding(points, figures, ["page"], "line", F.col("cx"), F.col("cy"), 0.0, 0.0, inside, "figure_id").drop("area")


def prose_units(lines: DataFrame) -> DataFrame:
    """page, section, kind, column, band, region, first_start, n_lines, reviews: units of a page's text, from lines (page, kind, record, layer,
    start, text, bold, x0, y0, x1, y1).

    A line belongs to the last section heading at or above its top; within a section lines are grouped into regions. Each region is a
    unit (kind prose) whose boundary is for review, and its structure too if a line of it comes from OCR; lines across
    columns or without a box are for review and no unit (kind none). A heading whose section has no lines is a unit by itself.
    """
    numbered_ = lines.withColumn("number", classify.section_number(F.col("text"), F.col("bold"))).withColumn("__y", _or_zero("y0"))
    heads = numbered_.where("number is not null").select("page", "__y", F.struct("start", F.col("number").alias("section")).alias("head"), "start", "layer")
    body = numbered_.where("number is null").drop("number")
    dated = as_of(body, heads.select("page", "__y", "head"), "page", "__y", "head").withColumn("section", F.col("last_head.section")).drop("last_head", "__y")
    whole = F.to_json(F.struct("page", "section"))
    apart = grouped(dated.select(F.struct("page", "section").alias("of"), whole.alias("page"), "kind", "record", "layer", "start", "text", "x0", "y0", "x1", "y1"))
    regions_ = apart.groupBy("of", "region").agg(F.first("column").alias("column"), F.first("band").alias("band"), F.min_by("start", "place").alias("first_start"), F.count("*").alias("n_lines"), F.bool_or(F.col("layer") == "ocr").alias("ocr"))
    alone = F.col("column").isin("cross_column", "unknown")
    reviews = F.when(alone, "CROSS_REGION_TEXT").when(F.col("ocr"), "STRUCTURE_BOUNDARY,OCR_REGION_STRUCTURE").otherwise("STRUCTURE_BOUNDARY")
    prose = regions_.select("of.page", "of.section", F.when(alone, "none").otherwise("prose").alias("kind"), "column", "band", "region", "first_start", "n_lines", reviews.alias("reviews"))
    bare = heads.select("page", "head.section", "start").join(prose.select("page", "section").where("section is not null").distinct(), ["page", "section"], "left_anti")
    none = F.lit(None).cast("string")
    single = bare.select("page", "section", F.lit("heading").alias("kind"), none.alias("column"), F.lit(None).cast("int").alias("band"), F.lit(None).cast("int").alias("region"), F.col("start").alias("first_start"), F.lit(1).cast("long").alias("n_lines"), none.alias("reviews"))
    return prose.unionByName(single)
