"""Classifiers that are priority rules: page kinds, columns, headings, reviews, anchors, labels, outcomes. All are expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading, label and document number patterns, shares of the page, anchor states, conversion factors, names.
SECTION = r"(?U)^(\d{1,2}-\d{1,3}(?:\.\d+)*[A-Za-z]?)\.\s+(.+)"
MARGIN_LABEL = r"^([123]-[0-9]+(?:\.[0-9]+)?)(?:[/-]?\(?[123]-[0-9]+(?:\.[0-9]+)?[Bb]lank\)?)?$"
DOCUMENT, CHANGE = r"(?U)^TM\s+9\s*-\s*2320\s*-\s*280\s*-\s*20\s*-\s*1$", r"^Change[12]$"
TOP_SHARE, BOTTOM_SHARE = 0.09, 0.85
ANCHOR_STATES = ("OUTSIDE_INDEX_SCOPE", "NATIVE_ANCHOR_FOUND", "TABLE_ANCHOR_FOUND", "OCR_ANCHOR_FOUND_REVIEW_REQUIRED", "ANCHOR_NOT_FOUND_REVIEW_REQUIRED")
REVIEW_CLASSES = ("CORRECTION_REGION_REQUIRES_REVIEWED_COORDINATES", "INCOMPLETE_EXACT_WORD_MAPPING", "NO_CLOSED_RECTANGLE_MATCH", "BOX_AND_UNBOXED_TEXT", "MULTIPLE_RECTANGLES", "SINGLE_RECTANGLE")
UNIT_FACTORS = {"psi_kPa": 6.894757, "in_mm": 25.4, "lb_kg": 0.45359237, "ft_m": 0.3048, "gal_L": 3.785412}
SAFE_NAME, SAFE_PATH = r"^[a-z0-9][a-z0-9-]{1,80}$", r"^(?!/)(?!.*(^|/)\.\.(/|$))[A-Za-z0-9._/-]+$"


def section_number(text: Column, bold: Column) -> Column:
    """The number of a section heading; null unless the line is numbered, has text behind, and is in capitals or bold. Capitals
    means at least one letter and none that is small."""
    line = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    found = F.regexp_extract(line, SECTION, 1)
    capitals = (F.upper(line) == line) & (F.lower(line) != line)
    return F.when((found != "") & (capitals | F.coalesce(bold, F.lit(False))), found)


def page_kind(header: Column, reviewed: Column, numbered: Column) -> Column:
    return F.when(reviewed, "reviewed_two_column").when(header.contains("DIAGNOSTIC FLOWCHART"), "diagnostic_flowchart").when(header.contains("REFERENCE INFORMATION"), "reference_information").when(numbered, "numbered_section").otherwise("other")


def column_bucket(kind: Column, x0: Column, x1: Column) -> Column:
    """The column of a line on a page of that kind; lines across columns stay apart; without a box it is unknown."""
    chart = F.when((x0 < 165) & (x1 <= 168), "left").when((x0 >= 165) & (x0 < 355) & (x1 <= 360), "centre").when(x0 >= 350, "right").otherwise("cross_column")
    two = F.when((x0 < 320) & (x1 <= 335), "left").when(x0 >= 320, "right").otherwise("wide")
    return F.when(x0.isNull(), "unknown").when(kind == "diagnostic_flowchart", chart).when(kind.isin("reference_information", "reviewed_two_column"), two).otherwise("body")


def margin_label(text: Column) -> Column:
    """A page label: white space, control characters and change marks go, then the rest has to be a label as a whole."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[\s\x00-\x1f\x7f]+", ""), "Change[12]", "")
    found = F.regexp_extract(bare, MARGIN_LABEL, 1)
    return F.when(found != "", found)


def margin_rule(text: Column, y0: Column, y1: Column, height: Column) -> Column:
    """What becomes of a line: recognized_margin if it lies in the margins (its bottom edge above 9 % of the page or its top edge below
    85 %) and is the document's number, a page label or a change mark; outer_whitespace if only blanks around it go; else null."""
    bare = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    margin = (y1 < height * TOP_SHARE) | (y0 > height * BOTTOM_SHARE)
    known = bare.rlike(DOCUMENT) | margin_label(bare).isNotNull() | F.regexp_replace(bare, r"(?U)\s+", "").rlike(CHANGE)
    return F.when(margin & known & (bare != ""), "recognized_margin").when(bare != text, "outer_whitespace")


def review_class(corrected: Column, complete: Column, boxes: Column, unboxed: Column) -> Column:
    """The state of a reference's words: whether it is a correction, whether its words are exactly its text, the number of
    rectangles they lie in and of those that lie in none."""
    names = [F.lit(c) for c in REVIEW_CLASSES]
    return F.when(corrected, names[0]).when(~complete, names[1]).when(boxes == 0, names[2]).when(unboxed > 0, names[3]).when(boxes > 1, names[4]).otherwise(names[5])


def anchor_status(in_scope: Column, anchor: Column, native: Column, table: Column, ocr: Column) -> Column:
    """Where an anchor's letters and digits are found first: outside of scope, native text, tables, OCR, or nowhere. An anchor without
    any is found nowhere."""
    from .text import compact

    a = compact(anchor)
    has = lambda t: F.coalesce((a != "") & compact(t).contains(a), F.lit(False))
    outside, in_native, in_table, in_ocr, nowhere = (F.lit(s) for s in ANCHOR_STATES)
    return F.when(~in_scope, outside).when(has(native), in_native).when(has(table), in_table).when(has(ocr), in_ocr).otherwise(nowhere)


def run_status(rows: Column, expected: Column, errors: Column) -> Column:
    return F.when(rows == 0, "NOT_RUN").when(rows < expected, "PARTIAL").when(errors > 0, "COMPLETED_WITH_EVAL_ERRORS").otherwise("COMPLETED")


def outcome(done: Column, response: Column, error: Column) -> Column:
    """What became of a request: OK only if done and not blank."""
    blank = F.trim(F.coalesce(response, F.lit(""))) == ""
    return F.when(error == "timeout", "GEN_TIMEOUT").when(error.isNotNull(), "GEN_ERROR").when(done & ~blank, "OK").otherwise("GEN_EMPTY")


def convert(value: Column, unit: Column) -> Column:
    """Value times the unit pair's fixed factor; null for an unknown pair."""
    return F.coalesce(*[F.when(unit == u, value * f) for u, f in UNIT_FACTORS.items()])


def budget(tokens: Column, reserved: int, context: int) -> Column:
    """OK, or the error that the input and the reserved output exceed the context; nothing is ever cut."""
    return F.when(tokens + reserved > context, "INPUT_EXCEEDS_CONTEXT").when(tokens == 0, "EMPTY_QUESTION").otherwise("OK")


def ocr_wanted(image: Column, invalid: Column, drawings: Column, native_chars: Column, cached: Column) -> Column:
    return image | invalid | (drawings & (native_chars < 350)) | cached
