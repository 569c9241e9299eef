"""Choice between layers of a page by witnesses: literal proofs that one piece of text stands in others."""

import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.io import cut_lineage
from . import closure, grid, layout, ledger

# How far two boxes have to overlap to be compared, and the least length of a text that proves the reverse.
ACROSS, DOWN, LEAST_REVERSE = 0.45, 0.5, 4
_WORD = re.compile(r"\S+")
_EDGE = re.compile(r"[^\W_]|[._/+\-−±°%]")


def _normal(text: str) -> str:
    """White space as single spaces, trimmed."""
    return " ".join(text.split())


def _places(text: str, *at: int) -> list[int]:
    """Where these characters of the normal text, no spaces, stand in the text; its words are only looked up where a text was found."""
    starts, here = [], 0
    for word in _WORD.finditer(text):
        starts.append((here, word.start()))
        here += word.end() - word.start() + 1
    held = [starts[bisect_right(starts, i, key=lambda s: s[0]) - 1] for i in at]
    return [begin + i - first for i, (first, begin) in zip(at, held)]


def _joins(one: str, other: str) -> bool:
    """Whether two neighbours belong to one word or value, so that no text may end between them."""
    return bool(_EDGE.match(one) and _EDGE.match(other))


def find(wanted: str, targets: list[tuple[str, int, str, str, str]]) -> list[tuple[str, int, int]] | None:
    """The parts (record, start, end) of the targets, joined in their order by line ends, in which the text stands, white space
    aside; None if it does nowhere. No word or value is cut, neither in the joined text nor in the records.

    A target is (record, start, text, the record's character before it, the one behind it)."""
    wanted = _normal(wanted)
    if not wanted:
        return None
    joined, ends = "\n".join(t[2] for t in targets), []
    actual = _normal(joined)
    at = actual.find(wanted)
    if at < 0:
        return None
    for t in targets:
        begin = ends[-1][1] + 1 if ends else 0
        ends.append((begin, begin + len(t[2])))
    while at >= 0:
        end = at + len(wanted)
        if not (at and _joins(actual[at - 1], wanted[0]) or end < len(actual) and _joins(wanted[-1], actual[end])):
            lo, last = _places(joined, at, end - 1)
            hi = last + 1
            parts = [(t, max(lo, a) - a, min(hi, b) - a) for t, (a, b) in zip(targets, ends) if max(lo, a) < min(hi, b)]
            if all(not _cuts(t, a, b) for t, a, b in parts) and _normal(" ".join(t[2][a:b] for t, a, b in parts)) == wanted:
                return [(t[0], t[1] + a, t[1] + b) for t, a, b in parts]
        at = actual.find(wanted, at + 1)
    return None


def _cuts(target: tuple[str, int, str, str, str], a: int, b: int) -> bool:
    text = target[2]
    before, behind = text[a - 1] if a else target[3], text[b] if b < len(text) else target[4]
    return bool(before and _joins(before, text[a]) or behind and _joins(text[b - 1], behind))


def first_found(wanted: str, near: list[dict]) -> list[tuple[str, int, int]] | None:
    """A witness in one target, then in all of them from top to bottom, then from left to right."""
    as_target = lambda n: (n["record"], n["start"], n["text"], n["before"], n["behind"])
    near = sorted(near, key=lambda n: (n["record"], n["start"]))
    for n in near:
        if found := find(wanted, [as_target(n)]):
            return found
    for order in (("y0", "x0"), ("x0", "y0")):
        if len(near) > 1 and (found := find(wanted, [as_target(n) for n in sorted(near, key=lambda n: (*(n[c] for c in order), n["start"]))])):
            return found
    return None


_PARTS = "array<struct<record: string, start: long, end: long>>"


def _witnessed(rows: DataFrame) -> DataFrame:
    """ref, found, reverse from (ref, text, near): the witness of each piece among its neighbours, and those of the neighbours
    that stand in it themselves (null unless all that may be asked do)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    ddl = f"ref string, found {_PARTS}, reverse array<struct<ref: string, parts: {_PARTS}>>"
    schema = to_arrow_schema(rows.sparkSession.createDataFrame([], ddl).schema)
    parts = lambda found: [dict(zip(("record", "start", "end"), p)) for p in found]

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                found, reverse = first_found(r["text"], r["near"]), []
                own = (r["record"], r["start"], r["text"], r["before"], r["behind"])
                for n in r["near"] if not found else []:
                    back = find(n["text"], [own]) if n["may"] and len(_normal(n["text"])) >= LEAST_REVERSE else None
                    reverse.append(back and {"ref": n["ref"], "parts": parts(back)})
                out.append({"ref": r["ref"], "found": found and parts(found), "reverse": reverse if reverse and all(reverse) else None})
            yield pa.RecordBatch.from_pylist(out, schema)

    return rows.select("ref", "record", "start", "text", "before", "behind", "near").mapInArrow(run, ddl)


def _near(sources: DataFrame, targets: DataFrame) -> DataFrame:
    """The sources with ``near``: the targets of other records whose boxes overlap enough."""
    box = ["x0", "y0", "x1", "y1"]
    pairs = grid.overlapping(sources.select("page", F.col("ref").alias("a"), F.col("record").alias("a_record"), *[F.col(c).alias(f"a{c}") for c in box]), targets.select("page", F.col("ref").alias("b"), F.col("record").alias("b_record"), *[F.col(c).alias(f"b{c}") for c in box]), ["page"], ACROSS, DOWN)
    pairs = pairs.where("a_record <> b_record").select(F.col("a").alias("ref"), F.col("b").alias("other"))
    item = F.struct(F.col("ref"), "record", "start", "text", "before", "behind", "x0", "y0", "may")
    near = pairs.join(targets.withColumn("may", targets["may"] if "may" in targets.columns else F.lit(False)).select(F.col("ref").alias("other"), item.alias("n")), "other").groupBy("ref").agg(F.collect_list("n").alias("near"))
    return sources.join(near, "ref", "left")


def _within(pieces: DataFrame, spans: DataFrame) -> DataFrame:
    """ref of the pieces that a span (record, start, end) holds whole."""
    outer = spans.select("record", F.col("start").alias("a0"), F.col("end").alias("a1"))
    return layout.contain_join(outer, pieces.select("record", "ref", F.col("start").alias("b0"), F.col("end").alias("b1")), ["record"], 1_000)


def select(pieces: DataFrame, claims: DataFrame, represented: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pieces with outcome, proofs): which layer's pieces are chosen, which stand for others, and which need review.

    pieces: ref, page, layer (native, ocr), record, start, end, text, before, behind, x0, y0, x1, y1; claims: the same without
    layer, text already used elsewhere; represented: record, start, end; decisions: record, start, end, state, reason.
    proofs: ref, reason, parts.

    By priority: BLANK, CLAIMED (a claim holds it), REPRESENTED, a decision's state, SELECTION_CONFLICT where decisions differ,
    REPRESENTED_BY_STRUCTURED_SOURCE with a witness among claims that overlap it. Then of OCR pieces: SELECTED if preferred or
    if no native piece overlaps; EXACT_ALTERNATIVE_TEXT with a witness among those; SELECTED_WITH_FRAGMENTS if all of them
    stand in it, none being claimed or represented, also by an OCR piece before it: those become
    NATIVE_FRAGMENT_IN_IMAGE_TEXT; else UNALIGNED_OVERLAPPING_OCR, for review. Native pieces that are left are SELECTED.
    """
    decided = ledger.decide(_within(pieces, decisions).join(decisions.select("record", F.col("start").alias("a0"), F.col("end").alias("a1"), "state", "reason").distinct(), ["record", "a0", "a1"]).select("ref", "state", "reason"), "ref")
    flag = lambda spans, name: _within(pieces, spans).select("ref", F.lit(True).alias(name)).distinct()
    rows = pieces.join(flag(claims, "claimed"), "ref", "left").join(flag(represented, "represented"), "ref", "left").join(decided.select("ref", "state"), "ref", "left")
    blank = tx.norm(F.col("text")) == ""
    early = F.when(blank, "BLANK").when(F.col("claimed"), "CLAIMED").when(F.col("represented"), "REPRESENTED").when(F.col("state") == "NEEDS_REVIEW", "SELECTION_CONFLICT").when(F.col("state") != "PREFERRED", F.col("state"))
    rows = cut_lineage(rows.withColumn("outcome", early).withColumn("preferred", F.coalesce(F.col("state") == "PREFERRED", F.lit(False))))
    open_ = rows.where("outcome is null")
    used = claims.withColumn("may", F.lit(False)).dropDuplicates(["record", "start", "end"])
    by_claim = cut_lineage(_witnessed(_near(open_, used).where("near is not null")).where("found is not null").select("ref", F.lit("REPRESENTED_BY_STRUCTURED_SOURCE").alias("reason"), F.col("found").alias("parts")))
    left = open_.join(by_claim, "ref", "left_anti")
    natives = rows.where((F.col("layer") == "native") & ~blank).join(by_claim.select("ref", F.lit(True).alias("proved")), "ref", "left")
    natives = natives.withColumn("may", F.coalesce(~F.col("claimed"), F.lit(True)) & F.coalesce(~F.col("represented"), F.lit(True)) & F.col("proved").isNull())
    ocr = _near(left.where("layer = 'ocr' and not preferred"), natives)
    alone = ocr.where("near is null").select("ref")
    asked = cut_lineage(_witnessed(ocr.where("near is not null")))
    exact = asked.where("found is not null").select("ref", F.lit("EXACT_ALTERNATIVE_TEXT").alias("reason"), F.col("found").alias("parts"))
    order = rows.select("ref", F.struct("page", "record", "start").alias("place"))
    backed = asked.where("found is null and reverse is not null").select("ref", F.explode("reverse").alias("r")).select("ref", F.col("r.ref").alias("item"), F.col("r.parts").alias("parts"))
    served = cut_lineage(closure.first_come(backed.select("ref", "item").join(order, "ref")))
    fragments = backed.join(served, "ref", "left_semi").select(F.col("item").alias("ref"), F.lit("NATIVE_FRAGMENT_IN_IMAGE_TEXT").alias("reason"), "parts")
    proofs = by_claim.unionByName(exact).unionByName(fragments)
    named = lambda df, name: df.select("ref", F.lit(name).alias("late"))
    unaligned = asked.where("found is null").join(served, "ref", "left_anti")
    late = proofs.select("ref", F.col("reason").alias("late")).unionByName(named(served, "SELECTED_WITH_FRAGMENTS")).unionByName(named(unaligned, "UNALIGNED_OVERLAPPING_OCR")).unionByName(named(alone, "SELECTED"))
    done = rows.join(late, "ref", "left").withColumn("outcome", F.coalesce("outcome", "late", F.lit("SELECTED"))).drop("late", "claimed", "represented", "state", "preferred")
    return done, proofs
