"""Corpus build: offset runs, references, units, chunks and their maps."""

from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from ..functions.text import covers
from .intervals import as_of, overlap_join


def runs(records: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """key, c0, c1, r0, r1, patch: how corrected text [c0, c1) comes from raw text [r0, r1); patch is null where nothing changed.

    Records are (key, length of the raw text), patches (key, id, start, end, after). Each patch gives the run before
    it and its own; one more goes to the end. Empty runs are left out, but for patches that insert nothing.
    """
    w = W.partitionBy(key).orderBy("start")
    p = patches.select(key, F.col("id").alias("patch"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.length("after").cast("long").alias("size"))
    p = p.withColumn("from", F.coalesce(F.lag("end").over(w), F.lit(0).cast("long")))
    p = p.withColumn("shift", F.coalesce(F.sum(F.col("size") - (F.col("end") - F.col("start"))).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")))
    none = F.lit(None).cast(patches.schema["id"].dataType)
    kept = p.select(key, (F.col("from") + F.col("shift")).alias("c0"), (F.col("start") + F.col("shift")).alias("c1"), F.col("from").alias("r0"), F.col("start").alias("r1"), none.alias("patch"))
    own = p.select(key, (F.col("start") + F.col("shift")).alias("c0"), (F.col("start") + F.col("shift") + F.col("size")).alias("c1"), F.col("start").alias("r0"), F.col("end").alias("r1"), "patch")
    last = p.groupBy(key).agg(F.max("end").alias("r0"), F.sum(F.col("size") - (F.col("end") - F.col("start"))).alias("shift"))
    tail = records.join(last, key, "left").select(key, F.coalesce("r0", F.lit(0).cast("long")).alias("r0"), F.coalesce("shift", F.lit(0).cast("long")).alias("shift"), F.col("length").cast("long").alias("r1"))
    tail = tail.select(key, (F.col("r0") + F.col("shift")).alias("c0"), (F.col("r1") + F.col("shift")).alias("c1"), "r0", "r1", none.alias("patch"))
    return kept.unionByName(tail).where("r1 > r0").unionByName(own)


def raw_spans(refs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """ref, raw0, raw1, n_patches, precision: the raw text that references (ref, key, s, e) to corrected text come from. A
    corrected run counts whole, an unchanged one as far as it is referred to."""
    both = refs.join(found, key).where("greatest(s, c0) < least(e, c1)")
    lo = F.when(F.col("patch").isNotNull(), F.col("r0")).otherwise(F.col("r0") + F.greatest(F.lit(0), F.col("s") - F.col("c0")))
    hi = F.when(F.col("patch").isNotNull(), F.col("r1")).otherwise(F.col("r0") + F.least(F.col("e"), F.col("c1")) - F.col("c0"))
    rows = both.groupBy("ref").agg(F.min(lo).alias("raw0"), F.max(hi).alias("raw1"), F.count("patch").alias("n_patches"))
    return rows.withColumn("precision", F.when(F.col("n_patches") > 0, "correction_region").otherwise("line_or_cell"))


def resolved(refs: DataFrame, found: DataFrame, lines: DataFrame, regions: DataFrame, words: DataFrame, key: str, width: int = 1_000) -> DataFrame:
    """ref, precision, n_patches, n_blocks, boxes, box: where references (ref, key, s, e, text) to corrected text are on their page.

    found: runs; lines: key, r0, r1 in raw text, x0, y0, x1, y1, block; regions and words: key, start, end in corrected text and a box.
    Regions that were reviewed count if all that lies outside of them is blank, else words whose coordinates are known if
    that holds for them, else the lines that the raw text touches: correction_region if a correction is among it, line_or_cell if
    not. boxes are distinct, in order of y0, x0, y1, x1; box is the one around all, null without any.
    """
    sides = ["x0", "y0", "x1", "y1"]
    place = F.struct("y0", "x0", "y1", "x1").alias("b")
    both = refs.join(found.withColumnsRenamed({"r0": "__r0", "r1": "__r1"}), key).where("greatest(s, c0) < least(e, c1)")
    kept = F.col("patch").isNotNull()
    raw = both.select(key, "ref", "patch", F.when(kept, F.col("__r0")).otherwise(F.col("__r0") + F.greatest(F.lit(0), F.col("s") - F.col("c0"))).alias("a0"), F.when(kept, F.col("__r1")).otherwise(F.col("__r0") + F.least(F.col("e"), F.col("c1")) - F.col("c0")).alias("a1"))
    patched = raw.groupBy("ref").agg(F.count("patch").alias("n_patches"))
    touched = overlap_join(raw.select(key, "ref", "a0", "a1"), lines.select(key, F.col("r0").alias("b0"), F.col("r1").alias("b1"), *sides, "block"), [key], width)
    by_line = touched.groupBy("ref").agg(F.array_sort(F.collect_set(F.when(F.col("x0").isNotNull(), place))).alias("line_boxes"), F.countDistinct("block").alias("n_blocks"))

    def within(spans: DataFrame, name: str) -> DataFrame:
        met = overlap_join(refs.select(key, "ref", F.col("s").alias("a0"), F.col("e").alias("a1")), spans.select(key, F.col("start").alias("b0"), F.col("end").alias("b1"), *sides), [key], width)
        own = F.struct((F.greatest("a0", "b0") - F.col("a0")).cast("int").alias("start"), (F.least("a1", "b1") - F.col("a0")).cast("int").alias("end"))
        return met.groupBy("ref").agg(F.collect_list(own).alias(f"{name}_spans"), F.array_sort(F.collect_set(place)).alias(f"{name}_boxes"))

    rows = refs.select("ref", "text").join(patched, "ref", "left").join(by_line, "ref", "left").join(within(regions, "region"), "ref", "left").join(within(words, "word"), "ref", "left")
    whole = lambda name: F.coalesce(covers(F.col("text"), F.col(f"{name}_spans")), F.lit(False))
    tiers = [(whole("region"), "reviewed_pdf_region", "region"), (whole("word"), "frozen_word_coordinates", "word"), (F.col("n_patches") > 0, "correction_region", "line"), (F.lit(True), "line_or_cell", "line")]
    first = lambda value: F.coalesce(*[F.when(c, value(name, kind)) for c, name, kind in tiers])
    placed = rows.withColumn("precision", first(lambda name, kind: F.lit(name))).withColumn("boxes", first(lambda name, kind: F.coalesce(f"{kind}_boxes", F.array().cast(rows.schema["line_boxes"].dataType))))
    end = lambda f, c: f(F.transform("boxes", lambda b: b[c]))
    box = F.when(F.size("boxes") > 0, F.struct(end(F.array_min, "x0").alias("x0"), end(F.array_min, "y0").alias("y0"), end(F.array_max, "x1").alias("x1"), end(F.array_max, "y1").alias("y1")))
    return placed.select("ref", "precision", F.coalesce("n_patches", F.lit(0)).alias("n_patches"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), "boxes", box.alias("box"))


def migrated(points: DataFrame, patches: DataFrame, key: str, at: str) -> DataFrame:
    """The points with ``moved``: where a raw position comes to lie once all patches that end at or before it are applied."""
    w = W.partitionBy(key).orderBy("end").rowsBetween(W.unboundedPreceding, 0)
    delta = F.sum(F.length("after") - (F.col("end") - F.col("start"))).over(w).cast("long")
    facts = patches.select(key, F.col("end").cast("long").alias(at), delta.alias("delta"))
    return as_of(points, facts, key, at, "delta").withColumn("moved", F.col(at) + F.coalesce("last_delta", F.lit(0))).drop("last_delta")


def sliced(parts: DataFrame, start: Column, end: Column, offset: Column) -> DataFrame:
    """Parts (start, end, text) cut to a window and re-based: out0, out1, piece."""
    a, b = F.greatest(start, F.col("start")), F.least(end, F.col("end"))
    rows = parts.withColumn("__a", a).withColumn("__b", b).where("__a < __b")
    piece = F.expr("substring(text, cast(__a - start + 1 as int), cast(__b - __a as int))")
    return rows.withColumn("out0", offset + F.col("__a") - start).withColumn("out1", offset + F.col("__b") - start).withColumn("piece", piece).drop("__a", "__b")


def units(parts: DataFrame, unit: str) -> DataFrame:
    """unit, body, n_parts, pages, first_page: a unit's parts (page, y, start, text) in reading order; blank units have no row."""
    item = F.struct("page", "y", "start", "text")
    rows = parts.groupBy(unit).agg(F.array_sort(F.collect_list(item)).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["text"]), "\n")
    pages = F.array_join(F.array_sort(F.array_distinct(F.transform("p", lambda x: x["page"]))), ",")
    return rows.select(unit, body.alias("body"), F.size("p").cast("long").alias("n_parts"), pages.alias("pages"), F.col("p")[0]["page"].alias("first_page")).where(F.trim("body") != "")


def selected(pieces: DataFrame) -> DataFrame:
    """pieces (claimed, represented, decision, native, witness) with ``choice``: what becomes of each, by priority."""
    d = F.col("decision")
    choice = (
        F.when(F.col("claimed"), "CLAIMED").when(F.col("represented"), "REPRESENTED").when(d.isNotNull() & ~d.isin("PREFERRED"), d).when(d == "PREFERRED", "SELECTED")
        .when(F.col("native"), "SELECTED").when(F.col("witness"), "REPRESENTED").otherwise("SELECTED")
    )
    return pieces.withColumn("choice", choice)
