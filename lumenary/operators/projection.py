"""Texts rebuilt from references to their sources, and what such a projection gets wrong."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters in a block of a record's text. References meet blocks, so no text is copied once for each reference to it.
BLOCK = 4_096
#: Characters of a digest; shorter lines stand for themselves.
DIGEST = 44


def short(text: Column) -> Column:
    """The text with its SHA-256 in base 64 for each line that is as long as that or longer. Short forms are equal where texts are and
    are never longer; that of texts joined by line ends is theirs, joined alike."""
    return F.array_join(F.transform(F.split(text, "\n"), lambda x: F.when(F.length(x) < DIGEST, x).otherwise(F.base64(F.unhex(F.sha2(x, 256))))), "\n")


def _found(refs: DataFrame, records: DataFrame, ref: str, record: str, form: Callable[[Column], Column]) -> DataFrame:
    """The references with ``exact``, the form of what they name, empty if there is nothing. One within a block takes it from the join
    as it is; only those over several are put together by ``ref``."""
    pieces = records.where(F.col("text") != "").select(record, F.posexplode_outer(F.regexp_extract_all("text", F.lit(f"(?s)(.{{1,{BLOCK}}})"), F.lit(1))).alias("__k", "__piece"))
    asked = refs.withColumn("__k", F.expr(f"cast(greatest(start, 0) div {BLOCK} as int)")).withColumn("__last", F.expr(f"cast(coalesce(end - 1, 0) div {BLOCK} as int)"))
    at = F.col("__k") * BLOCK
    lo, hi = F.greatest(F.col("start"), at) - at, F.least(F.col("end"), at + BLOCK) - at
    piece = F.when(F.col("end") > F.greatest(F.col("start"), F.lit(0)), F.substring(F.col("__piece"), (lo + 1).cast("int"), (hi - lo).cast("int")))
    one = asked.where("__k >= __last").join(pieces, [record, "__k"], "left").select(*refs.columns, F.coalesce(form(piece), F.lit("")).alias("exact"))
    more = asked.where("__k < __last")
    parts = more.select(ref, record, "start", "end", F.explode(F.sequence("__k", "__last")).alias("__k")).join(pieces, [record, "__k"]).select(ref, "__k", piece.alias("__piece"))
    whole = parts.groupBy(ref).agg(F.array_sort(F.collect_list(F.struct("__k", "__piece"))).alias("p")).select(ref, form(F.array_join(F.transform("p", lambda x: x["__piece"]), "")).alias("__text"))
    return one.unionByName(more.join(whole, ref, "left").select(*refs.columns, F.coalesce("__text", F.lit("")).alias("exact")))


def exact(refs: DataFrame, records: DataFrame, ref: str, record: str) -> DataFrame:
    """ref, exact: the text[start:end] that each reference (ref, record, start, end) names in records (record, text). What lies
    beyond the text is left out; a record that isn't there gives null."""
    there = records.select(record, F.lit(True).alias("__there")).distinct()
    return _found(refs.select(ref, record, "start", "end"), records, ref, record, lambda x: x).join(there, record, "left").select(ref, F.when(F.col("__there"), F.col("exact")).alias("exact"))


def errors(units: DataFrame, refs: DataFrame, records: DataFrame, middle: float = 320.0) -> DataFrame:
    """unit, code, n: what is wrong with each unit (unit, seq, page, half, text) that stands for its references
    (ref, unit, place, record, start, end, text, x0, x1) to records (record, page, text).

    duplicated_source_span: the same span was used before, in this unit or an earlier one; wrong_source_page: the record's
    page is another; altered_source_text: the reference's text isn't the record's; cross_column_mixing: its middle lies
    outside of the unit's half; missing_record; and unrecorded_projection_change, once, if the unit's text isn't that
    of its references, in order of place, joined by line ends. Every repeated span is found from its first use, so spans that
    are used often are only compared with that one.

    Only the records' texts are shuffled, once; references, what they name and units are compared by their short forms. A
    reference that names nothing is told from a missing record by the record's length, beside all that needs no text.
    """
    place, start = F.struct("seq", "place", "ref"), F.greatest(F.col("start"), F.lit(0))
    rows = refs.select("ref", "unit", "place", "record", "start", "end", ((F.col("x0") + F.col("x1")) / 2).alias("middle"), (F.col("text") != "").alias("says"))
    rows = rows.join(units.select("unit", "seq", F.col("page").alias("unit_page"), "half"), "unit")
    span = ["record", "start", "end"]
    again = rows.groupBy(*span).agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    there = records.select("record", F.col("page").alias("record_page"), F.coalesce(F.length("text"), F.lit(0)).alias("length"))
    held = rows.join(again, span, "left").join(there, "record", "left")
    names = F.coalesce((F.col("end") > start) & (F.col("length") > start), F.lit(False))
    found = {
        "duplicated_source_span": place != F.col("first"), "wrong_source_page": F.col("record_page") != F.col("unit_page"), "altered_source_text": F.col("length").isNotNull() & ~names & F.col("says"),
        "cross_column_mixing": ((F.col("half") == "left") & (F.col("middle") >= middle)) | ((F.col("half") == "right") & (F.col("middle") < middle)), "missing_record": F.col("length").isNull(),
    }
    codes = held.select("unit", F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in found.items()]))).alias("code"), F.lit(1).cast("long").alias("n"))
    named = _found(refs.select("ref", "unit", "place", "record", "start", "end", short(F.col("text")).alias("text")), records, "ref", "record", short)
    lines = named.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("place", "ref", "exact"))).alias("l"), F.count_if((F.col("exact") != "") & (F.col("exact") != F.col("text"))).alias("altered"))
    lines = lines.select("unit", "altered", F.array_join(F.transform("l", lambda x: x["exact"]), "\n").alias("rebuilt"))
    both = units.select("unit", short(F.col("text")).alias("text")).join(lines, "unit", "left")
    changed = F.when(F.col("text") != F.coalesce("rebuilt", F.lit("")), F.struct(F.lit("unrecorded_projection_change").alias("code"), F.lit(1).cast("long").alias("n")))
    altered = F.when(F.col("altered") > 0, F.struct(F.lit("altered_source_text").alias("code"), F.col("altered").alias("n")))
    texts = both.select("unit", F.inline(F.array_compact(F.array(changed, altered))))
    return codes.unionByName(texts).groupBy("unit", "code").agg(F.sum("n").alias("n"))
