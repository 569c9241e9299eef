"""Text expressions. Null in, null out. All but ``question_key`` stay in the JVM."""

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CITATION = r"\[C[0-9]{6}\]"
#: Characters that bind to a neighbour: a literal that touches one of them is part of a longer token.
PROTECTED = r"\p{L}\p{N}._/+\-−±°%"


def norm(text: Column) -> Column:
    """White space of any kind becomes one space; ends are trimmed. Nothing else changes."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compact(text: Column) -> Column:
    """Lower case, ASCII letters and digits only."""
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def word_compact(text: Column) -> Column:
    """Word characters only."""
    return F.regexp_replace(text, r"(?U)[^\w]", "")


def typographic(text: Column) -> Column:
    """Curly quotes made straight, white space normalised."""
    return norm(F.translate(text, "‘’“”", "''\"\""))


def ascii_key(text: Column) -> Column:
    """Lower-cased ASCII words joined by one space; the SQL-expressible form of ``question_key``."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9_]+)"), F.lit(1)), " ")


@F.pandas_udf(T.StringType())
def question_key(text: pd.Series) -> pd.Series:
    """NFKC, case-folded words joined by one space: equality guard against reserved questions."""
    words = re.compile(r"\w+")
    return text.map(lambda t: None if t is None else " ".join(words.findall(unicodedata.normalize("NFKC", t).casefold())))


def citations(text: Column) -> Column:
    """The distinct citations, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({CITATION})"), F.lit(1)))


def strip_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def protected_pattern(literal: str) -> str:
    """A pattern that finds ``literal`` only where no protected character touches a protected edge of it."""
    edge = re.compile(r"[\w.\/+\-−±°%]")
    head = f"(?<![{PROTECTED}])" if edge.match(literal[0]) else ""
    tail = f"(?![{PROTECTED}])" if edge.match(literal[-1]) else ""
    return head + re.escape(literal) + tail


def contains_protected(text: Column, literal: str) -> Column:
    return norm(text).rlike(protected_pattern(literal))


def redact(text: Column, patterns: dict[str, str]) -> Column:
    """Each pattern's matches replaced by its name."""
    for pattern, name in patterns.items():
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return text


def fielded(fields: dict[str, Column]) -> Column:
    """``name: value`` lines; empty and null fields are left out."""
    lines = [F.when(F.coalesce(F.trim(v), F.lit("")) != "", F.concat(F.lit(f"{n}: "), F.trim(v))) for n, v in fields.items()]
    return F.array_join(F.array_compact(F.array(*lines)), "\n")


def canonical(fields: dict[str, Column]) -> Column:
    """One JSON object with sorted keys, ``: `` after keys and ``, `` between members; strings are escaped, nulls written out."""
    members = [F.concat(F.lit(f'"{n}": '), F.coalesce(F.regexp_extract(F.to_json(F.array(fields[n])), r"(?s)^\[(.*)\]$", 1), F.lit("null"))) for n in sorted(fields)]
    return F.concat(F.lit("{"), F.concat_ws(", ", *members), F.lit("}"))


def fingerprint(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON: equal for equal values under equal names, whatever their order."""
    return F.sha2(canonical(fields), 256)


def quoted(source: Column, quote: Column) -> Column:
    """Whether a quote stands in its source, white space aside; an empty quote doesn't."""
    q = norm(quote)
    return (q != "") & norm(source).contains(q)


def covers(text: Column, spans: Column) -> Column:
    """Whether all that lies outside of the spans (start, end) is blank."""
    done = F.aggregate(
        F.array_sort(spans), F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok")),
        lambda acc, s: F.struct(F.greatest(acc["at"], s["end"]).alias("at"), (acc["ok"] & ((s["start"] <= acc["at"]) | (norm(F.substring(text, acc["at"] + 1, s["start"] - acc["at"])) == ""))).alias("ok")),
    )
    return done["ok"] & (norm(F.substring(text, done["at"] + 1, F.length(text))) == "")


def splice(text: Column, patches: Column) -> Column:
    """Apply non-overlapping patches (start, end, after), 0-based and half-open: unpatched runs and replacements in order."""
    ordered = F.array_sort(patches)
    done = F.aggregate(
        ordered, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, p: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, p["start"] - acc["at"]), p["after"]).alias("out"), p["end"].alias("at")),
    )
    return F.when(F.size(patches) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def running(lengths: Column) -> Column:
    """Each number's sum with all before it, by doubling: an array that grew number by number would be copied each time."""

    def step(done: Column, k: Column) -> Column:
        shift = F.least(F.pow(F.lit(2), k).cast("int"), F.size(done))
        return F.zip_with(done, F.concat(F.array_repeat(F.lit(0), shift), F.slice(done, 1, F.size(done) - shift)), lambda x, y: x + y)

    over = lambda n: F.when(F.size(n) < 2, n).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.size(n))).cast("int")), n, step))
    return F.transform(F.array(lengths), over)[0]


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, token) for every match of ``pattern``, in order."""

    def placed(found: Column) -> Column:
        lengths = F.zip_with(found, F.slice(F.split(text, pattern), 1, F.size(found)), lambda hit, gap: F.length(hit) + F.length(gap))
        return F.zip_with(running(lengths), found, lambda end, hit: F.struct((end - F.length(hit)).alias("start"), hit.alias("token")))

    return F.transform(F.array(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))), placed)[0]


def hits(text: Column, pattern: str, after: str) -> Column:
    """Patches that replace every match of ``pattern`` by ``after``."""
    return F.transform(matches(text, pattern), lambda m: F.struct(m["start"].alias("start"), (m["start"] + F.length(m["token"])).alias("end"), F.lit(after).alias("after")))


def tiles(text: Column, spans: Column) -> Column:
    """Whether the spans (start, end) within the text hold all that isn't blank, and nothing that is. Runs without white space and
    spans are met in one order, so a long text is read once."""
    runs = F.transform(matches(text, r"(?U)\S+"), lambda m: F.struct(m["start"].cast("long").alias("at"), F.lit(0).alias("span"), (m["start"] + F.length(m["token"])).cast("long").alias("end")))
    asked = F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.struct(s["start"].cast("long").alias("at"), F.lit(1).alias("span"), s["end"].cast("long").alias("end")))
    none = F.lit(0).cast("long")

    def meet(acc: Column, x: Column) -> Column:
        run = x["span"] == 0
        ok = F.when(run, acc["held"] >= acc["end"]).otherwise((x["at"] <= acc["held"]) & (x["end"] <= acc["end"]))
        return F.struct((acc["ok"] & ok).alias("ok"), F.when(run, x["end"]).otherwise(acc["end"]).alias("end"), F.when(run, x["at"]).otherwise(F.greatest(acc["held"], x["end"])).alias("held"))

    start = F.struct(F.lit(True).alias("ok"), none.alias("end"), none.alias("held"))
    return F.aggregate(F.array_sort(F.concat(runs, asked)), start, meet, lambda acc: acc["ok"] & (acc["held"] >= acc["end"]))
