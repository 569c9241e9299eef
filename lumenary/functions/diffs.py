"""Text comparisons that need a search: similarity, opcodes, minimal change, quote repair. Arrow batches."""

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio; null if either is null."""
    return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y, autojunk=False).ratio() for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end_before", "end_after")]))
def changed_span(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The smallest span that differs: common prefix and suffix trimmed."""

    def span(x: str, y: str) -> tuple[int, int, int]:
        n = min(len(x), len(y))
        head = next((i for i in range(n) if x[i] != y[i]), n)
        tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
        return head, len(x) - tail, len(y) - tail

    return pd.DataFrame([span(x or "", y or "") for x, y in zip(a, b)], columns=["start", "end_before", "end_after"])


@F.pandas_udf(T.StringType())
def repaired_quote(quotes: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """A quote as its source has it, white space normalised on both sides: unchanged if it is there; else the shortest, then
    earliest span of the source that holds all the quote's lines in order and is at most 4 * length + 100 long, provided
    that two of the lines have 12 characters or more. Null if there is none."""
    for quote, source in quotes:
        yield pd.Series([_repair(q, s) for q, s in zip(quote, source)], dtype="object")


def _repair(quote: str | None, source: str | None) -> str | None:
    if quote is None or source is None:
        return None
    text, whole = " ".join(source.split()), " ".join(quote.split())
    if whole and whole in text:
        return quote
    lines = [line for line in (" ".join(x.split()) for x in quote.splitlines()) if line]
    if sum(len(line) >= 12 for line in lines) < 2:
        return None
    best, at = None, text.find(lines[0])
    while at >= 0:
        end = at
        for line in lines:
            found = text.find(line, end)
            if found < 0:
                return best
            end = found + len(line)
        if end - at <= 4 * len(whole) + 100 and (best is None or end - at < len(best)):
            best = text[at:end]
        at = text.find(lines[0], at + 1)
    return best


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), *[T.StructField(n, T.ArrayType(T.IntegerType())) for n in ("starts", "ends")]]))
def norm_positions(text: pd.Series) -> pd.DataFrame:
    """White space normalised text and, for each of its characters, where in the original it starts and ends; a space stands
    for a whole run of white space."""

    def one(t: str | None) -> tuple[str | None, list[int] | None, list[int] | None]:
        if t is None:
            return None, None, None
        out, starts, ends = [], [], []
        for i, c in enumerate(t):
            if not c.isspace():
                out.append(c)
                starts.append(i)
                ends.append(i + 1)
            elif out and out[-1] == " ":
                ends[-1] = i + 1
            elif out:
                out.append(" ")
                starts.append(i)
                ends.append(i + 1)
        if out and out[-1] == " ":
            del out[-1], starts[-1], ends[-1]
        return "".join(out), starts, ends

    return pd.DataFrame([one(t) for t in text], columns=["text", "starts", "ends"])


@udtf(returnType="tag string, a_start int, a_end int, b_start int, b_end int")
class Opcodes:
    """Rows of the edit script between two texts, equal parts left out."""

    def eval(self, a: str, b: str):
        for tag, i, j, k, m in difflib.SequenceMatcher(None, a or "", b or "", autojunk=False).get_opcodes():
            if tag != "equal":
                yield tag, i, j, k, m
