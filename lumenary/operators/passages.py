"""Passages in texts: containment of many literals, without a join of texts."""

from collections import defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import norm
from ..sources.io import scratch

#: Literals of one pass, each with one anchor of a few words; characters of one pass of literals too short for an anchor.
PASS_ITEMS, SHORT_CHARS = 100_000, 1 << 20
#: Words of an anchor at most.
ANCHOR = 3


@F.udf(T.StructType([T.StructField("anchor", T.StringType()), T.StructField("before", T.IntegerType()), T.StructField("digest", T.BinaryType())]), useArrow=True)
def _anchor(literal: str):
    """The words of a literal, without its first and last one, which a text may have as parts of longer ones; of these the run that
    begins with the longest word. None if nothing is left."""
    words = literal.split(" ")
    inner = words[1:-1]
    if not inner:
        return None
    n = min(ANCHOR, len(inner))
    best = max(range(len(inner) - n + 1), key=lambda i: (len(inner[i]), -i))
    return " ".join(inner[best : best + n]), sum(len(w) + 1 for w in words[: best + 1]), _digest(literal)


def _digest(text: str) -> bytes:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def contained(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text") -> DataFrame:
    """doc, item for every text that holds an item's text, white space normalised on both sides; empty items are in no text.

    Texts are scanned where they are, none is shuffled, exploded or joined. The scan looks for one anchor of each literal, some
    inner words; where one is met, the piece of text that the literal would fill is compared by a digest of 16 bytes, and
    what agrees is joined with the literals and compared as it is. A pass holds at most PASS_ITEMS anchors; literals of one or
    two words are looked for as they are, a million characters a pass. With several passes each one's pairs are written
    before the next begins. Nulls hold nothing.
    """
    literals = items.select(F.col(item).alias("item"), norm(F.col(text)).alias("literal")).where("literal <> ''").withColumn("a", _anchor("literal"))
    spark = docs.sparkSession
    kinds = [docs.schema[doc].dataType.simpleString(), items.schema[item].dataType.simpleString()]
    texts = docs.select(F.col(doc).alias("doc"), norm(F.col(text)).alias("text")).where("text is not null")
    sizes = literals.agg(F.count("a.anchor").alias("anchored"), F.coalesce(F.sum(F.when(F.col("a.anchor").isNull(), F.length("literal"))), F.lit(0)).alias("short")).first()
    passes = [("anchored", i, -(-sizes.anchored // PASS_ITEMS)) for i in range(-(-sizes.anchored // PASS_ITEMS))] + [("short", i, -(-sizes.short // SHORT_CHARS)) for i in range(-(-sizes.short // SHORT_CHARS))]
    schema, out = f"{doc} {kinds[0]}, {item} {kinds[1]}", None
    path = scratch(spark, "passages") if len(passes) > 2 else ""
    for kind, i, n in passes:
        held = literals.where(F.col("a.anchor").isNotNull() if kind == "anchored" else F.col("a.anchor").isNull()).where(F.pmod(F.xxhash64("literal"), F.lit(n)) == i)
        found = _by_anchors(texts, held, kinds) if kind == "anchored" else _by_literals(texts, held, kinds)
        found = found.select(F.col("doc").alias(doc), F.col("item").alias(item))
        if path:
            found.write.mode("append").parquet(path)
        else:
            out = found if out is None else out.union(found)
    if path:
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema) if out is None else out


def _by_anchors(texts: DataFrame, literals: DataFrame, kinds: list[str]) -> DataFrame:
    anchors: dict[str, dict[str, set[tuple[int, int, bytes]]]] = defaultdict(lambda: defaultdict(set))
    for r in literals.select("a.anchor", "a.before", F.length("literal").alias("n"), F.col("a.digest").cast("binary").alias("digest")).toLocalIterator():
        anchors[r.anchor.split(" ", 1)[0]][r.anchor].add((r.before, r.n, bytes(r.digest)))
    held = {word: dict(own) for word, own in anchors.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            docs, pieces = [], []
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                words = t.split(" ")
                met, at, last = set(), 0, 0
                for i in [i for i, w in enumerate(words) if w in held]:
                    at += sum(len(w) + 1 for w in words[last:i])
                    last = i
                    for anchor, own in held[words[i]].items():
                        if t.startswith(anchor, at):
                            for before, n, digest in own:
                                piece = t[at - before : at - before + n] if at >= before else ""
                                if len(piece) == n and piece not in met and _digest(piece) == digest:
                                    met.add(piece)
                docs += [doc] * len(met)
                pieces += met
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.column("doc").type), pa.array(pieces, pa.string())], names=["doc", "literal"])

    found = texts.mapInArrow(run, f"doc {kinds[0]}, literal string").withColumn("d", F.xxhash64("literal"))
    own = literals.select(F.xxhash64("literal").alias("d"), F.col("literal").alias("whole"), "item")
    return found.join(own, "d").where("literal = whole").select("doc", "item")


def _by_literals(texts: DataFrame, literals: DataFrame, kinds: list[str]) -> DataFrame:
    held: dict[str, list] = defaultdict(list)
    for r in literals.select("literal", "item").toLocalIterator():
        held[r.literal].append(r["item"])
    names = dict(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal in names:
            automaton.add_word(literal, literal)
        automaton.make_automaton()
        for b in batches:
            docs, found = [], []
            for doc, t in zip(b.column("doc").to_pylist(), b.column("text").to_pylist()):
                met = {literal for _, literal in automaton.iter(t)}
                docs += [doc] * len(met)
                found += met
            yield pa.RecordBatch.from_arrays([pa.array(docs, b.column("doc").type), pa.array(found, pa.string())], names=["doc", "literal"])

    found = texts.mapInArrow(run, f"doc {kinds[0]}, literal string")
    return found.join(literals.select("literal", "item"), "literal").select("doc", "item")
