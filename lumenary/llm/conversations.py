"""Conversation structure repair by weighted finite-state composition.

Three machines are composed, arc by arc and only where a path can go. The input acceptor is the chain of a conversation's
turns. The edit transducer keeps, reroles or deletes a turn and inserts turns; its state is the number of turns inserted
since the last one read. The role grammar ``(s?(ua)+)?`` has four states. Weights are pairs of cost and label string,
ordered by cost, then by the string; labels are the edits' initials. A third insertion in a row would bring the grammar
back to a state it has left at the same turn, at a positive cost, so two are enough and the composition has no cycle: it
is relaxed in reverse topological order, from the last turn to the first, since a common label in front keeps the order
of strings.

A conversation of any length is cut into blocks of places. A block's weights form a matrix over the grammar's states
before its first and after its last turn. Insertions stand before the turn they precede, so all label strings of a block
end with its last turn and none is the beginning of another: then the order of strings also holds for what follows, and
blocks can be relaxed apart and joined, last one first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

SPACE = " \t\n\x0b\x0c\r"
#: The grammar's steps by state and role initial, and its accepting states.
GRAMMAR, ACCEPTING = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}), (0, 3)
STATES = range(len(GRAMMAR))
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
#: Places in a block, which bounds what a task holds of a conversation at once, and inserted turns in a row.
BLOCK, RUN = 4_096, 2

# the composition


@cache
def arcs(role: str, fault: str, run: int, state: int) -> tuple[tuple[int, str, bool, int, int], ...]:
    """Arcs out of the composed state (turn, run, state) before a turn with this role initial and fault (``.`` none, ``t``
    truncated, ``b`` blank, ``d`` duplicate; empty: no turn is left): cost, label, whether the turn is read, run, state."""
    edits: list[tuple[int, str, str, bool]] = []
    if fault:
        edits.append((DELETE, "D", "", True))
    if fault in (".", "t"):
        more = TRUNCATED * (fault == "t")
        edits += [(KEEP + more, "K", role, True), *((REROLE + more, "R", r, True) for r in NAMES)]
    if run < RUN:
        edits += [(INSERT, "I", r, False) for r in NAMES]
    out = []
    for cost, label, said, read in edits:
        to = GRAMMAR[state].get(said) if said else state
        if to is not None:
            out.append((cost, label, read, 0 if read else run + 1, to))
    return tuple(out)


#: A relaxed state: cost, first label, what follows, rank of its label string among the states of its layer.
Node = tuple[int, str, "Node | None", int]


def ranked(found: dict[int, tuple[int, str, Node | None]]) -> dict[int, Node]:
    """Within a layer, equal first labels lead into one layer, so strings compare as (label, rank of the rest)."""
    keys = {s: (label, rest[3] if rest else -1) for s, (_, label, rest) in found.items()}
    order = {k: i for i, k in enumerate(sorted(set(keys.values())))}
    return {s: (*found[s], order[keys[s]]) for s in found}


def relax(role: str, fault: str, after: dict[int, Node]) -> dict[int, Node]:
    """The states before a turn, from those after it."""
    layer: dict[int, Node] = {}
    for run in range(RUN, -1, -1):
        found = {}
        for state in STATES:
            best = None
            for cost, label, read, _, to in arcs(role, fault, run, state):
                rest = (after if read else layer).get(to)
                if rest is not None:
                    key = (cost + rest[0], label, rest[3])
                    if best is None or key < best[0]:
                        best = (key, rest)
            if not fault and state in ACCEPTING:  # all is read; stopping costs nothing
                best = ((0, "", -1), None)
            if best is not None:
                found[state] = (best[0][0], best[0][1], best[1])
        layer = ranked(found)
    return layer


def spelled(node: Node | None) -> str:
    out = []
    while node is not None:
        out.append(node[1])
        node = node[2]
    return "".join(out)


@lru_cache(4_096)
def matrix(roles: str, faults: str) -> tuple[tuple[int | None, ...], tuple[str | None, ...]]:
    """Costs and label strings of a block, by state before * 4 + state after; None where no path goes."""
    costs: list[int | None] = [None] * len(STATES) ** 2
    labels: list[str | None] = [None] * len(STATES) ** 2
    for end in STATES:
        layer: dict[int, Node] = {end: (0, "", None, 0)}
        for role, fault in zip(reversed(roles), reversed(faults), strict=True):
            layer = relax(role, fault, layer)
        for state, node in layer.items():
            costs[state * len(STATES) + end], labels[state * len(STATES) + end] = node[0], spelled(node)
    return tuple(costs), tuple(labels)


def joined(blocks: list[tuple[list[int | None], list[str | None]]]) -> tuple[int, str]:
    """Cost and label string of the cheapest path through all blocks, joined from the last to the first."""
    layer = relax("", "", {})
    for costs, labels in reversed(blocks):
        found = {}
        for state in STATES:
            best = None
            for to, rest in layer.items():
                cost = costs[state * len(STATES) + to]
                if cost is not None:
                    key = (cost + rest[0], labels[state * len(STATES) + to], rest[3])
                    if best is None or key < best[0]:
                        best = (key, rest)
            if best is not None:
                found[state] = (best[0][0], best[0][1], best[1])
        layer = ranked(found)
    return layer[0][0], spelled(layer[0])


class Repair:
    """Applies a label string to a conversation's turns, one by one and in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _said(self, edit: str, role: str, text: str) -> tuple[str, str, str]:
        initial = role[:1] if edit == "K" else next(r for r in GRAMMAR[self.state] if r in NAMES)
        self.state = GRAMMAR[self.state][initial]
        return edit, role if edit == "K" else NAMES[initial], text

    def take(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        """The repaired turns (edit, role, text) up to and with this one."""
        while (edit := self.audit[self.at]) == "I":
            self.at += 1
            yield self._said("I", "", "")
        self.at += 1
        if edit != "D":
            yield self._said(edit, role, text)

    def rest(self) -> Iterator[tuple[str, str, str]]:
        """The turns inserted behind the last one."""
        while self.at < len(self.audit):
            self.at += 1
            yield self._said("I", "", "")


# the tables


def plain(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; a null role or text is one space."""
    return conversations.select(*[F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")], *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that crc32 of ``conv_id:turn`` draws; nulls there are one space too."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows, draw = plain(conversations).withColumn("draw", F.crc32(key.cast("binary")) % 20), F.col("draw")
    return rows.where(draw != 0).select(
        "conv_id", "turn", F.when(draw == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(draw == 1, F.lit("")).when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(draw == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


#: The order of a conversation's turns: by turn, nulls first, then role, then the text's SHA-256; equal rows are alike.
def _order() -> list:
    return [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


def _digest():
    return F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")


def blocks(turns: DataFrame) -> DataFrame:
    """conv_id, block, roles, faults, lo, hi, turns: for each conversation and block of places the initials and faults of
    its turns as strings, the least and largest turn and the number of different ones.

    Only narrow rows are sorted: they're dealt by range over conversation, turn, role, digest and a number of their own, so
    neither a long conversation nor one row that is repeated often comes into one task.
    """
    spare = F.rtrim(F.col("text"), F.lit(SPACE))
    narrow = turns.select("conv_id", "turn", "role", _digest(), (F.length(spare) == 0).alias("blank"), (~F.right(spare, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    narrow = narrow.withColumn("number", F.monotonically_increasing_id())
    dealt = narrow.repartitionByRange(F.asc_nulls_first("conv_id"), *_order(), "number").sortWithinPartitions(F.asc_nulls_first("conv_id"), *_order(), "number")
    placed = materialize(dealt.drop("number").withColumn("place", F.monotonically_increasing_id()), "turns")
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("blank"), "b").when(F.col("first").isNull(), "d").when(F.col("truncated"), "t").otherwise(".")
    marked = placed.join(firsts, "place", "left").select(
        "conv_id", F.expr(f"place div {BLOCK}").alias("block"), F.struct("place", "turn", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("role"), fault.alias("fault")).alias("r")
    )
    grouped = marked.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("r")).alias("r"), F.min("r.turn").alias("lo"), F.max("r.turn").alias("hi"))
    return grouped.select(
        "conv_id", "block", F.array_join(F.transform("r", lambda x: x["role"]), "").alias("roles"), F.array_join(F.transform("r", lambda x: x["fault"]), "").alias("faults"), "lo", "hi",
        F.size(F.array_distinct(F.filter(F.transform("r", lambda x: x["turn"]), lambda t: t.isNotNull()))).cast("long").alias("turns"),
    )


_WEIGHED = "conv_id long, block long, ends string, lo long, hi long, turns long, blank long, duplicate long, truncated long, illegal long, costs array<int>, labels array<string>"
_AUDITED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")


def illegal(roles: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(roles, roles[1:], strict=False))


def _weigh(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = batch.to_pylist()
        for r in rows:
            roles, faults = r.pop("roles"), r.pop("faults")
            costs, labels = matrix(roles, faults)
            r |= {"ends": roles[0] + roles[-1], "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"), "illegal": illegal(roles), "costs": costs, "labels": labels}
        yield pa.RecordBatch.from_pylist(rows, schema)


def _join(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for conv, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "parts")), strict=True):
            counts = {c: sum(p[c] for p in parts) for c in _COUNTS}
            counts["illegal"] += sum(illegal(a["ends"][1] + b["ends"][0]) for a, b in zip(parts, parts[1:], strict=False))
            timed = [p for p in parts if p["lo"] is not None]
            different = sum(p["turns"] for p in timed) - sum(a["hi"] == b["lo"] for a, b in zip(timed, timed[1:], strict=False))
            cost, audit = joined([(p["costs"], p["labels"]) for p in parts])
            out.append({"conv_id": conv, "gaps": timed[-1]["hi"] - timed[0]["lo"] + 1 - different if timed else 0, **counts, "cost": cost, "audit": audit})
        yield pa.RecordBatch.from_pylist(out, schema)


def _arrow(spark, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], ddl).schema)


def audits(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit for every conversation of ``conversations``, whose
    turns are ``turns`` (its own rows unless given).

    Null ids are one conversation; a conversation without turns has zeros and an empty audit; of turns with the same number
    the order is that of role and the text's SHA-256; repeated rows are duplicates. Roles that begin with none of s, u, a
    fit nowhere as they are. Texts are only measured. An empty table gives an empty one; other columns are ignored.
    """
    spark = conversations.sparkSession
    turns = plain(conversations) if turns is None else turns
    weighed, audited = _arrow(spark, _WEIGHED), _arrow(spark, _AUDITED)
    parts = blocks(turns).mapInArrow(lambda batches: _weigh(batches, weighed), _WEIGHED)
    part = F.struct(*[c for c in parts.columns if c != "conv_id"])
    everyone = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().withColumn("part", F.lit(None).cast(parts.select(part).schema[0].dataType))
    whole = parts.select("conv_id", part.alias("part")).unionByName(everyone).groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return whole.mapInArrow(lambda batches: _join(batches, audited), _AUDITED)


def _walked(conversations: DataFrame, turns: DataFrame, each: Callable, ddl: str) -> DataFrame:
    """Passes every conversation's audit, then its turns in order, through ``each``. A conversation's texts come as a sorted
    stream behind their audit; nothing but the audit is held."""
    found = audits(conversations, turns)
    heads = found.select("conv_id", F.struct(*found.columns).alias("head"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("string").alias("text"), F.lit(None).cast("binary").alias("digest"))
    rows = turns.select("conv_id", F.lit(None).cast(heads.schema["head"].dataType).alias("head"), "turn", "role", "text", _digest())
    stream = heads.unionByName(rows).repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.col("head").isNull(), *_order())
    schema = _arrow(conversations.sparkSession, ddl)
    return stream.select("head", "role", "text").mapInArrow(lambda batches: each(batches, schema), ddl)


def _emitted(out: Iterator[dict], schema: pa.Schema, rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in out:
        held.append(row)
        if len(held) >= rows:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    yield pa.RecordBatch.from_pylist(held, schema)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict | None, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in ("head", "role", "text")), strict=True)


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, tuple[str, str, str] | None]]:
    """(head, repaired turn) in order, and (head, None) at a conversation's end."""
    head, repair = None, None
    for new, role, text in _stream(batches):
        if new is not None:
            if repair is not None:
                yield from ((head, t) for t in repair.rest())
                yield head, None
            head, repair = new, Repair(new["audit"])
        else:
            yield from ((head, t) for t in repair.take(role, text))
    if repair is not None:
        yield from ((head, t) for t in repair.rest())
        yield head, None


def _turns(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows():
        place = 0
        for head, said in _said(batches):
            if said is None:
                place = 0
                continue
            yield {"conv_id": head["conv_id"], "place": place, "edit": said[0], "role": said[1], "text": said[2]}
            place += 1

    return _emitted(rows(), schema)


def _hashes(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows():
        digest, place = hashlib.sha256(), 0
        for head, said in _said(batches):
            if said is None:
                yield head | {"repaired_sha256": digest.hexdigest()}
                digest, place = hashlib.sha256(), 0
                continue
            digest.update(("\n" * (place > 0) + said[1] + ":").encode())
            digest.update(said[2].encode())
            place += 1

    return _emitted(rows(), schema)


def repaired(conversations: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """conv_id, place, edit, role, text: the turns of every repaired conversation, numbered from 0. Deleted turns are gone,
    inserted ones have an empty text. Edge cases are those of ``audits``."""
    turns = plain(conversations) if turns is None else turns
    return _walked(conversations, turns, _turns, "conv_id long, place long, edit string, role string, text string")


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """The audits of all conversations after ``damaged``, with repaired_sha256: the hash of the repaired turns as
    ``role:text`` lines. The hash of one value is a chain, so a conversation's repaired bytes pass through one task, as a
    stream of which nothing is held. Edge cases are those of ``audits``; nulls are one space."""
    return _walked(conversations, damaged(conversations), _hashes, f"{_AUDITED}, repaired_sha256 string")
