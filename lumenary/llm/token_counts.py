"""Edit-aware token counts: a segment tree over pre-tokens, re-encoded only where edits touch.

Byte-level merges never cross pre-tokens, so a document's count is a sum over them. The tree's leaves are
runs of pre-tokens; a node holds the sum below it. An edit re-splits the text from a few pre-tokens before
it (a pre-token's end can depend on the two characters after it) until a new boundary meets an old
one behind the edit; from there on the old pre-tokens hold again, because the splitting pattern
never looks back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts

RUN, _MEMO, _LOOK = 64, 200_000, 2
Edit = tuple[int, int, str]

#: Spans that are replaced before training text is counted: addresses, long digit runs, telephone numbers.
MASKS: list[tuple[str, str]] = [
    (r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+", "<email>"),
    (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])", "<ip>"),
    (r"\+?[0-9][0-9() -]{7,18}[0-9]", "<number>"),
]


class _Counts(dict):
    def __init__(self, encode: Callable[[str], list[int]]):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> int:
        n = len(self.encode(word))
        if len(word) <= 64:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = n
        return n


@lru_cache(maxsize=2)
def _tools(path: str | None):
    import base64

    import public_tokenizers as P
    import regex
    import tiktoken

    with open(path or P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encoding = tiktoken.Encoding("counts", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return regex.compile(P.PATTERN), _Counts(encoding.encode_ordinary), encoding


class CountTree:
    """Token counts of one text under edits. The text lives in the leaves only; ``text`` puts it together."""

    def __init__(self, text: str, path: str | None = None, words: list[tuple[str, int]] | None = None):
        self.split, self.counts, _ = _tools(path)
        self.reencoded = 0
        self._lay([(w, self.counts[w]) for w in self.split.findall(text)] if words is None else words)

    def _lay(self, words: list[tuple[str, int]]) -> None:
        """Leaves of RUN pre-tokens each; sums of tokens and characters above them."""
        self.runs = [words[i : i + RUN] for i in range(0, len(words), RUN)] or [[]]
        self.size = 1
        while self.size < len(self.runs):
            self.size *= 2
        self.tokens, self.chars = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, run in enumerate(self.runs):
            self.tokens[self.size + i], self.chars[self.size + i] = self._sums(run)
        for i in range(self.size - 1, 0, -1):
            self._pull(i)

    @staticmethod
    def _sums(run: list[tuple[str, int]]) -> tuple[int, int]:
        return sum(n for _, n in run), sum(len(w) for w, _ in run)

    def _pull(self, i: int) -> None:
        self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
        self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]

    def _put(self, leaf: int, run: list[tuple[str, int]]) -> None:
        self.runs[leaf] = run
        i = leaf + self.size
        self.tokens[i], self.chars[i] = self._sums(run)
        while i > 1:
            i //= 2
            self._pull(i)

    @property
    def total(self) -> int:
        return self.tokens[1]

    @property
    def length(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(w for run in self.runs for w, _ in run)

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one for the end), and where it starts."""
        i, start = 1, 0
        while i < self.size:
            i *= 2
            if at >= start + self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i - self.size, start

    def tokens_before(self, at: int) -> int:
        """Tokens of the pre-tokens that end at or before character ``at``."""
        leaf, start = self._leaf(at)
        i, n = leaf + self.size, 0
        while i > 1:
            n += self.tokens[i - 1] if i % 2 else 0
            i //= 2
        for w, c in self.runs[leaf]:
            start += len(w)
            if start > at:
                break
            n += c
        return n

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace characters [start, end) and return the number of pre-tokens encoded anew.

        Only the leaves around the edit are read: the pre-tokens from just before it to its end, then as many more as it
        takes until a new boundary meets an old one with enough text behind it to be sure of the split.
        """
        if not 0 <= start <= end <= self.length:
            raise ValueError("the span is outside the text")
        first, at = self._leaf(max(0, start - _LOOK - 1))
        skip = 0
        for w, _ in self.runs[first]:  # pre-tokens that end well before the edit stay
            if at + len(w) >= start - _LOOK:
                break
            at += len(w)
            skip += 1
        old: list[tuple[str, int]] = []  # pre-tokens from there on, as far as they are read
        leaf, index, read, more = first, skip, at, RUN
        while True:
            while leaf < len(self.runs) and (read < end + _LOOK or len(old) < more):
                part = self.runs[leaf][index:]
                old += part
                read += sum(len(w) for w, _ in part)
                leaf, index = leaf + 1, 0
            whole = leaf >= len(self.runs)
            window = "".join(w for w, _ in old)
            window = window[: start - at] + new + window[end - at :]
            words, kept = self._met(window, old, end - at, start - at + len(new), whole)
            if words is not None:
                break
            more = 2 * len(old)
        fresh = [(w, self.counts[w]) for w in words]
        self.reencoded += len(fresh)
        merged = self.runs[first][:skip] + fresh + old[kept:]
        for between in range(first + 1, leaf):
            self._put(between, [])
        pieces = range(0, len(merged), RUN)
        if len(pieces) <= max(1, leaf - first):  # back into the leaves that were read
            for k in range(max(1, len(pieces))):
                self._put(first + k, merged[k * RUN : (k + 1) * RUN])
        else:
            self._put(first, merged)
            if len(merged) > 16 * RUN:
                self._lay([x for run in self.runs for x in run])
        return len(fresh)

    def _met(self, window: str, old: list[tuple[str, int]], end: int, changed: int, whole: bool) -> tuple[list[str] | None, int]:
        """New pre-tokens of the window up to a boundary that is also an old one behind the edit, and the number of old ones
        that they replace; None if the window ends too soon to tell."""
        shift, words, at, i = changed - end, [], 0, 0
        for m in self.split.finditer(window):
            position = m.start()
            while i < len(old) and (at < end or at + shift < position):
                at += len(old[i][0])
                i += 1
            if position >= changed and at >= end and at + shift == position:
                return words, i
            if not whole and m.end() > len(window) - _LOOK:  # the text behind could change this split
                return None, 0
            words.append(m.group())
        return (words, len(old)) if whole else (None, 0)


def masks(text: str, patterns: list[tuple[str, str]] = MASKS) -> list[Edit]:
    """Edits that replace personal data; of overlapping spans the earliest, then the longest stays."""
    found = sorted(((m.start(), m.end(), new) for p, new in _compiled(tuple(patterns)) for m in p.finditer(text)), key=lambda e: (e[0], -e[1]))
    out: list[Edit] = []
    for e in found:
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return out


@lru_cache(maxsize=4)
def _compiled(patterns: tuple[tuple[str, str], ...]):
    return [(re.compile(p), new) for p, new in patterns]


def trees(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tree for every row, from the whole text: a table of segment trees to keep beside the documents.

    ``tree`` holds the pre-tokens' text, their ends and their counts (little-endian int32), so that editing one re-splits and
    encodes nothing but what an edit touches. A null text is an empty one.
    """
    return texts(docs).mapInArrow(_tree_rows(path), "doc_id long, n_tokens long, tree struct<text:binary,ends:binary,counts:binary>")


_TREE = pa.struct([("text", pa.binary()), ("ends", pa.binary()), ("counts", pa.binary())])


def _packed(tree: CountTree) -> dict[str, bytes]:
    words = [x for run in tree.runs for x in run]
    ends = np.cumsum([len(w) for w, _ in words], dtype="<i4")
    return {"text": tree.text.encode("utf-8", "replace"), "ends": ends.tobytes(), "counts": np.array([n for _, n in words], "<i4").tobytes()}


def _unpacked(tree: dict[str, bytes], path: str | None) -> CountTree:
    text, ends = tree["text"].decode("utf-8"), np.frombuffer(tree["ends"], "<i4").tolist()
    return CountTree("", path, [(text[a:b], n) for a, b, n in zip([0, *ends], ends, np.frombuffer(tree["counts"], "<i4").tolist())])


def _tree_rows(path: str | None):
    def run(batches):
        for b in batches:
            made = [CountTree((t.as_py() or b"").decode("utf-8", "replace"), path) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t.total for t in made], pa.int64()), pa.array(map(_packed, made), _TREE)], names=["doc_id", "n_tokens", "tree"])

    return run


def edited(kept: DataFrame, edits: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, tree, n_pretokens_reencoded: the trees of ``trees`` after edits (doc_id, start, end, new).

    A document's edits don't overlap and count characters of its text as kept; they are applied from the end. Documents
    without edits pass through in the JVM; edits without a document are ignored.
    """
    by = edits.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end", "new")), False).alias("edits"))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, tree, changes in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                t = _unpacked(tree.as_py(), path)
                for e in changes.as_py():
                    t.edit(e["start"], e["end"], e["new"])
                out.append((doc, t.total, _packed(t), t.reencoded))
            columns = list(zip(*out)) if out else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), _TREE, pa.int64()))], names=["doc_id", "n_tokens", "tree", "n_pretokens_reencoded"])

    touched = kept.join(by, "doc_id").select("doc_id", "tree", "edits").mapInArrow(run, "doc_id long, n_tokens long, tree struct<text:binary,ends:binary,counts:binary>, n_pretokens_reencoded long")
    rest = kept.join(by, "doc_id", "left_anti").select("doc_id", "n_tokens", "tree", F.lit(0).cast("long").alias("n_pretokens_reencoded"))
    return touched.unionByName(rest)


def count_edited(docs: DataFrame, edits: Callable[[str], Iterable[Edit]] = masks, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, n_edits, n_tokens_edited, n_pretokens_reencoded for every row.

    ``edits`` gives non-overlapping spans of a text with their replacements. They are applied from the end, so that
    offsets stay valid; only the touched pre-tokens are encoded again. A null or empty text has no tokens
    and is not edited. A very long text costs what its length and its edits' surroundings ask for. Repeated rows and null ids
    pass through; other columns are ignored; an empty table gives an empty result. No shuffle.
    """
    names = ["doc_id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens_reencoded"]

    def run(batches):
        for b in batches:
            out: list[list[int]] = [[], [], [], []]
            for t in b.column(1):
                text = (t.as_py() or b"").decode("utf-8", "replace")
                changes = sorted(edits(text), reverse=True)
                tree = CountTree(text, path)
                before = tree.total
                for start, end, new in changes:
                    tree.edit(start, end, new)
                after, again = tree.total, tree.reencoded
                for column, value in zip(out, (before, len(changes), after, again)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in out)], names=names)

    return texts(docs).mapInArrow(run, ", ".join(f"{n} long" for n in names))
