"""Language identification by cross-parsing entropy.

Per language, a suffix automaton of labelled text recognises all its factors. A text is parsed greedily
into the longest phrases that the automaton accepts; the language that needs the fewest phrases a
letter wins. All letters and marks of all scripts count; an automaton's transitions are kept in a hash
table, so its size follows its sample and not the alphabet.

The parse is that of the whole text, yet a batch is parsed in blocks side by side: each block is first parsed
as if a phrase began with it, then, from the state in which the block before it really ends, again until both
parses are in the same state, from where on they are one. Two greedy parses meet after a few phrases.
"""

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from .common import remainder

#: The labelled sample: languages at most (the commonest), and a language's characters and documents, and the longest document taken.
LANGUAGES, SAMPLE_CHARS, SAMPLE_DOCS, SAMPLE_LONGEST = 128, 24_000, 64, 20_000
BLOCK, PORTION, DENSE, FOLDS = 256, 4_000_000, 1 << 23, 5
#: A text is foreign if its phrases, less EVIDENCE standard deviations of their count, exceed the winner's limit a letter.
EVIDENCE = 1.5
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: (language, sample text, limit of phrases a letter)
Sample = tuple[tuple[str, str, float], ...]


def suffix_automaton(codes: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the automaton of all factors of ``codes``, a dictionary a state; 0 is the root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes.tolist():
        cur, p = len(nxt), last
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Transitions:
    """An automaton's edges, which whole arrays of (state, code) are looked up in: in a full table while that has at most
    DENSE cells, as it does for alphabets, else in an open hash table. ``local`` maps codes to the automaton's own."""

    def __init__(self, automaton: list[dict[int, int]], codes: int):
        own = sorted({c for out in automaton for c in out})
        width = len(own) + 1  # 0: any code that the automaton doesn't know
        self.local = np.zeros(codes, np.int32)
        self.local[own] = np.arange(1, width)
        automaton = [{int(self.local[c]): t for c, t in out.items()} for out in automaton]
        self.width, self.root = np.int64(width), np.zeros(width, np.int32)
        for c, t in automaton[0].items():
            self.root[c] = t
        self.dense = None
        if len(automaton) * width <= DENSE:
            self.dense = np.zeros((len(automaton), width), np.int32)
            for s, out in enumerate(automaton):
                for c, t in out.items():
                    self.dense[s, c] = t
            self.dense = self.dense.ravel()
            return
        edges = [(s * width + c, t) for s, out in enumerate(automaton) for c, t in out.items()]
        keys, targets = np.array(edges, np.int64).reshape(-1, 2).T if edges else np.empty((2, 0), np.int64)
        bits = max(4, int(2 * len(keys)).bit_length() + 1)
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            at, first = np.unique(slot[free], return_index=True)
            self.keys[at], self.values[at] = keys[free[first]], targets[free[first]]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys.astype(np.uint64) * _ODD >> self.shift).astype(np.int64)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next states, 0 where there is no transition."""
        keys = state * self.width + code
        if self.dense is not None:
            return self.dense.take(keys)
        slot = self._slot(keys)
        found = self.keys.take(slot)
        out = np.where(found == keys, self.values.take(slot), 0)
        probing = np.flatnonzero((found != keys) & (found >= 0))
        while len(probing):
            slot[probing] = (slot[probing] + 1) & self.mask
            at = slot[probing]
            found = self.keys[at]
            hit = found == keys[probing]
            out[probing[hit]] = self.values[at[hit]]
            probing = probing[~hit & (found >= 0)]
        return out


class Parser:
    """The automata of a sample, and batch parsing."""

    def __init__(self, sample: Sample):
        self.langs = [lang for lang, _, _ in sample]
        self.limits = np.array([limit for _, _, limit in sample])
        self.letters: dict[str, int] = {}  # 0: no letter; 1..: the samples' letters; last: any other, which no automaton knows
        for _, text, _ in sample:
            for c in map(_letter, text):
                if c:
                    self.letters.setdefault(c, len(self.letters) + 1)
        self.other = len(self.letters) + 1
        self.lut = np.full(0x110000, -1, np.int32)
        self.tables = [Transitions(suffix_automaton(self.codes(text)), self.other + 1) for _, text, _ in sample]

    def codes(self, text: str, gap: bool = True) -> np.ndarray:
        """Letter codes, each run of other characters as one 0; ``gap``: what comes before needs no 0 more."""
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        codes = self.lut.take(points)
        for p in np.unique(points[codes < 0]).tolist():
            c = _letter(chr(p))
            self.lut[p] = self.letters.get(c, self.other) if c else 0
        codes = self.lut.take(points)
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0
        if len(keep):
            keep[0] |= not gap
        return codes[keep]

    def phrases(self, parts: list[np.ndarray], entry: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each array of codes and each language, the phrases of its greedy parse and the state at its end.
        ``entry`` has the states in which the arrays begin, the roots unless given."""
        n, k = len(parts), len(self.tables)
        counts, ends = np.zeros((n, k), np.int64), np.zeros((n, k), np.int32) if entry is None else entry.astype(np.int32)
        sizes = np.array([len(p) for p in parts], np.int64)
        owners = np.repeat(np.arange(n), -(-sizes // BLOCK))
        if not len(owners):
            return counts, ends
        lengths = np.concatenate([np.minimum(BLOCK, len(p) - np.arange(0, len(p), BLOCK)) for p in parts])
        first = np.ones(len(owners), bool)
        first[1:] = owners[1:] != owners[:-1]
        order = np.argsort(-lengths, kind="stable")
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))  # column of each block
        flat, starts, longest = np.concatenate(parts), (np.cumsum(lengths) - lengths)[order], int(lengths.max())
        active = np.searchsorted(-lengths[order], -np.arange(longest), "left")  # blocks longer than t
        grid = np.zeros((longest, len(order)), np.int32)
        for t in range(longest):
            grid[t, : active[t]] = flat[starts[: active[t]] + t]
        height = lengths[order]
        whole = grid
        for j, table in enumerate(self.tables):
            grid = table.local.take(whole)
            states, begun = np.zeros((longest, len(order)), np.int32), np.zeros((longest, len(order)), bool)
            state, total = np.zeros(len(order), np.int32), np.zeros(len(order), np.int64)
            for t in range(longest):
                m = active[t]
                state[:m], begun[t, :m] = self._step(table, state[:m], grid[t, :m])
                states[t, :m] = state[:m]
                total[:m] += begun[t, :m]
            last = states[height - 1, np.arange(len(order))]
            # each block again from where the one before it really ends, as long as that changes
            came = np.zeros(len(order), np.int32)  # by block
            came[first] = ends[owners[first], j]
            came[~first] = last[where[:-1][~first[1:]]]
            delta, exits = np.zeros(len(order), np.int64), last.copy()
            redo = np.flatnonzero(came)
            while len(redo):
                at, now, gain = where[redo], came[redo].copy(), np.zeros(len(redo), np.int64)
                exits[at] = last[at]
                open_ = np.arange(len(redo))
                for t in range(longest):
                    open_ = open_[height[at[open_]] > t]
                    if not len(open_):
                        break
                    col = at[open_]
                    now[open_], new = self._step(table, now[open_], grid[t, col])
                    gain[open_] += new.astype(np.int64) - begun[t, col]
                    ended = height[col] == t + 1
                    exits[col[ended]] = now[open_[ended]]
                    open_ = open_[now[open_] != states[t, col]]
                delta[at] = gain
                after = redo[redo + 1 < len(owners)] + 1
                after = after[~first[after]]
                redo = after[came[after] != exits[where[after - 1]]]
                came[redo] = exits[where[redo - 1]]
            np.add.at(counts[:, j], owners[order], total + delta)
            final = np.flatnonzero(np.append(first[1:], True))
            ends[owners[final], j] = exits[where[final]]
        return counts, ends

    @staticmethod
    def _step(table: Transitions, state: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after one code, and where a phrase begins with it: there was none, or it couldn't go on."""
        to = table.step(state, code)
        new = (to == 0) | (state == 0)
        to[new] = table.root.take(code[new])
        return to, new

    def judge(self, texts_: list[str]) -> list[tuple[str, float, float, int, bool]]:
        """(language or und, score, phrases a letter, phrases, foreign) for each text, from all of it."""
        out: list[tuple[str, float, float, int, bool]] = []
        counts, sizes, letters = self._counted(texts_)
        for own, size, any_ in zip(counts, sizes, letters):
            if not any_ or not self.langs:
                out.append(("und", 0.0, 1.0, 0, True))
                continue
            rates = own / size
            best = int(rates.argmin())
            shares = (rates.min() / rates) ** 6
            foreign = own[best] - EVIDENCE * math.sqrt(own[best]) > self.limits[best] * size
            out.append((self.langs[best], float(shares[best] / shares.sum()), float(rates[best]), int(own[best]), bool(foreign)))
        return out

    def _counted(self, texts_: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        counts, sizes = np.zeros((len(texts_), len(self.langs)), np.int64), np.zeros(len(texts_), np.int64)
        letters = np.array([any(map(str.isalpha, t)) for t in texts_], bool)  # marks alone are no letters
        for some in _portions(texts_):
            states, gap = np.zeros((len(some), len(self.langs)), np.int32), True
            for at in range(0, max(len(texts_[i]) for i in some) or 1, PORTION):  # a text beyond that goes on in its state
                parts = [self.codes(texts_[i][at : at + PORTION], gap) for i in some]
                found, states = self.phrases(parts, states)
                counts[some] += found
                sizes[some] += [len(p) for p in parts]
                gap = not (len(parts[0]) and parts[0][-1])
        return counts, sizes, letters


def _letter(c: str) -> str:
    """The lower-case form of a letter or mark, empty for anything else."""
    return c.lower()[:1] if c.isalpha() or unicodedata.category(c)[0] == "M" else ""


def _portions(rows: list[str]) -> Iterator[list[int]]:
    """Consecutive texts of about PORTION characters together, to bound the parse tables; a longer one stands alone."""
    part, size = [], 0
    for i, r in enumerate(rows):
        if part and size + len(r) > PORTION:
            yield part
            part, size = [], 0
        part.append(i)
        size += len(r)
    if part:
        yield part


@lru_cache(maxsize=2)
def _parser(sample: Sample) -> Parser:
    return Parser(sample)


def limit(text: str) -> float:
    """Phrases a letter that a language's own texts stay under: half way from the rate at which one half of the
    sample parses the other to one phrase a letter."""
    half = len(text) // 2
    parser = Parser((("", text[:half], 1.0),))
    codes = parser.codes(text[half:])
    rate = parser.phrases([codes])[0][0, 0] / len(codes) if len(codes) else 1.0
    return (1.0 + float(rate)) / 2


def learn(docs: DataFrame, chars: int = SAMPLE_CHARS, per_lang: int = SAMPLE_DOCS, longest: int = SAMPLE_LONGEST, languages: int = LANGUAGES) -> Sample:
    """A bounded sample of labelled text per language: whole documents in the order of their id's hash, none
    longer than ``longest`` characters, at most ``per_lang`` ids and ``chars`` characters together (one document at
    least), for the ``languages`` commonest languages. A repeated id counts once, with its least text. Counting
    comes first, so that only ids of small hashes, some sixteen times as many as wanted, are grouped at all."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where("doc_id is not null and lang is not null").where(remainder("doc_id", FOLDS) != 0).where(F.length("text").between(1, longest))
    ids = rows.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids")).orderBy(F.desc("ids"), "lang").limit(languages).collect()
    held: dict[str, list[str]] = {}
    share = {r.lang: min(1.0, 16 * per_lang / max(1, r.ids)) for r in ids}
    while share:
        low = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
        asked = F.coalesce(*[F.when(F.col("lang") == lang, low <= s) for lang, s in share.items()], F.lit(False))
        once = rows.where(asked).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).withColumn("low", low)
        by = W.partitionBy("lang").orderBy("low", "doc_id")
        chosen = once.withColumn("r", F.row_number().over(by)).where(F.col("r") <= per_lang).withColumn("so_far", F.sum(F.length("text")).over(by.rowsBetween(W.unboundedPreceding, 0)))
        found: dict[str, list[tuple[int, str]]] = {}
        for r in chosen.select("lang", "r", F.when((F.col("r") == 1) | (F.col("so_far") <= chars), F.col("text")).alias("text")).collect():
            found.setdefault(r.lang, []).append((r.r, r.text))
        again = {}
        for lang, s in share.items():
            if s < 1.0 and len(found.get(lang, ())) < per_lang:  # the estimate was far off: a larger share of this language
                again[lang] = min(1.0, 16 * s)
            else:
                held[lang] = [text for _, text in sorted(found.get(lang, ())) if text is not None]
        share = again
    joined = {lang: "\n".join(held[lang]) for lang in sorted(held) if held[lang]}
    return tuple((lang, text, limit(text)) for lang, text in joined.items())


def language(sample: Sample):
    """A column function from text to (lang_pred, score, rate, phrases, foreign)."""

    @F.pandas_udf("lang_pred string, score double, rate double, phrases long, foreign boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(_parser(sample).judge([t or "" for t in b]), columns=["lang_pred", "score", "rate", "phrases", "foreign"])

    return run


def rejected(said: Column) -> Column:
    """Whether a text has no letters or is in none of the learned languages."""
    return (said["lang_pred"] == "und") | said["foreign"]


def identify(docs: DataFrame, sample: Sample) -> DataFrame:
    """doc_id, lang_pred, score, rate, phrases, foreign for every row, from the whole text.

    ``und`` (score 0, rate 1, no phrase, foreign) where the text is null or has no letter, or nothing was learned. ``rate``
    is the winner's phrases a letter (a run of other characters counts as one letter). A text is foreign if even the lower
    confidence bound of its phrase count exceeds the winner's limit, so a very short text rarely is. Ties go to
    the language that comes first in the alphabet. Very long texts are parsed in portions that go on from
    state to state. Repeated rows and null ids pass through; other columns are ignored; an empty table gives an
    empty result. No shuffle.
    """
    said = docs.select(F.col("doc_id").cast("long").alias("doc_id"), language(sample)(F.col("text").cast("string")).alias("said"))
    return said.select("doc_id", "said.lang_pred", "said.score", "said.rate", "said.phrases", "said.foreign")


def predict(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rate: learned from rows whose id's crc32 mod 5 is not 0; see ``identify``."""
    held = remainder("doc_id", FOLDS) == 0
    return identify(docs, learn(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "rate")
