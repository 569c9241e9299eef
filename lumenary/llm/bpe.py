"""BPE encoding and decoding as streaming transducers.

Encoder: a merge list's encoding of a prefix ends in exactly one token that is compatible with the
encoding before it, so the symbols read so far form a tree of last tokens, one node per position. A token
leaves once ``sufficient_lookahead`` symbols, the merge list's own bound, have come after it; the encoding of any
longer input passes through one of the last ``longest`` positions, and what leaves is checked to be common to all
their chains. So at most twice the bound waits, however long a pre-token is. Every pre-token goes through the
stream; the states of short prefixes and the ids of short words are remembered. Decoder: ids give bytes, and an
incremental state machine turns bytes into text, holding unfinished sequences back.

Character classes and case are those of the library whose results count: characters that are newer than the oldest
tables in use are normalised and split by the library itself, all others by Python's tables, which agree there.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from functools import cached_property, lru_cache
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import texts

_MEMO, _MEMO_WORD, _CHUNK = 400_000, 64, 1 << 18
_SEPARATORS = re.compile("[\x1c-\x1f]")


@lru_cache(maxsize=1)
def newer() -> re.Pattern:
    """Characters that not all Unicode tables in use know alike: unassigned here, or, beyond the old blocks, assigned since 3.2."""
    old, ranges = unicodedata.ucd_3_2_0.category, []
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c)) == "Cn" or c > 0x2E50 and old(chr(c)) == "Cn":
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]")


@lru_cache(maxsize=1)
def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = sorted(set(range(256)).difference(shown))
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Merges:
    """A merge list with an end-of-word suffix: vocabulary, pair ranks, compatibility of neighbours."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.longest = max((self.width(t) for t in vocab), default=1)
        made: dict[str, int] = {}  # the last merge that can make a token
        #: Every merge comes after all that can make its parts, so a text's merges happen in order of rank.
        self.ordered = all(made.get(a, -1) < i > made.get(b, -1) and made.update({a + b: i}) is None for i, (a, b) in enumerate(merges))
        self._spine: dict[str, tuple[list, list] | None] = {}
        self._fits: dict[tuple[str, str], bool] = {}
        self._last: dict[str, str] = {}
        self.lookahead = self.sufficient_lookahead()

    def width(self, token: str) -> int:
        return len(token) - len(self.suffix) * bool(self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix))

    def symbols(self, token: str) -> list[str]:
        n = self.width(token)
        return [*token[: n - 1], token[n - 1 :]]

    def merge(self, symbols: list[str], steps: list[tuple[int, int, int]] | None = None) -> list[str]:
        """The plain rule: again and again the pair of lowest rank, the leftmost first. ``steps`` gets
        (rank, place, tokens before it) for every merge."""
        s = list(symbols)
        while len(s) > 1:
            best, at = min((self.rank.get((s[i], s[i + 1]), 1 << 60), i) for i in range(len(s) - 1))
            if best == 1 << 60:
                break
            if steps is not None:
                steps.append((best, at, len(s)))
            s[at : at + 2] = [s[at] + s[at + 1]]
        return s

    def spines(self, token: str) -> tuple[list[tuple[str, int]], list[tuple[str, int]]] | None:
        """The tokens that stand at the left and right end while ``token`` is merged from its symbols, each with the
        rank of the merge that consumes it; None if the merges make something else of the symbols."""
        if token not in self._spine:
            steps: list[tuple[int, int, int]] = []
            symbols = self.symbols(token)
            ends = None
            if self.merge(symbols, steps) == [token]:
                now, ends = list(symbols), ([], [])
                for rank, at, n in steps:
                    if at == 0:
                        ends[0].append((now[0], rank))
                    if at == n - 2:
                        ends[1].append((now[-1], rank))
                    now[at : at + 2] = [now[at] + now[at + 1]]
                for own in ends:
                    own.append((token, 1 << 60))
            self._spine[token] = ends
        return self._spine[token]

    def fits(self, a: str, b: str) -> bool:
        """Whether a and b, put together, encode to a and b (with a empty: whether b encodes to itself).

        They do unless, at some time, the tokens at their common edge merge before either is consumed on
        its own side; of equal ranks the left one goes first.
        """
        if not a:
            return self.spines(b) is not None
        known = self._fits.get((a, b))
        if known is None:
            known = self._apart(a, b)
            if len(self._fits) >= _MEMO:
                self._fits.clear()
            self._fits[a, b] = known
        return known

    def _apart(self, a: str, b: str) -> bool:
        if not self.ordered:
            return self.merge([*self.symbols(a), *self.symbols(b)]) == [a, b]
        if (left := self.spines(a)) is None or (right := self.spines(b)) is None:
            return False
        x, y = left[1], right[0]
        i = j = 0
        while True:
            (s, before), (t, until) = x[i], y[j]
            r = self.rank.get((s, t))
            if r is not None and r < before and r <= until:
                return False
            if i == len(x) - 1 and j == len(y) - 1:
                return True
            if before <= until:
                i += 1
            else:
                j += 1

    def last_token(self, prefix: str) -> str:
        """The last token of a prefix without a word's end; the empty string's is empty."""
        if not prefix:
            return ""
        known = self._last.get(prefix)
        if known is None:
            for n in range(min(self.longest, len(prefix)), 0, -1):
                known = prefix[-n:]
                if known in self.vocab and self.fits(self.last_token(prefix[:-n]), known):
                    break
            if len(self._last) >= _MEMO:
                self._last.clear()
            self._last[prefix] = known
        return known

    def sufficient_lookahead(self) -> int:
        """Symbols after which no merge can still reach back: a change travels left over one token per
        link of a chain of merges with falling rank, and no chain is longer than the merge list's deepest
        derivation; each link spans the longest token at most."""
        depth: dict[str, int] = {}
        for a, b in self.rank:  # parts precede their whole
            depth[a + b] = max(depth.get(a, 0), depth.get(b, 0)) + 1
        return (max(depth.values(), default=0) + 1) * self.longest


class StreamEncoder:
    """One pre-token's symbols in, stable tokens out; ``waiting`` is the number of symbols held back."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.last = [""]  # last[i]: the token that ends i symbols after the last one emitted
        self.text, self.held = "", ""  # symbols not yet emitted; the newest one, which may be the word's end
        self.begun = False  # whether a token has left

    def _step(self, symbol: str) -> None:
        m, text = self.m, self.text + symbol[:1]
        end, self.text = len(text), text
        for n in range(min(m.longest, end), 0, -1):
            token = text[end - n :] + symbol[1:]
            if token in m.vocab and m.fits(self.last[end - n], token):
                self.last.append(token)
                return
        raise ValueError(f"no token ends in {symbol!r}")

    def _chain(self, at: int) -> list[int]:
        out = [at]
        while at:
            at -= self.m.width(self.last[at])
            out.append(at)
        return out

    def _stable(self) -> list[str]:
        """Tokens with the sufficient lookahead behind them that the chains of all the last positions share."""
        n = len(self.text)
        common = {p for p in self._chain(n) if p <= n - self.m.lookahead}
        for p in range(max(0, n - self.m.longest + 1), n):
            common &= set(self._chain(p))
        cut = max(common, default=0)
        if not cut:
            return []
        at, out = cut, []
        while at:
            out.append(self.last[at])
            at -= self.m.width(self.last[at])
        self.text, self.last, self.begun = self.text[cut:], self.last[cut:], True  # last[0] stays: what comes after has to fit it
        return out[::-1]

    def feed(self, symbols: str) -> list[str]:
        """The tokens that no later symbol can change. States are worked out when they are needed: symbols are only held
        as long as they fit a short word, whose end asks for the states on its own way back and no others."""
        self.held += symbols
        out: list[str] = []
        if self.begun or len(self.text) + len(self.held) > _MEMO_WORD:
            for c in self.held[:-1]:
                self._step(c)
                if len(self.text) >= 2 * self.m.lookahead:
                    out += self._stable()
            self.held = self.held[-1:]
        return out

    @property
    def waiting(self) -> int:
        return len(self.text) + len(self.held)

    def finish(self) -> list[str]:
        """The rest, once the pre-token has ended."""
        m, out, word = self.m, [], self.held
        if not self.text and not self.begun:
            end, last = m.suffix, m._last
            while word:
                if end:
                    for n in range(min(m.longest, len(word)), 0, -1):
                        token = word[-n:] + end
                        if token in m.vocab and m.fits(m.last_token(word[:-n]), token):
                            break
                    end = ""
                else:
                    token = last.get(word) or m.last_token(word)
                    n = len(token)
                out.append(token)
                word = word[:-n]
            return out[::-1]
        if word:
            self._step(word + m.suffix)
        at = len(self.text)
        while at:
            out.append(self.last[at])
            at -= m.width(self.last[at])
        return out[::-1]


def token_bytes(tokens: dict[int, str], mode: str = "spaced", suffix: str = "") -> dict[int, bytes]:
    """What each id gives the decoder: its string's own UTF-8 (``spaced``), or the bytes that its characters stand
    for, a word's end being a space (``bytes``)."""
    if mode == "spaced":
        return {i: t.encode("utf-8") for i, t in tokens.items()}
    byte, out = {c: b for b, c in byte_alphabet().items()}, {}
    for i, t in tokens.items():
        end = bool(suffix) and t.endswith(suffix)
        out[i] = bytes(byte[c] for c in (t[: -len(suffix)] if end else t)) + b" " * end
    return out


class StreamDecoder:
    """Ids in, text out, one piece at a time, through bytes: an unfinished UTF-8 sequence is held back until its last byte
    comes. ``between`` is put between tokens, a space where a tokenizer has no decoder."""

    def __init__(self, table: dict[int, bytes], between: bytes = b""):
        self.table, self.between, self.first = table, between, True
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids) -> str:
        data = self.between.join(map(self.table.__getitem__, ids))
        if data and not self.first:
            data = self.between + data
        self.first = self.first and not data
        return self.utf8.decode(data)

    def finish(self) -> str:
        return self.utf8.decode(b"", True)


class WordTokenizer:
    """A tokenizer file with NFC, lower case, word splitting, byte-level symbols and word ends."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.at_special = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")")
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.symbols = {b: c for b, c in byte_alphabet().items()}
        self.tokens = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.path, self.bytes = path, token_bytes(self.tokens)
        self.id_text = {i: str(i) for i in self.tokens}
        self.memo = _Memo(self)

    def word(self, word: str):
        """The ids of one pre-token."""
        if len(word) <= _MEMO_WORD:
            stream = StreamEncoder(self.merges)
            out = stream.feed(word.encode("utf-8", "replace").decode("latin-1").translate(self.symbols))
            return map(self.merges.vocab.__getitem__, out + stream.finish())
        return self.streamed(word[at : at + 4096].encode("utf-8", "replace").decode("latin-1").translate(self.symbols) for at in range(0, len(word), 4096))

    def streamed(self, parts):
        """The ids of one pre-token's symbols, which come in parts."""
        stream, vocab = StreamEncoder(self.merges), self.merges.vocab
        for part in parts:
            yield from map(vocab.__getitem__, stream.feed(part))
        yield from map(vocab.__getitem__, stream.finish())

    def pretokens(self, run: str):
        """The ids of a run without white space."""
        if not run.isascii() and newer().search(run):
            return chain.from_iterable(self.streamed([p]) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(run))
        parts = self.words.findall(run)
        return self.word(run) if parts == [run] else chain.from_iterable(map(self.memo.__getitem__, parts))

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def normalise(self, text: str) -> str:
        if text.isascii():
            return text.lower()
        if newer().search(text):
            return self.library.normalizer.normalize_str(text)
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def chunks(self, text: str):
        """The text's parts, cut at special tokens and at white space, each in bounded size."""
        for part in self.at_special.split(text) if "<|" in text else [text]:
            if part in self.special:
                yield part, True
                continue
            at = 0
            while len(part) - at > _CHUNK:
                cut = max(part.rfind(" ", at, at + _CHUNK), part.rfind("\n", at, at + _CHUNK))
                if cut <= at:
                    found = [x for x in (part.find(" ", at + _CHUNK), part.find("\n", at + _CHUNK)) if x > 0]
                    cut = min(found, default=len(part))
                yield part[at:cut], False
                at = cut
            if at < len(part):
                yield part[at:], False

    def encode(self, text: str):
        """Lists of ids, one for each bounded part of the text."""
        for part, special in self.chunks(text):
            if special:
                yield [self.special[part]]
                continue
            text = self.normalise(part)
            # no pre-token crosses white space, so runs without any are looked up whole; \x1c to \x1f are white space to split() only
            runs = self.words.findall(text) if _SEPARATORS.search(text) else text.split()
            yield list(chain.from_iterable(map(self.memo.__getitem__, runs)))


class _Memo(dict):
    """Ids of runs of pre-tokens seen before, in bounded number and length."""

    def __init__(self, tokenizer: WordTokenizer):
        super().__init__()
        self.tokenizer = tokenizer

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = tuple(self.tokenizer.pretokens(word))
        if len(word) <= _MEMO_WORD:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = ids
        return ids


@lru_cache(maxsize=2)
def tokenizer(path: str | None) -> WordTokenizer:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    return WordTokenizer(path)


def digest(text: str | None, path: str | None = None) -> tuple[int, str, str]:
    """n_tokens, SHA-256 of the ids joined by spaces, SHA-256 of the decoded text; held in parts only."""
    tok = tokenizer(path)
    ids_sha, text_sha, decoder, n = hashlib.sha256(), hashlib.sha256(), StreamDecoder(tok.bytes, b" "), 0
    for ids in tok.encode(text or ""):
        if ids:
            ids_sha.update(((" " if n else "") + " ".join(map(tok.id_text.__getitem__, ids))).encode())
            n += len(ids)
            text_sha.update(decoder.feed(ids).encode("utf-8"))
    text_sha.update(decoder.finish().encode("utf-8"))
    return n, ids_sha.hexdigest(), text_sha.hexdigest()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, from the whole text.

    Null and empty texts have no tokens and the digests of the empty string. A very long text is read in bounded parts and a
    very long word streamed. Repeated rows and null ids pass through; other columns are ignored; an empty table gives an
    empty result. There is no shuffle.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        for b in batches:
            found = [digest((t.as_py() or b"").decode("utf-8", "replace"), path) for t in b.column(1)]
            n, ids, decoded = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())], schema=schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
