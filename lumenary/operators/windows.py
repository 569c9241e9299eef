"""Token windows with overlap over text bodies."""

import hashlib
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def token_windows(docs: DataFrame, key: str, text: str, size: int = 500, overlap: int = 100) -> DataFrame:
    """key, window, first, last, text for white-space tokens: closed form, since these tokens add up.

    Windows start every ``size - overlap`` tokens and the last one ends the text; a blank text has none.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    tokens = F.filter(F.split(F.col(text), r"[ \t\n\r]+"), lambda t: t != "")
    rows = docs.select(key, tokens.alias("t")).where(F.size("t") > 0).withColumn("n", F.size("t"))
    count = F.when(F.col("n") <= size, F.lit(1)).otherwise(F.ceil((F.col("n") - size) / (size - overlap)).cast("int") + 1)
    each = rows.select(key, "t", "n", F.explode(F.sequence(F.lit(0), count - 1)).alias("window"))
    first = F.col("window") * (size - overlap)
    return each.select(key, F.col("window").cast("long"), first.cast("long").alias("first"), F.least(first + size, F.col("n")).cast("long").alias("last"), F.array_join(F.slice("t", first + 1, size), " ").alias("text"))


class Counter:
    """A tokenizer as windows need it. ``offsets`` gives each token's (start, end) in characters; ``splits`` gives the pieces that
    are tokenized on their own. Where one piece ends, what comes behind doesn't depend on what came before."""

    def __init__(self, offsets: Callable[[str], list[tuple[int, int]]], splits: Callable[[str], list[tuple[int, int]]]):
        self.offsets, self.splits = offsets, splits
        self._counts: dict[str, int] = {}

    def count(self, text: str) -> int:
        return len(self.offsets(text))

    def piece(self, text: str) -> int:
        """The count of a piece, remembered if it is short."""
        if len(text) > 64:
            return self.count(text)
        if text not in self._counts:
            if len(self._counts) > 50_000:
                self._counts.clear()
            self._counts[text] = self.count(text)
        return self._counts[text]


def bpe_counter(path: str) -> Counter:
    """The counter of a tokenizer file, without special tokens; their strings in a text are text."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    model.encode_special_tokens = True
    return Counter(lambda text: model.encode(text, add_special_tokens=False).offsets, lambda text: [span for _, span in model.pre_tokenizer.pre_tokenize_str(text)])


def _tokens_ahead(body: str, start: int, n: int, counter: Counter) -> list[tuple[int, int]]:
    """Offsets of the tokens from ``start``, n at least unless the text ends. Only as much text is tokenized, and the pieces at
    the cut, which might go on behind it, are left out."""
    reach = 8 * n + 64
    while True:
        part = body[start : start + reach]
        if start + reach >= len(body):
            return counter.offsets(part)
        pieces = counter.splits(part)
        sure = pieces[-3][1] if len(pieces) > 3 else 0
        tokens = [t for t in counter.offsets(part) if t[1] <= sure]
        if len(tokens) >= n:
            return tokens
        reach *= 2


class Joined:
    """Counts of a prefix joined with any part of a body, by pieces. The body is split once. A joined text is split anew only until
    one of its pieces begins where one of the body's does, and from a few pieces before its end on: between, its pieces are
    the body's, whose counts add up."""

    def __init__(self, body: str, prefix: str, counter: Counter):
        self.body, self.prefix, self.counter = body, prefix, counter
        self.spans = counter.splits(body)
        self.starts = [a for a, _ in self.spans]
        self.at = {a: i for i, a in enumerate(self.starts)}
        self.sums = [0]
        for a, b in self.spans:
            self.sums.append(self.sums[-1] + counter.piece(body[a:b]))
        self._heads: dict[tuple[str, int], tuple[int, int] | None] = {}

    def head(self, prefix: str, start: int) -> tuple[int, int] | None:
        """(i, tokens before it): the first of the body's pieces that is one of prefix + body[start:] too; None if none is."""
        if (prefix, start) not in self._heads:
            self._heads.clear() if len(self._heads) > 8 else None
            self._heads[prefix, start] = self._head(prefix, start)
        return self._heads[prefix, start]

    def _head(self, prefix: str, start: int) -> tuple[int, int] | None:
        reach = 64
        while True:
            part, whole = prefix + self.body[start : start + reach], start + reach >= len(self.body)
            total, found = 0, self.counter.splits(part)
            for a, b in found if whole else found[:-3]:
                if a >= len(prefix) and start + a - len(prefix) in self.at:
                    return self.at[start + a - len(prefix)], total
                total += self.counter.piece(part[a:b])
            if whole:
                return None
            reach *= 2

    def count(self, start: int, end: int) -> int:
        """The tokens of the prefix and body[start:end]."""
        head, last = self.head(self.prefix, start), bisect_right(self.starts, end) - 5
        if head is None or last <= head[0]:
            return self.counter.count(self.prefix + self.body[start:end])
        tail = self.body[self.starts[last] : end]
        return head[1] + self.sums[last] - self.sums[head[0]] + sum(self.counter.piece(tail[a:b]) for a, b in self.counter.splits(tail))

    def token_end(self, start: int, room: int, size: int) -> tuple[int, bool]:
        """Where the token ``room`` of body[start:] ends, or its last one, and whether it has fewer than ``size``."""
        head = self.head("", start)
        total = 0 if head is None else head[1] + self.sums[-1] - self.sums[head[0]]
        if head is None or min(room, total) <= head[1]:
            ahead = _tokens_ahead(self.body, start, size, self.counter)
            return start + ahead[min(room, len(ahead)) - 1][1], len(ahead) < size
        wanted = min(room, total) - head[1] + self.sums[head[0]]
        i = bisect_left(self.sums, wanted) - 1
        a, b = self.spans[i]
        return a + self.counter.offsets(self.body[a:b])[wanted - self.sums[i] - 1][1], total < size


def window_end(joined: Joined, start: int, size: int) -> int:
    """From where the tokens that the prefix leaves room for end, back until the window fits, then on while it still fits with one
    more character. Counts of joined texts are neither sums nor monotone, so each candidate is counted."""
    body, room = joined.body, max(1, size - joined.counter.piece(joined.prefix))
    guess, short = joined.token_end(start, room, size + 8)
    if short and joined.count(start, len(body)) <= size:
        return len(body)
    end = max(start + 1, min(guess, len(body)))
    while end > start and joined.count(start, end) > size:
        end -= 1
    if end <= start:
        raise ValueError("the prefix leaves no room for the next character")
    while end < len(body) and joined.count(start, end + 1) <= size:
        end += 1
    return end


def overlap_begin(body: str, start: int, end: int, counter: Counter, overlap: int) -> tuple[int, int]:
    """(begin, tokens) of the shortest suffix of body[start:end] with ``overlap`` tokens or more.

    Counts of whole pieces add up from the end. A suffix that begins within a piece is split anew only until one of its pieces
    begins where a known one does: what follows is the same. Pieces whose bytes can't make up what is missing are passed over.
    """
    reach = 8 * overlap
    while True:
        base = max(start, end - reach)
        text = body[base:end]
        pieces = counter.splits(text)
        behind = {len(text): 0}  # tokens from where a piece begins on
        for i in range(len(pieces) - 1, -1 if base == start else 1, -1):  # the first two may have been cut at base
            after = pieces[i + 1][0] if i + 1 < len(pieces) else len(text)
            if behind[after] + len(text[pieces[i][0] : after].encode()) + 2 >= overlap:
                ahead = pieces[min(i + 4, len(pieces) - 1)][1]
                for begin in range(after - 1, pieces[i][0] - 1, -1):
                    tokens = _counted(text[begin:ahead], begin, behind, counter)
                    if tokens >= overlap:
                        if base + begin == start:
                            raise ValueError("the overlap takes the whole window")
                        return base + begin, tokens
            behind[pieces[i][0]] = behind[after] + counter.piece(text[pieces[i][0] : pieces[i][1]])
        if base == start:
            raise ValueError("the window is smaller than the overlap")
        reach *= 2


def _counted(part: str, begin: int, behind: dict[int, int], counter: Counter) -> int:
    total = 0
    for a, b in counter.splits(part):
        if a and begin + a in behind:
            return total + behind[begin + a]
        total += counter.piece(part[a:b])
    return total


def body_windows(body: str, prefix: str, counter: Counter, size: int, overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, tokens, overlap in tokens, overlap in characters) of a body's windows, each with the prefix within ``size`` tokens.

    A blank body has none. The prefix must leave room, and each window must go on: else it is an error, and nothing is cut.
    The body's pieces are counted once and a window costs a few counts of the pieces at its ends, so the time grows with the text.
    """
    if not 0 < overlap < size:
        raise ValueError("the overlap must be smaller than the window")
    if not body.strip():
        return []
    if counter.count(prefix) >= size:
        raise ValueError("the prefix leaves no room")
    out, start, shared, joined = [], 0, 0, Joined(body, prefix, counter)
    while True:
        end = window_end(joined, start, size)
        if out and end <= out[-1][1]:
            raise ValueError("a window makes no progress")
        out.append((start, end, joined.count(start, end), shared, out[-1][1] - start if out else 0))
        if end == len(body):
            return out
        start, shared = overlap_begin(body, start, end, counter, overlap)


def unit_windows(units: DataFrame, key: str, counter: Callable[[], Counter], size: int = 500, overlap: int = 100) -> DataFrame:
    """key, window, start, end, token_count, overlap_tokens, overlap_chars, text_sha256, error for units (key, prefix, body): one row with
    an error where a unit can't be windowed. ``counter`` is called once a task. Units are independent, so there is no shuffle."""
    kind = units.schema[key].dataType.simpleString()
    names = ["window", "start", "end", "token_count", "overlap_tokens", "overlap_chars", "text_sha256", "error"]
    ddl = f"{key} {kind}, window long, start long, end long, token_count long, overlap_tokens long, overlap_chars long, text_sha256 string, error string"

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = counter()
        for b in batches:
            rows = []
            for k, prefix, body in zip(*(b.column(c).to_pylist() for c in (key, "prefix", "body"))):
                prefix, body = prefix or "", body or ""
                try:
                    for i, (a, z, *counts) in enumerate(body_windows(body, prefix, tokens, size, overlap)):
                        rows.append((k, i, a, z, *counts, hashlib.sha256((prefix + body[a:z]).encode()).hexdigest(), None))
                except ValueError as e:
                    rows.append((k, *[None] * 7, str(e)))
            yield pa.RecordBatch.from_pylist([dict(zip([key, *names], r)) for r in rows], schema)

    return units.select(key, "prefix", "body").mapInArrow(run, ddl)
