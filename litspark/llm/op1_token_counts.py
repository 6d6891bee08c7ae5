"""Token counts by prefix dynamic programming.

For a byte-pair vocabulary the encoding of every prefix of a word is the
encoding of a shorter prefix plus one last token, and that token is the only one
that ends there and is *compatible* with the last token before it (encoding the two
side by side gives exactly these two). So one pass over a word yields

    count[i] = count[i - len(last[i])] + 1

for every prefix i. A text is cut into units whose encodings do not influence each
other (``units``); the counts of equal units are computed once per worker and kept in a bounded memo.
The index of a text is one signed 16-bit number per code point, the change of
the exact count from one prefix to the next. Counts are not monotone (one more
letter can turn three tokens into one), which the index reproduces.

Defined results: a null text counts as empty (no tokens); the tokenizer's
special strings inside a text count as the library counts them by default (one token
when complete); repeated rows give repeated rows; an empty table gives an empty
table; other columns pass through, and a column that has the name of a result
is replaced by it.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate
from operator import sub

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nonnull_text, session, table, worker_cache
from .units import cut, gathered, unit_blocks

#: Fixed value: the published split pattern of this byte-level vocabulary.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO_UNITS = 600_000
MEMO_PAIRS = 1_000_000
MEMO_PREFIXES = 600_000
#: Longest prefix in bytes whose state is shared between words.
SHORT = 24
LIMIT = 512


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write bytes as printable characters: printable
    Latin-1 stands for itself, the rest follow from U+0100 on in byte order."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts at every prefix for one byte-level BPE file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = _byte_alphabet()
        raw = lambda s: bytes(chars[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        merges = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        #: Order in which tokens come to be: bytes first, then one per merge.
        self.order = {raw(t): -1 for t in spec["model"]["vocab"] if t not in self.special}
        self.made: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (x, y) in enumerate(merges):
            self.order[x + y] = i
            self.made[x + y] = (x, y)
        self.suffixes = {t[i:] for t in self.order for i in range(len(t))}
        self.split = regex.compile(SPLIT)
        # Where a cut text may be split unlike the whole: contractions, runs of white space, special strings.
        self.delicate = re.compile("|".join([r"'|\s\s", *map(re.escape, self.special)]))
        self.runs = regex.compile(r"\s{2,}(?=\S)")
        self.specials = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.prefixes: dict[bytes, tuple[int, bytes]] = {}
        self.pieces: dict[str, bytes] = {}
        self.units: dict[bytes, bytes] = {}

    def _compatible(self, a: bytes, b: bytes) -> bool:
        """Whether merging a + b leaves exactly these two tokens: take back the
        merges that made them, latest first; no two parts that met at the
        boundary in between may have had a merge of their own by then."""
        if len(self.pairs) > MEMO_PAIRS:
            self.pairs.clear()
        made, order = self.made, self.order
        x, y, until = a, b, 1 << 60
        ok = True
        while True:
            if made.get(x + y) == (x, y) and order[x + y] < until:
                ok = False
                break
            left, right = order[x], order[y]
            if left < 0 and right < 0:
                break
            if left > right:  # the left part was finished later
                until, x = left, made[x][1]
            else:  # at equal order the left one of two equal pairs merges first
                until, y = right + 1, made[y][0]
        self.pairs[a, b] = ok
        return ok

    def piece(self, word: bytes) -> list[int]:
        """count[0..len(word)] of one pretoken, by the recurrence above."""
        n, order, suffixes, pairs, known = len(word), self.order, self.suffixes, self.pairs, self.prefixes
        if len(known) > MEMO_PREFIXES:
            known.clear()
        count, last = [0] * (n + 1), [b""] * (n + 1)
        for i in range(1, n + 1):
            if i <= SHORT and (seen := known.get(word[:i])) is not None:
                count[i], last[i] = seen
                continue
            ends, j = [], i - 1
            while j >= 0 and (t := word[j:i]) in suffixes:
                if t in order:
                    ends.append(j)
                j -= 1
            for j in reversed(ends):
                t = word[j:i]
                if j:
                    ok = pairs.get((last[j], t))
                    if not (self._compatible(last[j], t) if ok is None else ok):
                        continue
                count[i], last[i] = count[j] + 1, t
                break
            if i <= SHORT:
                known[word[:i]] = count[i], last[i]
        return count

    def total(self, text: str) -> int:
        """Tokens of ``text`` without special strings."""
        return sum(self.piece(p.encode())[-1] for p in self.split.findall(text))

    def _points(self, p: str) -> list[int]:
        """Counts at each code point of one pretoken."""
        c = self.piece(p.encode())
        if len(c) == len(p) + 1:
            return c[1:]
        return [c[e] for e in accumulate(len(ch.encode()) for ch in p)]

    def _plain(self, text: str) -> list[int]:
        """Counts at each code point of a text without special strings."""
        out, before = [], 0
        for p in self.split.findall(text):
            here = self._points(p)
            total = here[-1]
            if len(p) == 3 and p[0] == "'" and p[1].isalpha():  # a cut contraction is a quote and a letter
                here[1] = self.total("'") + self.total(p[1])
            out.extend(before + x for x in here)
            before += total
        for m in self.runs.finditer(text):  # a text that ends in white space keeps its run whole
            start = out[m.start() - 1] if m.start() else 0
            out[m.end() - 1] = start + self.piece(m[0].encode())[-1]
        return out

    def _simple(self, p: str) -> bytes:
        if len(self.pieces) > MEMO_UNITS:
            self.pieces.clear()
        c = self._points(p)
        deltas = self.pieces[p] = array("h", map(sub, c, [0, *c[:-1]])).tobytes()
        return deltas

    def unit(self, text: str) -> bytes:
        """The index of one unit: a signed 16-bit change per code point."""
        if not self.delicate.search(text):
            get = self.pieces.get
            return b"".join([get(p) or self._simple(p) for p in self.split.findall(text)])
        if self.specials is None or not (found := list(self.specials.finditer(text))):
            counts = self._plain(text)
        else:
            counts, at, before = [], 0, 0
            for m in [*found, None]:
                part = text[at:m.start() if m else len(text)]
                counts.extend(before + x for x in (self._plain(part) if part else []))
                if m is None:
                    break
                inside = [before + self.total(part + m[0][:r]) for r in range(1, len(m[0]))]
                before += self.total(part) + 1
                counts.extend([*inside, before])
                at = m.end()
        return array("h", map(sub, counts, [0, *counts[:-1]])).tobytes()

    def index(self, text: str) -> bytes:
        """The index of a text: concatenation of its units' indexes."""
        return next(self.indexes(pa.array([text]))).tobytes()

    def indexes(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The index of each text, in order."""
        for _, _, codes, units, bounds in unit_blocks(texts):
            if len(self.units) > MEMO_UNITS:
                self.units.clear()
            get = self.units.get
            for u in units:
                if get(u) is None:
                    self.units[u] = self.unit(u.decode())
            deltas, end = gathered(codes, [get(u) for u in units], "<i2")
            first = cut(end, bounds).tolist()
            for i, j in zip(first, first[1:]):
                yield deltas[i:j]


def counts_of(index: bytes) -> np.ndarray:
    """Exact token count after each code point."""
    return np.cumsum(np.frombuffer(index, dtype=np.int16), dtype=np.int64)


def _counter(path: str) -> PrefixCounter:
    return worker_cache(f"op1 {path}", lambda: PrefixCounter(path))


def with_prefix_counts(df: DataFrame, text: str = "text", tokenizer: str | None = None,
                       index: str = "prefix_index") -> DataFrame:
    """``df`` plus the binary column ``index``; ``tokenizer`` is a path that every
    worker can read. Budget questions are then answered by ``tokens_at`` and ``longest_prefix``."""
    path = tokenizer or default_tokenizer()
    session(df)

    @F.pandas_udf(T.BinaryType())
    def build(texts):
        counter = _counter(path)
        return texts.map(lambda x: counter.index(x or ""))

    return df.withColumn(index, build(nonnull_text(text)))


def tokens_at(df: DataFrame, position, index: str = "prefix_index", out: str = "tokens") -> DataFrame:
    """Exact tokens of the first ``position`` code points (beyond the end: of
    the whole text; null or below 1: none), from the index alone."""
    session(df)

    @F.pandas_udf(T.LongType())
    def at(indexes, positions):
        return indexes.combine(positions, lambda x, k: 0 if x is None or not k > 0 else int(
            np.frombuffer(x, dtype=np.int16)[:int(k)].sum(dtype=np.int64)))

    return df.withColumn(out, at(F.col(index), (position if not isinstance(position, int) else F.lit(position)).cast("double")))


def longest_prefix(df: DataFrame, budget: int, index: str = "prefix_index", out: str = "cut") -> DataFrame:
    """Code points of the longest prefix with at most ``budget`` tokens."""
    session(df)

    @F.pandas_udf(T.LongType())
    def longest(indexes):
        return indexes.map(lambda x: 0 if x is None else _cut(counts_of(x), budget))

    return df.withColumn(out, longest(F.col(index)))


def _cut(counts: np.ndarray, budget: int) -> int:
    fits = np.flatnonzero(counts <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, cut long"


def token_counts(documents: DataFrame, limit: int = LIMIT, tokenizer: str | None = None) -> DataFrame:
    """Per row: UTF-8 bytes, exact tokens, whether they exceed ``limit``, and the
    code points of the longest prefix within it. The index of each text lives
    in its task only; nothing is shuffled."""
    path = tokenizer or default_tokenizer()
    session(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for b in batches:
            total, cuts = [], []
            for index in counter.indexes(b.column(1)):
                counts = np.cumsum(index, dtype=np.int32)
                total.append(int(counts[-1]) if len(counts) else 0)
                cuts.append(len(counts) if not len(counts) or counts.max() <= limit else _cut(counts, limit))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pc.binary_length(b.column(1)).cast(pa.int64()), pa.array(total, pa.int64()),
                 pa.array([t > limit for t in total], pa.bool_()), pa.array(cuts, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit", "cut"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), nonnull_text().alias("text")).mapInArrow(run, SCHEMA)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
