"""Quality rules by line sequence labelling.

Every line with a word is a position of a linear-chain conditional random field with
two labels, content and boilerplate; Viterbi decoding labels the lines of a
text jointly, and the share of word characters on content lines decides whether
the document stays. The field is trained here: the lines of a labelled document
carry its quality label (weak supervision), on at most ``TRAIN_DOCUMENTS`` labelled
documents, the first by a hash of the id; the parameters are a few dozen numbers that go to
every task. Scoring is narrow: nothing is shuffled.

Base rules fail a text of few words or of many repeated 8-word windows.

Defined results: a null or empty text has no words and fails the base rules; a text
without lines that carry words has content share 0; without usable labels (none, or of
one class) every line counts as content, so the base rules alone decide; repeated
rows give repeated rows; an empty table gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, WORD, nonnull_text, session, table, worker_cache

MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
SYMBOLS = "#*$%&|<>"
MIN_CONTENT_SHARE = 0.5
TRAIN_DOCUMENTS = 3000
BLOCK_BYTES = 1_000_000

_WORDS = re.compile(WORD)
# Byte classes of the line features.
_UPPER, _LOWER, _DIGIT, _SYMBOL, _STOP, _SPACE, _OTHER, _HIGH = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[ord(c) for c in SYMBOLS]] = _SYMBOL
_CLASS[[ord(c) for c in ".,;:'\"!?-()"]] = _STOP
_CLASS[[ord(c) for c in WHITE]] = _SPACE
FEATURES = ["bias", "log_bytes", "log_words", "upper", "digit", "symbol", "stop", "other", "letters_per_word",
            "symbols_per_word", "stops_per_word", "repeated_words", "seen_before"]


@dataclass
class ChainField:
    """Weights of the content label against the boilerplate label: per feature,
    for the first line, and for each pair of neighbouring labels (boilerplate 0, content 1)."""
    weights: np.ndarray = field(default_factory=lambda: np.r_[1.0, np.zeros(len(FEATURES) - 1)])
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def decode(self, scores: list[float]) -> list[bool]:
        """Viterbi: the best label sequence for the lines' content scores; ties go to content."""
        (t00, t01), (t10, t11) = self.trans.tolist()
        b, c = float(self.start[0]), float(self.start[1]) + scores[0]
        back: list[tuple[bool, bool]] = []
        for s in scores[1:]:
            to_b, to_c = c + t10 >= b + t00, c + t11 >= b + t01
            back.append((to_b, to_c))
            b, c = (c + t10 if to_b else b + t00), (c + t11 if to_c else b + t01) + s
        label = c >= b
        out = [label]
        for to_b, to_c in reversed(back):
            label = to_c if label else to_b
            out.append(label)
        return out[::-1]


def line_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(features, word characters, keeps a word?, repeated lines per text) over the \\n-split lines
    of all ``texts``, in order. One pass over the bytes of the block."""
    blob = np.frombuffer("\n".join(texts).encode(), np.uint8)
    cls = _CLASS[blob]
    ends = np.append(np.flatnonzero(blob == 10), len(blob))
    starts = np.r_[0, ends[:-1] + 1]
    n = len(starts)
    count = np.zeros((n, 8))
    line_of = np.zeros(len(blob), np.int64)
    line_of[ends[:-1]] = 1
    line_of = np.cumsum(line_of)
    if len(blob):
        count = np.bincount(line_of * 8 + cls, minlength=8 * (n + 1))[:8 * n].reshape(n, 8).astype(float)
        count[1:, _SPACE] -= 1  # the newline in front counts to no line
    space = cls == _SPACE
    begin = ~space
    begin[1:] &= space[:-1]
    words = np.bincount(line_of[begin], minlength=n).astype(float)[:n] if len(blob) else np.zeros(n)
    tail = (blob & 0xC0) == 0x80  # continuation bytes: the rest are code points
    points = np.bincount(line_of[~space & ~tail], minlength=n)[:n] if len(blob) else np.zeros(n, np.int64)
    size = (ends - starts).astype(float)
    full = np.maximum(1.0, size - count[:, _SPACE])
    per = np.maximum(1.0, words)
    seen, distinct, repeats = np.zeros(n), np.ones(n), []
    at = 0
    for x in texts:
        known: set[str] = set()
        again = 0
        for line in x.split("\n"):
            if words[at]:
                distinct[at] = len(set(_WORDS.findall(line)))
                if line in known:
                    seen[at] = 1
                    again += 1
                else:
                    known.add(line)
            at += 1
        repeats.append(again)
    x = np.stack([np.ones(n), np.log1p(size) / 5, np.log1p(words) / 3, count[:, _UPPER] / full, count[:, _DIGIT] / full,
                  count[:, _SYMBOL] / full, count[:, _STOP] / full, count[:, _OTHER] / full,
                  (count[:, _UPPER] + count[:, _LOWER] + count[:, _HIGH]) / per / 10,
                  np.minimum(2, count[:, _SYMBOL] / per), np.minimum(2, count[:, _STOP] / per), 1 - distinct / per, seen], axis=1)
    return x, points, words > 0, repeats


def repeated_words(words: list[str]) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    rank = ids  # equal windows of 2, 4, 8 words get equal numbers
    width = 1
    while width < WINDOW:
        pair = rank[:-width] * (len(words) + 1) + rank[width:]
        _, rank, times = np.unique(pair, return_inverse=True, return_counts=True)
        if len(times) == len(rank):
            return 0
        width *= 2
    cover = np.zeros(len(words) + 1, np.int64)
    hit = np.flatnonzero(times[rank] > 1)
    cover[hit] += 1
    cover[hit + WINDOW] -= 1
    return int((np.cumsum(cover)[:-1] > 0).sum())


def fit_chain(docs: list[tuple[np.ndarray, int]], rounds: int = 120, rate: float = 0.2, decay: float = 1e-3) -> ChainField:
    """Maximum likelihood by forward-backward and Adam steps; ``docs`` are (features per line, label)."""
    docs = sorted((d for d in docs if len(d[0])), key=lambda d: -len(d[0]))
    if len({y for _, y in docs}) < 2:
        return ChainField()
    sizes = np.array([len(x) for x, _ in docs])
    label = np.array([y for _, y in docs])
    steps = int(sizes[0])
    alive = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(steps)]  # docs with more than t lines
    flat = np.concatenate([x for x, _ in docs])
    offset = np.r_[0, np.cumsum(sizes)[:-1]]
    share = np.array([0.5 / max(1, (label == y).sum()) for y in (0, 1)])[label]  # both classes weigh alike
    share = share / sizes
    f = len(FEATURES)
    theta = np.zeros(f + 2 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lse = lambda a: np.logaddexp(a[..., 0], a[..., 1])
    for k in range(1, rounds + 1):
        w, start, trans = theta[:f], theta[f:f + 2], theta[f + 2:].reshape(2, 2)
        score = flat @ w
        alpha = [np.stack([np.full(len(docs), start[0]), start[1] + score[offset]], 1)]
        for t in range(1, steps):
            a = alpha[-1][:alive[t]]
            nxt = lse((a[:, :, None] + trans[None]).transpose(0, 2, 1))
            nxt[:, 1] += score[offset[:alive[t]] + t]
            alpha.append(nxt)
        beta = np.zeros((len(docs), 2))
        z = np.zeros(len(docs))
        for t in range(steps - 1, -1, -1):
            done = sizes[:alive[t]] == t + 1
            z[:alive[t]][done] = lse(alpha[t][done])
        grad = np.zeros_like(theta)
        for t in range(steps - 1, -1, -1):
            n = alive[t]
            p = np.exp(alpha[t] + beta[:n] - z[:n, None])
            y = np.stack([1 - label[:n], label[:n]], 1)
            diff = (y - p) * share[:n, None]
            grad[:f] += diff[:, 1] @ flat[offset[:n] + t]
            if t == 0:
                grad[f:f + 2] += diff.sum(0)
                break
            emit = np.stack([np.zeros(n), score[offset[:n] + t]], 1) + beta[:n]
            pair = np.exp(alpha[t - 1][:n, :, None] + trans[None] + emit[:, None, :] - z[:n, None, None])
            grad[f + 2:] += ((y[:, :, None] * y[:, None, :] - pair) * share[:n, None, None]).sum(0).ravel()
            beta[:n] = lse(trans[None] + emit[:, None, :])
        grad -= decay * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return ChainField(theta[:f], theta[f:f + 2], theta[f + 2:].reshape(2, 2))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, bound: int, condition=None) -> DataFrame:
    """``(doc_id, text, y)`` of at most ``bound`` labelled documents, the first by md5 of
    the id, among those that meet ``condition`` on ``doc_id``. The sampled ids are
    at most ``bound`` rows, so they are broadcast and the texts aren't shuffled; of repeated ids one text counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    rows = rows.filter(F.col("y").isin(0, 1)) if condition is None else rows.filter(F.col("y").isin(0, 1) & condition)
    rows = rows.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(bound)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), nonnull_text().alias("text"))
    return texts.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))


def train(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCUMENTS) -> ChainField:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(2).to_pylist():
                x, _, wordy, _ = line_features([text])
                out.append(x[wordy].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["doc_id", "y", "lines"])

    session(documents)
    rows = training_rows(documents, labels, "quality", bound).mapInArrow(run, "doc_id long, y int, lines binary").collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit_chain([(np.frombuffer(r.lines, "<f4").reshape(-1, len(FEATURES)).astype(float), r.y) for r in rows])


RESULT = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
          "kept boolean, n_lines long, content_share double")


def _judge(model: ChainField, min_share: float, texts: list[str]) -> list[list]:
    """The columns of ``RESULT`` for a block of texts."""
    x, points, wordy, repeats = line_features(texts)
    scores = (x @ model.weights).tolist()
    out: list[list] = [[] for _ in range(9)]
    at = 0
    for text, again in zip(texts, repeats):
        lines = range(at, at + text.count("\n") + 1)
        at = lines.stop
        lines = [i for i in lines if wordy[i]]
        content = sum(int(points[i]) for i, good in zip(lines, model.decode([scores[i] for i in lines])) if good) if lines else 0
        words = _WORDS.findall(text)
        n, chars, rep = len(words), sum(map(len, words)), repeated_words(words)
        failed = n < MIN_WORDS or 100 * rep > MAX_REPEATED_PERCENT * n
        share = content / chars if chars else 0.0
        for col, v in zip(out, (n, chars, sum(map(text.count, SYMBOLS)), again, rep, failed,
                                not failed and share >= min_share, len(lines), share)):
            col.append(v)
    return out


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int, list[str]]]:
    """``(first, end, texts)`` of runs of about ``BLOCK_BYTES``; only a run at a time is in Python's strings."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_pylist()
    a = 0
    while a < len(sizes):
        z, size = a, 0
        while z < len(sizes) and size < BLOCK_BYTES:
            size += sizes[z]
            z += 1
        yield a, z, [x or "" for x in texts.slice(a, z - a).to_pylist()]
        a = z


def judged(documents: DataFrame, model: ChainField, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """``doc_id`` and the figures, verdict and content share of each row."""
    session(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("op2")
        for b in batches:
            for a, z, texts in _blocks(b.column(0)):
                out = _judge(model, min_share, texts)
                yield pa.RecordBatch.from_arrays([b.column(1).slice(a, z - a), *(pa.array(o, t) for o, t in zip(out, kinds))], names)

    result = T._parse_datatype_string(RESULT).fields
    names = ["doc_id", *(f.name for f in result)]
    kinds = [{"bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[f.dataType.simpleString()] for f in result]
    rows = documents.select(nonnull_text().alias("scored_text"), F.col("doc_id").cast("long").alias("doc_id"))
    return rows.mapInArrow(run, T.StructType(rows.schema.fields[1:] + result))


def keep_good(documents: DataFrame, model: ChainField, min_share: float = MIN_CONTENT_SHARE) -> DataFrame:
    """The rows that stay, with the columns of ``documents``. Rows go to Python once and only those that stay come back.
    Null and empty texts have no words and go; repeated rows are judged alike; an empty table gives an empty table."""
    session(documents)
    rows = documents.select(*[F.col(f"`{c}`").cast("string") if c == "text" else F.col(f"`{c}`").cast("long") if c == "doc_id" else F.col(f"`{c}`")
                              for c in documents.columns]).toDF(*documents.columns)
    at = documents.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("op2")
        for b in batches:
            for a, z, texts in _blocks(b.column(at)):
                yield b.slice(a, z - a).filter(pa.array(_judge(model, min_share, texts)[6], pa.bool_()))

    return rows.mapInArrow(run, rows.schema)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")))
