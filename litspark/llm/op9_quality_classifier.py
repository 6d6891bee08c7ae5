"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates, scored as sparse dot products.

A text is a sequence of words and of symbol runs. Features are hashed n-grams of the
words (1 and 2; a word twice in a row is one more gram, whatever the word) and of their shapes (1 to 3; a shape is the case of a word, digits,
or the symbol run itself), each counted relative to the text's length. Training
takes at most ``TRAIN_DOCUMENTS`` labelled documents outside the held-out fold, the first by
a hash of the id, in that order; labels, language, source and id are never features.
Scoring is narrow: the weights (one fixed-size array) go to every task.

Defined results: a null or empty text has only the intercept; without usable
labels the score is 0.5; a null id is in no fold and trains nothing; repeated
rows give repeated rows; an empty table gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nonnull_text, session, table, worker_cache
from .op2_quality_rules import training_rows

TRAIN_DOCUMENTS = 6000
EPOCHS = 3
BITS = 18
THRESHOLD = 0.3
MEMO_WORDS = 400_000
SCALE = 10.0

_TOKENS = re.compile(r"[^\W_]+|[^\w\s]+|_+")


def _code(token: str, memo: dict[str, int]) -> int:
    """Hash of the token in the high half, hash of its shape in the low half."""
    if not token[0].isalnum():
        shape = token[:3]
    elif token.isdigit():
        shape = "0"
    elif len(token) > 1 and token.isupper():
        shape = "AA"
    elif token[0].isupper():
        shape = "Aa"
    else:
        shape = "a"
    if len(memo) > MEMO_WORDS:
        memo.clear()
    code = memo[token] = zlib.crc32(token.encode()) << 32 | zlib.crc32(shape.encode())
    return code


def features(text: str) -> tuple[np.ndarray, float]:
    """Indexes of all occurrences (the intercept, index 0, not among them) and the value of each."""
    tokens = _TOKENS.findall(text)
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), 0.0
    memo = worker_cache("op9", dict)
    get = memo.get
    code = np.fromiter((get(t) or _code(t, memo) for t in tokens), np.uint64, n)
    word, shape = code >> np.uint64(32), code & np.uint64(0xFFFFFFFF)
    mul, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - BITS)
    grams = [(word + np.uint64(1)) * mul, (((word[:-1] * mul) ^ word[1:]) + np.uint64(2)) * mul,
             (shape + np.uint64(3 << 33)) * mul]
    two = (shape[:-1] * mul) ^ shape[1:]
    same = np.flatnonzero(word[1:] == word[:-1])  # a word and itself again: one gram, whatever the word
    grams.append(np.full(len(same), 11, np.uint64) * mul)
    grams += [(two + np.uint64(5)) * mul, (((two[:-1] * mul) ^ shape[2:]) + np.uint64(7)) * mul]
    return np.maximum(1, np.concatenate([(g >> top).astype(np.int64) for g in grams])), SCALE / n


class FollowTheLeader:
    """FTRL-proximal logistic regression with per-coordinate rates."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z = self.z[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def step(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = (_sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def _sigmoid(a: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(a, -40, 40))))


def score(text: str, weights: np.ndarray) -> float:
    at, value = features(text)
    return _sigmoid(float(weights[0] + value * weights[at].sum()))


def held_out(doc_id="doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCUMENTS, epochs: int = EPOCHS) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = [], []
            for text in b.column(2).to_pylist():
                i, value = features(text)
                i, times = np.unique(i, return_counts=True)
                at.append(np.r_[0, i].astype("<i4").tobytes())
                x.append(np.r_[1.0, times * value].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(at, pa.binary()), pa.array(x, pa.binary())], ["doc_id", "y", "at", "x"])

    session(documents)
    fold = (F.crc32(F.col("doc_id").cast("string")) % 5) != 0
    rows = training_rows(documents, labels, "quality", bound, fold).mapInArrow(
        run, "doc_id long, y int, at binary, x binary").collect()
    if len({r.y for r in rows}) < 2:
        return np.zeros(1 << BITS, np.float32)
    rows.sort(key=lambda r: zlib.crc32(b"order" + str(r.doc_id).encode()))
    model = FollowTheLeader(1 << BITS)
    for _ in range(epochs):
        for r in rows:
            model.step(np.frombuffer(r.at, "<i4"), np.frombuffer(r.x, "<f4").astype(float), r.y)
    return model.weights().astype(np.float32)


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def classify(documents: DataFrame, weights: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    session(documents)
    shared = documents.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = shared.value
        for b in batches:
            s = [score(x.as_py() or "", w) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([int(v >= threshold) for v in s], pa.int32())],
                ["doc_id", "held_out", "score", "predicted"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                            nonnull_text().alias("text")).mapInArrow(run, SCHEMA)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))
