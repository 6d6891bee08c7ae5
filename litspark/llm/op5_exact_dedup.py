"""Exact deduplication by content sort.

Texts are equal when their normalised bytes (white space U+0020, U+0009-U+000D
deleted) are. Sampled splitters range-partition the normalised content, each
partition is sorted externally, so equal texts lie next to each other, and
neighbours are compared in full. A splitter holds at most ``SPLITTER_BYTES`` of content
and the digest, so splitters stay small whatever the texts are; behind them come
the length and the id, so a group of copies of any size is split over as many
partitions as its bytes need. A run of equal texts that ends within a batch is settled there.
Of the others (at the ends of batches and partitions) rows are given out as *open* at once, so
no run is held in memory; they are put together by an aggregate and a join on the digest, without their texts.

Of equal texts the row with the most code points in the original text stays, then the
smallest ``doc_id`` (null last). Defined results: null texts count as empty and are
equal to each other and to texts of white space; of repeated rows one stays;
an empty table gives an empty table; other columns are carried along by
``deduplicate`` and don't matter otherwise.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WHITE, session, table, worker_cache, written

SPLITTER_BYTES = 48
_DELETE = WHITE.encode()
DECISION = "doc_id long, uid long, n_points long, sha binary, run_size long, head_uid long, head_id long, open boolean"


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, _DELETE)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha, n_points) in front of the row: what the sort needs."""
    worker_cache("op5")
    for b in batches:
        key, sha, points = [], [], []
        for x in b.column(b.schema.get_field_index("text")):
            text = x.as_py() or ""
            norm = normalised(text)
            key.append(norm[:SPLITTER_BYTES])
            sha.append(hashlib.sha256(norm).digest())
            points.append(len(text))
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.binary()), pa.array(sha, pa.binary()), pa.array(points, pa.int64()), *b.columns],
            ["k_key", "k_sha", "k_points", *b.schema.names])


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Neighbour comparison over a sorted partition: each batch with the places where runs begin, and which rows are open: their run goes
    on from the batch before, may go on in the next one, or is the partition's first and may have begun in another."""
    last: bytes | None = None
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        first, norm = last is None, [normalised(x.as_py()) for x in b.column(b.schema.get_field_index("text"))]
        same = np.fromiter((x == y for x, y in zip([last, *norm], norm)), bool, n)
        last = norm[-1]
        del norm
        starts = np.flatnonzero(~same)
        ends = np.append(starts, n)
        is_open = np.zeros(n, bool)
        is_open[:ends[0]] = True
        if len(starts):
            is_open[starts[-1]:] = True
        if first:
            is_open[:ends[1]] = True
        yield b, starts, is_open


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row without its text; run size and ``head_id`` are null where the row is open, ``head_uid`` is the first row of its run in this batch."""
    for b, starts, is_open in _compared(batches):
        get = lambda c: b.column(b.schema.get_field_index(c))
        sizes = np.diff(np.append(starts, b.num_rows))
        before = b.num_rows - int(sizes.sum())
        first = np.r_[np.zeros(before, np.int64), np.repeat(starts, sizes)]
        yield pa.RecordBatch.from_arrays(
            [get("doc_id"), get("k_uid"), get("k_points"), get("k_sha"), pa.array(np.r_[np.zeros(before, np.int64), np.repeat(sizes, sizes)], mask=is_open),
             pc.take(get("k_uid"), pa.array(first)), pc.take(get("doc_id"), pa.array(first, mask=is_open)), pa.array(is_open)], [f.split()[0] for f in DECISION.split(", ")])


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of every run; by the sort it is the one that stays of what this partition holds."""
    for b, starts, is_open in _compared(batches):
        part = b.select([c for c in b.schema.names if c != "k_key"]).take(pa.array(starts))
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(is_open[starts])], [*part.schema.names, "k_open"])


def _sorted(documents: DataFrame, carry: bool) -> DataFrame:
    """The rows with sort keys ``k_*``, ``text`` and, with ``carry``, the other columns as ``row_<name>``, in content order."""
    session(documents)
    others = [c for c in documents.columns if c not in ("doc_id", "text")] if carry else []
    rows = documents.select(
        F.col("text").cast("string").alias("text"), *[F.col(f"`{c}`").alias(f"row_{c}") for c in others],
        F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("k_uid"))
    keyed = rows.mapInArrow(_keys, T.StructType([
        T.StructField("k_key", T.BinaryType()), T.StructField("k_sha", T.BinaryType()), T.StructField("k_points", T.LongType()),
        *rows.schema.fields]))
    order = ["k_key", "k_sha", F.col("k_points").desc(), F.col("doc_id").asc_nulls_last(), "k_uid"]
    return keyed.repartitionByRange(*order).sortWithinPartitions(*order)


def _first(points: str, uid: str):
    """Which of equal texts stays."""
    return F.min(F.struct((-F.col(points)).alias("p"), F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("i"), F.col(uid).alias("u")))


def decisions(documents: DataFrame) -> DataFrame:
    """One row per row of ``documents``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = written(_sorted(documents, False).mapInArrow(_decided, DECISION), "runs")
    # Open runs of a batch, then of a text: the rows meet the answer by their run, so a text of very many copies is many keys.
    runs = written(rows.filter("open").groupBy("head_uid", "sha").agg(_first("n_points", "uid").alias("best"), F.count("*").alias("size")), "open-runs")
    groups = runs.groupBy(F.col("sha").alias("g_sha")).agg(F.min("best").alias("best"), F.sum("size").alias("size"))
    answers = runs.select(F.col("head_uid").alias("run"), "sha").join(groups, F.col("sha") == F.col("g_sha")).select("run", "best", "size")
    some = rows.filter("open").join(answers, F.col("head_uid") == F.col("run"))
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    return (rows.filter("not open").select("doc_id", F.col("head_id").alias("keep_id"), F.col("run_size").alias("group_size"),
                                           (F.col("uid") == F.col("head_uid")).alias("kept"), sha)
            .unionByName(some.select("doc_id", F.col("best.i").alias("keep_id"), F.col("size").alias("group_size"), (F.col("uid") == F.col("best.u")).alias("kept"), sha)))


def deduplicate(documents: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``documents``. Copies are dropped in the sorting task already."""
    ranged = _sorted(documents, True)
    heads = written(ranged.mapInArrow(_heads, T.StructType([*ranged.schema.fields[1:], T.StructField("k_open", T.BooleanType())])), "heads")
    best = heads.filter("k_open").groupBy("k_sha").agg(_first("k_points", "k_uid").alias("best")).select(F.col("best.u").alias("best_uid"))
    kept = heads.filter("not k_open").unionByName(heads.join(best, (F.col("k_uid") == F.col("best_uid")) & F.col("k_open"), "left_semi"))
    return kept.select(*[F.col(c if c in ("doc_id", "text") else f"`row_{c}`").alias(c) for c in documents.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents),
r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM r
"""
