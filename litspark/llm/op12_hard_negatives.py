"""Hard-negative mining by segment summaries.

Vectors become integers, floor(256 x). Each vector is cut into 1, 4 and 16 segments, and for every segment the mean and
the deviation from it are stored with the vector. For two vectors a and x and any of these divisions,

    sum_j L_j mean_j(a) mean_j(x)  -+  sum_j dev_j(a) dev_j(x)        (dev: root of the summed squared deviations)

are bounds of their inner product (Cauchy and Schwarz within each segment). A search first bounds all pairs by the whole
vector's summary, then those that are left by 4 and by 16 segments, and takes the exact product of the rest only. What
is left is decided by what an answer needs: for the nearest positives the k-th best lower bound or score so far, for negatives
the window of scores that each positive allows and the k-th best score in it so far. No pair that could be in the
answer is dropped, so the answer is exact whatever the data; on data without structure the bounds leave most pairs to the exact product.

Anchors against rows: rows are dealt by hash into blocks of bounded bytes; a task holds one block while all anchors stream past it
in batches, and gives out the best of its block, k an anchor. These are merged by a ranked window. So rows
move once, anchors once per block, and nothing depends on how large a label is. Two passes: positives (rows of the anchor's label only, as
blocks are sorted by label), then negatives with the windows of the anchor's positives.

Defined results: rows with a null id, label or vector, with a null or non-finite component, or with one beyond +-2^19 (whose
products leave 64 bits) take no part; shorter vectors count as padded with zeros; repeated rows are rows of their own, a copy of an
anchor is another row; equal scores go by id, then by place in the input; an anchor without positives or a positive without negatives
gives no rows; an empty table gives an empty table; only ``vec_id``, ``label`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import session, table, written

LEVELS = (1, 4, 16)
SCALE = 256
#: Bytes of a block's exact vectors in a task.
BLOCK_BYTES = 32 << 20
TILE = 8192
BATCH = 64
#: Below this share of pairs left, pairs are looked at one by one instead of as a matrix.
SPARSE = 0.1
PAIR_VALUES = 1 << 20
LARGEST = 1 << 27
POSITIVES, NEGATIVES = 5, 10
ANCHOR_STEP, RELABEL_STEP, CLASSES = 100, 7, 10


def summary(q: np.ndarray) -> np.ndarray:
    """Means (times the root of the length) of all segments of all levels, then their deviations, a row per vector."""
    dim, means, devs = q.shape[1], [], []
    for s in (x for x in LEVELS if x <= dim):
        at = np.arange(s + 1) * dim // s
        size = np.diff(at)
        mean = np.add.reduceat(q, at[:-1], axis=1) / size
        means.append(mean * np.sqrt(size))
        devs.append(np.sqrt(np.add.reduceat((q - np.repeat(mean, size, axis=1)) ** 2, at[:-1], axis=1)))
    return np.concatenate(means + devs, axis=1) if means else np.zeros((len(q), 0))


def level_columns(dim: int) -> list[tuple[slice, slice]]:
    """Columns of the means and of the deviations of each level."""
    levels = [x for x in LEVELS if x <= dim]
    ends = np.cumsum([0, *levels]).tolist()
    return [(slice(a, b), slice(ends[-1] + a, ends[-1] + b)) for a, b in zip(ends, ends[1:])]


VECTORS = "vec_id long, label long, q binary, summary binary"


def summarised(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """``vec_id, label, uid`` with the integer vector and its summary, stored; and the dimension."""
    session(embeddings)
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    e = e.filter("vec_id is not null and label is not null and v is not null")
    dim = e.agg(F.max(F.size("v"))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = pc.list_value_length(b["v"]).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = b["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(size)), size)
            q = np.zeros((len(size), dim))
            with np.errstate(all="ignore"):
                whole = np.floor(SCALE * flat)
            fine = np.ones(len(size), bool)
            fine[row[~(np.abs(whole) <= LARGEST)]] = False
            q[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = whole
            q, keep = q[fine], pa.array(fine)
            s = summary(q).astype("<f4")
            raw = lambda x: pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.RecordBatch.from_arrays([b["vec_id"].filter(keep), b["label"].filter(keep), raw(q.astype("<i4")), raw(s)], ["vec_id", "label", "q", "summary"])

    stored = written(e.mapInArrow(run, VECTORS), "negatives-summaries")
    return written(stored.withColumn("uid", F.monotonically_increasing_id()), "negatives-vectors"), dim


class Block:
    """Rows of one block, sorted by label, as matrices."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int):
        self.dim = dim
        self.label, self.id, self.uid = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("label", "vec_id", "uid"))
        self.q, self.s = matrices(parts, dim)


def matrices(parts: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray]:
    width = 2 * sum(x for x in LEVELS if x <= dim)
    join = lambda c, kind, w: np.frombuffer(b"".join(x for p in parts for x in p[c].to_pylist()), kind).reshape(-1, w) if w else np.zeros((sum(map(len, parts)), 0))
    return join("q", "<i4", dim).astype(np.float64), join("summary", "<f4", width)


def exact(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as doubles where inner products are exact in these, else as whole numbers."""
    if not a.size or not x.size or float(np.abs(a).max()) * float(np.abs(x).max()) * a.shape[1] < 2.0 ** 53:
        return a, x
    return a.astype(np.int64), x.astype(np.int64)


def paired(a: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Inner products of rows i of a with rows j of x, a bounded part at a time."""
    part = max(1, PAIR_VALUES // max(1, a.shape[1]))
    return np.concatenate([np.einsum("pd,pd->p", a[i[n:n + part]], x[j[n:n + part]]) for n in range(0, max(1, len(i)), part)])


def bounded(block: Block, rows: slice, q: np.ndarray, s: np.ndarray, alive: np.ndarray, needed) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs ``(anchor, row)`` that the bounds leave, and their exact scores. ``needed(low, high, i, j)`` tells which
    pairs the bounds don't exclude; for matrices i and j are None."""
    xq, xs = block.q[rows], block.s[rows]
    norm = lambda m: float(np.sqrt((m * m).sum(axis=1).max())) if len(m) else 0.0
    slack = np.float32(0.5 + 1e-5 * norm(q) * norm(xq))
    pairs = None
    for mean, dev in level_columns(block.dim):
        if pairs is None:
            mid, off = s[:, mean] @ xs[:, mean].T, s[:, dev] @ xs[:, dev].T + slack
            alive &= needed(mid - off, mid + off, None, None)
            if alive.sum() < SPARSE * alive.size:
                pairs = np.nonzero(alive)
        else:
            i, j = pairs
            mid, off = paired(s[:, mean], xs[:, mean], i, j), paired(s[:, dev], xs[:, dev], i, j) + slack
            keep = needed(mid - off, mid + off, i, j)
            pairs = i[keep], j[keep]
    a, x = exact(q, xq)
    if pairs is None:
        score = a @ x.T
        i, j = np.nonzero(alive)
        return i, j, score[i, j]
    return *pairs, paired(a, x, *pairs)


def best(score: np.ndarray, ident: np.ndarray, uid: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k by score (descending), id and uid."""
    if len(score) > k:
        worst = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= worst)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((uid[at], ident[at], -score[at]))[:k]]


class Top:
    """The first k so far."""

    def __init__(self, k: int):
        self.k, self.score, self.id, self.uid = k, *(np.zeros(0, np.int64) for _ in range(3))

    def add(self, score: np.ndarray, ident: np.ndarray, uid: np.ndarray) -> None:
        s, i, u = np.append(self.score, score.astype(np.int64)), np.append(self.id, ident), np.append(self.uid, uid)
        at = best(s, i, u, self.k)
        self.score, self.id, self.uid = s[at], i[at], u[at]

    @property
    def least(self) -> float:
        """What another row must reach."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


def _kth(low: np.ndarray, alive: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest lower bound of each anchor among pairs still alive."""
    if low.shape[1] < k:
        return np.full(len(low), -np.inf)
    return np.partition(np.where(alive, low, -np.inf), low.shape[1] - k, axis=1)[:, low.shape[1] - k]


def _positives(block: Block, batch: pa.RecordBatch, dim: int, k: int) -> list[tuple]:
    """The first k rows of its label in this block for each anchor of ``batch`` (all of one label)."""
    q, s = matrices([batch], dim)
    uid, label = batch["uid"].to_numpy(), batch["label"][0].as_py()
    top = [Top(k) for _ in uid]
    first, last = np.searchsorted(block.label, label, "left"), np.searchsorted(block.label, label, "right")
    for a in range(first, last, TILE):
        rows = slice(a, min(a + TILE, last))
        alive = block.uid[rows][None, :] != uid[:, None]
        floor = np.array([t.least for t in top])

        def needed(low, high, i, j):
            if i is not None:
                return high >= floor[i]
            np.maximum(floor, _kth(low, alive, k), out=floor)
            return high >= floor[:, None]

        i, j, score = bounded(block, rows, q, s, alive, needed)
        cuts = np.searchsorted(i, np.arange(len(uid) + 1))
        for n, (x, z) in enumerate(zip(cuts, cuts[1:])):
            if x < z:
                top[n].add(score[x:z], block.id[rows][j[x:z]], block.uid[rows][j[x:z]])
    ids = batch["vec_id"].to_pylist()
    return [(u, ids[n], *x) for n, u in enumerate(uid.tolist()) for x in zip(top[n].uid.tolist(), top[n].id.tolist(), top[n].score.tolist())]


def window(positive: int, low: int, high: int) -> tuple[int, int]:
    """Least and greatest integer score with low * positive <= 100 * score <= high * positive."""
    return -((-low * positive) // 100), (high * positive) // 100


def _negatives(block: Block, batch: pa.RecordBatch, dim: int, k: int, low: int, high: int) -> list[tuple]:
    """The first k rows of other labels in this block for each window of each anchor of ``batch``."""
    q, s = matrices([batch], dim)
    label, uid = batch["label"].to_numpy(), batch["uid"].to_pylist()
    scores = batch["scores"].to_pylist()
    windows = [{p: window(p, low, high) for p in x} for x in scores]
    top = [{p: Top(k) for p, (a, z) in w.items() if a <= z} for w in windows]
    width = max([1, *map(len, top)])
    for a in range(0, len(block.label), TILE):
        rows = slice(a, a + TILE)
        alive = block.label[rows][None, :] != label[:, None]
        lows, highs = np.full((len(uid), width), np.inf, np.float32), np.full((len(uid), width), -np.inf, np.float32)
        for n, t in enumerate(top):
            for w, (p, x) in enumerate(t.items()):
                lows[n, w], highs[n, w] = max(windows[n][p][0], x.least), windows[n][p][1]

        def needed(lower, upper, i, j):
            out = np.zeros(upper.shape, bool)
            for w in range(width):
                lo, hi = (lows[:, w:w + 1], highs[:, w:w + 1]) if i is None else (lows[i, w], highs[i, w])
                out |= (upper >= lo) & (lower <= hi)
            return out

        i, j, score = bounded(block, rows, q, s, alive, needed)
        cuts = np.searchsorted(i, np.arange(len(uid) + 1))
        for n, (x, z) in enumerate(zip(cuts, cuts[1:])):
            if x == z:
                continue
            ident, own, sc = block.id[rows][j[x:z]], block.uid[rows][j[x:z]], score[x:z]
            for p, t in top[n].items():
                lo, hi = windows[n][p]
                at = np.flatnonzero((sc >= max(lo, t.least)) & (sc <= hi))
                if len(at):
                    t.add(sc[at], ident[at], own[at])
    return [(uid[n], p, *x) for n, ts in enumerate(top) for p, t in ts.items() for x in zip(t.uid.tolist(), t.id.tolist(), t.score.tolist())]


def _search(rows: DataFrame, anchors: DataFrame, blocks: int, dim: int, kernel, schema: str, by_label: bool) -> DataFrame:
    """All anchors past each block of rows. ``kernel(block, batch)`` gives result rows; with ``by_label`` a batch has one label."""
    columns = ["block", "kind", "label", "uid", "vec_id", "q", "summary", "scores"]
    r = rows.select(F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), "label", "uid", "vec_id", "q", "summary",
                    F.lit(None).cast("array<bigint>").alias("scores"))
    a = anchors.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), *columns[2:])
    kinds = {"long": pa.int64()}
    out_schema = pa.schema([(n, kinds[t]) for n, t in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, block, at = [], None, None
        for b in batches:
            where, kind, label = b["block"].to_numpy(), b["kind"].to_numpy(), b["label"].to_numpy()
            change = (where[1:] != where[:-1]) | (kind[1:] != kind[:-1])
            if by_label:
                change |= (kind[1:] == 1) & (label[1:] != label[:-1])
            for x, z in zip([0, *(np.flatnonzero(change) + 1).tolist()], [*(np.flatnonzero(change) + 1).tolist(), len(where)]):
                if where[x] != at:
                    parts, block, at = [], None, where[x]
                if kind[x] == 0:
                    parts.append(b.slice(x, z - x))
                    continue
                if block is None and parts:
                    block, parts = Block(parts, dim), []
                for i in range(x, z if block is not None else x, BATCH):
                    if out := kernel(block, b.slice(i, min(BATCH, z - i))):
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], schema=out_schema)

    return r.unionByName(a).repartition(blocks, "block").sortWithinPartitions("block", "kind", "label", "uid").mapInArrow(run, schema)


def block_count(rows: int, dim: int, parallel: int) -> int:
    """Blocks of bounded bytes, and enough of them for all cores while they hold 1,024 rows or more."""
    return max(1, -(-rows * 8 * max(dim, 1) // BLOCK_BYTES), min(-(-rows // 1024), 4 * parallel))


def hard_negatives(embeddings: DataFrame, anchor=None, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = 30, high: int = 90) -> DataFrame:
    """``embeddings(vec_id, label, embedding)`` to ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.
    ``anchor`` is a condition on ``vec_id`` and ``label``; ``low`` and ``high`` are percents of the positive's score."""
    spark = session(embeddings)
    rows, dim = summarised(embeddings)
    blocks = block_count(rows.count(), dim, spark.sparkContext.defaultParallelism)
    anchors = rows.filter(F.col("vec_id") % ANCHOR_STEP == 0 if anchor is None else anchor)
    found = _search(rows, anchors.withColumn("scores", F.lit(None).cast("array<bigint>")), blocks, dim, lambda b, x: _positives(b, x, dim, positives),
                    "anchor long, anchor_id long, positive long, positive_id long, positive_score long", True)
    nearest = Window.partitionBy("anchor").orderBy(F.desc("positive_score"), "positive_id", "positive")
    chosen = written(found.withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= positives).drop("n"), "negatives-positives")
    scores = chosen.groupBy("anchor").agg(F.collect_set("positive_score").alias("scores"))
    asked = anchors.join(scores, F.col("uid") == F.col("anchor")).drop("anchor")
    hard = _search(rows, asked, blocks, dim, lambda b, x: _negatives(b, x, dim, negatives, low, high),
                   "at long, score long, negative long, negative_id long, negative_score long", False)
    first = Window.partitionBy("at", "score").orderBy(F.desc("negative_score"), "negative_id", "negative")
    ranked = hard.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= negatives)
    return (chosen.join(ranked, (F.col("anchor") == F.col("at")) & (F.col("positive_score") == F.col("score")))
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def relabelled(embeddings: DataFrame) -> DataFrame:
    """Every seventh id with the next label, as the query asks."""
    return embeddings.withColumn("label", F.when(F.col("vec_id") % RELABEL_STEP == 0, (F.col("label") + 1) % CLASSES).otherwise(F.col("label")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")))


ORACLE = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.uid AS anchor, a.vec_id AS anchor_id, b.uid, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.uid <> b.uid),
positive AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, uid) <= 5),
negative AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor, p.uid ORDER BY n.score DESC, n.vec_id, n.uid) AS rank
  FROM positive p JOIN scored n ON p.anchor = n.anchor AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM negative WHERE rank <= 10
"""
