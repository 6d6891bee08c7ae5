"""Exact nearest neighbours within a key over bounded blocks of points.

Points of a key are sorted along a space-filling curve over three coordinates (a range sort,
so a hot key spans partitions) and cut into blocks of at most ``size`` points. A block is one row:
its points as packed arrays, the ball that holds them and the smallest weight. A pair
of blocks is searched only if the balls are closer than the worst neighbour distance that the
points already have within their own block; neighbouring blocks form tiles, a task holds two of them and
compares each block of one with its partners in the other by a few matrix products. What the search costs beyond that is the number of pairs whose
balls cannot be told apart, which in many dimensions may be all of them.

The distance is Euclidean, or Ward's between weighted points, 2ab/(a+b) times its square; both
are recomputed pair by pair for everything within rounding of the best, so equal points
get equal distances and ties are decided by the stated order, not by rounding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import KEYS, scratch_path, ship_package

SIZE = 512
#: Points of a tile: a ``TILES``th of all within these bounds; and those that a block is compared with at once.
MIN_TILE, MAX_TILE, TILES = 1024, 16384, 8
BATCH = 4096
_BITS = 10


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def curve(points: DataFrame, keys=KEYS, dims: int = 3) -> DataFrame:
    """``points(keys, id, x, w)`` plus ``z``: the bits of the first coordinates, scaled to their range in the key, interleaved."""
    x = [F.coalesce(F.get("x", F.lit(i)), F.lit(0.0)) for i in range(dims)]
    span = points.groupBy(*keys).agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(x) for n, f in (("lo", F.min), ("hi", F.max))])
    cell = [F.floor((c - F.col(f"lo{i}")) / F.greatest(F.col(f"hi{i}") - F.col(f"lo{i}"), F.lit(1e-300)) * ((1 << _BITS) - 1)).cast("long")
            for i, c in enumerate(x)]
    z = F.lit(0).cast("long")
    for b in range(_BITS):
        for i, c in enumerate(cell):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1)).cast("long"), b * dims + i))
    return points.join(span, list(keys)).select(*keys, "id", "x", "w", z.alias("z"))


def blocks(points: DataFrame, keys=KEYS, size: int = SIZE, together: bool = False) -> DataFrame:
    """``points(keys, id long, x array<double>, w double)`` as one row per block. ``together`` (for at most ``size`` points in
    all) makes every key one block, whatever partitions the range sort would give; keys are dealt to the tasks."""
    ship_package(points.sparkSession)
    order = [*keys, "z", "id"]
    schema = T.StructType([points.schema[c] for c in keys] + [T.StructField(n, t) for n, t in (
        ("block", T.LongType()), ("n", T.LongType()), ("ids", T.BinaryType()), ("xs", T.BinaryType()), ("ws", T.BinaryType()),
        ("center", T.ArrayType(T.DoubleType())), ("radius", T.DoubleType()), ("w_min", T.DoubleType()))])

    def row(key, number, part):
        x = np.stack(part["x"].to_numpy()).astype(float)
        center = x.mean(0)
        w = part["w"].to_numpy(float)
        radius = float(np.sqrt(((x - center) ** 2).sum(1).max())) * (1 + 1e-12) + 1e-300
        return (*key, number, len(part), part["id"].to_numpy(np.int64).tobytes(), x.tobytes(), w.tobytes(), center.tolist(), radius, float(w.min()))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, held, key = TaskContext.get().partitionId() << 32, None, None
        for p in batches:
            out = []
            for k, part in p.groupby(list(keys), sort=False, dropna=False):
                if held is not None and k != key:
                    out.append(row(key, number, held))
                    number, held = number + 1, None
                key = k
                held = part if held is None else pd.concat([held, part])
                while len(held) >= size:
                    out.append(row(key, number, held.iloc[:size]))
                    number, held = number + 1, held.iloc[size:] if len(held) > size else None
                    if held is None:
                        break
            yield pd.DataFrame(out, columns=schema.names)
        if held is not None and len(held):
            yield pd.DataFrame([row(key, number, held)], columns=schema.names)

    placed = curve(points, keys)
    ordered = (placed.repartition(*keys) if together else placed.repartitionByRange(*order)).sortWithinPartitions(*order)
    return written(ordered.mapInPandas(cut, schema), "blocks")


def _arrays(r) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids = np.frombuffer(r.ids, np.int64)
    return ids, np.frombuffer(r.xs, float).reshape(len(ids), -1), np.frombuffer(r.ws, float)


def _rough(x, w, y, v, ward: bool) -> np.ndarray:
    d = np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * (x @ y.T), 0)
    return d * (2 * w[:, None] * v[None] / (w[:, None] + v[None])) if ward else d


def tie_order(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A hash of the unordered pair: equal distances are taken in this order, so that
    evenly spaced points don't merge one pair at a time."""
    lo, hi = np.minimum(i, j).astype(np.uint64), np.maximum(i, j).astype(np.uint64)
    h = lo * np.uint64(0x9E3779B97F4A7C15) + hi * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(1)).astype(np.int64)


def best(ids, x, w, other, y, v, k: int, ward: bool, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, exact distance) of each row's ``k`` nearest below ``cut``, with everything that ties."""
    rough = _rough(x, w, y, v, ward)
    slack = 1e-9 * (1 + (x * x).sum(1).max() + (y * y).sum(1).max()) * (max(w.max(), v.max()) if ward else 1.0)
    same = ids[:, None] == other[None]
    rough[same] = np.inf
    kth = np.partition(rough, min(k, rough.shape[1]) - 1, axis=1)[:, min(k, rough.shape[1]) - 1]
    r, c = np.nonzero((rough <= np.minimum(kth, cut)[:, None] + slack) & ~same)
    diff = x[r] - y[c]
    d = (diff * diff).sum(1)
    if ward:
        d = d * (2 * (w[r] * v[c]) / (w[r] + v[c]))
    keep = d < cut
    return r[keep], c[keep], d[keep]


def _first(r, order, k: int) -> np.ndarray:
    """Positions of the first ``k`` of each row in the order of the last key first."""
    at = np.lexsort((*order, r))
    start = np.r_[True, r[at][1:] != r[at][:-1]] if len(at) else np.zeros(0, bool)
    rank = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0)) if len(at) else at
    return at[rank < k]


def _tiles(blocked: DataFrame, keys, name: str, points: int) -> DataFrame:
    """``(keys, block, name)``: runs of blocks, in the order of the curve, that hold about so many points."""
    before = Window.partitionBy(*keys).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocked.select(*keys, "block", "n").select(*keys, "block", F.floor(F.coalesce(F.sum("n").over(before), F.lit(0)) / points).alias(name))


def _batches(partners: list[int], arrays: dict) -> Iterator[list]:
    """The partners' arrays, as many at a time as hold ``BATCH`` points."""
    held, n = [], 0
    for p in partners:
        held.append(arrays[p])
        n += len(arrays[p][0])
        if n >= BATCH:
            yield held
            held, n = [], 0
    if held:
        yield held


def neighbours(blocked: DataFrame, k: int, keys=KEYS, ward: bool = False, cut: float = np.inf, stats: dict | None = None, targets: DataFrame | None = None) -> DataFrame:
    """``(keys, src, dst, d, tie, w, y)`` of each point's ``k`` nearest neighbours with squared (Ward: weighted)
    distance below ``cut``, from a written ``blocks``; among ``targets`` (blocks of all points, if
    ``blocked`` holds some of them). Order: distance, then ``dst`` (Ward: hashed pair, then
    the pair). ``stats`` gets the pairs of points compared, the number of blocks and how many times a block is sent to a task."""

    def bound(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = []
            for r in p.itertuples(index=False):
                ids, x, w = _arrays(r)
                rough = _rough(x, w, x, w, ward)
                np.fill_diagonal(rough, np.inf)
                out.append(float(np.partition(rough, k - 1, axis=1)[:, k - 1].max()) if len(ids) > k else float("inf"))
            yield p.drop(columns=["ids", "xs", "ws"]).assign(bound=np.minimum(out, cut))

    meta_schema = T.StructType([f for f in blocked.schema.fields if f.name not in ("ids", "xs", "ws")] + [T.StructField("bound", T.DoubleType())])
    meta = written(blocked.mapInPandas(bound, meta_schema), "block-meta")
    names = {"block": "p_block", "center": "p_center", "radius": "p_radius", "w_min": "p_w", "n": "p_n"}
    targets = blocked if targets is None else targets
    other = targets.select(*[F.col(c).alias(f"p_{c}") for c in keys], *[F.col(a).alias(b) for a, b in names.items()])
    same_key = [F.col(c).eqNullSafe(F.col(f"p_{c}")) for c in keys]
    gap = F.greatest(F.lit(0.0), F.sqrt(F.aggregate(F.zip_with("center", "p_center", lambda a, b: (a - b) * (a - b)), F.lit(0.0),
                                                    lambda a, b: a + b)) * (1 - 1e-12) - F.col("radius") - F.col("p_radius"))
    least = gap * gap * (2 * F.col("w_min") * F.col("p_w") / (F.col("w_min") + F.col("p_w")) if ward else F.lit(1.0))
    # Blocks, not points: one small row each.
    pairs = meta.join(other, same_key).filter(least * (1 - 1e-9) <= F.col("bound")).select(
        *keys, "block", "p_block", (F.col("n") * F.col("p_n")).alias("work"))
    pairs = written(pairs, "block-pairs")
    # Neighbouring blocks form a tile on either side; a task holds two tiles, so a block travels once per tile it is searched with, not once per block.
    points = other.agg(F.sum("p_n")).first()[0] or 0
    tile_points = max(MIN_TILE, min(MAX_TILE, points // TILES))
    on_left = pairs.join(_tiles(blocked, keys, "tile", tile_points), [*keys, "block"])
    dealt = written(on_left.join(_tiles(targets, keys, "part", tile_points).withColumnRenamed("block", "p_block"), [*keys, "p_block"]).groupBy(
        *keys, "tile", "part", "block").agg(F.collect_list("p_block").alias("with")), "block-tiles")
    body = ["ids", "xs", "ws"]
    left = dealt.join(blocked.select(*keys, "block", *body), [*keys, "block"])
    if stats is not None:
        s = pairs.agg(F.sum("work"), F.count("*"), F.count_distinct("block")).first()
        sent = dealt.select(*keys, "tile", "part", F.explode("with").alias("block")).distinct().count() + dealt.count()
        stats.update(compared=s[0] or 0, pairs=s[1], blocks=s[2], sent=sent)
    right = dealt.select(*keys, "tile", "part", F.explode("with").alias("block")).distinct().join(targets.select(*keys, "block", *body), [*keys, "block"])
    rows = left.select(*keys, "tile", "part", "block", "with", *body).unionByName(
        right.select(*keys, "tile", "part", "block", F.lit(None).cast("array<bigint>").alias("with"), *body))
    out_schema = T.StructType([blocked.schema[c] for c in keys] + [T.StructField(n, t) for n, t in (
        ("src", T.LongType()), ("dst", T.LongType()), ("d", T.DoubleType()), ("tie", T.LongType()), ("w", T.DoubleType()), ("y", T.ArrayType(T.DoubleType())))])

    def search(p: pd.DataFrame) -> pd.DataFrame:
        own = p["with"].notna().to_numpy()
        others = {r.block: _arrays(r) for r in p[~own].itertuples(index=False)}
        outs = []
        for r in p[own].itertuples(index=False):
            ids, x, w = _arrays(r)
            found = []
            for many in _batches(sorted(r[p.columns.get_loc("with")]), others):
                other_ids, y, v = (np.concatenate(f) for f in zip(*many))
                a, c, d = best(ids, x, w, other_ids, y, v, k, ward, cut)
                found.append((a, other_ids[c], d, v[c], y[c] if ward else c))
            a, dst, d, v, y = (np.concatenate(f) for f in zip(*found))
            tie = tie_order(ids[a], dst) if ward else np.zeros(len(a), np.int64)
            at = _first(a, (dst, tie, d), k)
            outs.append((ids[a[at]], dst[at], d[at], tie[at], v[at], y[at]))
        src, dst, d, tie, w, y = (np.concatenate(f) for f in zip(*outs))
        out = pd.DataFrame({"src": src, "dst": dst, "d": d, "tie": tie, "w": w, "y": pd.Series(y.tolist() if ward else [None] * len(src), dtype=object)})
        for c in reversed(keys):
            out.insert(0, c, p[c].iloc[0])
        return out

    found = rows.groupBy(*keys, "tile", "part").applyInPandas(search, out_schema)
    if k == 1:
        # The pair as (smaller, larger) id decides what the hash doesn't.
        pick = F.min(F.struct("d", "tie", F.least("src", "dst").alias("lo"), F.greatest("src", "dst").alias("hi"), "dst", "w", "y")).alias("m")
        return found.groupBy(*keys, "src").agg(pick).select(*keys, "src", "m.*")
    rank = F.row_number().over(Window.partitionBy(*keys, "src").orderBy("d", "dst"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(*keys, "src", "dst", "d", "rank")
