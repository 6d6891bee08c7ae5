"""Clustering features for Ward: many points as few summaries (n, mean, sum of squares, ball), merged level by level (after BIRCH, Zhang,
Ramakrishnan and Livny 1996), so that a corpus of millions of points reaches the exact clustering as thousands of weighted ones.

A level sorts the summaries of every key along a space-filling curve (a range sort, so a hot key spans partitions) and cuts them into runs of
``block`` neighbours; in a run the first one left becomes an anchor and takes in all whose ball lies within the level's radius of it.
Counts, means and squares add up exactly, and a ball about an anchor never drifts. The levels' radii grow
up to ``radius``; when more than ``max_summaries`` are left, the radius doubles and they merge on, without the points.

What is exact and what is bounded:

* a merge of clusters made of whole summaries has Ward's exact height for their points;
* the merges that happen inside a summary have squared heights that halve to its ``sse``, so none is higher than sqrt(2 sse) (``inner``);
* two clusters that differ from those merged by points moved within their summaries have a height that differs by at most sqrt(2ab/(a+b)) times
  twice the largest ball of the key (``merge_errors``);
* a summary is isolated if sqrt(2 sse) is below the cut and below its distance to every other ball. Two points of different summaries are at least that
  distance apart and a merge's height is at least the distance of the means, so the greedy sequence finishes an isolated summary before it
  touches another; where all are isolated the clusters are those of the exact way (``certificate``).

Defined results: coordinates are finite, as ``reduce_dims`` gives them; points with a null key take no part, as in the block searches; equal points share a summary whatever the radius if a run holds
them; the smallest member's id names a summary; an empty table gives empty ones. Which points share a summary depends on the runs, the bounds don't."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import KEYS, ship_package
from . import blocks as B
from .cluster import DISTANCE_THRESHOLD, cut_tree, merge_tree

#: Shares of the radius that the levels reach: neighbours merge first, so runs of later levels span more of the space.
LEVELS = (0.5, 0.75, 0.875, 1.0)


def absorbed(anchor: np.ndarray, rho: np.ndarray, limit: float) -> list[np.ndarray]:
    """Which rows join: the first one left takes in every other whose ball lies within ``limit`` of its anchor."""
    sq = (anchor * anchor).sum(1)
    left = np.ones(len(anchor), dtype=bool)
    out = []
    for i in range(len(anchor)):
        if not left[i]:
            continue
        near = np.flatnonzero(left & (sq - 2 * (anchor @ anchor[i]) + sq[i] <= (1 + 1e-9) * limit * limit + 1e-9))
        near = near[np.sqrt(((anchor[near] - anchor[i]) ** 2).sum(1)) + rho[near] <= limit]
        near = np.union1d(near, [i])
        left[near] = False
        out.append(np.concatenate([[i], near[near != i]]))
    return out


def _level(entries: DataFrame, limit: float, keys, block: int) -> DataFrame:
    """One level: rows of kind ``entry`` (a summary) and ``edge`` (``id`` went into ``parent``), stored."""
    kinds = [entries.schema[c] for c in keys]
    vector = T.ArrayType(T.DoubleType())
    schema = T.StructType(kinds + [T.StructField(n, t) for n, t in (
        ("kind", T.StringType()), ("id", T.LongType()), ("parent", T.LongType()), ("n", T.LongType()), ("anchor", vector), ("mean", vector),
        ("sse", T.DoubleType()), ("rho", T.DoubleType()))])

    def merged(key, p: pd.DataFrame) -> list:
        ids, n = p["id"].to_numpy(np.int64), p["n"].to_numpy(np.int64)
        anchor, mean = np.stack(p["x"].to_numpy()).astype(float), np.stack(p["mean"].to_numpy()).astype(float)
        sse, rho = p["sse"].to_numpy(float), p["rho"].to_numpy(float)
        rows = []
        for group in absorbed(anchor, rho, limit):
            first, name = group[0], int(ids[group].min())
            w = n[group].astype(float)
            # A single summary, or equal means, keep their last bit.
            alike = (mean[group] == mean[first]).all()
            m = mean[first] if alike else (w[:, None] * mean[group]).sum(0) / w.sum()
            away = np.sqrt(((anchor[group] - anchor[first]) ** 2).sum(1))
            rows.append([*key, "entry", name, None, int(n[group].sum()), anchor[first].tolist(), m.tolist(),
                         float(sse[group].sum() + (w * ((mean[group] - m) ** 2).sum(1)).sum()), float((away + rho[group]).max())])
            rows += [[*key, "edge", int(i), name, None, None, None, None, None] for i in ids[group] if i != name]
        return rows

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, key = None, None

        def out(rows):
            return pd.DataFrame(rows, columns=schema.names).astype({"parent": "Int64", "n": "Int64"})

        for p in batches:
            for k, part in p.groupby(list(keys), sort=False, dropna=False):
                if held is not None and k != key:
                    yield out(merged(key, held))
                    held = None
                key = k
                held = part if held is None else pd.concat([held, part])
                while len(held) >= block:
                    yield out(merged(key, held.iloc[:block]))
                    held = held.iloc[block:]
                held = held if len(held) else None
        if held is not None:
            yield out(merged(key, held))

    packed = entries.select(*keys, "id", F.col("anchor").alias("x"), F.struct("n", "mean", "sse", "rho").alias("w"))
    placed = B.curve(packed, keys).select(*keys, "id", "x", "w.*", "z")
    order = [*keys, "z", "id"]
    return B.written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(run, schema), "summaries")


def summarise(points: DataFrame, k: int, radius: float, keys=KEYS, block: int = B.SIZE, max_summaries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``points(keys, sentence_id, c0..c{k-1})`` as ``(summaries, unit_map)``, both stored: ``summaries(keys, cid, n, mean, sse, ball, inner)``, ``ball`` a
    radius about the mean that holds its points, and ``unit_map(keys, sentence_id, cid)``."""
    ship_package(points.sparkSession)
    points = points.dropna(subset=list(keys))
    x = F.array(*[F.col(f"c{i}").cast("double") for i in range(k)])
    now = points.select(*keys, F.col("sentence_id").cast("long").alias("id"), F.lit(1).cast("long").alias("n"), x.alias("anchor"), x.alias("mean"),
                        F.lit(0.0).alias("sse"), F.lit(0.0).alias("rho"))
    umap = points.select(*keys, "sentence_id", F.col("sentence_id").cast("long").alias("cid"))
    while True:
        for share in LEVELS:
            out = _level(now, radius * share, keys, block)
            edges = out.filter("kind = 'edge'").select(*[F.col(c).alias(f"_{c}") for c in keys], F.col("id").alias("_id"), "parent")
            same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("cid") == F.col("_id")]
            umap = B.written(umap.join(edges, same, "left").select(*keys, "sentence_id", F.coalesce("parent", "cid").alias("cid")), "summaries-map")
            now = out.filter("kind = 'entry'").drop("kind", "parent")
        if max_summaries is None or now.count() <= max(max_summaries, now.select(*keys).distinct().count()):
            break
        radius *= 2
    away = F.sqrt(F.aggregate(F.zip_with("anchor", "mean", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda a, b: a + b))
    done = now.select(*keys, F.col("id").alias("cid"), "n", "mean", "sse", F.when(F.col("n") == 1, 0.0).otherwise((F.col("rho") + away) * (1 + 1e-12)).alias("ball"),
                      F.sqrt(2 * F.col("sse")).alias("inner"))
    return B.written(done, "summaries-done"), umap


def _units(summaries: DataFrame, k: int, keys) -> DataFrame:
    return summaries.select(*keys, "cid", F.col("n").alias("size"), *[F.col("mean")[i].alias(f"c{i}") for i in range(k)])


def certificate(summaries: DataFrame, threshold: float = DISTANCE_THRESHOLD, keys=KEYS, block: int = B.SIZE) -> DataFrame:
    """Per key ``summaries``, ``isolated`` and ``exact``: whether all are, so that the clusters equal those of the exact way."""
    s = summaries.select(*keys, "cid", "ball", "inner", F.col("mean").alias("x"))
    near = B.neighbours(B.blocks(s.select(*keys, F.col("cid").alias("id"), "x", F.lit(1.0).alias("w")), keys, block), 1, keys)
    near = near.select(*[F.col(c).alias(f"_{c}") for c in keys], "src", F.sqrt("d").alias("gap"))
    most = s.groupBy(*keys).agg(F.max("ball").alias("most")).select(*[F.col(c).alias(f"m_{c}") for c in keys], "most")
    j = s.join(near, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys] + [F.col("cid") == F.col("src")], "left")
    j = j.join(most, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in keys])
    apart = F.coalesce(F.col("gap") * (1 - 1e-9) - F.col("ball") - F.col("most"), F.lit(float("inf")))
    alone = (F.col("inner") * (1 + 1e-9) < apart) & (F.col("inner") * (1 + 1e-9) < threshold)
    return j.groupBy(*keys).agg(F.count("*").alias("summaries"), F.count_if(alone).alias("isolated")).withColumn("exact", F.col("summaries") == F.col("isolated"))


def merge_errors(summaries: DataFrame, merges: DataFrame, keys=KEYS) -> DataFrame:
    """``merges`` of the tree on ``summaries`` with ``error``: how far the height may be off for points moved within their balls."""
    most = summaries.groupBy(*keys).agg(F.max("ball").alias("most")).select(*[F.col(c).alias(f"m_{c}") for c in keys], "most")
    j = merges.join(most, [F.col(c).eqNullSafe(F.col(f"m_{c}")) for c in keys])
    scale = F.sqrt(2 * F.col("size") * F.col("parent_size") / (F.col("size") + F.col("parent_size")))
    return j.select(*merges.columns, (scale * 2 * F.col("most")).alias("error"))


def ward_summarised(points: DataFrame, k: int, radius: float, threshold: float = DISTANCE_THRESHOLD, keys=KEYS, block: int = B.SIZE,
                    max_summaries: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``cluster.ward`` on summaries: ``(keys, sentence_id, cluster_id)`` and the certificate per key."""
    s, umap = summarise(points, k, radius, keys, block, max_summaries)
    tree = merge_tree(points, k, threshold, keys, block=block, given=(_units(s, k, keys), umap))
    return cut_tree(*tree, threshold, keys), certificate(s, threshold, keys, block)
