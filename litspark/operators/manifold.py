"""The neighbour-graph reducer: approximate neighbours, the fuzzy graph of local scales, and a layout of it.

* ``nn_descent`` (Dong, Moses and Li 2011): k nearest neighbours by looking at neighbours of neighbours. The start is a
  forest of random projection trees: for each tree the points are sorted along the cells of a few random
  projections (a range sort, so a hot key spans partitions) and cut into leaves. In a round every point brings a
  sample of its new and old neighbours, in both directions, together in one task; pairs with a new one are
  compared and reported to those two whose worst neighbour is farther. The exact search (``embed.knn_graph``) stays the default.
* ``fuzzy_graph`` (McInnes, Healy and Melville 2018): each point's distances are measured from its nearest neighbour in
  units of a local scale, found by bisection so that its weights sum to log2 k; the two directions of an edge are
  united as probabilities.
* ``layout``: a spectral start (block power iteration on the edge table), then epochs of attraction along edges and
  repulsion from seeded random points. Points lie in chunks and edges in tiles of a chunk and a chunk, packed once; in an epoch a chunk's
  coordinates go to every chunk of their key, not to every edge, and a task holds two chunks and a tile. The state is a Parquet table."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vec import dim_of
from ..session import KEYS, ship_package
from . import blocks
from .blocks import written
from .clean import sequence
from .embed import KNN_K, REDUCED_DIM

TREES = 6
LEAF = 96
SAMPLE = 10
ROUNDS = 8
#: A round that changes fewer than this share of all neighbours is the last.
UNTIL = 0.002
#: Random projections of a tree; their bits, taken in turn, are its splits.
PROJECTIONS = 6
BISECTIONS = 64
#: Points of a layout's chunk: a ``CHUNKS``th of the key's within these bounds; edges of a tile's part, about; edges looked at at once.
MIN_CHUNK, MAX_CHUNK, CHUNKS = 4096, 1 << 17, 4
PART = 1 << 18
SLICE = 1 << 15


# -- approximate neighbours ----------------------------------------------------------

def _pack(x: np.ndarray) -> bytes:
    """A vector's places that aren't zero and their values."""
    at = np.flatnonzero(x)
    return at.astype("<u4").tobytes() + x[at].astype("<f8").tobytes()


def _matrix(packed: list[bytes], dim: int) -> np.ndarray:
    out = np.zeros((len(packed), dim))
    for i, b in enumerate(packed):
        n = len(b) // 12
        out[i, np.frombuffer(b, "<u4", n)] = np.frombuffer(b, "<f8", n, 4 * n)
    return out


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows."""
    s = (x * x).sum(1)
    return np.maximum(s[:, None] + s[None] - 2 * (x @ x.T), 0)


def _schema(df: DataFrame, keys, fields: str) -> T.StructType:
    return T.StructType([df.schema[c] for c in keys] + T._parse_datatype_string(fields).fields)


def _runs(batches: Iterator[pa.RecordBatch], same: list[str], most: int | None = None) -> Iterator[tuple[pa.RecordBatch, list[tuple[int, int]]]]:
    """Sorted rows as batches with the complete runs of equal ``same`` in them, cut at ``most`` rows; a run that is still open at the end of a
    batch is carried over (with ``most`` it never gets longer than that)."""
    left: pa.RecordBatch | None = None
    for b in batches:
        if left is not None and left.num_rows:
            b = pa.Table.from_batches([left, b]).combine_chunks().to_batches()[0]
        if not b.num_rows:
            continue
        change = np.zeros(b.num_rows, bool)
        change[0] = True
        for c in same:
            code = b.column(b.schema.get_field_index(c)).dictionary_encode(null_encoding="encode").indices.to_numpy()
            change[1:] |= code[1:] != code[:-1]
        starts = np.flatnonzero(change).tolist()
        if most:
            starts = [x for a, z in zip(starts, [*starts[1:], b.num_rows]) for x in range(a, z, most)]
        yield b, list(zip(starts, starts[1:]))
        left = b.slice(starts[-1])
    if left is not None and left.num_rows:
        yield left, [(0, left.num_rows)]


def _edges(b: pa.RecordBatch, keys, src: np.ndarray, dst: np.ndarray, d: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    at = pa.array(src)
    return pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(at) for c in keys), pa.array(ids[src]), pa.array(ids[dst]), pa.array(d)],
                                      [*keys, "src", "dst", "d"])


def _collect(b: pa.RecordBatch, keys, found: list[tuple]) -> Iterator[pa.RecordBatch]:
    if found:
        ids = b.column(b.schema.get_field_index("id")).to_numpy()
        yield _edges(b, keys, *(np.concatenate(x) for x in zip(*found)), ids)


def _packed(points: DataFrame, keys, vec_col: str, id_col: str, metric: str, dim: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b["x"].flatten().to_numpy().reshape(-1, dim) if dim else np.zeros((b.num_rows, 0))
            if metric == "cosine":
                n = np.sqrt((x * x).sum(1, keepdims=True))
                x = np.divide(x, n, out=np.array(x), where=n > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([_pack(r) for r in x], pa.binary())], [*keys, "id", "v"])

    p = points.select(*keys, F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    return written(p.mapInArrow(run, _schema(points, keys, "id long, v binary")), "descent-points")


def _start(points: DataFrame, keys, dim: int, k: int, trees: int, leaf: int, seed: int) -> DataFrame:
    """``(keys, src, dst, d)``: each point's nearest within its leaf of every tree."""
    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        axes = [np.random.default_rng([seed, t]).normal(size=(dim, PROJECTIONS)) for t in range(trees)]
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                x = _matrix(part["v"].to_pylist(), dim)
                for t, axis in enumerate(axes):
                    yield pa.RecordBatch.from_arrays(
                        [*(part.column(part.schema.get_field_index(c)) for c in keys), pa.array(np.full(len(x), t, np.int32)), part["id"],
                         pa.array(list(x @ axis), pa.list_(pa.float64())), part["v"]], [*keys, "tree", "id", "x", "w"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, runs in _runs(batches, [*keys, "tree"], leaf):
            found, packed = [], b["w"].to_pylist()
            for a, z in runs:
                if z - a < 2:
                    continue
                d = _distances(_matrix(packed[a:z], dim))
                np.fill_diagonal(d, np.inf)
                m = min(k, z - a - 1)
                near = np.argpartition(d, m - 1, axis=1)[:, :m]
                row = np.repeat(np.arange(z - a), m)
                found.append((a + row, a + near.ravel(), d[row, near.ravel()]))
            yield from _collect(b, keys, found)

    # ``curve`` passes its column w on untouched: here it is the packed vector.
    projected = points.mapInArrow(project, _schema(points, keys, "tree int, id long, x array<double>, w binary"))
    order = [*keys, "tree", "z", "id"]
    cells = blocks.curve(written(projected, "descent-projected"), [*keys, "tree"], PROJECTIONS)
    return cells.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(search, _schema(points, keys, "src long, dst long, d double"))


def _nearest(edges: DataFrame, keys, k: int) -> DataFrame:
    """The first k distinct neighbours of each point by (d, dst); an edge known before stays old."""
    one = edges.groupBy(*keys, "src", "dst").agg(F.min("d").alias("d"), F.bool_and("fresh").alias("fresh"))
    first = Window.partitionBy(*keys, "src").orderBy("d", "dst")
    return one.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= k)


def nn_descent(points: DataFrame, k: int = KNN_K, keys=KEYS, vec_col: str = "vec", id_col: str = "sentence_id", metric: str = "cosine", trees: int = TREES,
               leaf: int = LEAF, sample: int = SAMPLE, rounds: int = ROUNDS, until: float = UNTIL, seed: int = 7, stats: list | None = None) -> DataFrame:
    """Approximate ``embed.knn_graph``, with its columns, for many dimensions and points; ``stats`` gets the changed neighbours of each round.

    A task holds a leaf or one point's sample (at most 4 * ``sample`` vectors); a hub that is many points' neighbour
    is sampled like any other, by a hash that changes with the round."""
    ship_package(points.sparkSession)
    dim = dim_of(points, vec_col) or 0
    p = _packed(points, keys, vec_col, id_col, metric, dim)
    graph = written(_nearest(_start(p, keys, dim, k, trees, leaf, seed).withColumn("fresh", F.lit(True)), keys, k), "descent-graph")
    total = max(1, p.count() * k)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, runs in _runs(batches, [*keys, "u"]):
            found, packed, fresh, worst = [], b["v"].to_pylist(), b["fresh"].to_numpy(zero_copy_only=False), b["worst"].to_numpy()
            for a, z in runs:
                if z - a < 2 or not fresh[a:z].any():
                    continue
                d = _distances(_matrix(packed[a:z], dim))
                near = (d < worst[a:z, None]) & (fresh[a:z, None] | fresh[None, a:z])
                np.fill_diagonal(near, False)
                i, j = np.nonzero(near)
                found.append((a + i, a + j, d[i, j]))
            yield from _collect(b, keys, found)

    for n in range(rounds):
        dealt = F.xxhash64("src", "dst", F.lit(seed + n))
        rank = lambda side: F.row_number().over(Window.partitionBy(*keys, side, "fresh").orderBy("h", "src", "dst"))
        g = graph.select(*keys, "src", "dst", "fresh", dealt.alias("h"))
        ahead = g.withColumn("r", rank("src")).filter(F.col("r") <= sample).drop("r", "h")
        behind = g.withColumn("r", rank("dst")).filter(F.col("r") <= sample).drop("r", "h")
        seen = written(ahead, "descent-ahead")
        both = seen.select(*keys, F.col("src").alias("u"), F.col("dst").alias("id"), "fresh").unionByName(
            behind.select(*keys, F.col("dst").alias("u"), F.col("src").alias("id"), "fresh"))
        both = both.groupBy(*keys, "u", "id").agg(F.bool_or("fresh").alias("fresh"))
        # A point with fewer than k neighbours takes any.
        worst = graph.groupBy(*keys, F.col("src").alias("id")).agg(F.when(F.count("*") >= k, F.max("d")).otherwise(F.lit(float("inf"))).alias("worst"))
        rows = both.join(p.join(worst, [*keys, "id"], "left").withColumn("worst", F.coalesce("worst", F.lit(float("inf")))), [*keys, "id"])
        order = [*keys, "u"]
        found = rows.repartition(*order).sortWithinPartitions(*order, "id").mapInArrow(join, _schema(points, keys, "src long, dst long, d double"))
        was = seen.filter("fresh").select(*keys, "src", "dst", F.lit(True).alias("used"))
        old = graph.join(was, [*keys, "src", "dst"], "left").select(*keys, "src", "dst", "d", (F.col("fresh") & F.col("used").isNull()).alias("fresh"))
        merged = _nearest(old.withColumn("known", F.lit(True)).unionByName(
            found.withColumns({"fresh": F.lit(True), "known": F.lit(False)})).drop("known"), keys, k)
        new = written(merged, "descent-graph")
        changed = new.join(graph.select(*keys, "src", "dst"), [*keys, "src", "dst"], "left_anti").count()
        graph = new
        if stats is not None:
            stats.append(changed)
        if changed < until * total:
            break
    out = graph.select(*keys, "src", "dst", F.sqrt("d").alias("distance"), F.col("rank").cast("int").alias("rank"))
    return out.withColumn("similarity", 1.0 - F.col("distance") * F.col("distance") / 2.0) if metric == "cosine" else out


def recall(found: DataFrame, exact: DataFrame, keys=KEYS) -> float:
    """Share of the exact neighbours that ``found`` has too."""
    cols = [*keys, "src", "dst"]
    return exact.select(cols).join(found.select(cols), cols, "left_semi").count() / max(1, exact.count())


# -- the fuzzy graph -----------------------------------------------------------------

def local_scales(graph: DataFrame, k: int = KNN_K, keys=KEYS) -> DataFrame:
    """``(keys, src, rho, sigma, edges)``: distance to the nearest other place, and the scale at which the weights
    exp(-max(0, distance - rho) / sigma) sum to log2 k (as far as halving gets; points whose neighbours are all equally near have no scale)."""
    per = graph.groupBy(*keys, "src").agg(F.array_sort(F.collect_list(F.struct("rank", "dst", "distance"))).alias("edges"))
    rho = F.coalesce(F.array_min(F.filter(F.transform("edges", lambda e: e["distance"]), lambda d: d > 0)), F.lit(0.0))
    per = per.withColumn("rho", rho)

    def weights(s: Column) -> Column:
        return F.aggregate("edges", F.lit(0.0), lambda a, e: a + F.exp(-F.greatest(F.lit(0.0), e["distance"] - F.col("rho")) / s))

    def halve(s: Column, _: Column) -> Column:
        over = weights(s["mid"]) > F.lit(math.log2(k))
        lo, hi = F.when(over, s["lo"]).otherwise(s["mid"]), F.when(over, s["mid"]).otherwise(s["hi"])
        return F.struct(lo.alias("lo"), hi.alias("hi"), F.when(hi.isNull(), lo * 2).otherwise((lo + hi) / 2).alias("mid"))

    begin = F.struct(F.lit(0.0).alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(1.0).alias("mid"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(BISECTIONS)), begin, halve)
    return per.select(*keys, "src", "rho", found["mid"].alias("sigma"), "edges")


def fuzzy_graph(graph: DataFrame, k: int = KNN_K, keys=KEYS) -> DataFrame:
    """``(keys, src, dst, weight)`` in both directions from ``knn_graph``'s columns: a + b - ab of the two directed weights. The
    pair is one group of at most two rows, so nothing is joined."""
    s = local_scales(graph, k, keys).select(*keys, "src", "rho", "sigma", F.inline("edges"))
    w = F.when((F.col("distance") <= F.col("rho")) | (F.col("sigma") == 0), 1.0).otherwise(F.exp(-(F.col("distance") - F.col("rho")) / F.col("sigma")))
    pair = s.select(*keys, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), w.alias("w")).groupBy(*keys, "a", "b").agg(
        F.max("w").alias("x"), F.when(F.count("*") > 1, F.min("w")).otherwise(0.0).alias("y"))
    both = pair.select(*keys, F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))),
                       (F.col("x") + F.col("y") - F.col("x") * F.col("y")).alias("weight"))
    return both.filter("weight > 0")


# -- the layout ----------------------------------------------------------------------

def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _summed(df: DataFrame, by: list, terms: Column, dims: int, name: str = "g") -> DataFrame:
    """Arrays added place by place, as plain sums (combined before the shuffle)."""
    t = df.select(*by, terms.alias("_t"))
    out = t.groupBy(*by).agg(*[F.sum(F.col("_t")[i]).alias(f"_{i}") for i in range(dims)])
    return out.select(*by, F.array(*[f"_{i}" for i in range(dims)]).alias(name))


def _centred(state: DataFrame, keys, dims: int, scale: float) -> DataFrame:
    """Coordinates orthogonalised (Gram and Schmidt on their sums of products, a small matrix per key), centred and scaled to ``scale``."""
    sums = state.groupBy(*keys).agg(F.count("*").alias("n"), *[F.sum(F.col("y")[i]).alias(f"s{i}") for i in range(dims)],
                                    *[F.sum(F.col("y")[i] * F.col("y")[j]).alias(f"p{i}_{j}") for i in range(dims) for j in range(i, dims)])

    def solve(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                mean = np.array([getattr(r, f"s{i}") for i in range(dims)]) / r.n
                cov = np.array([[getattr(r, f"p{min(i, j)}_{max(i, j)}") for j in range(dims)] for i in range(dims)]) / r.n - np.outer(mean, mean)
                low = np.linalg.cholesky(cov + 1e-9 * (np.trace(cov) / dims + 1e-300) * np.eye(dims))
                yield b.__class__([{**{c: getattr(r, c) for c in keys}, "mean": mean.tolist(), "turn": (scale * np.linalg.inv(low)).ravel().tolist()}])

    small = sums.mapInPandas(solve, T.StructType([state.schema[c] for c in keys] + T._parse_datatype_string("mean array<double>, turn array<double>").fields))
    y = [sum((F.col("turn")[i * dims + j] * (F.col("y")[j] - F.col("mean")[j]) for j in range(i + 1)), F.lit(0.0)) for i in range(dims)]
    return state.join(small, list(keys)).select(*keys, "id", "no", "n", F.array(*y).alias("y"))


def _spectral(norm: DataFrame, state: DataFrame, keys, dims: int, rounds: int) -> DataFrame:
    """Block power iteration: the leading vectors of the normalised edge matrix, orthogonalised every round."""
    for _ in range(rounds):
        moved = norm.join(state.select(*keys, F.col("id").alias("dst"), "y"), [*keys, "dst"])
        g = _summed(moved, [*keys, "src"], F.transform("y", lambda v: v * F.col("a")), dims).withColumnRenamed("src", "id")
        nxt = state.join(g, [*keys, "id"]).select(*keys, "id", "no", "n", F.zip_with("y", "g", lambda x, v: (x + v) / 2).alias("y"))
        state = written(_centred(nxt, keys, dims, 1.0), "layout-state")
    return state


def _copies(points: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the numbered points, and which of ``points`` each is of; a point may have several rows, or none."""
    count = bounds[points + 1] - bounds[points]
    which = np.repeat(np.arange(len(points)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + bounds[points][which]


class _Chunk:
    """A chunk's rows: their points' places in it (in order) and coordinates."""

    def __init__(self, first: int, size: int, at, y, dims: int):
        self.first, self.size = first, size
        self.at, self.y = np.frombuffer(at, "<i4"), np.frombuffer(y, "<f8").reshape(-1, dims)
        self.bounds = np.searchsorted(self.at, np.arange(size + 1))

    def push_and_pull(self, force: np.ndarray, rows: np.ndarray, other: _Chunk, points: np.ndarray, w: np.ndarray, pull: bool) -> None:
        """Adds to ``force`` what ``rows`` get from those of the other chunk's ``points``."""
        for i in range(0, len(rows), SLICE):
            which, t = _copies(points[i:i + SLICE], other.bounds)
            s = rows[i:i + SLICE][which]
            diff = other.y[t] - self.y[s]
            d2 = (diff * diff).sum(1)
            c = (2.0 / (1.0 + d2) if pull else -2.0 / ((0.1 + d2) * (1.0 + d2))) * w[i:i + SLICE][which]
            low, at = 0, self.at[s]
            if len(at):  # tiles are sorted: a slice lies in a part of the chunk
                low = int(at.min())
                for k in range(force.shape[1]):
                    g = np.bincount(at - low, c * diff[:, k])
                    force[low:low + len(g), k] += g


_STATE = "chunk int, chunks int, n long, first long, size int, at binary, w binary, y binary"
_TILE = "home int, b int, i binary, j binary, e binary"


def _chunks(state: DataFrame, sizes: DataFrame, keys) -> DataFrame:
    """``state(keys, no, n, w, y)`` as one row per chunk."""
    def packed(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("no", kind="stable")
        row = p.iloc[:1][[*keys, "chunk", "chunks", "n"]].copy()
        first = int(p["chunk"].iloc[0]) * int(p["points"].iloc[0])
        row["first"], row["size"] = first, min(int(p["points"].iloc[0]), int(p["n"].iloc[0]) - first)
        row["at"], row["w"] = [(p["no"].to_numpy() - first).astype("<i4").tobytes()], [p["w"].to_numpy("<f8").tobytes()]
        row["y"] = [np.stack(p["y"].to_numpy()).astype("<f8").tobytes()]
        return row

    dealt = state.join(sizes.select(*keys, "points", "chunks"), list(keys)).withColumn("chunk", F.floor(F.col("no") / F.col("points")).cast("int"))
    return written(dealt.groupBy(*keys, "chunk").applyInPandas(packed, _schema(state, keys, _STATE)), "layout-state")


def _tiles(pull: DataFrame, sizes: DataFrame, keys) -> DataFrame:
    """``pull(keys, src_no, dst_no, w)`` packed into rows of about ``PART`` edges from a chunk to a chunk."""
    def packed(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["i", "j"])
        return pd.DataFrame([(*key[:-1], p["i"].to_numpy("<i4").tobytes(), p["j"].to_numpy("<i4").tobytes(), p["w"].to_numpy("<f8").tobytes())],
                            columns=[*keys, "home", "b", "i", "j", "e"])

    parts = pull.groupBy(*keys).agg(F.count("*").alias("_e"))
    sized = sizes.join(parts, list(keys)).withColumn("parts", F.ceil(F.col("_e") / (F.col("chunks") * PART)).cast("int"))
    e = pull.join(sized.select(*keys, "points", "parts"), list(keys))
    place = [F.floor(F.col(f"{x}_no") / F.col("points")).cast("int").alias(y) for x, y in (("src", "home"), ("dst", "b"))]
    within = [F.pmod(F.col(f"{x}_no"), F.col("points")).cast("int").alias(y) for x, y in (("src", "i"), ("dst", "j"))]
    e = e.select(*keys, *place, F.expr("cast(pmod(xxhash64(src_no, dst_no), parts) as int)").alias("part"), *within, "w")
    return written(e.groupBy(*keys, "home", "b", "part").applyInPandas(packed, _schema(pull, keys, _TILE)), "layout-tiles")


def _epoch(state: DataFrame, tiles: DataFrame, keys, dims: int, negatives: int, seed: int, step: float) -> DataFrame:
    """``state`` after a step. A chunk's task gets its own row, then chunk by chunk of its key the coordinates and the tile's parts."""
    names = [f.split()[0] for f in _STATE.split(", ")]
    own = state.select(*keys, F.col("chunk").alias("home"), F.lit(-1).alias("b"), F.lit(0).alias("kind"), *names)
    every = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("home")
    others = state.select(*keys, every, F.col("chunk").alias("b"), F.lit(1).alias("kind"), "first", "size", "at", "y")
    rows = own.unionByName(others, True).unionByName(tiles.withColumn("kind", F.lit(2)), True)
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(tasks, *keys, "home").sortWithinPartitions(*keys, "home", "b", "kind")
    # The points that each of the chunk's is pushed off, in its order.
    pick = F.transform(F.sequence(F.lit(0).cast("long"), F.col("size").cast("long") * negatives - 1), lambda x: F.pmod(
        F.xxhash64(F.col("first") + F.floor(x / F.lit(negatives)), (F.pmod(x, F.lit(negatives).cast("long")) + 1).cast("int"), F.lit(seed)), F.col("n")))
    rows = rows.withColumn("picks", F.when((F.col("kind") == 0) & (F.col("size") * negatives > 0), pick))

    def moved(own: dict, chunk: _Chunk, force: np.ndarray) -> pa.RecordBatch:
        # Like SQL's least and greatest, these pass over what is not a number.
        y = chunk.y + np.fmax(-1.0, np.fmin(1.0, force[chunk.at] * step))
        out = {**own, "y": pa.array([y.astype("<f8").tobytes()], pa.binary())}
        return pa.RecordBatch.from_arrays([out[c] for c in (*keys, *names)], [*keys, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = chunk = other = force = key = None
        for b in batches:
            kept = {c: b.column(b.schema.get_field_index(c)) for c in b.schema.names}
            for r in range(b.num_rows):
                get = lambda c: kept[c][r].as_py()  # noqa: E731, B023
                raw = lambda c: kept[c][r].as_buffer()  # noqa: E731, B023
                kind, here = get("kind"), (*[get(c) for c in keys], get("home"))
                if kind == 0:
                    if own is not None:
                        yield moved(own, chunk, force)
                    own = {c: pa.array([get(c)], kept[c].type) for c in (*keys, *names)}
                    chunk, key, other = _Chunk(get("first"), get("size"), own["at"][0].as_buffer(), own["y"][0].as_buffer(), dims), here, None
                    force, weights = np.zeros((chunk.size, dims)), np.frombuffer(own["w"][0].as_buffer(), "<f8")
                    picks = kept["picks"][r].values.to_numpy().reshape(-1, negatives).copy() if negatives and kept["picks"][r].is_valid else np.zeros((chunk.size, 0), np.int64)
                elif here != key:  # no point of this chunk has a place
                    continue
                elif kind == 1:
                    other, number = _Chunk(get("first"), get("size"), raw("at"), raw("y"), dims), get("b")
                    theirs = picks[chunk.at]
                    hit = (theirs >= other.first) & (theirs < other.first + other.size) & (theirs != (chunk.at + chunk.first)[:, None])
                    s, at = np.nonzero(hit)
                    chunk.push_and_pull(force, s, other, theirs[s, at] - other.first, weights[s], False)
                elif other is not None and number == get("b"):
                    which, s = _copies(np.frombuffer(raw("i"), "<i4"), chunk.bounds)
                    chunk.push_and_pull(force, s, other, np.frombuffer(raw("j"), "<i4")[which], np.frombuffer(raw("e"), "<f8")[which], True)
        if own is not None:
            yield moved(own, chunk, force)

    return rows.mapInArrow(run, state.schema)


def layout(edges: DataFrame, dims: int = REDUCED_DIM, keys=KEYS, start: DataFrame | None = None, power: int = 16, epochs: int = 30, negatives: int = 5,
           rate: float = 0.05, spread: float = 3.0, seed: int = 42, chunk: int | None = None) -> DataFrame:
    """``(keys, sentence_id, c0..)`` from the symmetric ``edges(keys, src, dst, weight)``, started from ``start`` (the same columns, such as
    ``embed.reduce_dims`` gives) or from the graph's spectral coordinates. Deterministic for equal edges: random starts and
    samples come from hashes of the point's number.

    Attraction along an edge is that of the curve 1 / (1 + d^2) (a smallest distance of 0 makes both its constants about 1), times
    the edge's weight; each point is pushed off ``negatives`` random points an epoch, with the sum of its edges' weights. Steps shrink to 0.
    ``chunk`` sets the points of a chunk."""
    ship_package(edges.sparkSession)
    degree = edges.groupBy(*keys, "src").agg(F.sum("weight").alias("deg"))
    numbered = sequence(degree.select(F.struct(*keys).alias("_key"), *keys, F.col("src").alias("id"), "deg"), ["_key", "id"], "no", group_col="_key").drop("_key")
    points = written(numbered.select(*keys, "id", "deg", (F.col("no") - 1).cast("long").alias("no")), "layout-points")
    size = points.groupBy(*keys).agg(F.count("*").alias("n"))
    # Weights over the roots of both degrees: the matrix whose leading vectors are the spectral coordinates.
    d = points.select(*keys, "id", "deg", "no")
    norm = written(edges.join(d.withColumnsRenamed({"id": "src", "deg": "da", "no": "src_no"}), [*keys, "src"]).join(
        d.withColumnsRenamed({"id": "dst", "deg": "db", "no": "dst_no"}), [*keys, "dst"]).select(
        *keys, "src", "dst", "src_no", "dst_no", "weight", (F.col("weight") / F.sqrt(F.col("da") * F.col("db"))).alias("a")), "layout-edges")
    if start is None:
        unit = [F.pmod(F.xxhash64("no", F.lit(i), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20)) - 0.5 for i in range(dims)]
        state = points.join(size, list(keys)).select(*keys, "id", "no", "n", F.array(*unit).alias("y"))
        state = _spectral(norm, written(_centred(state, keys, dims, 1.0), "layout-state"), keys, dims, power)
    else:
        given = start.select(*keys, F.col("sentence_id").alias("id"), F.array(*[F.col(f"c{i}").cast("double") for i in range(dims)]).alias("y"))
        wide = given.groupBy(*keys).agg(F.greatest(F.sqrt(sum((F.var_pop(F.col("y")[i]) for i in range(dims)), F.lit(0.0)) / dims), F.lit(1e-300)).alias("s"))
        state = (points.join(size, list(keys)).join(given, [*keys, "id"]).join(wide, list(keys))
                 .select(*keys, "id", "no", "n", F.transform("y", lambda v: v / F.col("s")).alias("y")))
    state = state.withColumn("y", F.transform("y", lambda v: v * F.lit(spread / math.sqrt(dims))))
    top = norm.groupBy(*keys).agg(F.max("weight").alias("top"))
    pull = norm.join(top, list(keys)).select(*keys, "src_no", "dst_no", (F.col("weight") / F.col("top")).alias("w"))
    push = points.join(top, list(keys)).select(*keys, "id", (F.col("deg") / F.col("top")).alias("w"))
    about = F.lit(chunk) if chunk else F.greatest(F.lit(MIN_CHUNK), F.least(F.lit(MAX_CHUNK), F.ceil(F.col("n") / CHUNKS)))
    sizes = size.withColumn("points", about.cast("long")).withColumn("chunks", F.ceil(F.col("n") / F.col("points")).cast("int"))
    tiles = _tiles(pull, sizes, keys)
    state = _chunks(state.join(push, [*keys, "id"]).drop("id"), sizes, keys)
    for e in range(epochs):
        state = written(_epoch(state, tiles, keys, dims, negatives, seed + e, rate * (1 - e / epochs)), "layout-state")

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                one = lambda c: b.column(b.schema.get_field_index(c))  # noqa: E731, B023
                at, y = np.frombuffer(one("at")[r].as_buffer(), "<i4"), np.frombuffer(one("y")[r].as_buffer(), "<f8").reshape(-1, dims)
                yield pa.RecordBatch.from_arrays([*(one(c).take(pa.array(np.full(len(at), r))) for c in keys), pa.array(one("first")[r].as_py() + at.astype(np.int64)),
                                                  *(pa.array(y[:, i]) for i in range(dims))], [*keys, "no", *[f"c{i}" for i in range(dims)]])

    flat = state.mapInArrow(unpacked, _schema(points, keys, ", ".join(["no long", *[f"c{i} double" for i in range(dims)]])))
    return points.select(*keys, F.col("id").alias("sentence_id"), "no").join(flat, [*keys, "no"]).drop("no")


def trustworthiness(high: np.ndarray, low: np.ndarray, k: int) -> float:
    """Venna and Kaski's measure for a few thousand points: 1 when every near neighbour in ``low`` is one in ``high``."""
    n = len(high)
    near = lambda x: np.argsort(_distances(x) + np.diag(np.full(n, np.inf)), axis=1, kind="stable")
    rank = np.empty((n, n), int)
    order = near(high)
    rank[np.arange(n)[:, None], order] = np.arange(n)
    miss = np.maximum(0, rank[np.arange(n)[:, None], near(low)[:, :k]] - k + 1)
    return 1.0 - 2.0 * miss.sum() / (n * k * (2 * n - 3 * k - 1))
