import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.operators import embed, manifold

KEYS = ("corpus_id", "run_key")
SCHEMA = "corpus_id string, run_key string, sentence_id long, vec array<double>"


def frame(spark, x, corpus="a", start=0):
    return spark.createDataFrame([(corpus, "abstract", start + i, [float(c) for c in r]) for i, r in enumerate(x)], SCHEMA)


def clustered(seed, n, dim, centres=20, spread=0.4):
    r = np.random.default_rng(seed)
    c = r.normal(size=(centres, dim))
    return c[r.integers(0, centres, n)] + spread * r.normal(size=(n, dim))


def test_descent_finds_the_exact_neighbours(spark):
    x = clustered(1, 900, 768)
    sparse = np.where(np.random.default_rng(2).random((400, 300)) < 0.04, 1.0, 0.0)
    pts = frame(spark, x).unionByName(frame(spark, np.pad(sparse, ((0, 0), (0, 468))), "b")).checkpoint()
    stats = []
    found = manifold.nn_descent(pts, 10, leaf=40, trees=3, stats=stats).checkpoint()
    exact = embed.knn_graph(pts, 10).checkpoint()
    assert manifold.recall(found.filter("corpus_id = 'a'"), exact.filter("corpus_id = 'a'")) > 0.9
    assert len(stats) > 1 and stats[-1] < stats[0]
    # Distances are exact, ranks are 1 to k, no point is its own neighbour; on tied distances any of the tied is right.
    both = found.join(exact.select(*KEYS, "src", "dst", F.col("distance").alias("held")), [*KEYS, "src", "dst"])
    assert both.filter("abs(distance - held) > 1e-7").count() == 0
    r = found.groupBy(*KEYS, "src").agg(F.count("*").alias("n"), F.sum("rank").alias("s"), F.count_distinct("dst").alias("u"), F.max((F.col("src") == F.col("dst")).cast("int")).alias("own"))
    assert r.filter("n <> 10 or s <> 55 or u <> 10 or own <> 0").count() == 0 and r.count() == 1300
    worst = lambda g: {(q.corpus_id, q.src): q.w for q in g.groupBy(*KEYS, "src").agg(F.max("distance").alias("w")).collect()}
    a, b = worst(found), worst(exact)
    assert sum(a[q] <= b[q] + 1e-7 for q in b) > 0.6 * len(b)


def test_descent_on_few_equal_and_no_points(spark):
    x = np.array([[1.0, 0], [1, 0], [1, 0], [0, 0], [0, 1]])
    pts = frame(spark, x).unionByName(frame(spark, x[:1], "lonely"))
    g = manifold.nn_descent(pts, 3).collect()
    assert {r.corpus_id for r in g} == {"a"} and all(sum(q.src == s for q in g) == 3 for s in range(5))
    assert sorted(round(r.distance, 6) for r in g if r.src == 0) == [0.0, 0.0, 1.0]
    assert manifold.nn_descent(frame(spark, x[:0]), 3).count() == 0


def test_fuzzy_graph_is_symmetric_and_scaled(spark):
    pts = frame(spark, clustered(3, 300, 20)).unionByName(frame(spark, clustered(4, 40, 5), "b"))
    g = embed.knn_graph(pts, 15).checkpoint()
    s = manifold.local_scales(g).collect()
    for r in s:
        total = sum(math.exp(-max(0.0, e.distance - r.rho) / r.sigma) for e in r.edges)
        assert total == pytest.approx(math.log2(15), abs=1e-9)
    w = {(r.corpus_id, r.src, r.dst): r.weight for r in manifold.fuzzy_graph(g).collect()}
    assert all(w[c, b, a] == v and 0 < v <= 1 and a != b for (c, a, b), v in w.items())
    scale = {(r.corpus_id, r.src): r for r in s}
    way = {(r.corpus_id, r.src, r.dst): math.exp(-max(0.0, r.distance - scale[r.corpus_id, r.src].rho) / scale[r.corpus_id, r.src].sigma) for r in g.collect()}
    for (c, a, b), v in w.items():
        p, q = way.get((c, a, b), 0.0), way.get((c, b, a), 0.0)
        assert v == pytest.approx(p + q - p * q, abs=1e-9)
    assert all((c, a) and any(x[:2] == (c, a) for x in w) for c, a in scale)


def test_equal_distances_have_weight_one(spark):
    g = embed.knn_graph(frame(spark, np.eye(8)), 5)
    assert {round(r.weight, 9) for r in manifold.fuzzy_graph(g, 5).collect()} == {1.0}
    same = embed.knn_graph(frame(spark, np.ones((7, 3))), 5)
    assert {round(r.weight, 9) for r in manifold.fuzzy_graph(same, 5).collect()} == {1.0}


def test_layout_keeps_neighbours_better_than_components(spark):
    """On the given vectors, started from their components; on clusters, from the graph alone; and repeatable."""
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").filter("vec_id % 2 = 0")
    pts = e.select(F.lit("a").alias("corpus_id"), F.lit("abstract").alias("run_key"), F.col("vec_id").alias("sentence_id"), F.col("embedding").cast("array<double>").alias("vec")).checkpoint()
    start = embed.reduce_dims(pts, 10, "vec").drop("vec").checkpoint()
    edges = manifold.fuzzy_graph(embed.knn_graph(pts, 15)).checkpoint()
    cols = lambda df, k: np.array([[r[f"c{i}"] for i in range(k)] for r in df.orderBy("sentence_id").collect()])
    high = np.array([r.vec for r in pts.orderBy("sentence_id").collect()])
    high = high / np.linalg.norm(high, axis=1, keepdims=True)
    y = cols(manifold.layout(edges, 10, start=start), 10)
    assert manifold.trustworthiness(high, y, 15) > manifold.trustworthiness(high, cols(start, 10), 15)
    x = clustered(5, 200, 40, 12, 0.5)
    graph = manifold.fuzzy_graph(embed.knn_graph(frame(spark, x), 10, metric="euclidean"), 10).checkpoint()
    a = cols(manifold.layout(graph, 3, epochs=6), 3)
    flat = cols(embed.reduce_dims(frame(spark, x), 3, "vec"), 3)
    assert manifold.trustworthiness(x, a, 10) > manifold.trustworthiness(x, flat, 10)
    b = cols(manifold.layout(graph.repartition(5), 3, power=2, epochs=1), 3)
    assert np.allclose(b, cols(manifold.layout(graph, 3, power=2, epochs=1), 3), atol=1e-6)


def forces(n, rows, edges, push, picks, step):
    """One epoch by its definition: ``rows`` of (point, coordinates), every edge and pick with every row of both its points."""
    total, hit = {}, lambda p: [y for q, y in rows if q == p]
    for s, y in rows:
        pull = [(2.0 / (1.0 + (t - y) @ (t - y)) * w * (t - y)) for (a, b), w in edges.items() if a == s for t in hit(b)]
        off = [(-2.0 / ((0.1 + (t - y) @ (t - y)) * (1.0 + (t - y) @ (t - y))) * push[s] * (t - y)) for p in picks[s] if p != s for t in hit(p)]
        total[s] = total.get(s, 0) + sum(pull + off)
    return [(s, y + np.clip(step * total[s], -1, 1)) for s, y in rows]


def test_layout_in_chunks_is_the_layout_by_definition(spark, monkeypatch):
    """Points in several chunks, a key of one chunk, a point with two starts and one with none; an epoch moves and writes rows of chunks, not of edges or points."""
    r = np.random.default_rng(6)
    rows, start, want = [], [], []
    for key, n in (("a", 40), ("b", 9)):
        w = {}
        for _ in range(3 * n):
            i, j = sorted(r.choice(n, 2, replace=False).tolist())
            w[i, j] = w[j, i] = float(r.uniform(0.1, 1))
        for i in range(n):
            w[i, (i + 1) % n] = w[(i + 1) % n, i] = 0.5
        rows += [(key, "abstract", 7 * i, 7 * j, v) for (i, j), v in w.items()]
        at = [(i, r.normal(size=2)) for i in [*range(1, n), 2]]  # point 0 has no start, point 2 two
        start += [(key, "abstract", 7 * i, *map(float, y)) for i, y in at]
        top = max(w.values())
        wide = math.sqrt(sum(np.var([y for _, y in at], axis=0)) / 2)
        now = [(i, y / wide * 3.0 / math.sqrt(2)) for i, y in at]
        push = [sum(v for (a, _), v in w.items() if a == i) / top for i in range(n)]
        for e in range(2):
            pick = [F.pmod(F.xxhash64("id", F.lit(j), F.lit(42 + e)), F.lit(n).cast("long")).alias(f"p{j}") for j in range(1, 6)]
            picks = [list(p) for p in spark.range(n).orderBy("id").select(*pick).collect()]
            now = forces(n, now, {k: v / top for k, v in w.items()}, push, picks, 0.05 * (1 - e / 2))
        want += [(key, 7 * i, *y) for i, y in now]
    edges = spark.createDataFrame(rows, "corpus_id string, run_key string, src long, dst long, weight double")
    first = spark.createDataFrame(start, "corpus_id string, run_key string, sentence_id long, c0 double, c1 double")
    states, kept = [], manifold.written

    def written(df, name):
        out = kept(df, name)
        if name == "layout-state":
            states.append(out.count())
        return out

    monkeypatch.setattr(manifold, "written", written)
    monkeypatch.setattr(manifold, "PART", 8)  # tiles in several parts
    for size, chunks in ((16, 4), (None, 2)):
        states.clear()
        got = sorted((x.corpus_id, x.sentence_id, x.c0, x.c1) for x in manifold.layout(edges, 2, start=first, epochs=2, chunk=size).collect())
        assert [x[:2] for x in got] == [x[:2] for x in sorted(want)]
        assert np.allclose([x[2:] for x in got], [x[2:] for x in sorted(want)], atol=1e-9)
        assert states == [chunks] * 3


def test_trustworthiness():
    x = np.random.default_rng(1).normal(size=(60, 4))
    assert manifold.trustworthiness(x, 3 * x, 5) == 1.0
    assert manifold.trustworthiness(x, np.random.default_rng(2).normal(size=(60, 4)), 5) < 0.7
