"""Ward (distributed rounds and the bounded per-key finish) and the kNN graph
against brute force on small fixtures; size filter and cluster stats."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from litspark.operators import cluster, embed, topics


def greedy_ward(X, t):
    """Brute force: repeatedly merge the globally closest pair below t."""
    groups = {i: [i] for i in range(len(X))}
    cen = {i: X[i].astype(float).copy() for i in range(len(X))}
    sz = {i: 1.0 for i in range(len(X))}
    while len(groups) > 1:
        keys = list(groups)
        C = np.array([cen[k] for k in keys])
        S = np.array([sz[k] for k in keys])
        D = ((C[:, None, :] - C[None, :, :]) ** 2).sum(-1) * (2 * S[:, None] * S[None, :] / (S[:, None] + S[None, :]))
        np.fill_diagonal(D, np.inf)
        i, j = np.unravel_index(np.argmin(D), D.shape)
        if D[i, j] >= t * t:
            break
        a, b = keys[i], keys[j]
        cen[a] = (sz[a] * cen[a] + sz[b] * cen[b]) / (sz[a] + sz[b])
        sz[a] += sz[b]
        groups[a] += groups.pop(b)
        del cen[b], sz[b]
    return sorted(sorted(g) for g in groups.values())


def blobs(seed, n, k, dup=0):
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, 3, size=(5, k))
    X = centers[rng.integers(0, 5, n)] + rng.normal(0, 0.6, size=(n, k))
    if dup:
        X[-dup:] = X[:dup]          # identical vectors (repeated sentences)
    return X


def points_frame(spark, data):
    rows = []
    for corpus, X in data.items():
        for i, x in enumerate(X):
            rows.append((corpus, "abstract", i, *map(float, x)))
    k = len(next(iter(data.values()))[0])
    cols = "corpus_id string, run_key string, sentence_id long, " + ", ".join(f"c{i} double" for i in range(k))
    return spark.createDataFrame(rows, cols)


def partitions(pdf, corpus):
    d = pdf[pdf.corpus_id == corpus]
    return sorted(sorted(g.sentence_id.tolist()) for _, g in d.groupby("cluster_id"))


def test_ward_local_and_rounds_equal_brute_force(spark):
    data = {"a": blobs(1, 60, 4, dup=5), "b": blobs(2, 45, 4)}
    pts = points_frame(spark, data)
    # one block per key; blocks smaller than a cluster; a few blocks
    for block in (512, 4, 16):
        stats = []
        got = cluster.ward(pts, 4, 2.5, block=block, stats=stats).toPandas()
        for c, X in data.items():
            assert partitions(got, c) == greedy_ward(X, 2.5), (block, c)
        assert bool(stats) == (block < 60)


def test_ward_far_groups_finish_inside_their_blocks(spark):
    rng = np.random.default_rng(5)
    X = np.concatenate([rng.normal(100 * i, 0.3, size=(30, 3)) for i in range(4)])
    stats = []
    got = cluster.ward(points_frame(spark, {"a": X}), 3, 2.0, block=30, stats=stats).toPandas()
    assert partitions(got, "a") == greedy_ward(X, 2.0) and len(stats) <= 2


def test_ward_evenly_spaced_points(spark):
    X = np.c_[np.arange(64.0), np.zeros(64)]
    stats = []
    got = cluster.ward(points_frame(spark, {"a": X}), 2, 1.2, block=8, stats=stats).toPandas()
    # Hashed ties: about a third of the pairs merge in each round, not one.
    assert len(stats) <= 8
    sizes = got.groupby("cluster_id").size()
    assert sizes.max() == 2 and (sizes == 1).sum() <= 32
    for _, g in got[got.cluster_id.isin(sizes[sizes == 2].index)].groupby("cluster_id"):
        assert abs(np.diff(sorted(g.sentence_id)))[0] == 1


def test_ward_of_spread_points_needs_few_rounds(spark):
    """Points that all lie about equally far apart: few pairs are mutual, so a chain takes over early."""
    X = np.random.default_rng(11).normal(size=(160, 24))
    X = (X / np.linalg.norm(X, axis=1)[:, None])[:, :10]
    stats = []
    got = cluster.ward(points_frame(spark, {"a": X}), 10, 1.2, block=8, stats=stats).toPandas()
    assert partitions(got, "a") == greedy_ward(X, 1.2) and 1 <= len(stats) <= 4


def test_ward_raises_when_rounds_run_out(spark):
    pts = points_frame(spark, {"a": blobs(6, 60, 3)})
    with pytest.raises(RuntimeError, match="still active"):
        cluster.ward(pts, 3, 2.5, block=8, max_rounds=1)


def test_ward_ids_by_size(spark):
    data = {"a": blobs(3, 40, 3)}
    got = cluster.ward(points_frame(spark, data), 3, 2.0).toPandas()
    sizes = got.groupby("cluster_id").size().sort_index().tolist()
    assert sizes == sorted(sizes, reverse=True)
    assert sorted(got.cluster_id.unique()) == list(range(len(sizes)))


def test_knn_graph_exact(spark):
    data = {"a": blobs(4, 80, 3), "b": blobs(5, 30, 3)}
    pts = points_frame(spark, data).select("corpus_id", "run_key", "sentence_id",
                                           F.array("c0", "c1", "c2").alias("vec"))
    got = embed.knn_graph(pts, k=5, metric="euclidean").toPandas()
    for c, X in data.items():
        D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
        np.fill_diagonal(D, np.inf)
        for i in range(len(X)):
            exp = np.lexsort((np.arange(len(X)), D[i]))[:5].tolist()
            g = got[(got.corpus_id == c) & (got.src == i)].sort_values("rank")
            assert g.dst.tolist() == exp, (c, i)


def test_drop_small_and_stats(spark):
    rows = [("c", "abstract", i, i % 10, 0 if i < 25 else 1 if i < 30 else 2) for i in range(40)]
    m = spark.createDataFrame(rows, "corpus_id string, run_key string, sentence_id long, paper_id long, cluster_id int")
    d = topics.drop_small(m, 20)
    got = {r.sentence_id: r.cluster_id for r in d.collect()}
    assert all(got[i] == 0 for i in range(25)) and all(got[i] == -1 for i in range(25, 40))
    st = topics.cluster_stats(d).first()
    assert (st.noise_count, st.n_clusters, st.sentences, st.largest) == (15, 1, 40, 25)


def test_reduce_dims_shape_and_variance_order(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(200, 12)) * np.linspace(5, 0.5, 12)
    df = spark.createDataFrame(pd.DataFrame({"sentence_id": range(200), "embedding": list(X.astype("float32"))}))
    r = embed.reduce_dims(df, 4).toPandas()
    var = [r[f"c{i}"].var() for i in range(4)]
    assert var == sorted(var, reverse=True)
    assert len(r) == 200


def test_knn_graph_blocks_prune_and_stay_exact(spark):
    rng = np.random.default_rng(11)
    X = np.c_[rng.uniform(0, 100, size=(400, 2)), rng.normal(0, 1, size=400)]
    X[:5] += 500                                   # a far-away group: needs a wide ring
    data = {"a": X}
    pts = points_frame(spark, data).select("corpus_id", "run_key", "sentence_id",
                                           F.array("c0", "c1", "c2").alias("vec"))
    stats = {}
    got = embed.knn_graph(pts, k=5, metric="euclidean", block=16, stats=stats).toPandas()
    assert stats["blocks"] >= 25 and stats["compared"] < 0.75 * len(X) ** 2
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        exp = np.lexsort((np.arange(len(X)), D[i]))[:5].tolist()
        g = got[got.src == i].sort_values("rank")
        assert g.dst.tolist() == exp, i


def test_knn_graph_ties_and_small_keys(spark):
    X = np.zeros((70, 3))
    X[40:, 0] = np.arange(30) % 3
    pts = points_frame(spark, {"a": X, "b": X[:3], "c": X[:1]}).select(
        "corpus_id", "run_key", "sentence_id", F.array("c0", "c1", "c2").alias("vec"))
    got = embed.knn_graph(pts, k=4, metric="euclidean", block=8).toPandas()
    D = np.abs(X[:, None, 0] - X[None, :, 0])
    np.fill_diagonal(D, np.inf)
    for i in range(len(X)):
        g = got[(got.corpus_id == "a") & (got.src == i)].sort_values("rank")
        assert g.dst.tolist() == np.lexsort((np.arange(len(X)), D[i]))[:4].tolist()
    assert sorted(zip(got[got.corpus_id == "b"].src, got[got.corpus_id == "b"].dst)) == [(0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)]
    assert not (got.corpus_id == "c").any()


def test_model_embedder_plug_point(spark):
    def toy_model():
        # Stand-in for a user model: loaded once per worker, encodes a batch.
        def encode(texts):
            return [[float(len(t)), float(t.count(" ")), 1.0] for t in texts]
        return encode

    emb = embed.model_embedder(toy_model, dim=3)
    df = spark.createDataFrame([(1, "a b c"), (2, "hello"), (3, None)], "sentence_id long, sentence string")
    got = {r.sentence_id: list(r.embedding) for r in embed.embed(df, "sentence", emb).collect()}
    assert got[1] == [5.0, 2.0, 1.0] and got[2] == [5.0, 0.0, 1.0] and got[3] == [0.0, 0.0, 1.0]


def test_cuts_of_one_tree_equal_runs_of_their_own(spark):
    data = {"a": blobs(21, 120, 4, dup=6), "b": blobs(22, 70, 4)}
    pts = points_frame(spark, data).checkpoint()
    tree = cluster.merge_tree(pts, 4, 4.0, block=25)
    for t in (0.3, 1.0, 1.9, 2.7, 4.0):
        got = cluster.cut_tree(*tree, t).toPandas()
        for c, X in data.items():
            assert partitions(got, c) == greedy_ward(X, t), (c, t)
    own = cluster.ward(pts, 4, 1.9, block=25).toPandas()
    cut = cluster.cut_tree(*tree, 1.9).toPandas()
    order = ["corpus_id", "run_key", "sentence_id"]
    assert own.sort_values(order).values.tolist() == cut.sort_values(order).values.tolist()


def test_certificates_fail_for_what_is_wrong(spark):
    pts = points_frame(spark, {"a": blobs(23, 90, 4)}).checkpoint()
    tree = cluster.merge_tree(pts, 4, 2.5, block=25)
    good = cluster.cut_tree(*tree, 2.5).checkpoint()
    hold = lambda a, t=2.5: cluster.ward_certificate(pts, 4, *tree, a, t, block=25).first()
    r = hold(good)
    assert (r.sentences, r.assigned, r.clusters_off, r.pairs_below_cut) == (90, 90, 0, 0) and good.select("cluster_id").distinct().count() > 1
    one = good.withColumn("cluster_id", F.lit(0))
    assert hold(one).clusters_off > 0
    fine = good.withColumn("cluster_id", F.col("sentence_id").cast("int"))
    assert hold(fine).pairs_below_cut > 0 and hold(good.unionByName(good.limit(1))).assigned == -1
    other = good.withColumn("cluster_id", F.when(F.col("sentence_id") % 7 == 0, 0).otherwise(F.col("cluster_id")))
    assert hold(other).clusters_off > 0

    import numpy as np
    r = np.random.default_rng(4)
    x = r.normal(size=(200, 6)) * [5, 4, 3, 2, 1, 0.5] @ np.linalg.qr(r.normal(size=(6, 6)))[0]
    v = spark.createDataFrame([(i, [float(c) for c in row]) for i, row in enumerate(x)], "sentence_id long, embedding array<double>")
    red = embed.reduce_dims(v, 3).checkpoint()
    fits = lambda d: [all((q.uncorrelated, q.principal, q.descending)) for q in embed.components_certificate(d, 3).orderBy("i").collect()]
    assert fits(red) == [True] * 3
    assert not any(fits(red.withColumns({f"c{i}": F.lit(0.0) for i in range(3)})))
    assert not all(fits(red.withColumns({"c0": F.col("c1"), "c1": F.col("c0")})))
    shuffled = red.withColumn("c2", F.expr("c2 * if(sentence_id % 2 = 0, 1, -1)"))
    assert not all(fits(shuffled)) and not all(fits(red.withColumn("c1", F.col("c1") * 1.01)))


def test_knn_graph_sends_blocks_once_per_tile(spark):
    """High-dimensional points, whose blocks can't be told apart: a block isn't sent once per block (F1)."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 12))
    df = spark.createDataFrame([("c", "r", i, v.tolist()) for i, v in enumerate(x)], "corpus_id string, run_key string, sentence_id long, vec array<double>")
    stats: dict = {}
    got = embed.knn_graph(df, 5, metric="euclidean", block=16, stats=stats).collect()
    assert stats["pairs"] > 20 * stats["blocks"] and stats["sent"] <= 4 * stats["blocks"]
    d = ((x[:, None] - x[None]) ** 2).sum(2)
    np.fill_diagonal(d, np.inf)
    assert {(r["src"], r["dst"]) for r in got} == {(i, int(j)) for i in range(600) for j in np.argsort(d[i])[:5]}
