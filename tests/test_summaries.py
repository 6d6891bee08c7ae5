"""Clustering features: sums and balls recomputed from the points, and the same clusters as the exact way where the certificate says so."""

import numpy as np
import pytest

from litspark.operators import cluster, summaries as S
from test_cluster import blobs, greedy_ward, partitions, points_frame


def _held(got, umap, X, k):
    """Every summary against its points."""
    members = umap.groupby("cid").sentence_id.apply(list)
    assert sorted(i for m in members for i in m) == list(range(len(X)))
    assert set(members.index) == set(got.cid) and all(min(m) == c for c, m in members.items())
    for r in got.itertuples():
        P = X[members[r.cid]]
        assert r.n == len(P) and np.allclose(r.mean, P.mean(0), atol=1e-9)
        assert abs(r.sse - ((P - P.mean(0)) ** 2).sum()) < 1e-8 * (1 + r.sse)
        assert np.sqrt(((P - np.array(r.mean)) ** 2).sum(1)).max() <= r.ball + 1e-9


@pytest.mark.parametrize("block", [512, 16])
def test_sums_and_balls(spark, block):
    data = {"a": blobs(5, 200, 3), "b": np.repeat(np.array([[1.0, 2, 3], [4, 5, 6]]), 20, axis=0), "c": np.array([[0.0, 0, 0]])}
    s, umap = S.summarise(points_frame(spark, data), 3, 0.6, block=block)
    s, umap = s.toPandas(), umap.toPandas()
    for c, X in data.items():
        _held(s[s.corpus_id == c], umap[umap.corpus_id == c], X, 3)
    assert (s[s.corpus_id == "a"].ball <= 2 * 0.6).all() and len(s[s.corpus_id == "a"]) < len(data["a"])
    assert (s[s.corpus_id == "b"].sse == 0).all()


def test_same_clusters_where_certified(spark):
    rng = np.random.default_rng(2)
    places = rng.uniform(0, 60, size=(25, 3))
    X = np.concatenate([p + rng.normal(0, 0.01, size=(12, 3)) for p in places])
    mixed = rng.uniform(0, 0.5, size=(200, 3))  # no gaps between the balls
    got, cert = S.ward_summarised(points_frame(spark, {"far": X, "near": mixed}), 3, 0.1, 25.0, block=32)
    cert = {r["corpus_id"]: r for r in cert.collect()}
    assert cert["far"]["exact"] and cert["far"]["summaries"] == 25 and not cert["near"]["exact"]
    assert partitions(got.toPandas(), "far") == greedy_ward(X, 25.0)


def test_heights_are_those_of_the_points(spark):
    """Merges on summaries have the points' own heights, and their squares add up to the spread that the summaries left."""
    X = blobs(9, 150, 3)
    pts = points_frame(spark, {"a": X})
    s, umap = S.summarise(pts, 3, 0.5)
    umap2, merges = cluster.merge_tree(pts, 3, 1e6, given=(S._units(s, 3, S.KEYS), umap))
    e = S.merge_errors(s, merges).toPandas()
    assert len(e) == s.count() - 1 and (e.error > 0).all() and e["size"].max() + 0 < len(X)
    whole = ((X - X.mean(0)) ** 2).sum()
    assert abs(s.agg({"sse": "sum"}).first()[0] + (e.height ** 2).sum() / 2 - whole) < 1e-6 * whole
    top = e.loc[e.height.idxmax()]
    assert top["size"] + top["parent_size"] == len(X)


def test_rebuilt_when_too_many(spark):
    X = np.random.default_rng(4).uniform(0, 10, size=(600, 2))
    s, umap = S.summarise(points_frame(spark, {"a": X}), 2, 0.05, block=64, max_summaries=60)
    s, umap = s.toPandas(), umap.toPandas()
    assert 1 < len(s) <= 60
    _held(s, umap, X, 2)


def test_empty_and_null_keys(spark):
    none = spark.createDataFrame([], "corpus_id string, run_key string, sentence_id long, c0 double, c1 double")
    s, umap = S.summarise(none, 2, 0.5)
    assert s.count() == umap.count() == 0 and S.certificate(s).count() == 0
    rows = spark.createDataFrame([(c, "r", i, float(i % 2), 0.0) for c in ("a", None) for i in range(6)], none.schema)
    s, umap = S.summarise(rows, 2, 0.1)
    assert sorted(r["n"] for r in s.collect()) == [3, 3] and {r["cid"] for r in umap.collect()} == {0, 1}
