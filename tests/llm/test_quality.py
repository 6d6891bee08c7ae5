import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import op2_quality_rules as op2
from litspark.llm import op9_quality_classifier as op9

from .helpers import awkward, documents

SF = "/root/testdata/sf0.1"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute_base(text):
    words = WORDS.findall(text or "")
    windows = {}
    for i in range(len(words) - 7):
        windows.setdefault(tuple(words[i:i + 8]), []).append(i)
    repeat = {i + k for v in windows.values() if len(v) > 1 for i in v for k in range(8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(repeat), n < 20 or 100 * len(repeat) > 30 * n)


def test_base_figures(spark):
    r = random.Random(1)
    texts = ["\n".join(" ".join(r.choice("ab c# é|x".split(" ")) for _ in range(r.randint(0, 9))) for _ in range(r.randint(1, 9))) for _ in range(150)]
    rows = awkward() + [(100 + i, t) for i, t in enumerate(texts)]
    got = op2.judged(documents(spark, rows), op2.ChainField()).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or -1, *tuple(r)[1:7]) for r in got) == sorted((d or -1, *brute_base(t)) for d, t, *_ in rows)
    assert all(r.kept == (not r.base_failed) for r in got)  # an untrained field takes every line as content
    assert op2.judged(documents(spark, []), op2.ChainField()).count() == 0


def test_line_features_do_not_depend_on_the_block():
    texts = ["a b\n\nC# D", "", "x", "été 漢字.\n \n12\n"]
    x, points, wordy, repeats = op2.line_features(texts)
    alone = [op2.line_features([t]) for t in texts]
    assert np.allclose(x, np.concatenate([a[0] for a in alone]))
    assert points.tolist() == [p for a in alone for p in a[1]] == [2, 0, 3, 0, 1, 6, 0, 2, 0]
    assert wordy.tolist() == [p for a in alone for p in a[2]]


def test_viterbi_is_the_best_of_all_labellings():
    r = np.random.default_rng(2)
    for n in range(1, 9):
        model = op2.ChainField(start=r.normal(size=2), trans=r.normal(size=(2, 2)))
        scores = r.normal(size=n)
        value = lambda y: model.start[y[0]] + sum(scores[i] * y[i] for i in range(n)) + sum(model.trans[a, b] for a, b in zip(y, y[1:]))
        best = max(itertools.product((0, 1), repeat=n), key=value)
        assert model.decode(scores.tolist()) == [bool(b) for b in best]


def test_training_gradient_reaches_the_labels():
    r = np.random.default_rng(3)
    docs = []
    for i in range(60):
        x = np.zeros((r.integers(1, 12), len(op2.FEATURES)))
        x[:, 0] = 1
        x[:, 5] = (i % 2 == 0) * r.uniform(0.2, 0.4, len(x))
        docs.append((x, i % 2))
    model = op2.fit_chain(docs)
    right = [(np.mean(model.decode((x @ model.weights).tolist())) > 0.5) == bool(y) for x, y in docs]
    assert np.mean(right) > 0.95
    assert np.array_equal(op2.fit_chain([d for d in docs if d[1]]).weights, op2.ChainField().weights)


def test_verdicts_on_documents_not_trained_on(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = op2.train(docs, labels.filter("doc_id % 2 = 0"))
    held = op2.judged(docs, model).join(labels.filter("doc_id % 2 = 1"), "doc_id").toPandas()
    good, bad = held[held.quality == 1], held[held.quality == 0]
    long_enough = good[~good.base_failed]
    assert long_enough.kept.mean() > 0.98 and bad.kept.mean() < 0.1
    kept = op2.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == op2.judged(docs, model).filter("kept").count()


def test_training_without_usable_labels(spark):
    docs = documents(spark, awkward())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert np.array_equal(op2.train(docs, none).weights, op2.ChainField().weights)
    assert not op9.train(docs, none).any()
    one = spark.createDataFrame([(4, 1, 0), (None, 0, 0), (9, None, None)], "doc_id long, quality int, toxic int")
    assert not op9.train(docs, one).any()


def test_training_sample_is_bounded_and_uses_one_text_per_id(spark):
    docs = documents(spark, awkward())
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 14)] * 2, "doc_id long, quality int, toxic int")
    rows = op2.training_rows(docs, labels, "quality", 5).collect()
    assert len(rows) == 5 and len({r.doc_id for r in rows}) == 5


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0


@pytest.fixture(scope="module")
def classified(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    weights = op9.train(docs, labels)
    return docs, labels, weights, op9.classify(docs, weights).join(labels, "doc_id", "left").toPandas()


def test_classifier_on_the_held_out_fold(classified):
    p = classified[3]
    h = p[p.held_out & p.quality.notna()]
    assert len(h) > 500
    pos, neg = h[h.quality == 1].score.to_numpy(), h[h.quality == 0].score.to_numpy()
    auc = (pos[:, None] > neg[None]).mean()
    assert auc > 0.99 and (h.predicted == h.quality).mean() > 0.97
    assert (p.predicted == (p.score >= 0.3)).all() and p.score.between(0, 1).all()
    assert [held_out(int(d)) for d in p.doc_id] == p.held_out.tolist()


def test_held_out_labels_and_other_columns_are_never_used(classified):
    docs, labels, weights, _ = classified
    other = labels.withColumn("quality", F.when(op9.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(op9.train(docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("y")), other), weights)


def test_classifier_edges(spark):
    weights = np.zeros(1 << op9.BITS, np.float32)
    rows = op9.classify(documents(spark, awkward()), weights).collect()
    assert len(rows) == len(awkward()) and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    assert all(r.held_out == held_out(r.doc_id) for r in rows)
    assert op9.classify(documents(spark, []), weights).count() == 0


def test_sparse_score_is_the_dot_product():
    r = np.random.default_rng(4)
    w = r.normal(size=1 << op9.BITS).astype(np.float32)
    at, value = op9.features("Some words, SOME WORDS!! 12 | x | x")
    dense = np.zeros(1 << op9.BITS)
    np.add.at(dense, at, value)
    dense[0] += 1
    assert abs(op9.score("Some words, SOME WORDS!! 12 | x | x", w) - 1 / (1 + np.exp(-dense @ w))) < 1e-4
