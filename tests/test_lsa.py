import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.operators import embed, lsa, text
from litspark.sources.corpus import gen_corpus

CELLS = "sentence_key long, term string, weight double"


def dense(matrix):
    rows = matrix.collect()
    s, t = sorted({r.sentence_key for r in rows}), sorted({r.term for r in rows})
    a = np.zeros((len(s), len(t)))
    for r in rows:
        a[s.index(r.sentence_key), t.index(r.term)] += r.weight
    return a, t


@pytest.fixture(scope="module")
def matrix(spark):
    r = np.random.default_rng(3)
    low = r.normal(size=(90, 6)) * [9, 7, 5, 4, 3, 2] @ r.normal(size=(6, 40)) + 0.05 * r.normal(size=(90, 40))
    low[r.random(low.shape) < 0.3] = 0
    return spark.createDataFrame([(i, f"t{j:02}", float(low[i, j])) for i in range(90) for j in range(40) if low[i, j]], CELLS).repartition(4).checkpoint()


def test_singular_vectors_are_those_of_the_matrix(matrix):
    a, names = dense(matrix)
    terms, s = lsa.term_vectors(matrix, 8, rounds=6)
    want, v = np.linalg.svd(a, full_matrices=False)[1:]
    assert np.allclose(s[:6], want[:6], rtol=1e-3) and all(x >= y - 1e-9 for x, y in zip(s, s[1:]))
    got = {r.term: r.v for r in terms.collect()}
    x = np.array([got[t] for t in names])
    for i in range(4):
        assert abs(abs(x[:, i] @ v[i]) / s[i] - 1) < 1e-2
    c = lsa.certificate(matrix, terms, s).first()
    assert (c.sentences, c.terms) == a.shape and c.squares == pytest.approx((a * a).sum()) and c.values_fit and c.orthogonal and c.singular


def test_certificate_fails_for_other_vectors(matrix):
    terms, s = lsa.term_vectors(matrix, 8, rounds=6)
    bad = lambda t, v: (lambda c: not (c.values_fit and c.orthogonal and c.singular))(lsa.certificate(matrix, t, v).first())
    zero = F.transform("v", lambda x: x * 0.0)
    assert bad(terms.withColumn("v", zero), s) and bad(terms.withColumn("v", F.reverse("v")), s) and bad(terms, [2 * x for x in s])
    turned = F.when(F.col("term") < "t20", F.col("v")).otherwise(F.transform("v", lambda x: -x))
    assert bad(terms.withColumn("v", turned), s)


def test_vectors_keep_topics_together_better_than_counts(spark):
    """Share of sentences whose nearest other one is of the same topic, on the synthetic corpus."""
    papers = gen_corpus(spark, 16).withColumn("corpus_id", F.lit("c"))
    topic = papers.select("paper_id", "topic")
    s = text.sentence_table(text.run_text(papers, "abstract")).join(topic, "paper_id").filter("sentence_id % 3 = 0").checkpoint()

    def purity(embedder):
        e = embed.embed(s, "sentence", embedder).select("sentence_id", "topic", "sentence", "embedding").collect()
        x = np.array([r.embedding for r in e], float)
        sim = x @ x.T
        same_text = np.array([[a.sentence == b.sentence for b in e] for a in e])
        sim[same_text] = -np.inf
        return np.mean([e[i].topic == e[j].topic for i, j in enumerate(sim.argmax(1))])

    learnt, counts = purity(lambda df, col: lsa.sentence_vectors(df, col, 24, min_sentences=1)), purity(None)
    print(f"topic purity: learnt {learnt:.3f}, hashed TF-IDF {counts:.3f}")
    assert learnt >= counts - 0.02 and learnt > 0.6


def test_awkward_sentences(spark):
    rows = [(1, "alpha beta gamma"), (2, "alpha beta"), (3, None), (4, ""), (5, "... !!"), (6, "hapax"), (1, "alpha beta gamma")]
    got = lsa.sentence_vectors(spark.createDataFrame(rows, "sentence_id long, sentence string"), "sentence", 4).collect()
    assert len(got) == len(rows) and all(len(r.embedding) == 4 for r in got)
    length = {r.sentence_id: float(np.linalg.norm(r.embedding)) for r in got}
    assert length[3] == length[4] == length[5] == length[6] == 0
    assert lsa.sentence_vectors(spark.createDataFrame([], "sentence_id long, sentence string"), "sentence", 4).count() == 0


def test_products_over_chunks_equal_the_dense_ones(spark):
    """Chunks of whole sentences, each with its own terms once, multiply as the whole matrix does; a sentence without an id isn't multiplied back (F2)."""
    rng = np.random.default_rng(2)
    rows = [(i if i else None, f"t{t}", float(w)) for i in range(60) for t, w in zip(rng.choice(25, 12, replace=False), rng.normal(size=12))]
    matrix = spark.createDataFrame(rows, "sentence_key long, term string, weight double")
    a = np.zeros((60, 25))
    for i, t, w in rows:
        a[i or 0, int(t[1:])] = w
    b = rng.normal(size=(25, 4))
    block = spark.createDataFrame([(f"t{t}", v.tolist()) for t, v in enumerate(b)], "term string, v array<double>")
    chunks = lsa.packed(matrix, cells=200)
    held = chunks.select(F.size("terms").alias("n")).collect()
    assert 1 < len(held) and sum(r["n"] for r in held) < len(rows) / 4
    got = {r["term"]: r["v"] for r in lsa._products(chunks, block, 4).collect()}
    assert np.allclose([got[f"t{t}"] for t in range(25)], a[1:].T @ (a[1:] @ b))
    assert np.allclose(lsa._square(lsa._products(chunks, block, 4, gram=True), 4), (a @ b).T @ (a @ b))
