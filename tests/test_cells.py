import contextlib
import io
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from litspark.operators import cells, council, graph_voice, lsa, seeded_bayes


def plan(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def texts(repeated):
    """Ids come once, or several times, also the null one, in different partitions."""
    r = random.Random(4)
    rows = [(i % 7 if repeated else i, " ".join(r.choices("abcdefg", k=r.randint(0, 6))) or None) for i in range(40)]
    return rows + [(None, "a b b"), *([(None, "b zz")] if repeated else [])]


@pytest.mark.parametrize("repeated", [False, True])
def test_cells_are_counted_and_packed_as_whole_texts(spark, repeated):
    rows = texts(repeated)
    df = spark.createDataFrame(rows, "id long, text string").repartition(5)
    got, total = cells.counted(df, "id", F.split("text", " "), 2, "test")
    tf = defaultdict(Counter)
    for i, t in rows:
        tf[i].update((t or "").split())
    known = {w for w, k in Counter(w for c in tf.values() for w in c).items() if k >= 2}
    n = sum(tf.values(), Counter())
    want = {(i, w): (k, n[w]) for i, c in tf.items() for w, k in c.items() if w in known}
    held = got.collect()
    assert total == sum(n.values()) and len(held) == len(want) and {(x.id, x.term): (x.tf, x.n) for x in held} == want
    stored = cells.written(got.repartition(6, "term"), "test")   # a text's cells lie apart
    chunks = cells.packed(stored, "id", "tf", "<i4", 20)
    ids = [i for x in chunks.collect() for i in x.ids]
    assert sorted(ids, key=str) == sorted({i for i, _ in want}, key=str)
    assert [x.ids[x.nameless] for x in chunks.collect() if x.nameless >= 0] == [None]
    chunks.unpersist()


def test_rounds_leave_the_chunks_in_place(spark):
    """a product or a count over chunks shuffles the vectors they need, not the chunks."""
    df = spark.createDataFrame([(i, f"w{i % 5} w{i % 3} w{i % 2}") for i in range(60)], "sentence_key long, sentence string")
    matrix = cells.written(lsa.cells(df), "test")
    chunks = lsa.packed(matrix, cells=30)
    block = matrix.select("term").distinct().withColumn("v", F.array(F.lit(1.0), F.lit(2.0)))
    p = plan(lsa._products(chunks, block, 2))
    assert "InMemoryTableScan" in p and "Exchange hashpartitioning(chunk" not in p.split("InMemoryRelation")[0]
    chunks.unpersist()
    corpus = seeded_bayes.cells(df, id_col="sentence_key")
    packed = seeded_bayes._packed(corpus)
    assert packed.storageLevel.useDisk and not packed.storageLevel.useMemory
    packed.unpersist()


def test_grams_carry_the_counts_of_their_corpus(spark):
    """counts in the cluster and in the corpus come from one shuffle; a null corpus is one of its own, single words have no bigram."""
    rows = [(c, "r", k, t) for c in ("a", None) for k, t in ((0, "x y x y"), (1, "x y"), (1, "Z"), (-1, "x y"), (2, None), (2, " . "))]
    got = {(x.corpus_id, x.cluster_id, x.gram, x.two): (x.n, x.n_all) for x in council.gram_counts(
        spark.createDataFrame(rows, "corpus_id string, run_key string, cluster_id int, sentence string").repartition(4)).collect()}
    want = {(0, "x", False): (2, 3), (0, "y", False): (2, 3), (0, "x y", True): (2, 3), (0, "y x", True): (1, 1),
            (1, "x", False): (1, 3), (1, "y", False): (1, 3), (1, "x y", True): (1, 3), (1, "z", False): (1, 1)}
    assert got == {(c, *k): v for c in ("a", None) for k, v in want.items()}


def test_phrases_do_not_carry_their_sentence(spark):
    """the rows of a sentence's phrases hold three words each, not all of the sentence."""
    df = spark.createDataFrame([("a", "r", 0, "deep net work deep net")], "corpus_id string, run_key string, cluster_id int, sentence string")
    topic = ["corpus_id", "run_key", "cluster_id"]
    seen = []
    old, graph_voice.written = graph_voice.written, lambda d, name: (seen.append((name, plan(d))), old(d, name))[1]
    try:
        ranks = graph_voice.word_ranks(graph_voice.neighbour_words(df))
        grams, _ = graph_voice._top_phrases(df, ranks, topic, 256)
    finally:
        graph_voice.written = old
    assert "posexplode" not in dict(seen)["rank-phrases"]
    assert {tuple(x.g) for x in grams.collect()} == {("deep", "net"), ("net", "work"), ("work", "deep"), ("deep", "net", "work"), ("net", "work", "deep"), ("work", "deep", "net")}
