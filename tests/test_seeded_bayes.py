"""Categories learnt from seeds, against the same rounds in plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from litspark.operators import seeded_bayes as SB
from litspark.operators.taxonomy import CATEGORIES

KEYS = ("corpus_id", "run_key")
MOBILE, SECURITY, CLOUD = 9, 11, 12
WORDS = {MOBILE: ["phone", "wireless", "app", "signal", "antenna"], SECURITY: ["attack", "privacy", "breach", "cipher", "leak"],
         0: ["river", "stone", "garden", "cloudberry", "bread"]}


def _corpus(n=240, seed=3):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        c = [MOBILE, SECURITY, 0][i % 3]
        rows.append((i, " ".join(r.choice(WORDS[c]) if r.random() < 0.8 else r.choice(["results", "study", "field"]) for _ in range(9))))
    return rows


def _plain(rows, seeds, rounds):
    """Posterior of each sentence's words under the last model, and the model, by loops."""
    tf = {i: Counter(w for w in "".join(ch if ch.isalnum() else " " for ch in (t or "").lower()).split() if w not in SB.STOP_WORDS) for i, t in rows}
    df = Counter(w for c in tf.values() for w in c)
    tf = {i: {w: n for w, n in c.items() if df[w] >= 2} for i, c in tf.items()}
    tf = {i: c for i, c in tf.items() if c}
    vocabulary = sorted({w for c in tf.values() for w in c})
    seeds = {(c, w) for c, w in seeds if w in vocabulary}
    classes = [0, *sorted({c for c, _ in seeds})]
    post = {}
    for i, words in tf.items():
        hits = {c: sum(n for w, n in words.items() if (c, w) in seeds) for c in classes[1:]}
        total = sum(hits.values())
        post[i] = {c: (hits.get(c, 0) / total if total else float(c == 0)) for c in classes}
    for k in range(rounds):
        n = {(w, c): SB.SMOOTH + (SB.SEED_COUNT if (c, w) in seeds else 0.0) for w in vocabulary for c in classes}
        for i, words in tf.items():
            for w, m in words.items():
                for c in classes:
                    n[w, c] += m * post[i][c]
        total = {c: sum(n[w, c] for w in vocabulary) for c in classes}
        size = {c: sum(p[c] for p in post.values()) for c in classes}
        prior = {c: math.log((size[c] + 1) / (sum(size.values()) + len(classes))) for c in classes}

        def score(words):
            z = {c: prior[c] + sum(m * math.log(n[w, c] / total[c]) for w, m in words.items() if (w, classes[0]) in n) for c in classes}
            top = max(z.values())
            e = {c: math.exp(v - top) for c, v in z.items()}
            return {c: v / sum(e.values()) for c, v in e.items()}

        if k < rounds - 1:
            post = {i: score(words) for i, words in tf.items()}
    return classes, size, score


def _learn(spark, rows, seeds, rounds=SB.ROUNDS):
    c = SB.cells(spark.createDataFrame(rows, "sentence_id long, sentence string"))
    return c, SB.learn(c, spark.createDataFrame(seeds, "category_no int, term string"), rounds)


SEEDS = [(MOBILE, "wireless"), (MOBILE, "phone"), (SECURITY, "privacy"), (CLOUD, "nowhere"), (77, "river")]


@pytest.mark.parametrize("budget", [SB.BROADCAST_BYTES, 0])
def test_equals_plain_rounds(spark, monkeypatch, budget):
    monkeypatch.setattr(SB, "BROADCAST_BYTES", budget)
    rows = _corpus()
    cells, model = _learn(spark, rows, SEEDS, 4)
    classes, size, score = _plain(rows, [s for s in SEEDS if s[0] <= len(CATEGORIES)], 4)
    assert model.classes == classes == [0, MOBILE, SECURITY]
    assert all(abs(model.sentences[c] - size[c]) < 1e-6 for c in classes)
    by_id = defaultdict(dict)
    for r in cells.collect():
        by_id[r["sid"]][r["term"]] = r["tf"]
    got = {r["sid"]: r for r in SB.posteriors(cells, ["sid"], model).collect()}
    assert set(got) == set(by_id)
    for i, words in by_id.items():
        want = score(words)
        assert all(abs(got[i][f"p{c}"] - want[c]) < 1e-6 for c in classes)


def test_chunks_hold_whole_texts_and_move_a_row_a_term(spark, monkeypatch):
    rows = _corpus()
    cells, whole = _learn(spark, rows, SEEDS, 3)
    monkeypatch.setattr(SB, "LEAST_CELLS", 300)
    monkeypatch.setattr(SB, "MOST_CELLS", 300)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        chunks = SB._packed(cells).collect()
        cut = SB.learn(cells, spark.createDataFrame(SEEDS, "category_no int, term string"), 3)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(chunks) > 3 and sum(len(c.starts) // 8 for c in chunks) == cells.select("sid").distinct().count()
    assert sum(len(c.at) // 4 for c in chunks) == cells.count() > 5 * sum(len(c.terms) for c in chunks)
    assert all(abs(cut.sentences[c] - whole.sentences[c]) < 1e-9 for c in whole.classes)


def test_learns_words_that_are_no_seeds(spark):
    rows = _corpus()
    _, model = _learn(spark, rows, SEEDS)
    themes = spark.createDataFrame([("a", "r", "antenna signal", ["app signal app"]), ("a", "r", "cipher leak", None), ("a", "r", "bread and stone", []),
                                    ("b", "r", "unseen", ["entirely unheard"]), (None, "r", "breach", ["attack"])],
                                   "corpus_id string, run_key string, theme_name string, representative_sentences array<string>")
    got = {r["theme_name"]: r for r in SB.classify(themes.withColumn("_p", F.lit(1)).drop("_p"), model, KEYS).collect()}
    assert got["antenna signal"]["pajais_match"] == CATEGORIES[MOBILE - 1] and got["antenna signal"]["match_confidence"] > 0.9
    assert got["cipher leak"]["pajais_match"] == CATEGORIES[SECURITY - 1] == got["breach"]["pajais_match"]
    assert got["bread and stone"]["is_novel"] and got["bread and stone"]["reasoning"].startswith("texts outside")
    assert got["unseen"]["is_novel"] and got["unseen"]["reasoning"] == "no known word" and got["unseen"]["match_confidence"] == 0.0


def test_awkward_inputs(spark):
    themes = spark.createDataFrame([("a", "r", "river stone", None), ("a", "r", None, ["phone"]), ("a", "r", "", [])],
                                   "corpus_id string, run_key string, theme_name string, representative_sentences array<string>")
    for rows, seeds in (([], SEEDS), ([(1, None), (2, ""), (3, " \n")], SEEDS), (_corpus(30), [])):
        _, model = _learn(spark, rows, seeds) if seeds else (None, SB.learn(
            SB.cells(spark.createDataFrame(rows, "sentence_id long, sentence string")), spark.createDataFrame([], "category_no int, term string")))
        out = SB.classify(themes, model, KEYS).collect()
        assert len(out) == 3 and all(r["is_novel"] for r in out)


def test_seeds_of_names_and_mapped_themes(spark):
    names = {(r["category_no"], r["term"]) for r in SB.name_seeds(spark).collect()}
    assert (CLOUD, "cloud") in names and not any(t in SB.STOP_WORDS for _, t in names)
    mapped = spark.createDataFrame([("Fog computing", "Cloud Computing"), ("lost", "NOVEL"), ("none", None), (None, "Cloud Computing")],
                                   "theme_name string, pajais_match string")
    assert {tuple(r) for r in SB.mapped_seeds(mapped).collect()} == {(CLOUD, "fog"), (CLOUD, "computing")}
