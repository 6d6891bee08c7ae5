import random

from .helpers import awkward, documents
from .test_dedup_join import LOWER, WORDS, near_copies

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def kept_ids(rows):
    """The smallest id of each component of links at five words and 0.8, over all pairs."""
    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if s[i] and s[j] and 10 * len(s[i] & s[j]) >= 8 * len(s[i] | s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (doc, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), doc), doc)
    return sorted(low.values())


def test_stage_joins_near_copies_at_five_words_and_four_fifths(spark):
    import corpus_pipeline as p

    r = random.Random(8)
    rows = near_copies(5, 6, 8, 50) + [(i, t) for i, t, *_ in awkward() if i in (8, 9, 10, 11)]
    for k in range(30):  # two words changed in the middle of 90 to 150: similarities around 0.8 to 0.9
        words = [f"u{r.randint(0, 5000)}" for _ in range(r.randint(90, 150))]
        other = list(words)
        other[40], other[60] = "x", "y"
        rows += [(3000 + 2 * k, " ".join(words)), (3001 + 2 * k, " ".join(other))]
    got = p.ngram_join(spark, documents(spark, rows), SF)
    assert got.columns == documents(spark, []).columns
    assert sorted(d.doc_id for d in got.collect()) == kept_ids(rows)


def test_stage_on_the_table(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(d.doc_id for d in p.ngram_join(spark, docs, SF).select("doc_id").collect())
    assert got == kept_ids([tuple(d) for d in docs.select("doc_id", "text").collect()])
