import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from litspark.llm import common
from litspark.llm import op5_exact_dedup as op5
from litspark.llm import op6_ngram_join as op6

from .helpers import awkward, documents, rows_of, same_as_sql

WHITE = re.compile(r"[\x20\x09-\x0D]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def brute_dedup(rows):
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(WHITE.sub("", text or ""), []).append((-len(text or ""), doc is None, doc or 0, doc))
    out = []
    for norm, members in groups.items():
        best = min(members)[3]
        out += [(m[3], best, len(members), hashlib.sha256(norm.encode()).hexdigest()) for m in members]
    return sorted(out, key=repr)


def test_exact_dedup(spark):
    # A group of copies that spans partitions, of several lengths.
    rows = awkward() + [(100 + i, "copied text " + " " * (i % 7)) for i in range(900)] + [(5000, "copied  text"), (5001, "y")]
    got = op5.decisions(documents(spark, rows).repartition(5)).collect()
    assert sorted((tuple(r[:3]) + (r.text_sha256,) for r in got), key=repr) == brute_dedup(rows)
    kept = [r for r in got if r.kept]
    assert len(kept) == len({r.text_sha256 for r in got}) and all(r.doc_id == r.keep_id for r in kept)
    stay = op5.deduplicate(documents(spark, rows))
    assert stay.columns == documents(spark, []).columns
    assert sorted(map(repr, (r.doc_id for r in stay.collect()))) == sorted(map(repr, (r.doc_id for r in kept)))
    assert all(r.row_text == "clash" and r.uid == 7 for r in stay.collect())


def test_exact_dedup_is_its_sql_and_handles_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got, want = same_as_sql(op5.decisions(docs), op5.ORACLE, documents=docs)
    assert got == want
    assert op5.decisions(documents(spark, [])).count() == 0 and op5.deduplicate(documents(spark, [])).count() == 0


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())


def linked(a, b):
    return bool(a) and bool(b) and 100 * len(a & b) >= 85 * len(a | b)


def brute_components(rows):
    s = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if linked(s[i], s[j]):
                root[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s[i]), low.get(find(i))) for i, r in enumerate(rows)), key=repr)


def near_copies(seed, families, size, length):
    """Families of near copies: each a chain of small edits of the one before or of the first."""
    r = random.Random(seed)
    rows, k = [], 1000
    for f in range(families):
        first = [f"w{r.randint(0, 400)}" for _ in range(length)]
        last = first
        for _ in range(size):
            words = list(r.choice([first, last]))
            for _ in range(r.randint(0, 3)):
                words[r.randrange(length)] = f"v{r.randint(0, 99)}"
            rows.append((k, " ".join(words) + r.choice(["", " and a passage that many of the documents share in full"])))
            k += 1
            last = words
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("chunk", [op6.CHUNK, 12])
def test_ngram_components(spark, chunk):
    rows = near_copies(1, 6, 40, 50) + near_copies(2, 40, 2, 30) + [r for r in awkward() if r[0] != 7]
    got = rows_of(op6.ngram_components(documents(spark, rows).repartition(3), chunk=chunk))
    assert got == brute_components(rows)


def test_ngram_components_of_the_tables_and_of_nothing(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    assert rows_of(op6.ngram_components(docs)) == brute_components([tuple(r) for r in docs.collect()])
    got, want = same_as_sql(op6.ngram_components(docs), op6.ORACLE, documents=docs)
    assert got == want
    assert op6.ngram_components(documents(spark, [])).count() == 0
    assert op6.representatives(documents(spark, [])).count() == 0


def test_representatives(spark):
    rows = near_copies(4, 5, 12, 40) + [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f")]
    keep = {c for _, _, c in brute_components(rows)}
    out = op6.representatives(documents(spark, rows))
    assert out.columns == documents(spark, []).columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(keep)


@pytest.mark.parametrize("n,size", [(2, 5), (70, 30), (300, 60)])
def test_tree_links_join_what_brute_force_joins(n, size):
    r = np.random.default_rng(n)
    base = [np.unique(r.integers(0, 1 << 63, size, dtype=np.uint64)) for _ in range(max(1, n // 12))]
    sets = []
    for _ in range(n):
        b = base[r.integers(len(base))]
        k = r.integers(0, max(2, len(b) // 6))
        sets.append(np.unique(np.r_[r.permutation(b)[k:], r.integers(0, 1 << 63, k, dtype=np.uint64)]))
    pairs = op6.link(sets, np.arange(n))
    want = [(i, j) for i in range(n) for j in range(i) if linked(set(sets[i].tolist()), set(sets[j].tolist()))]

    def closure(edges):
        root = list(range(n))
        for _ in range(n):
            moved = False
            for a, b in edges:
                m = min(root[a], root[b])
                moved |= root[a] != m or root[b] != m
                root[a] = root[b] = m
            if not moved:
                return root

    assert closure(pairs) == closure(want)
    assert all(linked(set(sets[i].tolist()), set(sets[j].tolist())) for i, j in pairs)


def test_prefix_filter_keeps_every_link():
    known = np.random.default_rng(5).integers(0, 1 << 63, (2, 1 << (op6.BITMAP_BITS - 6)), dtype=np.uint64)
    r = np.random.default_rng(6)
    for _ in range(200):
        a = np.unique(r.integers(0, 1 << 63, 80, dtype=np.uint64))
        b = np.unique(np.r_[a[7:], r.integers(0, 1 << 63, r.integers(0, 6), dtype=np.uint64)])
        if linked(set(a.tolist()), set(b.tolist())):
            assert len(np.intersect1d(op6.in_prefix(a, known, 85), op6.in_prefix(b, known, 85)))


def test_components(spark):
    r = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 240)] + [(r.randint(300, 400), r.randint(300, 400)) for _ in range(70)]
    df = spark.createDataFrame(edges + [(5, 5), (None, 3)], "a long, b long")
    got = {x.id: x.root for x in common.components(df, "t").collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(100):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k in got} and set(got) >= {a for a, b in edges if a != b}
    assert common.components(df.filter(F.lit(False)), "t").count() == 0
