import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litspark.llm import op1_token_counts as op1
from litspark.llm import op10_packing as op10

from .helpers import awkward, documents

PIECES = list("abtsr'\" \n\t\r\x0b\x0c\x1c.,!?-_=#0123é漢😀　\xa0 ​\x85²") + [
    "the", "ing", "  ", "<|endoftext|>", "'re", "'ll", "====", "aaaa", "    "]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(op1.default_tokenizer())


def ids(tok, text):
    return tok.encode(text, add_special_tokens=False).ids


def random_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


def test_every_prefix_count_is_the_librarys(tok):
    counter = op1.PrefixCounter(op1.default_tokenizer())
    for text in random_texts(1200, 5) + ["it's we're  \n x", "!<|endoftext|>?", "  <|endoftext|>  a"]:
        got = op1.counts_of(counter.index(text)).tolist()
        assert got == [len(ids(tok, text[:i + 1])) for i in range(len(text))], repr(text)


def test_unit_encoder_is_the_library(tok):
    texts = random_texts(4000, 6) + ["", "", "a" * 5000 + " " * 3000 + "b"]
    got = list(op10.UnitEncoder(op1.default_tokenizer()).encode(pa.array(texts)))
    assert all(g.tolist() == ids(tok, t) for g, t in zip(got, texts, strict=True))


def test_token_counts(spark, tok):
    rows = awkward()
    got = op1.token_counts(documents(spark, rows), limit=50).collect()
    want = []
    for doc, text, *_ in rows:
        n = [len(ids(tok, (text or "")[:i])) for i in range(len(text or "") + 1)] if len(text or "") < 2000 else None
        total = len(ids(tok, text or ""))
        want.append((doc, len((text or "").encode()), total, total > 50, max(i for i, c in enumerate(n) if c <= 50) if n else None))
    for g, w in zip(sorted(got, key=lambda r: repr(tuple(r)[:4])), sorted(want, key=lambda r: repr(r[:4]))):
        assert tuple(g)[:4] == w[:4] and (w[4] is None or g.cut == w[4])
    assert op1.token_counts(documents(spark, [])).count() == 0


def test_budget_questions_from_the_index(spark, tok):
    df = op1.with_prefix_counts(documents(spark, [(1, "we'll see  it all, won't we?"), (2, None)]).withColumn("prefix_index", F.lit(1)))
    df = op1.longest_prefix(op1.tokens_at(df, 11), budget=4).orderBy("doc_id")
    a, b = df.collect()
    text = a.text
    assert a.tokens == len(ids(tok, text[:11]))
    assert a.cut == max(i for i in range(len(text) + 1) if len(ids(tok, text[:i])) <= 4)
    assert (b.tokens, b.cut) == (0, 0)


def test_first_fit_decreasing_is_first_fit():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 7, 300):
        sizes = r.integers(1, 101, n)
        bins, offsets = op10.first_fit_decreasing(sizes, 100)
        room, want = [], {}
        for k in np.argsort(-sizes, kind="stable"):
            j = next((j for j, free in enumerate(room) if free >= sizes[k]), len(room))
            room += [100] * (j == len(room))
            want[int(k)] = (j, 100 - room[j])
            room[j] -= int(sizes[k])
        assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[k] for k in range(n)]


def check_packing(rows, texts, tok, length):
    """rows: pieces with ids; texts: multiset of (doc_id, text)."""
    by_seq, docs = {}, {}
    for p in rows:
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length and 0 < p.length <= length
    for parts in by_seq.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= length
    want = sorted(repr((d, ids(tok, t or "") + [1])) for d, t in texts)
    # Equal ids may repeat: put pieces together by (doc, start), rows of a copy apart.
    pieces = {}
    for p in rows:
        pieces.setdefault((p.doc_id, p.start), []).append(np.frombuffer(p.ids, "<u4").tolist())
    for (doc, start), v in pieces.items():
        docs.setdefault(doc, {})[start] = v
    got = []
    for doc, t in {(d, t) for d, t in texts}:
        n = sum(x == (doc, t) for x in texts)
        whole = ids(tok, t or "") + [1]
        for _ in range(n):
            for a in range(0, len(whole), length):
                docs[doc][a].remove(whole[a:a + length])
            got.append(repr((doc, whole)))
    assert sorted(got) == want and not any(v for d in docs.values() for v in d.values())


def test_packing_round_trip(spark, tok):
    rows = [r[:2] for r in awkward()]
    out = op10.pack(documents(spark, awkward()), length=128, group_documents=4, with_ids=True).collect()
    check_packing(out, rows, tok, 128)
    assert op10.pack(documents(spark, [])).count() == 0


def test_packing_fills_sequences(spark):
    out = op10.op10_packing(spark, "/root/testdata/sf0.01").toPandas()
    used = out.groupby("sequence_id")["length"].sum()
    assert used.sum() / (2048 * len(used)) > 0.97
    assert (out.groupby("doc_id")["length"].sum() == out.groupby("doc_id")["doc_tokens"].first()).all()
