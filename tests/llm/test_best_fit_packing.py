import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from litspark.llm import op13_best_fit_packing as op13

from .helpers import awkward, documents

SF = "/root/testdata/sf0.01"


def check(p, docs, length=2048, separator=0):
    """Exact round trip: every id in one piece, pieces in gapless sequences, only long documents cut."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(op13.default_tokenizer())
    want = {}
    for doc, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, separator]
        for k, a in enumerate(range(0, len(ids), length)):
            part = ids[a:a + length]
            key = (doc, k, a, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in p:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    bins = {}
    for r in sorted(p, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert all(x <= length for x in bins.values())
    return bins


def test_every_document_of_the_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    p = op13.op13_best_fit_packing(spark, SF).collect()
    bins = check(p, docs)
    assert len(bins) <= -(-sum(r.length for r in p) // 2048) + 1


def test_awkward_documents(spark):
    rows = awkward()
    p = op13.pack(documents(spark, rows).repartition(3), group_pieces=4)
    check(p.collect(), [r[:2] for r in rows])
    assert op13.pack(documents(spark, [])).collect() == []
    assert [(r.length, r.offset) for r in op13.pack(documents(spark, [(None, None)])).collect()] == [(1, 0)]


def test_short_sequences_and_ids(spark):
    rows = [(i, "word " * (i % 40)) for i in range(300)]
    p = op13.pack(documents(spark, rows), length=32, separator=5, group_pieces=64, with_ids=True).collect()
    bins = check(p, rows, 32, 5)
    assert len(bins) <= 1.01 * sum(r.length for r in p) / 32 + 2
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in p)


def test_levels_lose_nothing_to_groups(spark):
    """Many small groups end up with as few sequences as one."""
    rows = [(i, "w " * random.Random(i).randint(1, 24)) for i in range(3000)]
    p = op13.pack(documents(spark, rows).repartition(5), length=64, group_pieces=40).collect()
    bins = check(p, rows, 64)
    least = op13.lower_bound([r.length for r in p], 64)
    assert len(bins) <= least + 2  # 75 groups on their own would lose about half a sequence each


def test_units_learnt_between_digits():
    """Units joined by a digit, Latin ones without the normaliser, have the library's ids; another vocabulary's are joined by special strings."""
    from tokenizers import Tokenizer

    from litspark.llm import op10_packing as op10
    from litspark.llm.op1_token_counts import default_tokenizer as byte_level
    path, rng = op13.default_tokenizer(), random.Random(3)
    signs = ["a", "Zq", "\u0130", "\u00c4", "\u00df", "e\u0301", "\u0301", "\u03a3", "\u1e9e", "\u212a", "\u00ad", "\u00a0", "\u0085", "\u2003", "\u200b", "0", "10", "7", "\u0660", "\u00b2",
             "'s", "'", "'LL", ".", "!?", "<|endoftext|>", "<|startoftext|", " ", "  ", "\n", "\t", "\x0b", "\x00", "\u4e2d", "\U0001f600", "\u0e01\u0e34", "\u1100\u1161", "\ufb01", "\u0149"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 25))) for _ in range(4000)] + ["", "0", " 0 0", "00"]
    enc, tok = op10.UnitEncoder(path, block_bytes=3000), Tokenizer.from_file(path)
    assert enc.digit_id is not None and op10.UnitEncoder(byte_level()).digit_id is None
    assert [x.tolist() for x in enc.encode(pa.array(texts))] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def triplets(n, length, rng):
    """Lengths that fill ``n`` bins exactly, three a bin."""
    out = []
    for _ in range(n):
        a = rng.randint(length * 38 // 100, length * 49 // 100)
        b = rng.randint(length // 4, (length - a) // 2)
        out += [a, b, length - a - b]
    rng.shuffle(out)
    return out


def test_crossover_keeps_whole_bins_and_every_document():
    rng = random.Random(4)
    lengths = [rng.randint(1, 900) for _ in range(400)]
    a, b = op13.founders(lengths, 1000, rng, 3)[::2]
    for _ in range(30):
        child = op13.crossover(a, b, lengths, 1000, rng)
        assert sorted(i for x in child.bins for i in x) == list(range(400))
        assert child.fills == [sum(lengths[i] for i in x) for x in child.bins] and max(child.fills) <= 1000
        given = {tuple(x) for x in a.bins} & {tuple(x) for x in child.bins}
        assert given
        m = op13.mutated(child, lengths, 1000, rng)
        assert sorted(i for x in m.bins for i in x) == list(range(400)) and max(m.fills) <= 1000
        back = op13.packing(m.assignment(400), lengths)
        assert sorted(map(sorted, back.bins)) == sorted(map(sorted, m.bins))


@pytest.mark.parametrize("seed", range(3))
def test_evolution_beats_best_fit_decreasing(seed):
    """On lengths that best fit alone packs badly, breeding needs fewer bins."""
    rng = random.Random(seed)
    lengths = triplets(60, 1000, rng)
    first = op13.founders(lengths, 1000, rng, 8)
    best = first[0]
    assert op13.lower_bound(lengths, 1000) == 60 < len(best.bins)
    p = op13.bred(first, lengths, 1000, 60, rng, 1500)[0]
    assert p.fitness() < best.fitness() and len(p.bins) < len(best.bins)


def test_islands_and_migration(spark):
    """Elites move on, epochs only improve, and every group ends with its items placed once."""
    rng = random.Random(7)
    groups = [(g, list(range(1000 * g, 1000 * g + 90)), triplets(30, 1000, rng)) for g in range(4)]
    df = spark.createDataFrame(groups, "grp long, uids array<long>, lengths array<int>")
    few = {r.grp: r for r in op13.evolved(df, 1000, 1, 4, 0, 1, 3).collect()}
    many = {r.grp: r for r in op13.evolved(df, 1000, 3, 4, 3, 150, 3).collect()}
    gained = 0
    for g, uids, lengths in groups:
        assert sorted(many[g].uids) == uids
        p, q = (op13.packing(np.frombuffer(x[g].best, "<i4"), x[g].lengths) for x in (few, many))
        assert max(q.fills) <= 1000 and sum(map(len, q.bins)) == 90 and q.fitness() <= p.fitness()
        gained += len(p.bins) - len(q.bins)
    assert gained > 0


def test_lower_bound():
    rng = random.Random(1)
    for _ in range(200):
        lengths = [rng.randint(1, 20) for _ in range(rng.randint(1, 7))]
        best = min(len(op13.best_fit(op13.Packing([], []), rng.sample(range(len(lengths)), len(lengths)), lengths, 20).bins) for _ in range(60))
        assert -(-sum(lengths) // 20) <= op13.lower_bound(lengths, 20) <= best
    assert op13.lower_bound([11, 12, 13], 20) == 3 and op13.lower_bound([], 20) == 0 and op13.lower_bound([10, 10, 10], 20) == 2
