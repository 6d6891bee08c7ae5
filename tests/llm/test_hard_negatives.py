import math
import random

import numpy as np
import pytest

from litspark.llm import op12_hard_negatives as op12

from .helpers import rows_of

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<double>, label int, uid long, q string, block int, scores array<long>"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 9, "clash", 1, [1]) for r in rows], SCHEMA).repartition(3)


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """All pairs by plain Python; rows of one id and vector can't be told apart, and needn't be."""
    v = []
    for ident, x, label in rows:
        if ident is None or x is None or label is None or any(c is None or not math.isfinite(c) or abs(math.floor(256 * c)) > 2 ** 27 for c in x):
            continue
        v.append((ident, [math.floor(256 * c) for c in x], (label + 1) % 10 if ident % 7 == 0 else label))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))
    out = []
    for i, (a, x, label) in enumerate(v):
        if a % 100:
            continue
        scored = sorted((-dot(x, y), b, other == label) for j, (b, y, other) in enumerate(v) if j != i)
        for s, b, _ in [t for t in scored if t[2]][:positives]:
            hard = [(n, t) for t, n, same in scored if not same and low * -s <= 100 * -t <= high * -s][:negatives]
            out += [(a, b, k + 1, n, -s, -t) for k, (n, t) in enumerate(hard)]
    return sorted(out, key=repr)


def random_rows(seed, n, dim, spread, start=0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(12, dim)) + 0.8
    x = centre[r.integers(0, 12, n)] + spread * r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(start + i, [float(c) for c in row], int(r.integers(0, 4))) for i, row in enumerate(x)]


@pytest.mark.parametrize("dim,spread", [(64, 0.05), (64, 3.0), (5, 0.3), (1, 0.1)])
def test_against_all_pairs(spark, monkeypatch, dim, spread):
    monkeypatch.setattr(op12, "TILE", 128)
    monkeypatch.setattr(op12, "BLOCK_BYTES", 256 * 8 * dim)
    rows = random_rows(dim, 900, dim, spread)
    rows += [(100 * i, rows[0][1], i % 4) for i in range(9, 14)] + rows[3:9] + rows[100:101]  # ties and repeated rows
    df = frame(spark, rows)
    got = rows_of(op12.hard_negatives(op12.relabelled(df)))
    assert got == brute(rows) and (got or dim == 1)


def test_awkward_rows(spark):
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)], i % 3) for i in range(120)]
    rows += [(200, None, 1), (300, [1.0] * 8, None), (None, [1.0] * 8, 1), (400, [1.0, None] * 4, 1), (500, [float("nan")] + [1.0] * 7, 1), (600, [float("inf")] * 8, 0),
             (700, [], 1), (800, [1.0, 2.0], 2), (900, [0.0] * 8, 1), (1000, [1e300] * 8, 1), (1100, [500000.0] * 8, 1), (1200, [400000.0] * 8, 0), (1300, [300000.1] * 8, 1)]
    assert rows_of(op12.hard_negatives(op12.relabelled(frame(spark, rows)))) == brute(rows)


def test_one_label_and_empty(spark):
    rows = [(i, [float(i % 5), 1.0], 3) for i in range(0, 300, 2) if i % 7]
    assert rows_of(op12.hard_negatives(op12.relabelled(frame(spark, rows)))) == []
    assert rows_of(op12.hard_negatives(frame(spark, []))) == []
    assert rows_of(op12.hard_negatives(frame(spark, [(1, None, None)]))) == []


def test_bounds_hold_and_shrink():
    r = np.random.default_rng(3)
    a, x = np.floor(256 * r.normal(size=(20, 61))), np.floor(256 * (r.normal(size=(300, 61)) + r.normal(size=(300, 1))))
    sa, sx, true, last = op12.summary(a), op12.summary(x), a @ x.T, None
    for mean, dev in op12.level_columns(61):
        mid, off = sa[:, mean] @ sx[:, mean].T, sa[:, dev] @ sx[:, dev].T
        assert (mid - off <= true + 1e-6).all() and (true <= mid + off + 1e-6).all()
        assert last is None or (off <= last + 1e-6).all()
        last = off


def test_bounds_leave_few_pairs_on_clustered_data(monkeypatch):
    """The exact product is taken of what the bounds leave, and that is the answer's neighbourhood."""
    import pyarrow as pa
    rows = random_rows(1, 4000, 64, 0.02)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    x = np.concatenate([x, np.repeat(np.floor(256 * np.random.default_rng(5).normal(size=(4000, 16))), 4, axis=1)])
    part = lambda q: pa.RecordBatch.from_arrays(
        [pa.array(np.zeros(len(q), np.int64)), pa.array(np.arange(len(q))), pa.array(np.arange(len(q))), pa.array([v.tobytes() for v in q.astype("<i4")], pa.binary()),
         pa.array([v.tobytes() for v in op12.summary(q).astype("<f4")], pa.binary())], ["label", "vec_id", "uid", "q", "summary"])
    seen = []
    real = op12.bounded
    monkeypatch.setattr(op12, "bounded", lambda *a: seen.append(real(*a)) or seen[-1])
    found = op12._positives(op12.Block([part(x)], 64), part(x[4000:4064]), 64, 5)
    exact = x[4000:4064] @ x.T
    exact[np.arange(64), np.arange(64)] = -np.inf  # the uids of the batch are 0 to 63
    want = np.sort(exact, axis=1)[:, -5:]
    assert np.array_equal(np.sort(np.array([f[4] for f in found]).reshape(64, 5), axis=1), want)
    assert sum(len(i) for i, _, _ in seen) < 0.2 * 64 * len(x)


def test_sql_and_query_agree_on_the_table(spark):
    df = op12.op12_hard_negatives(spark, SF)
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in e.collect()]
    got = rows_of(df)
    assert got == brute(rows) and got
    import duckdb
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    cur = con.execute(op12.ORACLE)
    assert [d[0] for d in cur.description] == df.columns and sorted((tuple(x) for x in cur.fetchall()), key=repr) == got
