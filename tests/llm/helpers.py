"""Tables with every awkward row, shared by the tests of this folder."""

import random

import duckdb
import pandas as pd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, row_text string, key string"
LONG = "The quick brown fox, number 12. " * 8000


def documents(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, lang, source); the other columns clash with names the operators use."""
    full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "src1")), len(r[1] or ""), 7, "clash", "k") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def awkward():
    r = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "été", "über", "漢字", "x1", "don't", "we'll", "<|endoftext|>"]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = text(60)
    return [
        (1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, "no id here at all"), (None, None), (4, base), (5, base), (5, base),
        (6, base.replace(" ", "\n  ")), (7, LONG), (8, text(5)), (9, text(200) + "\n\n\n" + text(9)), (10, "one"), (11, "one two three"),
        (12, "  odd space \u0085\x1c"), (13, base + " tail"), (7, LONG), (14, None, None, None), (15, "a b c d", None, "x"),
    ]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def duck(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        frame = df.toPandas() if not isinstance(df, pd.DataFrame) else df
        con.register(f"{name}_", frame)
        cast = ", ".join(f'CAST("{c}" AS {"BIGINT" if c.endswith("_id") or c in ("n_chars", "turn") else "VARCHAR"}) AS "{c}"' for c in frame.columns)
        con.execute(f'CREATE TABLE {name} AS SELECT {cast} FROM {name}_')
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def same_as_sql(df, sql, **tables):
    cols, rows = duck(sql, **tables)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    assert sorted(cols) == sorted(df.columns)
    want = sorted((tuple(r[i] for i in order) for r in rows), key=repr)
    return rows_of(df.select(*sorted(df.columns))), want
