import math
import random
import re

import pytest

from litspark.llm import op4_pii as op4

from .helpers import documents


@pytest.fixture(scope="module")
def rare():
    """An address in two texts, one in five copies of a text, one in two texts that are copied, and one in a single text."""
    r = random.Random(4)
    word = lambda: r.choice(["time", "year", "people", "thing", "world", "house"])
    rows = [f"{' '.join(word() for _ in range(14))} filler{i}" for i in range(400)]
    rows += [f"Twoname {word()} two@mail.example first", f"then Twoname {word()} {word()} two@mail.example"]
    rows += ["Copyname writes from copy@mail.example here"] * 5
    rows += ["Bothname alpha both@mail.example"] * 4 + ["beta Bothname both@mail.example"] * 3
    return list(enumerate([*rows, "Singlename single@mail.example"]))


def test_two_texts_are_evidence_and_copies_are_none(spark, rare):
    out = {r.doc_id: r.spans for r in op4.find(documents(spark, rare).repartition(3)).collect()}
    flagged = {(d, t[int(a):int(b)]) for d, t in rare for k, a, b in (s.split(":") for s in out[d].split(",") if s) if k != "email"}
    assert flagged == {(d, w) for d, t in rare for w in ("Twoname", "Bothname") if w in t}


def test_estimate_is_the_formula_over_distinct_texts(spark, rare):
    rows = op4.disclosing(op4.written(op4.scan(documents(spark, rare)), "t"), generalise=0.0).collect()
    texts = {t for _, t in rare}
    words = {t: set(re.sub(r"\S+@\S+", "", t.lower()).split()) for t in texts}
    want = {}
    for e in ("two", "copy", "both", "single"):
        own = [t for t in texts if f"{e}@mail" in t]
        for w in set().union(*(words[t] for t in own)):
            joint = sum(w in words[t] for t in own)
            if joint > 1:
                lower = 1 + math.log2((joint - 1) / sum(w in x for x in words.values())) / math.log2(len(texts) / len(own))
                if lower >= 0:
                    want[w] = lower
    assert {r.term for r in rows} == set(want) and {"twoname", "bothname"} <= set(want)
    assert all(abs(r.lower - want[r.term]) < 1e-9 for r in rows)
