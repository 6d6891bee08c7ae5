import hashlib
import random
import re

import pytest

from litspark.llm import op4_pii as op4

from .helpers import awkward, documents

# The patterns as they are stated, without the engine's guards against slow runs.
PLAIN = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(d):
    t = [int(c) for c in d]
    return (sum(t[-1::-2]) + sum(sum(divmod(2 * c, 10)) for c in t[-2::-2])) % 10 == 0


def plain_spans(text):
    out = []
    for k, p in enumerate(PLAIN):
        for m in p.finditer(text):
            d = re.sub("[^0-9]", "", m[0])
            if k == 1 and any(int(x) > 255 for x in m[0].split(".")):
                continue
            if k == 2 and not (16 <= len(d) <= 19 and luhn(d)):
                continue
            if k == 3 and not 8 <= len(d) <= 15:
                continue
            out.append((k, *m.span()))
    return out


def test_base_spans_are_the_stated_patterns():
    r = random.Random(1)
    parts = ["a@b.c", "a@b", "x_c@d.e.f", "@", ".", "+", "-", " ", "(", ")", "1", "0", "255", "256", "12.3.4.5", "4111 1111 1111 1111", "411111111111",
             "+49 (30) 1234-567", "+1", "é", "word", "%", "001", "5500-0000-0000-0004", "\n", "a.b@c-d.example.com_e@f.g"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert [s[:3] for s in op4.base_spans(text)] == plain_spans(text), repr(text)
    for long in ("a" * 200_000, "1" * 200_000, "+1 " * 50_000, "a@" * 50_000, "0." * 50_000, "1.1.1." + "0" * 9000):
        op4.base_spans(long)


def test_every_row_gets_its_base_columns(spark):
    rows = awkward() + [(50, "mail a.b@c.example or +49 30 1234567, 10.0.0.1 and 4111 1111 1111 1111.")]
    got = {repr((r.doc_id, r.spans)) for r in op4.find(documents(spark, rows)).collect()}
    out = op4.find(documents(spark, rows)).collect()
    assert len(out) == len(rows)
    names = op4.KINDS
    want = {repr((d, ",".join(f"{names[k]}:{a}:{b}" for k, a, b in plain_spans(t or "")))) for d, t, *_ in rows}
    assert got == want
    one = next(r for r in out if r.doc_id == 50)
    assert (one.n_email, one.n_ip, one.n_card, one.n_phone) == (1, 1, 1, 1)
    assert one.base_sha256 == hashlib.sha256(one.spans.encode()).hexdigest()
    assert op4.find(documents(spark, [])).count() == 0


@pytest.fixture(scope="module")
def corpus():
    """A name that goes with one address only, one that mostly does, and words that go with everything."""
    r = random.Random(2)
    common = ["time", "year", "people", "thing", "world", "house"]
    rows = [(i, " ".join(r.choice(common) for _ in range(12))) for i in range(300)]
    for i in range(300, 308):
        rows.append((i, f"Dear Zebulon wrote {r.choice(common)} {r.choice(common)} from zeb@mail.example today with Quartermain"))
    rows += [(i, f"Quartermain and {r.choice(common)} {r.choice(common)}") for i in range(308, 320)]
    rows += [(320, "Zebulon? no"), (321, "rare@one.example Hapaxname here")]
    return [(d, t.replace("Zebulon? no", "nothing")) for d, t in rows]


def test_terms_that_reveal_an_entity(spark, corpus):
    out = {r.doc_id: r for r in op4.find(documents(spark, corpus)).collect()}
    marks = lambda d: {(k, dict(corpus)[d][int(a):int(b)]) for k, a, b in (s.split(":") for s in out[d].spans.split(",") if s)}
    assert {("email", "zeb@mail.example"), ("remove", "Zebulon"), ("remove", "Dear"), ("remove", "wrote")} <= marks(300)
    assert not any(w in ("time", "year", "people", "thing", "world", "house") for _, w in marks(300))
    assert not any(w == "Quartermain" and k == "remove" for k, w in marks(300))
    assert marks(321) == {("email", "rare@one.example")}  # no evidence below the support
    assert all(not out[i].spans for i in [*range(300), *range(308, 321)])


def test_disclosure_is_the_formula(spark, corpus):
    import math
    rows = op4.disclosing(op4.written(op4.scan(documents(spark, corpus)), "t"), generalise=0.0).collect()
    n = len(corpus)
    words = {d: set(re.findall(r"[^\W_]+", re.sub(r"\S+@\S+", "", t.lower()))) for d, t in corpus}
    texts = {t: d for d, t in corpus}
    once = {d for t, d in texts.items()}
    with_e = {d for d, t in corpus if "zeb@mail.example" in t}
    want = {}
    for t in set().union(*(words[d] for d in with_e)):
        joint = sum(t in words[d] for d in with_e & once)
        if joint > 1:
            lower = 1 + math.log2((joint - 1) / sum(t in words[d] for d in once)) / math.log2(len(texts) / len(with_e & once))
            if lower >= 0:
                want[t] = lower
    assert {r.term for r in rows} == set(want) and "zebulon" in want
    for r in rows:
        both, term = sum(r.term in words[d] for d in with_e), sum(r.term in w for w in words.values())
        assert abs(r.ratio - math.log2(n * both / (term * len(with_e))) / math.log2(n / len(with_e))) < 1e-9 and abs(r.lower - want[r.term]) < 1e-9


def test_keys_are_found_by_their_information(spark):
    r = random.Random(9)
    prose = ["the house of the people was near the river", "time and again the year went by", "nobody knew that unbelievablenotwithstanding2words are long"]
    keys = ["".join(r.choice("0123456789abcdef") for _ in range(40)), "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(32)) + "1a"]
    rows = [(i, " ".join(r.choice(prose) for _ in range(6))) for i in range(200)]
    rows += [(200 + i, f"before token = \"{k}\" and after é {k[:12]}") for i, k in enumerate(keys)] + [(210, None), (211, "a" * 5000 + "1"), (212, "1" * 60 + " " + "ab" * 30), (213, "x1" * 30)]
    out = {x.doc_id: x for x in op4.find(documents(spark, rows)).collect()}
    for i, k in enumerate(keys):
        t = dict(rows)[200 + i]
        assert out[200 + i].n_key == 1 and out[200 + i].n_spans == 1 and out[200 + i].spans == f"key:{t.index(k)}:{t.index(k) + len(k)}"
    assert [d for d, x in out.items() if x.n_key and d not in (200, 201)] == []
    # The bits are those of the counts.
    bits, mean = op4.byte_pairs(documents(spark, [(1, "abab"), (2, "ac"), (3, None)]).coalesce(1))
    assert 0 < mean < 8
    assert bits.shape == (256, 256)
    import math
    row = {"b": 2, "c": 1}
    total = sum(row.values()) + 128
    assert math.isclose(bits[ord("a"), ord("b")], -math.log2(2.5 / total), rel_tol=1e-9) and math.isclose(bits[ord("a"), ord("z")], -math.log2(0.5 / total), rel_tol=1e-9)


def test_redaction(spark, corpus):
    docs = documents(spark, corpus).filter("doc_id = 300")
    spans = op4.find(documents(spark, corpus)).select("doc_id", "spans")
    text = docs.join(spans, "doc_id").select(op4.redacted("text", "spans").alias("t")).first().t
    assert "Zebulon" not in text and "zeb@" not in text and "[EMAIL]" in text
    assert op4._redact("abcd 12 Abc", "generalise:0:4,generalise:5:7,generalise:8:11,email:5:11") == "[WORD] [EMAIL]"
