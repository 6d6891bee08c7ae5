import random

from litspark.llm import op4_pii as op4

from .helpers import documents


def test_short_names_reveal_an_entity_and_short_words_do_not(spark):
    r = random.Random(6)
    common = ["it", "is", "a", "to", "we", "the", "house", "world"]
    rows = [" ".join([r.choice(common) for _ in range(12)] + [f"filler{i}"]) for i in range(300)]
    rows += [f"{r.choice(common)} Li of 漢 and X9 is no{i} ann_lee@short.example" for i in range(8)]
    docs = list(enumerate(rows))
    out = {x.doc_id: x.spans for x in op4.find(documents(spark, docs)).collect()}
    for d, t in docs[300:]:
        flagged = {t[int(a):int(b)] for k, a, b in (s.split(":") for s in out[d].split(",")) if k != "email"}
        assert flagged == {"Li", "of", "漢", "and", "X9"}  # those that occur beside the address only
    assert not any(out[d] for d in range(300))
    # Runs of letters and digits of any length, found without a pattern.
    text = "a bc_d é1 漢字 o'er -x- Z"
    runs = "".join(c if c.isalnum() else " " for c in text).split()
    assert {w: [text[a:b] for a, b in zip(at[::2], at[1::2])] for w, at in op4.terms(text, []).items()} == {w.lower(): [w] for w in runs}
