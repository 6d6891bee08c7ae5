import json
import random

import pytest

from litspark.llm import op7_tool_calls as op7

from .helpers import LONG

CALLS = "conv_id long, call_id string, name string, arguments string, after string, position long, uid long, depth string"
RESULTS = "conv_id long, call_id string, content string, position long, n_results string"


def run(spark, calls, results, **kw):
    c = spark.createDataFrame([(*x, 1, "clash") for x in calls], CALLS)
    r = spark.createDataFrame([(*x, "clash") for x in results], RESULTS)
    return op7.link_calls(c, r, **kw).collect()


def brute_depth(after):
    out = {}
    for k in after:
        seen, at = [], k
        while at in after and at not in seen:
            seen.append(at)
            at = after[at]
        out[k] = None if at in seen else len(seen) - 1
    return out


def test_chains_orders_and_links(spark):
    r = random.Random(1)
    calls, after = [], {}
    for conv in range(6):
        n = [1, 3, 40, 200, 700, 20][conv]
        for i in range(n):
            up = None if i == 0 else f"k{r.randint(max(0, i - 2), i - 1)}" if conv != 4 else f"k{i - 1}"
            if conv == 5:
                up = f"k{(i + 1) % 7}" if i < 7 else f"k{i - 3}"  # a cycle and what hangs on it
            if conv == 2 and i % 9 == 5:
                up = "unknown"
            calls.append((conv, f"k{i}", "lookup", json.dumps({"query": str(i)}), up, i))
            after[conv, f"k{i}"] = (conv, up)
    results = [(c, k, f"answer {k}", 1) for c, k, *_ in calls if int(k[1:]) % 3]
    rows = run(spark, calls, results)
    depth = brute_depth(after)
    assert len(rows) == len(calls)
    for x in rows:
        assert x.depth == depth[x.conv_id, x.call_id], x
        assert x.status == ("linked" if int(x.call_id[1:]) % 3 else "unanswered") and x.valid
        assert (x.topology == "cycle") == (x.depth is None)
        assert (x.topology == "dangling") == (after[x.conv_id, x.call_id][1] == "unknown")
    for conv in range(6):
        mine = sorted((x.order_no, x.call_id) for x in rows if x.conv_id == conv)
        assert [o for o, _ in mine] == list(range(1, len(mine) + 1))
        place = {k: o for o, k in mine}
        assert all(place[k] > place[after[conv, k][1]] for k in place
                   if depth[conv, k] is not None and (conv, after[conv, k][1]) in depth)


def test_awkward_calls(spark):
    calls = [(1, "a", "lookup", '{"limit": 3, "query": "é\\n"}', None, 1), (1, "a", "lookup", '{"query": "second"}', None, 2), (1, None, "lookup", "{}", "a", 3),
             (None, "a", "lookup", None, None, None), (2, "b", "nope", "{}", "b", 1), (2, "c", "summarise", '{"text": "t", "words": NaN}', None, None),
             (2, "d", "summarise", '{"words": "5", "more": 1}', "c", 5), (2, "e", "translate", '{"text": "x", "to": "xx"}', "d", 6), (2, "f", "lookup", "[1]", None, 7),
             (2, "g", "lookup", json.dumps({"query": LONG}), None, 8), (2, "h", "lookup", '{"query": "x", "limit": true}', None, 9)]
    results = [(1, "a", "late", 9), (1, "a", "first", 4), (1, None, "lost", 1), (3, "z", None, 1), (2, "g", None, None)]
    rows = run(spark, calls, results)
    by = {(r.conv_id, r.call_id, r.status): r for r in rows}
    a = by[1, "a", "linked"]
    assert (a.n_results, a.valid) == (2, True)
    assert a.json == '{"after":null,"arguments":{"limit":3,"query":"é\\n"},"id":"a","name":"lookup","result":"first"}'
    assert (1, "a", "duplicate") in by and (1, None, "unidentified") in by and (3, "z", "orphan") in by and (1, None, "orphan") in by
    assert by[2, "b", "unanswered"].topology == "cycle" and by[2, "b", "unanswered"].errors == "unknown tool"
    assert by[2, "c", "unanswered"].errors == "not JSON"
    assert by[2, "d", "unanswered"].errors == "missing text; unexpected more; words is no integer"
    assert by[2, "e", "unanswered"].errors == "to not allowed" and by[2, "f", "unanswered"].errors == "not an object"
    assert by[2, "g", "linked"].valid and json.loads(by[2, "g", "linked"].json)["result"] is None
    assert by[2, "h", "unanswered"].errors == "limit is no integer"
    assert [r.order_no for r in rows if r.call_id == "b"] == [7]
    assert run(spark, [], []) == []


def test_canonical_json():
    value = {"b": [1, {"d": None, "c": "ü "}], "a": 1.5, "": True}
    text = op7.canonical(value)
    assert json.loads(text) == value and text == '{"":true,"a":1.5,"b":[1,{"c":"ü ","d":null}]}'
    assert op7.parsed("1e999") == ("1e999", "not JSON") and op7.parsed("[" * 100_000)[1] == "not JSON" and op7.parsed(None) == (None, "no arguments")


def test_surrogates_and_schema_keywords(spark):
    schema = {"t": {"required": ["a"], "properties": {
        "a": {"type": ["string", "null"], "minLength": 2, "maxLength": 3, "pattern": "^x"}, "n": {"minimum": 1, "maximum": 5, "enum": [1, 2, 7, "z", True]},
        "l": {"type": "array", "items": {"type": "integer"}, "minItems": 1}, "o": {"type": "object", "required": ["k"], "properties": {"k": {"type": "null"}}}}}}
    arguments = ['{"a": "\\ud800"}', '{"a": null}', '{"a": "xy", "n": 2}', '{"a": "yyyy", "n": "z"}', '{"a": "x", "n": 7, "l": []}', '{"a": 5, "l": [1, "b", true]}',
                 '{"a": "xx", "o": {"k": 1, "m": 2}}', '{"a": "xx", "o": {}}', '{"a": "xx", "n": true}', '{"a": "xx", "n": 1.0}', '{"\\udfff": 1}', '{"a": "\\ud83d\\ude00"}']
    rows = {r.call_id: r for r in run(spark, [(1, f"c{i:02}", "t", x, None, i) for i, x in enumerate(arguments)], [], schemas=schema)}
    assert [rows[k].errors for k in sorted(rows)] == [
        "not Unicode", "", "", "a too long; a has another form", "a too short; l has too few items; n too large", "a is no string or null; l[1] is no integer; l[2] is no integer",
        "o.k is no null; unexpected o.m", "missing o.k", "", "n not allowed", "not Unicode", "a too short; a has another form"]
    assert json.loads(rows["c00"].json)["arguments"] == arguments[0]
    for bad in ({"t": {"properties": {"a": {"oneOf": []}}}}, {"t": {"properties": {"a": {"type": "date"}}}}, {"t": {"properties": {"a": {"items": {"format": "x"}}}}}):
        with pytest.raises(ValueError):
            run(spark, [], [], schemas=bad)


def test_query_over_the_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = op7.op7_tool_calls(spark, sf).collect()
    t = {(r.conv_id, r.turn): r for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()}
    assert {(r.conv_id, r.call_id) for r in rows if r.status != "orphan"} == {(c, f"call-{c}-{n}") for (c, n), x in t.items() if x.role == "assistant"}
    for r in rows:
        turn = int(r.call_id.split("-")[2]) if r.call_id else None
        answer = t.get((r.conv_id, turn + 1))
        if r.status == "linked":
            assert json.loads(r.json)["result"] == answer.text
        assert (r.status == "unanswered") == (t[r.conv_id, turn].role == "assistant" and not (answer and answer.role == "user"))
    assert {r.valid for r in rows} == {True, False}


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline as p

    from litspark.llm.common import written

    sf = "/root/testdata/sf0.01"
    out, docs = [], spark.read.parquet(f"{sf}/documents.parquet")
    for name, f in p.STAGES:
        docs = written(f(spark, docs, sf), f"test-{name}")
        out.append((name, docs))
    return sf, out


def test_pipeline_stages(spark, stages):
    from litspark.llm import op2_quality_rules as op2
    from litspark.llm import op8_mixing as op8

    from .test_dedup_join import brute_dedup
    from .test_near_copies_stage import kept_ids

    sf, out = stages
    start = spark.read.parquet(f"{sf}/documents.parquet")
    ids = [sorted(r.doc_id for r in start.collect())] + [sorted(r.doc_id for r in d.collect()) for _, d in out[:4]]
    assert all(d.columns == start.columns for _, d in out[:4])
    rows = lambda d: [(r.doc_id, r.text) for r in d.collect()]
    verdict = op2.judged(start, op2.train(start, spark.read.parquet(f"{sf}/labels.parquet"))).filter("kept")
    assert ids[1] == sorted(r.doc_id for r in verdict.collect())
    assert ids[2] == sorted({best for _, best, _, _ in brute_dedup(rows(out[0][1]))})
    assert ids[3] == kept_ids(rows(out[1][1]))
    assert ids[4] == sorted(r.doc_id for r in op8.mixture(out[2][1], 70, max_epochs=1).collect())
    assert all(set(b) < set(a) for a, b in zip(ids, ids[1:]))
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1").collect()}
    long_enough = {d for d, t in rows(start) if len((t or "").split()) >= 30}
    assert len(good & long_enough & set(ids[1])) > 0.97 * len(good & long_enough)


def test_stages_on_awkward_and_empty_tables(spark):
    import corpus_pipeline as p

    from litspark.llm.common import written

    from .helpers import awkward, documents
    sf = "/root/testdata/sf0.001"
    for rows in (awkward(), []):
        docs = start = documents(spark, rows).repartition(3)
        for name, f in p.STAGES:
            before, docs = docs, written(f(spark, docs, sf), f"awkward-{name}")
            if name != "packing":
                assert docs.schema.names == start.columns
                assert {(r.doc_id, r.text) for r in docs.collect()} <= {(r.doc_id, r.text) for r in before.collect()}
        kept = {r.doc_id for r in before.collect()}
        assert {r.doc_id for r in docs.collect()} == kept and bool(rows) == bool(kept)


def test_pipeline_packs_what_is_left(spark, stages):
    from tokenizers import Tokenizer

    from litspark.llm.op1_token_counts import default_tokenizer

    tok = Tokenizer.from_file(default_tokenizer())
    docs = stages[1][3][1].collect()
    p = stages[1][4][1].toPandas()
    assert p.groupby("doc_id")["length"].sum().to_dict() == {r.doc_id: len(tok.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in docs}
    seq = p.sort_values(["sequence_id", "offset"])
    assert (seq.groupby("sequence_id")["length"].cumsum() - seq["length"] == seq["offset"]).all() and (seq.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_registered_queries():
    import __spark_entry__ as e
    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(e.oracle_sql()) <= names
