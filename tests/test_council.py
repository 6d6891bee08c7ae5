"""Response parsing (F5 edge rows), first/last-match lookups, fallbacks,
arbiter rule, merge and label quality."""
from pyspark.sql import functions as F

from litspark.operators import council as C

KEYS = "corpus_id string, run_key string"


def responses(spark, rows):
    return spark.createDataFrame([("c", "abstract", m, b, t) for m, b, t in rows],
                                 f"{KEYS}, model_idx int, batch int, response string")


def test_parse_edge_rows(spark):
    rows = [
        (0, 0, '<think>try [1,2] first</think>\n```json\n[{"cluster_id": 1, "label": "A", "confidence": 0.9}]\n```'),
        (0, 1, 'Sure! Here:\n[{"cluster_id": "2", "label": "B"}] hope it helps'),
        (1, 0, '{"cluster_id": 1, "label": "object not array"}'),
        (1, 1, '[{"cluster_id": 1, "label": "trunc'),
        (2, 0, '[{"cluster_id": 3, "label": "first"}, {"cluster_id": 3, "label": "second"}, {"label": "no id"}]'),
    ]
    p = C.proposals_from_responses(responses(spark, rows))
    got = sorted((r.model_idx, r.batch, r.item_pos, r.cluster_id, r.label) for r in p.collect())
    assert got == [(0, 0, 0, "1", "A"), (0, 1, 0, "2", "B"), (2, 0, 0, "3", "first"), (2, 0, 1, "3", "second"),
                   (2, 0, 2, None, "no id")]
    parsed = C.parse_json_array(responses(spark, rows), "response", C.PROPOSAL_SCHEMA)
    bad = sorted((r.model_idx, r.batch) for r in C.isolate_failures(parsed, ["model_idx", "batch"]).collect())
    assert bad == [(1, 0), (1, 1)]


def ranked(spark):
    return spark.createDataFrame([("c", "abstract", 1, 30, 10, 1, ["s1", "s2"]), ("c", "abstract", 3, 20, 5, 2, ["t1"])],
                                 f"{KEYS}, cluster_id int, size int, paper_count int, topic_rank int, "
                                 "top_sentences array<string>")


def test_lookup_first_wins_and_fallback(spark):
    rows = [(0, 0, '[{"cluster_id": 3, "label": "x", "confidence": 0.7}, {"cluster_id": 3, "label": "y"}]'),
            (1, 0, '[{"cluster_id": "1", "label": "z", "confidence": 0.8, "reasoning": "r"}]')]
    props = C.proposals_from_responses(responses(spark, rows))
    lk = {(r.cluster_id, r.model_idx): (r.label, r.confidence) for r in C.proposal_lookup(ranked(spark), props).collect()}
    assert lk[(3, 0)] == ("x", 0.7)
    assert lk[(1, 1)] == ("z", 0.8)
    assert lk[(1, 0)] == ("Unlabeled", 0.5) and lk[(3, 2)] == ("Unlabeled", 0.5)
    col = {r.cluster_id: [p.label for p in r.proposals] for r in C.collect_proposals(C.proposal_lookup(ranked(spark), props)).collect()}
    assert col[3] == ["x", "Unlabeled", "Unlabeled"]


def test_arbitrate_majority_then_confidence(spark):
    rows = [(1, 0, "Trade Networks", 0.5), (1, 1, " trade networks ", 0.6), (1, 2, "Other", 0.99),
            (3, 0, "Unlabeled", 0.5), (3, 1, "Alpha", 0.4), (3, 2, "Beta", 0.7)]
    lk = spark.createDataFrame([("c", "abstract", c, 10, 1, m, l, conf, "") for c, m, l, conf in rows],
                               f"{KEYS}, cluster_id int, size int, topic_rank int, model_idx int, label string, "
                               "confidence double, reasoning string")
    got = {r.cluster_id: (r.label, r.winning_model) for r in C.arbitrate(lk).collect()}
    assert got["1"] == (" trade networks ", 2)
    assert got["3"] == ("Beta", 0)   # no two agree: the most confident label, nobody's win


def test_council_last_wins_and_merge_defaults(spark):
    resp = spark.createDataFrame([("c", "abstract", 0, '[{"cluster_id": 1, "label": "old", "winning_model": 1}]'),
                                  ("c", "abstract", 1, '[{"cluster_id": 1, "label": "new", "confidence": 0.8, "winning_model": 2}, {"label": "x"}]')],
                                 f"{KEYS}, batch int, response string")
    dec = C.decisions_from_responses(resp)
    t = ranked(spark).withColumn("label", F.concat(F.lit("Topic "), F.col("cluster_id")))
    m = {r.cluster_id: r for r in C.merge_council(t, dec).collect()}
    assert (m[1].label, m[1].confidence, m[1].winning_model) == ("new", 0.8, 2)
    assert (m[3].label, m[3].confidence, m[3].reasoning, m[3].winning_model) == (
        "Topic 3", 0.5, "Council fallback mapping active", 0)
    w = C.model_wins(dec, ranked(spark)).first()
    assert (w.wins_model_1, w.wins_model_2, w.decisions, w.topics) == (1, 1, 2, 2)


def test_label_quality_status(spark):
    rows = [("c", "r1", "Topic 1"), ("c", "r1", "Real"), ("c", "r2", "Topic 2"), ("c", "r2", " "),
            ("c", "r3", "A"), ("c", "r3", "B")]
    lq = {r.run_key: r.status for r in C.label_quality(spark.createDataFrame(rows, f"{KEYS}, label string")).collect()}
    assert lq == {"r1": "WARN", "r2": "FAIL", "r3": "OK"}


def test_batches_and_blocks(spark):
    b = C.batch_rows(spark.range(1, 32).withColumnRenamed("id", "topic_rank"), 15)
    assert [r.batch for r in b.orderBy("topic_rank").collect()] == [0] * 15 + [1] * 15 + [2]
    blk = C.topic_block(ranked(spark)).orderBy("cluster_id").first().block
    assert blk == "TOPIC 1 (size=30, papers=10):\n  - s1\n  - s2"
    assert [r[1] for r in C.model_rows()] == C.COUNCIL_MODELS and [r[2] for r in C.model_rows()] == [15, 15, 10]


def test_items_are_parsed_one_by_one(spark):
    rows = [(0, 0, '[1, {"cluster_id": 1, "label": "A", "confidence": "0.9"}, null, "x", {"cluster_id": 2, "confidence": [1], "niche": "true"}]'),
            (1, 0, '[{"cluster_id": 1, "label": "A"},]'), (2, 0, "[]")]
    p = {(r.item_pos, r.cluster_id, r.label, r.confidence, r.niche) for r in C.proposals_from_responses(responses(spark, rows)).collect()}
    assert p == {(1, "1", "A", 0.9, None), (4, "2", None, None, True)}
    parsed = C.parse_json_array(responses(spark, rows), "response", C.PROPOSAL_SCHEMA)
    assert [r.model_idx for r in C.isolate_failures(parsed, ["model_idx"]).collect()] == [1]
    resp = spark.createDataFrame([("c", "abstract", 0, '[{"cluster_id": 1, "winning_model": 2.0}, {"cluster_id": 2, "winning_model": "1"}, '
                                                       '{"cluster_id": 3, "winning_model": 1.5}]')], f"{KEYS}, batch int, response string")
    assert [(r.cluster_id, r.winning_model) for r in C.decisions_from_responses(resp).orderBy("cluster_id").collect()] == [("1", 2), ("2", 1), ("3", None)]
