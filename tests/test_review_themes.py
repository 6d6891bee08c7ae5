"""Review table (F6 edge rows), theme map, consolidation (F7), coverage,
uncovered topics, taxonomy merge and counts."""

from litspark.operators import review as R
from litspark.operators import taxonomy as X
from litspark.operators import themes as TH

KEYS = "corpus_id string, run_key string"


def rv(spark, rows):
    return spark.createDataFrame(
        [("c", "abstract", n, lab, ev, 10, 5, ap, rn, rs, cid) for n, lab, ev, ap, rn, rs, cid in rows],
        f"{KEYS}, row_no int, topic_label string, top_evidence string, sentences bigint, papers bigint, "
        "approve string, rename_to string, reasoning string, cluster_id int")


def test_theme_map_edge_rows(spark):
    rows = [(1, "Alpha", "e", " YES ", "", "", 7), (2, "Beta", "e", "y", "  ", "", 3), (3, "Gamma", "e", "1", None, "", 9),
            (4, "Delta", "e", "true", "Shared", "", 4), (5, "Eps", "e", "no", "", "", 5), (6, "Zeta", "e", "", "", "", 6),
            (7, "Eta", "e", None, "", "", 8), (8, "Theta", "e", "Yes", "Shared", "", 2)]
    tm = R.theme_map(rv(spark, rows)).collect()
    got = sorted((r.theme_pos, r.theme_name, r.member_pos, r.cluster_id) for r in tm)
    assert got == [(1, "Alpha", 1, 7), (2, "Beta", 1, 3), (3, "Gamma", 1, 9), (4, "Shared", 1, 4), (4, "Shared", 2, 2)]


def test_auto_flag_and_bulk(spark):
    rows = [(1, "Springer Nature", "x", "yes", "", "", 1), (2, "Fine", "Under a LICENCE by", "yes", "", "keep", 2),
            (3, "Fine", "normal evidence", "no", "", "", 3)]
    f = {r.row_no: (r.approve, r.reasoning) for r in R.auto_flag(rv(spark, rows)).collect()}
    assert f == {1: ("no", "Auto-flagged: boilerplate"), 2: ("no", "keep"), 3: ("yes", "")}
    assert {r.approve for r in R.reject_all(rv(spark, rows)).collect()} == {"no"}
    assert {r.approve for r in R.approve_all(rv(spark, rows)).collect()} == {"yes"}


def topics_frames(spark):
    t = spark.createDataFrame([("c", "abstract", 1, 30, "L1", ["a1", "a2", "a3"]), ("c", "abstract", 2, 20, "L2", ["b1"]),
                               ("c", "abstract", 3, 10, "L3", ["c1", "c2"])],
                              f"{KEYS}, cluster_id int, size int, label string, top_sentences array<string>")
    p = spark.createDataFrame([("c", "abstract", 1, 100), ("c", "abstract", 1, 101), ("c", "abstract", 2, 101),
                               ("c", "abstract", 2, 102), ("c", "abstract", 3, 103)],
                              f"{KEYS}, cluster_id int, paper_id long")
    return t, p


def test_consolidate_edges(spark):
    t, p = topics_frames(spark)
    tm = spark.createDataFrame([("c", "abstract", "T1", 1, 1, 2), ("c", "abstract", "T1", 1, 2, 99),
                                ("c", "abstract", "T1", 1, 3, 1), ("c", "abstract", "T2", 2, 1, 1),
                                ("c", "abstract", "Empty", 3, 1, 98)],
                               f"{KEYS}, theme_name string, theme_pos int, member_pos int, cluster_id int")
    th = {r.theme_name: r for r in TH.themes_ranked(TH.consolidate(tm, t, p)).collect()}
    a = th["T1"]
    assert a.cluster_ids == [2, 99, 1] and a.merged_topic_labels == ["L2", "L1"]
    assert a.total_sentences == 50 and a.sub_topics == 2 and a.paper_count == 3
    assert a.representative_sentences == ["b1", "a1", "a2"]
    assert th["T2"].total_sentences == 30 and th["T2"].paper_count == 2
    e = th["Empty"]
    assert (e.total_sentences, e.sub_topics, e.paper_count, e.representative_sentences) == (0, 0, 0, [])
    assert [th[n].theme_rank for n in ("T1", "T2", "Empty")] == [1, 2, 3]
    un = [r.cluster_id for r in TH.uncovered(tm, t).collect()]
    assert un == [3]
    cov = {r.theme_name: r for r in TH.theme_coverage(TH.themes_ranked(TH.consolidate(tm, t, p))).collect()}
    assert abs(cov["T1"].pct - 50 / 80) < 1e-9 and cov["T1"].saturated


def test_taxonomy_merge_and_counts(spark):
    th = spark.createDataFrame([("c", "abstract", "A", 1, 10, 3, 1), ("c", "abstract", "B", 2, 5, 2, 1),
                                ("c", "abstract", "C", 3, 2, 1, 1)],
                               f"{KEYS}, theme_name string, theme_rank int, total_sentences bigint, paper_count bigint, "
                               "sub_topics int")
    resp = spark.createDataFrame([("c", "abstract", 0, '[{"theme_name": "A", "pajais_match": "Healthcare IT", '
                                   '"match_confidence": 0.8, "is_novel": false}, {"theme_name": "B", "pajais_match": '
                                   '"Made Up", "is_novel": false}, {"theme_name": "A", "pajais_match": "Cloud Computing",'
                                   ' "is_novel": false}]')], f"{KEYS}, batch int, response string")
    tax = {r.theme_name: r for r in X.merge_taxonomy(th, X.taxonomy_from_responses(resp)).collect()}
    assert tax["A"].pajais_match == "Cloud Computing"
    assert tax["B"].valid_category is False
    assert (tax["C"].pajais_match, tax["C"].is_novel, tax["C"].reasoning) == (
        "NOVEL", True, "Taxonomy validation threshold unmet")
    c = X.taxonomy_counts(X.merge_taxonomy(th, X.taxonomy_from_responses(resp))).first()
    assert (c.themes, c.novel, c.mapped, c.novel_names) == (3, 1, 2, ["C"])
    assert len(X.CATEGORIES) == 25


def test_caps_are_arguments_and_are_reached(spark):
    from litspark.operators import report, review, topics
    rows = [("c", "abstract", i, 1000 - i, 5, [float(i), 1.0], ["x" * 300], f"Label {i}", "why", 0.5, 1) for i in range(230)]
    t = spark.createDataFrame(rows, "corpus_id string, run_key string, cluster_id int, size int, paper_count int, centroid array<double>, "
                                    "top_sentences array<string>, label string, reasoning string, confidence double, winning_model int")
    full = topics.topics_ranked(t)
    assert full.count() == 230 and topics.topics_ranked(t, topics.MAX_TOPICS).count() == 120
    assert review.review_labels(full).count() == 230 and review.review_labels(full, review.MAX_REVIEW_ROWS).count() == 200
    assert review.phase_snapshot(full, "labels").count() == 230
    assert review.phase_snapshot(full, "labels", cap=review.MAX_SNAPSHOT_LABELS).count() == 100
    assert topics.chart_sizes(full).count() == topics.chart_map(full).count() == 230
    assert topics.chart_sizes(full, topics.CHART_TOP).count() == topics.chart_map(full, topics.CHART_TOP).count() == 30
    assert topics.chart_similarity(full).count() == topics.HEATMAP_TOP ** 2
    chars = lambda **k: len(report.rq5_cluster_summary(full, **k).first().top_evidence)
    assert chars() == 300 and chars(evidence_chars=report.EVIDENCE_CHARS) == 120
