"""Abstract-vs-title comparison on the F8 edge rows."""
import math

from litspark.operators import compare as CP

SCHEMA = "corpus_id string, theme_rank int, theme_name string, total_sentences bigint, paper_count bigint, vector array<double>"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def unit(deg):
    r = math.radians(deg)
    return [math.cos(r), math.sin(r)]


def test_comparison_edges(spark):
    ab = frame(spark, [("c", 1, "A1", 10, 5, unit(0)), ("c", 2, "A2", 8, 4, unit(1)),     # both pick T1: first keeps
                       ("c", 3, "A3", 6, 3, unit(90)), ("c", 4, "A4", 4, 2, None)])
    ti = frame(spark, [("c", 1, "T1", 9, 4, unit(0)), ("c", 2, "T2", 7, 3, unit(180)),
                       ("c", 3, "T3", 5, 2, unit(90 + math.degrees(math.acos(0.3996))))])
    rows = {r.row_order: r for r in CP.comparison(ab, ti).collect()}
    assert (rows[1].title_theme, rows[1].convergence, rows[1].similarity) == ("T1", "CONVERGED", 1.0)
    assert (rows[2].title_theme, rows[2].convergence) == (None, "ABSTRACT ONLY")      # claimed by A1
    assert rows[3].title_theme == "T3" and rows[3].convergence == "DIVERGED"         # 0.3996 shows as 0.4
    assert rows[3].similarity == 0.4
    assert rows[4].convergence == "ABSTRACT ONLY"
    title_only = sorted(r.title_theme for r in rows.values() if r.convergence == "TITLE ONLY")
    assert title_only == ["T2"]                                                      # first title theme is claimed
    cnt = CP.convergence_counts(CP.comparison(ab, ti)).first()
    assert (cnt.converged, cnt.diverged, cnt.abstract_only, cnt.title_only) == (1, 1, 2, 1)


def test_exact_threshold_and_ties(spark):
    ab = frame(spark, [("c", 1, "A1", 1, 1, [0.4, math.sqrt(1 - 0.16)])])
    ti = frame(spark, [("c", 1, "T1", 1, 1, [1.0, 0.0]), ("c", 2, "T2", 1, 1, [1.0, 0.0])])
    r = CP.comparison(ab, ti).filter("abstract_theme IS NOT NULL").first()
    assert r.title_theme == "T1" and r.convergence == "CONVERGED"                   # tie -> lowest index; 0.40 converges


def test_one_side_empty(spark):
    ab = frame(spark, [("c", 1, "A1", 1, 1, [1.0, 0.0])])
    empty = frame(spark, [])
    assert [r.convergence for r in CP.comparison(ab, empty).collect()] == ["ABSTRACT ONLY"]
    assert [r.convergence for r in CP.comparison(empty, ab).collect()] == ["TITLE ONLY"]


def test_name_vectors_identical_names_converge(spark):
    rows = [("c", "abstract", 1, "Digital trust in markets", 3, 2), ("c", "title", 1, "digital trust in markets", 2, 1),
            ("c", "title", 2, "Unrelated words here", 1, 1)]
    th = spark.createDataFrame(rows, "corpus_id string, run_key string, theme_rank int, theme_name string, "
                                     "total_sentences bigint, paper_count bigint")
    v = CP.theme_vectors_from_names(th)
    out = CP.comparison(v.filter("run_key = 'abstract'").drop("run_key"), v.filter("run_key = 'title'").drop("run_key"))
    r = {x.convergence: x for x in out.collect()}
    assert r["CONVERGED"].title_theme == "digital trust in markets" and r["CONVERGED"].similarity == 1.0
    assert r["TITLE ONLY"].title_theme == "Unrelated words here"
