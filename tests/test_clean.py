"""Cleaning of a raw export with the F2 edge rows, CSV tolerance, exact
numbering across many partitions."""
import csv

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from litspark.operators import clean as C
from litspark.sources import papers as P

HEADER = ["Authors", "Title", "Abstract", "Author Keywords", "Cited by", "Source title", "Year"]


def write_rows(path, rows, header=HEADER):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        for r in rows:
            w.writerow(r)


def test_tolerant_and_strict_csv(spark, tmp_dir):
    p = f"{tmp_dir}/export.csv"
    rows = [
        ["A1, B1", "A good title", "Line one\nline two with \"quotes\"", "k1", "5", "Journal", "2020"],
        ["A2", "Another title", "abs", "k2", "3", "Journal", "2019", "EXTRA"],       # too many: skipped
        ["A3", "Third title", "abs"],                                                 # too few: padded
        ["NA", "Fourth title", "", "null", "1", "Journal", "2018"],                     # NA tokens
    ]
    write_rows(p, rows)
    df = P.read_papers(spark, p)
    got = df.orderBy("row_id").collect()
    assert [r.title for r in got] == ["A good title", "Third title", "Fourth title"]
    assert got[0].abstract == 'Line one\nline two with "quotes"'
    assert got[1].cited_by is None and got[1].year is None
    assert got[2].authors is None and got[2].abstract is None and got[2].author_keywords is None
    with pytest.raises(P.MalformedCsv):
        P.read_papers(spark, p, strict=True)


def raw_frame(spark):
    rows = [
        # row_id, authors, title, abstract, keywords, cited, source, year
        (0, "A", "Valid title one", "abs", "k", "10", "Journal", "2020"),
        (1, "A", "Valid title two", "abs", "k", "10", "Journal", "2020"),   # tie with row 0: file order
        (2, "A", "Year junk", "abs", "k", "1", "Journal", "abc"),
        (3, "A", "Year blank", "abs", "k", "1", "Journal", None),
        (4, "A", "Year 1899 x", "abs", "k", "1", "Journal", "1899"),
        (5, "A", "Year 1900 x", "abs", "k", "1", "Journal", "1900"),
        (6, "A", "Year current", "abs", "k", "1", "Journal", "2026"),
        (7, "A", "Year next yr", "abs", "k", "1", "Journal", "2027"),
        (8, "A", "Year fraction", "abs", "k", "2", "Journal", "2015.5"),
        (9, "A", "Cited minus", "abs", "k", "-1", "Journal", "2020"),
        (10, "A", "Cited blank", "abs", "k", None, "Journal", "2020"),
        (11, "A", "Cited x val", "abs", "k", "x", "Journal", "2020"),
        (12, "A", "Cited zero", "abs", "k", "0", "Journal", "2020"),
        (13, "   ", "Blank author", "abs", "k", "3", "Journal", "2020"),
        (14, "A", "Five!", "abs", "k", "3", "Journal", "2020"),
        (15, "A", "Six ch", "abs", "k", "3", "Journal", "2020"),
        (16, "A", "Source pages", "abs", "k", "3", "pp. 528-542", "2020"),
        (17, "A", "Source range", "abs", "k", "3", "12-15", "2020"),
        (18, "A", "Source 3D", "abs", "k", "3", "3D Research", "2020"),
        (19, "A", "Source pager", "abs", "k", "3", "Page Turner", "2020"),
        (20, "A", "Null abstract", None, None, "3", "Journal", "2020"),
        (21, "A", "Exact dup xx", "abs", "k", "4", "Journal", "2020"),
        (22, "A", "Exact dup xx", "abs", "k", "4", "Journal", "2020"),
        (23, "A", "  Exact dup xx ", "abs", "k", "4", "Journal", "2020"),
    ]
    df = spark.createDataFrame(rows, "row_id long, authors string, title string, abstract string, "
                                     "author_keywords string, cited_by string, source_title string, year string")
    return df.withColumn("corpus_id", F.lit("c"))


def test_clean_rules(spark):
    out = C.clean_papers(raw_frame(spark), 2026).orderBy("sr_no").collect()
    titles = [r.title for r in out]
    for gone in ["Year junk", "Year blank", "Year 1899 x", "Year next yr", "Cited minus", "Cited blank",
                 "Cited x val", "Blank author", "Five!", "Source pages", "Source range", "Source 3D"]:
        assert gone not in titles, gone
    for kept in ["Year 1900 x", "Year current", "Year fraction", "Cited zero", "Six ch", "Source pager",
                 "Null abstract"]:
        assert kept in titles, kept
    assert titles.count("Exact dup xx") == 1
    assert [r.sr_no for r in out] == list(range(1, len(out) + 1))
    assert titles[:2] == ["Valid title one", "Valid title two"]          # cited 10 first, ties in file order
    frac = [r for r in out if r.title == "Year fraction"][0]
    assert frac.year == 2015
    dup = [r for r in out if r.title == "Exact dup xx"][0]
    assert dup.row_id == 21


def test_audit_matches_steps(spark):
    raw = raw_frame(spark)
    a = {r.step: r.rows for r in C.clean_audit(raw, 2026).collect()}
    assert a[1] == raw.count()
    assert a[12] == C.clean_papers(raw, 2026).count()
    assert a[3] == C.clean_year(C.clean_select(raw), 2026).count()
    assert a[9] == C.clean_source_regex(C.clean_required_text(C.clean_strip(
        C.clean_cited(C.clean_year(C.clean_select(raw), 2026))))).count()


def test_sequence_across_partitions(spark):
    df = spark.range(0, 5000, 1, 17).select(
        (F.col("id") % 3).cast("string").alias("g"), (F.col("id") * 7919 % 5000).alias("v"))
    got = C.sequence(df, [F.col("g"), F.col("v").desc()], "seq", group_col="g")
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    exp = df.withColumn("seq", F.row_number().over(w))
    assert got.select("g", "v", "seq").exceptAll(exp.select("g", "v", "seq")).count() == 0
    assert got.count() == 5000


def test_columns_by_header_name_and_rows_in_file_order(spark, tmp_dir):
    header = ["EID", "Year", "Title", "DOI", "Authors", "Source title", "Cited by", "Abstract", "Author Keywords", "Link"]
    import os
    os.makedirs(f"{tmp_dir}/export")
    big = [[f"e{i}", "2020", f"Title {i}", "10/x", "A", "J", str(i), "text " * 50, "k", "l"] for i in range(300)]
    write_rows(f"{tmp_dir}/export/part-1.csv", [["e", "2019", "First title", "d", "A", "J", "1", "abs\nline", "k", "l"],
                                               ["e", "2019", "Too long", "d", "A", "J", "1", "abs", "k", "l", "more"],
                                               ["e", "2019", "Too short"]], header)
    write_rows(f"{tmp_dir}/export/part-2.csv", big, header)
    got = P.read_papers(spark, f"{tmp_dir}/export").orderBy("row_id").collect()
    assert [r.title for r in got] == ["First title", "Too short", *[f"Title {i}" for i in range(300)]]
    assert (got[0].authors, got[0].year, got[0].abstract, got[0].cited_by) == ("A", "2019", "abs\nline", "1")
    assert (got[1].title, got[1].authors, got[1].abstract) == ("Too short", None, None)
    assert len({r.row_id for r in got}) == len(got)
    with pytest.raises(P.MalformedCsv):
        P.read_papers(spark, f"{tmp_dir}/export", strict=True)


def test_missing_column_and_differing_headers(spark, tmp_dir):
    import os
    write_rows(f"{tmp_dir}/missing.csv", [["A", "T", "abs", "1", "J", "2020"]], [h for h in HEADER if h != "Author Keywords"])
    df = P.read_papers(spark, f"{tmp_dir}/missing.csv")
    assert df.first().abstract == "abs" and "author_keywords" not in df.columns
    with pytest.raises(C.MissingColumns, match="author_keywords"):
        C.clean_select(df)
    os.makedirs(f"{tmp_dir}/mixed")
    write_rows(f"{tmp_dir}/mixed/a.csv", [["A", "T", "abs", "k", "1", "J", "2020"]])
    write_rows(f"{tmp_dir}/mixed/b.csv", [["T", "A", "abs", "k", "1", "J", "2020"]], ["Title", "Authors", *HEADER[2:]])
    with pytest.raises(Exception, match="(?i)header"):
        P.read_papers(spark, f"{tmp_dir}/mixed").collect()


@pytest.mark.parametrize("text,value", [("5", 5), (" 1e3 ", 1000), ("5d", None), ("2015f", None), ("Infinity", None), (" NaN ", None), ("0x10", None),
                                        ("3000000000", 3000000000), ("1e999", None), ("1e18", 10**18), ("1e19", None), ("", None), (None, None), (".5", 0)])
def test_numbers(spark, text, value):
    df = spark.createDataFrame([(text,)], "cited_by string")
    got = C.clean_cited(df).collect()
    assert [r.cited_by for r in got] == ([] if value is None else [value])
