"""Derived stages and the export's files at sizes where they'd move or gather too much."""

import glob
import random

from pyspark.sql import functions as F

from litspark.operators import topics
from litspark.plans import derived, queries

SF = "/root/testdata/sf0.001"
KEYS = "corpus_id string, run_key string, "


def test_members_keep_their_text_in_place(spark):
    """Sentences meet their labels without a shuffle of the text, whatever size Spark assumes (F19, F21)."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = derived.emb_members(spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Exchange hashpartitioning" not in plan


def test_evidence_by_link_equals_evidence_by_row(spark):
    r = random.Random(3)
    rows = [("c", "abstract", i, r.choice([-1, 0, 1, 2]), f"s{i}", i % 9 if i % 13 else None) for i in range(300)]
    rows += [r for r in rows if r[2] % 50 == 0]                    # sentences that come twice
    m = spark.createDataFrame(rows, KEYS + "sentence_id long, cluster_id int, sentence string, vec_id long")
    e = spark.createDataFrame([(i, [float(x) for x in (i % 3, i, 1)]) for i in [*range(9), 4]], "vec_id long, embedding array<float>")
    v = m.join(e, "vec_id")
    cents = topics.centroids(v, None)
    old = topics.top_evidence(v, None, cents, dim=3)
    new = topics.top_evidence(m, e, cents, dim=3, link="vec_id")
    assert new.columns == old.columns
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, old.collect())) and old.count() == 9


def test_export_has_files_by_its_rows(spark, monkeypatch):
    """A file with quoted line breaks is one task's: their number grows with the rows (F24)."""
    monkeypatch.setattr(queries, "FILE_ROWS", 20)
    path = queries._raw_csv(spark, SF)
    n = spark.read.parquet(f"{SF}/documents.parquet").agg(F.count("*")).first()[0]
    assert len(glob.glob(f"{path.removeprefix('file://')}/*.csv")) >= n // 20
