"""End to end on the synthetic corpus (the reference's acceptance check is
that topics get real labels), the stage store, and the driver contract."""
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from litspark.operators import council
from litspark.plans.pipeline import Pipeline
from litspark.session import scratch_path
from litspark.sources.corpus import TOPIC_TEMPLATES, gen_corpus
from litspark.sources.store import StageMissing, StageStore, stage_inventory

SF001 = "/root/testdata/sf0.001"


def test_gen_corpus_shape(spark):
    p = gen_corpus(spark, 20)
    assert p.count() == 100
    r = p.orderBy("sr_no").collect()
    assert r[0].year == 2011 and r[13].year == 2010
    assert all(0 <= x.cited_by <= 200 for x in r)
    assert {x.topic for x in r} == set(TOPIC_TEMPLATES)
    assert all("{" not in x.abstract for x in r)


def test_pipeline_end_to_end(spark):
    pl = Pipeline(spark, scratch_path(spark, "pipe"), threshold=3.0)
    labels = pl.discover_and_label(gen_corpus(spark, 20), run_keys=("abstract", "title"))
    q = council.label_quality(labels).first()
    assert q.status == "OK" and q.topics >= 3
    again = pl.discover_and_label(gen_corpus(spark, 20), run_keys=("abstract", "title"))   # compute-once
    assert again.count() == labels.count()
    files_before = set(pl.store.read("labels").inputFiles())
    emb_before = set(pl.store.read("embeddings").inputFiles())
    finer = pl.recluster(2.0)                                          # reuses stored vectors
    assert finer.count() >= 1
    assert set(pl.store.read("labels").inputFiles()) != files_before          # labels recomputed
    assert set(pl.store.read("embeddings").inputFiles()) == emb_before         # vectors reused
    labels = pl.store.read("labels")                                           # the recomputed table
    th = pl.themes()
    assert th.count() == labels.count()
    tax = pl.taxonomy()
    assert tax.count() == th.count()
    comp = pl.compare()
    n_abs = th.filter("run_key = 'abstract'").count()
    assert comp.filter("abstract_theme IS NOT NULL").count() == n_abs
    inv = stage_inventory(pl.store.counts()).first()
    assert inv.phase == "taxonomy" and inv.status.startswith("ready")


def test_one_changed_paper_rebuilds_its_corpus_only(spark):
    """A paper added to one of three corpora: that one is made anew, the others' files stay; a lower threshold is a cut of the stored tree."""
    papers = gen_corpus(spark, 9).withColumn("corpus_id", F.concat(F.lit("c/ "), (F.col("paper_id") % 3).cast("string"))).checkpoint()
    pl = Pipeline(spark, scratch_path(spark, "digests"), threshold=2.0, tree_height=3.0)
    pl.discover_and_label(papers)
    stages = ("sentences", "embeddings", "unit_map", "merges", "assignments", "labels")
    files = lambda: {s: set(pl.store.read(s).inputFiles()) for s in stages}
    before = files()
    pl.discover_and_label(papers.repartition(7))                       # another order, the same rows
    assert files() == before
    extra = papers.filter("corpus_id = 'c/ 1'").limit(1).withColumns({"paper_id": F.lit(999).cast(papers.schema["paper_id"].dataType),
                                                                      "abstract": F.lit("An added paper that speaks of something else at length. It has two sentences of some length.")})
    got = pl.discover_and_label(papers.unionByName(extra))
    after = files()
    for s in stages:
        mine = lambda names: {f for f in names if "%201" in f or " 1/" in f or "%25201" in f}
        assert before[s] - mine(before[s]) == after[s] - mine(after[s]) and mine(before[s]) and not mine(before[s]) & mine(after[s]), s
    assert pl.store.read("sentences").filter("paper_id = 999").count() == 2 and got.select("corpus_id").distinct().count() >= 1
    trees = after["merges"]
    high = {r.corpus_id: r.n for r in pl.store.read("assignments").groupBy("corpus_id").agg(F.count_distinct("cluster_id").alias("n")).collect()}
    pl.recluster(1.0)
    assert files()["merges"] == trees                                  # cut, not built
    pl.recluster(3.5)
    assert not files()["merges"] & trees and high                      # above what the tree was built to
    # What is gone from a corpus goes from the store.
    pl.discover_and_label(papers)
    assert pl.store.read("sentences").filter("paper_id = 999").count() == 0


def test_cached_by_digest(spark):
    from litspark.sources.store import row_digests
    st = StageStore(spark, scratch_path(spark, "by-digest"))
    rows = spark.createDataFrame([("a", "abstract", 1, "x"), ("a", "abstract", 1, "x"), ("b", "abstract", 2, None), ("b", "title", 2, "y")], "corpus_id string, run_key string, n int, t string")
    built = []

    def build(keys):
        built.append(sorted((r.corpus_id, r.run_key) for r in keys.collect()))
        return rows.join(keys, ["corpus_id", "run_key"], "left_semi")

    d = row_digests(rows)
    assert st.cached_by("s", d, build).count() == 4 and st.cached_by("s", row_digests(rows.repartition(3)), build).count() == 4
    rows = rows.unionByName(spark.createDataFrame([("b", "title", 3, "z")], rows.schema))
    assert st.cached_by("s", row_digests(rows), build).count() == 5
    once = rows.dropDuplicates()
    assert {r.digest for r in row_digests(once).filter("corpus_id = 'a'").collect()} != {r.digest for r in d.filter("corpus_id = 'a'").collect()}
    assert st.cached_by("s", row_digests(rows, parameters="other"), build).count() == 5
    assert [len(b) for b in built] == [3, 1, 3] and built[1] == [("b", "title")]


def test_stage_missing(spark):
    st = StageStore(spark, scratch_path(spark, "empty"))
    with pytest.raises(StageMissing):
        st.read("themes")


def test_entry_and_contract(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
    assert {"corpus_stats", "ward_cluster", "merge_council", "comparison"} <= set(E.queries())


def test_streaming_ingest_equals_batch(spark, tmp_dir):
    import shutil

    from litspark.operators import text
    from litspark.streaming.ingest import document_papers, start_ingest
    src = f"{tmp_dir}/docs"
    os.makedirs(src)
    shutil.copy(SF001 + "/documents.parquet", src)
    q = start_ingest(spark, src, f"{tmp_dir}/sentences", f"{tmp_dir}/ckpt")
    q.awaitTermination(300)
    got = spark.read.parquet(f"{tmp_dir}/sentences")
    docs = spark.read.parquet(SF001 + "/documents.parquet")
    exp = text.sentence_table(text.run_texts(document_papers(docs), ("abstract", "title")))
    cols = ["corpus_id", "run_key", "sentence_id", "sentence"]
    assert got.count() == exp.count()
    assert got.select(*cols).exceptAll(exp.select(*cols)).count() == 0


def test_package_outputs(spark):
    from litspark.sources.sinks import package_outputs
    st = StageStore(spark, scratch_path(spark, "pkg"))
    st.write("themes", spark.createDataFrame([("c", "abstract", "T", 1)], "corpus_id string, run_key string, theme_name string, n int"))
    target = scratch_path(spark, "out")
    missing = package_outputs(st, target, {"themes_abstract": "themes", "taxonomy_abstract": "taxonomy"})
    assert len(missing) == 1 and "taxonomy" in missing[0]
    assert spark.read.parquet(f"{target}/themes_abstract").count() == 1


def test_stage_json_export(spark):
    st = StageStore(spark, scratch_path(spark, "json"))
    st.write("themes", spark.createDataFrame([("c", "abstract", "T", [1, 2])],
                                             "corpus_id string, run_key string, theme_name string, cluster_ids array<int>"))
    out = scratch_path(spark, "json-out")
    st.export_json("themes", out)
    back = spark.read.json(out).first()
    assert back.theme_name == "T" and list(back.cluster_ids) == [1, 2]


def test_replayed_epoch_is_idempotent(spark, tmp_dir):
    from litspark.streaming.ingest import write_epoch
    rows = spark.createDataFrame([("c", "abstract", 1, "s1"), ("c", "title", 2, "s2")],
                                 "corpus_id string, run_key string, sentence_id long, sentence string")
    stage = f"{tmp_dir}/stage"
    write_epoch(rows, 0, stage)
    write_epoch(rows.limit(1), 1, stage)
    write_epoch(rows, 0, stage)                        # replay of epoch 0
    got = spark.read.parquet(stage)
    assert got.count() == 3 and got.filter("epoch = 0").count() == 2


def test_each_corpus_and_run_is_built_once(spark):
    pl = Pipeline(spark, scratch_path(spark, "pipe"), threshold=3.0)
    first = gen_corpus(spark, 12)
    second = first.withColumn("corpus_id", F.lit("second"))
    a = {tuple(r) for r in pl.discover_and_label(first).select("corpus_id", "run_key", "cluster_id", "label").collect()}
    files = lambda: {f for s in ("labels", "embeddings", "assignments") for f in pl.store.read(s).inputFiles()}
    before = files()
    t = {tuple(r) for r in pl.discover_and_label(first, ("combined",)).select("corpus_id", "run_key", "cluster_id", "label").collect()}
    assert t and {r[1] for r in t} == {"combined"} and {r[1] for r in a} == {"abstract"}
    b = pl.discover_and_label(second).select("corpus_id", "run_key", "cluster_id", "label").collect()
    assert b and {r.corpus_id for r in b} == {"second"}
    assert before <= files()                                   # nothing of the first was written again
    assert {tuple(r) for r in pl.discover_and_label(first).select("corpus_id", "run_key", "cluster_id", "label").collect()} == a
    vec = pl.store.read("embeddings").filter("corpus_id <> 'second' and run_key = 'abstract'")
    assert vec.count() == pl.store.read("sentences").filter("corpus_id <> 'second' and run_key = 'abstract'").count()


def test_raw_export_to_labels(spark, tmp_dir):
    from litspark.sources.papers import EXPORT_COLUMNS
    from litspark.sources.sinks import write_csv
    p = gen_corpus(spark, 12)
    cols = [F.col(s).cast("string").alias(h) if s in p.columns else F.lit("x").alias(h) for h, s in reversed(EXPORT_COLUMNS)]
    write_csv(p.select(F.lit("10.1/x").alias("DOI"), *cols), f"{tmp_dir}/export")
    stats, labels = Pipeline(spark, scratch_path(spark, "pipe"), threshold=3.0).run_export(f"{tmp_dir}/export", "mine", 2026, ("abstract",))
    s = stats.first()
    assert s.corpus_id == "mine" and 0 < s.papers <= p.count() and s.abstract_sentences > s.papers
    assert labels.count() >= 3


def test_empty_and_broken_stages(spark):
    st = StageStore(spark, scratch_path(spark, "st"))
    rows = spark.createDataFrame([("c", "abstract", "T", 1)], "corpus_id string, run_key string, theme_name string, n int")
    st.write("themes", rows.limit(0))
    assert st.exists("themes") and st.read("themes").count() == 0 and st.read("themes").columns
    inv = stage_inventory(st.counts()).first()
    assert (inv.phase, inv.status) == ("themes", "EMPTY")
    assert st.cached("themes", lambda: rows).count() == 1 and st.cached("themes", lambda: rows.limit(0)).count() == 1
    assert st.files().filter("path like '%parquet%' and kb >= 0").count() > 0
    path, fs = st._file_system("labels/corpus_id=c/run_key=abstract/part-0.parquet")
    out = fs.create(path)
    out.write(bytearray(b"not parquet"))
    out.close()
    assert st.cached("labels", lambda: rows).count() == 1
    st.clear("themes")
    assert not st.exists("themes")
