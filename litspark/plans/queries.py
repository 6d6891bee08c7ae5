"""Registered queries: one per operator of the inventory. Each takes
(spark, sf_dir) and returns a flat DataFrame (arrays joined to strings,
floats rounded to 6) whose columns match the DuckDB oracle in ``oracle.py``.
Queries without an oracle entry are property-checked in tests/."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import (clean, cluster, compare, council, embed, report, review, taxonomy, text, themes,
                         topics)
from ..session import KEYS, scratch_path, table_path
from ..sources import papers as P
from ..sources.sinks import package_outputs, write_csv, write_projected_csv
from ..sources.store import StageStore, best_stage, stage_inventory
from . import derived as D

CURRENT_YEAR = 2026       # a parameter, not current_date(), for determinism
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def q(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c, sep: str = " | "):
    return F.array_join(F.col(c) if isinstance(c, str) else c, sep)


# -- 2.1 sources and sinks ---------------------------------------------------------

#: Rows of a file of the raw export.
FILE_ROWS = 20_000


def _raw_csv(spark, sf_dir) -> str:
    """Write the raw export view as a real export has it (the export's header names in another
    order, among other columns, in several files in row order) and return the folder."""
    raw = P.raw_papers_from_documents(spark, sf_dir)
    name = {s: h for h, s in P.EXPORT_COLUMNS}
    order = ["source_title", "year", "abstract", "title", "cited_by", "authors", "author_keywords"]
    # One task reads a file with quoted line breaks, so files are as many as the rows ask for.
    files = max(4, -(-raw.count() // FILE_ROWS))
    out = raw.repartitionByRange(files, "row_id").sortWithinPartitions("row_id").select(
        F.concat(F.lit("2-s2.0-"), F.col("row_id")).alias("EID"), *[F.col(s).alias(name[s]) for s in order[:4]],
        F.concat(F.lit("10.1000/"), F.col("row_id")).alias("DOI"), *[F.col(s).alias(name[s]) for s in order[4:]])
    path = scratch_path(spark, "raw_csv")
    write_csv(out, path)
    return path


def _numbered(papers):
    """row_no instead of row_id: the position in the export."""
    return clean.sequence(papers, ["row_id"], "row_no").drop("corpus_id", "row_id")


@q("src_csv")
def src_csv(spark, sf_dir):
    return _numbered(P.read_papers(spark, _raw_csv(spark, sf_dir)))


@q("src_csv_strict")
def src_csv_strict(spark, sf_dir):
    return _numbered(P.read_papers(spark, _raw_csv(spark, sf_dir), strict=True))


@q("sink_csv")
def sink_csv(spark, sf_dir):
    c = clean.clean_papers(P.raw_papers_from_documents(spark, sf_dir), CURRENT_YEAR)
    path = scratch_path(spark, "clean_csv")
    write_csv(c.drop("row_id"), path, order_by=["corpus_id", "sr_no"])
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@q("sink_projected_csv")
def sink_projected_csv(spark, sf_dir):
    labels = D.labelled_topics(spark, sf_dir)[0]
    s = report.rq5_cluster_summary(labels, evidence_chars=report.EVIDENCE_CHARS)
    path = scratch_path(spark, "rq5_csv")
    fields = ["cluster_id", "label", "sentence_count", "paper_count", "winning_model", "top_evidence", "not_there"]
    write_projected_csv(s.select(*KEYS, *[c for c in s.columns if c not in KEYS]), path, list(KEYS) + fields)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def _store(spark, sf_dir) -> StageStore:
    tax, th, tmap, labels, p = D.emb_taxonomy(spark, sf_dir)
    st = StageStore(spark, scratch_path(spark, "stages"))
    st.write("labels", labels)
    st.write("themes", th)
    st.write("taxonomy", tax)
    return st


@q("stage_write_read")
def stage_write_read(spark, sf_dir):
    th = D.emb_themes(spark, sf_dir)[0]
    st = StageStore(spark, scratch_path(spark, "stages"))
    st.write("themes", th)
    back = st.read("themes")
    return back.select(*KEYS, "theme_name", "theme_rank", "total_sentences", "paper_count", "sub_topics",
                       joined("merged_topic_labels").alias("labels"))


@q("stage_cached")
def stage_cached(spark, sf_dir):
    st = StageStore(spark, scratch_path(spark, "stages"))
    th = D.emb_themes(spark, sf_dir)[0]
    first = st.cached("themes", lambda: th)
    again = st.cached("themes", lambda: th.limit(0))   # must come from the store
    return again.select(*KEYS, "theme_name", "theme_rank", "total_sentences").unionByName(
        first.select(*KEYS, "theme_name", "theme_rank", "total_sentences")).distinct()


@q("stage_inventory")
def stage_inventory_q(spark, sf_dir):
    return stage_inventory(_store(spark, sf_dir).counts())


@q("package_outputs")
def package_outputs_q(spark, sf_dir):
    """The deliverables copied out of a store, and the warning for the one it lacks."""
    st, target = _store(spark, sf_dir), scratch_path(spark, "package")
    wanted = {"labels": "labels", "themes": "themes", "taxonomy_map": "taxonomy", "comparison": "comparison"}
    missing = package_outputs(st, target, wanted)
    lost = {m.split(" for ")[1].split(":")[0] for m in missing}
    out = None
    for name in wanted:
        if name in lost:
            rows = spark.createDataFrame([(name, None, None, 0, "missing")], "deliverable string, corpus_id string, run_key string, rows long, status string")
        else:
            rows = spark.read.parquet(f"{target}/{name}").groupBy(*KEYS).agg(F.count("*").alias("rows")).select(
                F.lit(name).alias("deliverable"), *KEYS, "rows", F.lit("written").alias("status"))
        out = rows if out is None else out.unionByName(rows)
    return out


@q("stage_files")
def stage_files_q(spark, sf_dir):
    """Which stages hold data files, from the store's file listing with sizes."""
    f = _store(spark, sf_dir).files().filter("path like '%.parquet' and kb > 0")
    return f.select(F.regexp_extract("path", r"/(labels|themes|taxonomy)/", 1).alias("stage")).distinct()


@q("best_stage")
def best_stage_q(spark, sf_dir):
    return best_stage(_store(spark, sf_dir).counts(), "title")


# -- 2.2 cleaning ------------------------------------------------------------------

def _raw(spark, sf_dir):
    return P.raw_papers_from_documents(spark, sf_dir)


@q("clean_select")
def clean_select(spark, sf_dir):
    return clean.clean_select(_raw(spark, sf_dir))


@q("clean_year")
def clean_year(spark, sf_dir):
    return clean.clean_year(clean.clean_select(_raw(spark, sf_dir)), CURRENT_YEAR)


@q("clean_cited")
def clean_cited(spark, sf_dir):
    return clean.clean_cited(clean_year(spark, sf_dir))


@q("clean_strip")
def clean_strip(spark, sf_dir):
    return clean.clean_strip(clean_cited(spark, sf_dir))


@q("clean_required_text")
def clean_required_text(spark, sf_dir):
    return clean.clean_required_text(clean_strip(spark, sf_dir))


@q("clean_source_regex")
def clean_source_regex(spark, sf_dir):
    return clean.clean_source_regex(clean_required_text(spark, sf_dir))


@q("clean_key_nulls")
def clean_key_nulls(spark, sf_dir):
    return clean.clean_key_nulls(clean_source_regex(spark, sf_dir))


@q("clean_dedupe")
def clean_dedupe(spark, sf_dir):
    return clean.clean_dedupe(clean_key_nulls(spark, sf_dir))


@q("clean_order")
def clean_order(spark, sf_dir):
    return clean.clean_order_seq(clean_dedupe(spark, sf_dir)).select("corpus_id", "sr_no", "row_id", "cited_by", "year")


@q("clean_seq")
def clean_seq(spark, sf_dir):
    return clean.clean_papers(_raw(spark, sf_dir), CURRENT_YEAR)


@q("clean_audit")
def clean_audit(spark, sf_dir):
    return clean.clean_audit(_raw(spark, sf_dir), CURRENT_YEAR)


@q("clean_summary")
def clean_summary(spark, sf_dir):
    return clean.clean_summary(clean.clean_rows(_raw(spark, sf_dir), CURRENT_YEAR))


# -- 2.3 text ----------------------------------------------------------------------

def _papers(spark, sf_dir):
    return P.papers_from_documents(spark, sf_dir)


@q("run_text")
def run_text(spark, sf_dir):
    return text.run_texts(_papers(spark, sf_dir))


@q("strip_boilerplate")
def strip_boilerplate(spark, sf_dir):
    return text.strip_boilerplate(text.run_texts(_papers(spark, sf_dir)))


@q("split_sentences")
def split_sentences(spark, sf_dir):
    t = text.strip_boilerplate(text.run_texts(_papers(spark, sf_dir)))
    return text.split_sentences(t).select(*KEYS, "paper_id", "pos", "raw")


@q("min_len")
def min_len(spark, sf_dir):
    t = text.strip_boilerplate(text.run_texts(_papers(spark, sf_dir)))
    pieces = text.split_sentences(t).withColumn("sentence", text.py_strip("raw"))
    kept = F.length("sentence") > text.MIN_SENTENCE_CHARS
    return pieces.groupBy(*KEYS).agg(F.sum(kept.cast("int")).cast("bigint").alias("kept"),
                                     F.sum((~kept).cast("int")).cast("bigint").alias("dropped"))


@q("sentence_table")
def sentence_table(spark, sf_dir):
    return text.sentence_table(text.run_texts(_papers(spark, sf_dir)))


@q("corpus_stats")
def corpus_stats(spark, sf_dir):
    s = text.corpus_stats(_papers(spark, sf_dir))
    return s.select("corpus_id", "papers", "abstract_sentences", "title_sentences",
                    joined("columns", "|").alias("columns"),
                    F.array_join(F.col("years").cast("array<string>"), "|").alias("years"),
                    "min_year", "max_year")


# -- 2.4 vectors, clusters, topic summaries ----------------------------------------

@q("embed")
def embed_q(spark, sf_dir):
    s = text.sentence_table(text.run_texts(_papers(spark, sf_dir)))
    e = embed.embed(s, "sentence")
    return e.select(*KEYS, "sentence_id", F.size("embedding").alias("dim"),
                    r6(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))).alias("norm"))


@q("reduce_dims")
def reduce_dims(spark, sf_dir):
    v = D.emb_vectors(spark, sf_dir)
    r = embed.reduce_dims(v, embed.REDUCED_DIM)
    return r.select("sentence_id", *[r6(f"c{i}").alias(f"c{i}") for i in range(embed.REDUCED_DIM)])


#: Points of a block in the registered searches: small, so that a corpus of a few hundred points is several blocks.
BLOCK = 64


def _reduced_points(spark, sf_dir):
    v = embed.reduce_dims(D.emb_vectors(spark, sf_dir), embed.REDUCED_DIM).drop("embedding")
    return D.emb_rows(spark, sf_dir).join(v, "sentence_id").select(*KEYS, "sentence_id", *[f"c{i}" for i in range(embed.REDUCED_DIM)])


@q("knn_graph")
def knn_graph(spark, sf_dir):
    m = D.emb_rows(spark, sf_dir)
    pts = m.join(D.emb_vectors(spark, sf_dir), "sentence_id").select(*KEYS, "sentence_id", F.col("embedding").alias("vec"))
    g = embed.knn_graph(pts, embed.KNN_K, metric="cosine", block=BLOCK)
    return g.select(*KEYS, "src", "dst", r6("similarity").alias("similarity"), "rank")


@q("ward_cluster")
def ward_cluster(spark, sf_dir):
    return cluster.ward(_reduced_points(spark, sf_dir), embed.REDUCED_DIM, cluster.DISTANCE_THRESHOLD)


@q("ward_certificate")
def ward_certificate(spark, sf_dir):
    """What makes the clusters right, whatever their ids (see ``cluster.ward_certificate``), at the default cut and at one below it read from the same tree."""
    pts = _reduced_points(spark, sf_dir).checkpoint()
    tree = cluster.merge_tree(pts, embed.REDUCED_DIM, cluster.DISTANCE_THRESHOLD, block=BLOCK)
    out = None
    for t in (cluster.DISTANCE_THRESHOLD, 0.9):
        c = cluster.ward_certificate(pts, embed.REDUCED_DIM, *tree, cluster.cut_tree(*tree, t).checkpoint(), t, block=BLOCK).withColumn("cut", F.lit(t))
        out = c if out is None else out.unionByName(c)
    return out


@q("reduce_dims_certificate")
def reduce_dims_certificate(spark, sf_dir):
    """The reduced coordinates are the principal components (see ``embed.components_certificate``)."""
    return embed.components_certificate(embed.reduce_dims(D.emb_vectors(spark, sf_dir), embed.REDUCED_DIM), embed.REDUCED_DIM)


def _emb_valid(spark, sf_dir):
    return D.emb_topics(spark, sf_dir)[0]


@q("drop_small")
def drop_small(spark, sf_dir):
    return topics.drop_small(D.emb_members(spark, sf_dir), topics.MIN_CLUSTER_SIZE).select(
        *KEYS, "sentence_id", "cluster_id")


@q("cluster_stats")
def cluster_stats(spark, sf_dir):
    return topics.cluster_stats(_emb_valid(spark, sf_dir))


@q("centroid")
def centroid(spark, sf_dir):
    m = _emb_valid(spark, sf_dir)
    c = topics.centroids(D.with_vectors(spark, sf_dir, m), None)
    return c.select(*KEYS, "cluster_id", F.posexplode("centroid").alias("dim", "value")).withColumn("value", r6("value"))


@q("cosine")
def cosine(spark, sf_dir):
    m, v, t = D.emb_topics(spark, sf_dir)[:3]
    j = v.join(
        t.select(*KEYS, "cluster_id", "centroid"), [*KEYS, "cluster_id"])
    from ..functions.vec import dim_of, with_cosine
    j = with_cosine(j, "embedding", "centroid", "similarity", dim_of(D.emb_vectors(spark, sf_dir), "embedding"))
    return j.select(*KEYS, "sentence_id", "cluster_id", r6("similarity").alias("similarity"))


@q("top_evidence")
def top_evidence(spark, sf_dir):
    ev = D.emb_topics(spark, sf_dir)[4]
    return ev.withColumn("similarity", r6("similarity"))


def _topic_flat(t: DataFrame) -> DataFrame:
    return t.select(*KEYS, "cluster_id", "size", "paper_count", joined("top_sentences").alias("top_sentences"), "label")


@q("topic_summary")
def topic_summary(spark, sf_dir):
    m = _emb_valid(spark, sf_dir)
    t, p = topics.topic_summary(D.with_vectors(spark, sf_dir, m), None)
    return _topic_flat(t)


@q("topics_ranked")
def topics_ranked(spark, sf_dir):
    r = D.emb_topics(spark, sf_dir)[5]
    return r.select(*KEYS, "topic_rank", "cluster_id", "size")


@q("chart_sizes")
def chart_sizes(spark, sf_dir):
    return topics.chart_sizes(D.emb_topics(spark, sf_dir)[5], topics.CHART_TOP)


@q("chart_similarity")
def chart_similarity(spark, sf_dir):
    return topics.chart_similarity(D.emb_topics(spark, sf_dir)[5]).withColumn("similarity", r6("similarity"))


@q("chart_map")
def chart_map(spark, sf_dir):
    return topics.chart_map(D.emb_topics(spark, sf_dir)[5], topics.CHART_TOP).withColumn("x", r6("x")).withColumn("y", r6("y"))


# -- 2.5 council ---------------------------------------------------------------------

PROMPT_TEMPLATE = "Label each research topic. Return a JSON array.\n\nTopics:\n{topics_text}"


def _ranked(spark, sf_dir):
    return D.emb_topics(spark, sf_dir)[5]


@q("topic_block")
def topic_block(spark, sf_dir):
    return council.topic_block(_ranked(spark, sf_dir)).select(*KEYS, "cluster_id", "block")


def _model_batches(spark, sf_dir):
    r = _ranked(spark, sf_dir).select(*KEYS, "cluster_id", "topic_rank", "size", "paper_count", "top_sentences")
    voices = F.array(*[F.struct(F.lit(i).alias("model_idx"), F.lit(b).alias("batch_size"))
                       for i, _, b in council.model_rows()])
    r = r.select("*", F.inline(voices))
    return council.batch_rows(r, "batch_size")


@q("batch_rows")
def batch_rows(spark, sf_dir):
    return _model_batches(spark, sf_dir).select(*KEYS, "model_idx", "cluster_id", "batch")


@q("batch_prompt")
def batch_prompt(spark, sf_dir):
    b = council.topic_block(_model_batches(spark, sf_dir))
    return council.batch_prompt(b, PROMPT_TEMPLATE, group=[*KEYS, "model_idx"])


@q("propose_labels")
def propose_labels(spark, sf_dir):
    m, v, t, p, ev, ranked = D.emb_topics(spark, sf_dir)
    return council.offline_proposals(m, ev, ranked).select(*KEYS, "model_idx", "cluster_id", "label",
                                                           r6("confidence").alias("confidence"))


def _responses(spark, sf_dir):
    return D.responses(spark, sf_dir)


@q("parse_json_array")
def parse_json_array(spark, sf_dir):
    props = council.proposals_from_responses(_responses(spark, sf_dir))
    return props.select(*KEYS, "model_idx", "batch", "item_pos", "cluster_id", "label",
                        r6("confidence").alias("confidence"), "reasoning", "niche")


@q("isolate_failures")
def isolate_failures(spark, sf_dir):
    p = council.parse_json_array(_responses(spark, sf_dir), "response", council.PROPOSAL_SCHEMA)
    return council.isolate_failures(p, [*KEYS, "model_idx", "batch"])


@q("proposal_lookup")
def proposal_lookup(spark, sf_dir):
    looked = D.labelled_topics(spark, sf_dir)[1]
    return looked.select(*KEYS, "cluster_id", "model_idx", "label", r6("confidence").alias("confidence"), "reasoning")


@q("collect_proposals")
def collect_proposals(spark, sf_dir):
    c = D.labelled_topics(spark, sf_dir)[2]
    return c.select(*KEYS, "cluster_id", F.array_join(F.transform("proposals", lambda p: p["label"]), " | ").alias("labels"))


@q("proposal_block")
def proposal_block(spark, sf_dir):
    return council.proposal_block(D.labelled_topics(spark, sf_dir)[2]).select(*KEYS, "cluster_id", "block")


@q("arbitrate")
def arbitrate(spark, sf_dir):
    a = council.arbitrate(D.labelled_topics(spark, sf_dir)[1])
    return a.select(*KEYS, "cluster_id", "label", r6("confidence").alias("confidence"), "reasoning", "winning_model")


@q("council_lookup")
def council_lookup(spark, sf_dir):
    d = council.council_lookup(D.labelled_topics(spark, sf_dir)[3])
    return d.select(*KEYS, "cluster_id", "label", r6("confidence").alias("confidence"), "reasoning", "winning_model")


def _labels_flat(labels: DataFrame) -> DataFrame:
    return labels.select(*KEYS, "cluster_id", "size", "paper_count", "label", r6("confidence").alias("confidence"),
                         "reasoning", "winning_model", joined("council_proposals").alias("council_proposals"))


@q("merge_council")
def merge_council(spark, sf_dir):
    return _labels_flat(D.labelled_topics(spark, sf_dir)[0])


@q("model_wins")
def model_wins(spark, sf_dir):
    labels, looked, collected, dec, ranked, p = D.labelled_topics(spark, sf_dir)
    return council.model_wins(dec, ranked)


@q("label_quality")
def label_quality(spark, sf_dir):
    return council.label_quality(D.labelled_topics(spark, sf_dir)[0])


# -- 2.6 review ----------------------------------------------------------------------

def _labels(spark, sf_dir):
    return D.labelled_topics(spark, sf_dir)[0]


@q("review_labels")
def review_labels(spark, sf_dir):
    return review.review_labels(_labels(spark, sf_dir), review.MAX_REVIEW_ROWS)


@q("review_themes")
def review_themes(spark, sf_dir):
    return review.review_themes(D.emb_themes(spark, sf_dir)[0])


@q("review_taxonomy")
def review_taxonomy(spark, sf_dir):
    return review.review_taxonomy(D.emb_taxonomy(spark, sf_dir)[0])


@q("phase_snapshot")
def phase_snapshot(spark, sf_dir):
    return review.phase_snapshot(_labels(spark, sf_dir), "labels", cap=review.MAX_SNAPSHOT_LABELS).withColumn("confidence", r6("confidence"))


@q("approve_all")
def approve_all(spark, sf_dir):
    return review.approve_all(review.reject_all(review.review_labels(_labels(spark, sf_dir), review.MAX_REVIEW_ROWS)))


@q("reject_all")
def reject_all(spark, sf_dir):
    return review.reject_all(review.review_labels(_labels(spark, sf_dir), review.MAX_REVIEW_ROWS))


@q("auto_flag")
def auto_flag(spark, sf_dir):
    rv = review.review_labels(_labels(spark, sf_dir), review.MAX_REVIEW_ROWS)
    # Evidence carrying publisher boilerplate, as real abstracts do: topics
    # whose first evidence line mentions "the" get a licence line appended.
    rv = rv.withColumn("top_evidence", F.when(F.lower("top_evidence").contains(" the "),
                                              F.concat("top_evidence", F.lit(" Open Access licence, Springer")))
                       .otherwise(F.col("top_evidence")))
    return review.auto_flag(rv)


@q("theme_map")
def theme_map(spark, sf_dir):
    return D.emb_themes(spark, sf_dir)[1]


# -- 2.7 themes ----------------------------------------------------------------------

@q("theme_members")
def theme_members(spark, sf_dir):
    th, tmap, labels, p = D.emb_themes(spark, sf_dir)
    extra = tmap.filter(F.col("member_pos") == 1).select(
        *KEYS, "theme_name", "theme_pos", F.lit(99).alias("member_pos"), F.lit(777).alias("cluster_id"))
    m = themes.theme_members(tmap.unionByName(extra), labels)
    return m.select(*KEYS, "theme_name", "member_pos", "cluster_id", "found", "size")


@q("consolidate")
def consolidate(spark, sf_dir):
    th = D.emb_themes(spark, sf_dir)[0]
    return th.select(*KEYS, "theme_name", F.array_join(F.col("cluster_ids").cast("array<string>"), ",").alias("cluster_ids"),
                     joined("merged_topic_labels").alias("merged_topic_labels"), "total_sentences", "paper_count",
                     "sub_topics")


@q("representative")
def representative(spark, sf_dir):
    th = D.emb_themes(spark, sf_dir)[0]
    return th.select(*KEYS, "theme_name", joined("representative_sentences").alias("representative_sentences"))


@q("themes_ranked")
def themes_ranked(spark, sf_dir):
    return D.emb_themes(spark, sf_dir)[0].select(*KEYS, "theme_rank", "theme_name", "total_sentences")


@q("theme_coverage")
def theme_coverage(spark, sf_dir):
    return themes.theme_coverage(D.emb_themes(spark, sf_dir)[0])


@q("uncovered")
def uncovered(spark, sf_dir):
    th, tmap, labels, p = D.emb_themes(spark, sf_dir)
    return themes.uncovered(tmap, labels)


# -- 2.8 taxonomy --------------------------------------------------------------------

@q("taxonomy_dim")
def taxonomy_dim(spark, sf_dir):
    # The dimension, with how many mapped themes of the test run use each.
    tax = D.emb_taxonomy(spark, sf_dir)[0]
    used = tax.groupBy(F.col("pajais_match").alias("category")).agg(F.count(F.lit(1)).alias("themes"))
    return taxonomy.taxonomy_dim(spark).join(used, "category", "left").select(
        "category_no", "category", F.coalesce("themes", F.lit(0)).cast("bigint").alias("themes"))


@q("theme_block")
def theme_block(spark, sf_dir):
    return taxonomy.theme_block(D.emb_themes(spark, sf_dir)[0]).select(*KEYS, "theme_name", "block")


@q("classify_theme")
def classify_theme(spark, sf_dir):
    th = D.emb_themes(spark, sf_dir)[0]
    return taxonomy.classify_theme(th, embed.hashed_tf).withColumn("match_confidence", r6("match_confidence"))


def _tax_flat(tax: DataFrame) -> DataFrame:
    return tax.select(*KEYS, "theme_rank", "theme_name", "total_sentences", "paper_count", "sub_topics",
                      "pajais_match", r6("match_confidence").alias("match_confidence"), "is_novel", "reasoning",
                      "valid_category")


@q("merge_taxonomy")
def merge_taxonomy(spark, sf_dir):
    return _tax_flat(D.emb_taxonomy(spark, sf_dir)[0])


@q("taxonomy_counts")
def taxonomy_counts(spark, sf_dir):
    c = taxonomy.taxonomy_counts(D.emb_taxonomy(spark, sf_dir)[0])
    return c.select(*KEYS, "themes", "novel", "mapped", joined("novel_names").alias("novel_names"))


# -- 2.9 comparison ------------------------------------------------------------------

def _runs(spark, sf_dir):
    th, tmap, labels, p = D.emb_themes(spark, sf_dir)
    v = compare.theme_vectors_from_centroids(th, tmap, labels)
    return (v.filter(F.col("run_key") == "abstract").drop("run_key"),
            v.filter(F.col("run_key") == "title").drop("run_key"))


@q("theme_name_embed")
def theme_name_embed(spark, sf_dir):
    """Name-embedded theme vectors of both runs, matched abstract -> title."""
    th = compare.theme_vectors_from_names(D.emb_themes(spark, sf_dir)[0])
    a = th.filter(F.col("run_key") == "abstract").drop("run_key")
    t = th.filter(F.col("run_key") == "title").drop("run_key")
    return compare.comparison(a, t).select("corpus_id", "row_order", "abstract_theme", "title_theme",
                                           "similarity", "convergence")


@q("best_match")
def best_match(spark, sf_dir):
    a, t = _runs(spark, sf_dir)
    return compare.best_match(a, t).withColumn("sim", r6("sim"))


@q("claim_match")
def claim_match(spark, sf_dir):
    a, t = _runs(spark, sf_dir)
    return compare.claim_match(compare.best_match(a, t)).withColumn("sim", r6("sim"))


@q("comparison")
def comparison(spark, sf_dir):
    a, t = _runs(spark, sf_dir)
    return compare.comparison(a, t)


@q("convergence")
def convergence(spark, sf_dir):
    return comparison(spark, sf_dir).filter(F.col("abstract_theme").isNotNull()).select(
        "corpus_id", "row_order", "abstract_theme", "title_theme", "similarity", "convergence")


@q("title_only")
def title_only(spark, sf_dir):
    return comparison(spark, sf_dir).filter(F.col("convergence") == "TITLE ONLY").select(
        "corpus_id", "row_order", "title_theme", "title_sentences", "title_papers")


@q("convergence_counts")
def convergence_counts(spark, sf_dir):
    return compare.convergence_counts(comparison(spark, sf_dir))


# -- 2.10 reports --------------------------------------------------------------------

@q("theme_lines")
def theme_lines(spark, sf_dir):
    tax, th = D.emb_taxonomy(spark, sf_dir)[:2]
    return report.theme_lines(th, tax)


@q("novel_list")
def novel_list(spark, sf_dir):
    tax, th = D.emb_taxonomy(spark, sf_dir)[:2]
    return report.novel_list(th, tax)


@q("rq5_cluster_summary")
def rq5_cluster_summary(spark, sf_dir):
    return report.rq5_cluster_summary(_labels(spark, sf_dir), evidence_chars=report.EVIDENCE_CHARS).withColumn("confidence", r6("confidence"))


@q("paper_results")
def paper_results(spark, sf_dir):
    labels, _, _, _, _, p = D.labelled_topics(spark, sf_dir)
    papers = _papers(spark, sf_dir).withColumn("corpus_id", F.concat(F.lit("emb"), (F.col("paper_id") % 2).cast("string")))
    return report.paper_results(labels, p, papers)


@q("rq6_taxonomy_summary")
def rq6_taxonomy_summary(spark, sf_dir):
    return report.rq6_taxonomy_summary(D.emb_taxonomy(spark, sf_dir)[0]).withColumn("confidence", r6("confidence"))


@q("rq7_taxonomy_summary")
def rq7_taxonomy_summary(spark, sf_dir):
    return report.rq7_taxonomy_summary(D.emb_taxonomy(spark, sf_dir)[0])


@q("mapped_novel")
def mapped_novel(spark, sf_dir):
    return report.mapped_novel(D.emb_taxonomy(spark, sf_dir)[0])


@q("agenda")
def agenda(spark, sf_dir):
    return report.agenda(D.emb_taxonomy(spark, sf_dir)[0])


@q("paragraphs")
def paragraphs(spark, sf_dir):
    conv = spark.read.parquet(table_path(sf_dir, "conversations"))
    return report.paragraphs(conv, "text", ("conv_id", "turn"))
