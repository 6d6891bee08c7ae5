"""Per-cluster summaries over (sentence, vector, cluster) tables: size filter,
centroids, evidence sentences, topic records, ranking and chart data.

Scale notes: sizes and centroids are partial aggregates (map-side combine),
so a cluster holding a third of all sentences never reaches one task in full.
Evidence uses a ranked window that Spark plans as WindowGroupLimit on both
sides of the shuffle (only k rows per cluster per map task move). Topic-level
tables are keyed by (corpus_id, run_key) and hold at most one row per cluster."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import DEFAULT_TOPIC_LABEL, TOPIC_CODE, fmt
from ..functions.vec import cosine, dim_of, with_cosine
from ..session import KEYS
from .blocks import written

# ---------------------------------------------------------------------------
# Fixed values from the reference.
NEAREST_K = 3            # evidence sentences per topic
MIN_CLUSTER_SIZE = 20    # smaller clusters become noise (-1)
MAX_TOPICS = 120         # topics kept per (corpus, run)
CHART_TOP = 30           # topics in the size chart and the circle map
HEATMAP_TOP = 50         # topics in the similarity heat map
NOISE = -1
# ---------------------------------------------------------------------------


def cluster_sizes(assign: DataFrame, keys=KEYS) -> DataFrame:
    return assign.groupBy(*keys, "cluster_id").agg(F.count(F.lit(1)).alias("size"))


def drop_small(assign: DataFrame, min_size: int = MIN_CLUSTER_SIZE, keys=KEYS, sizes: DataFrame | None = None) -> DataFrame:
    """Clusters with fewer than ``min_size`` members get cluster_id -1. Sizes
    come from an aggregate joined back (one row per cluster), not from a
    window over a possibly huge cluster; ``sizes`` are ``cluster_sizes`` that are stored already."""
    sizes = (cluster_sizes(assign, keys) if sizes is None else sizes).withColumnRenamed("size", "_size")
    return (assign.join(sizes, [*keys, "cluster_id"])
            .withColumn("cluster_id", F.when(F.col("_size") >= min_size, F.col("cluster_id"))
                        .otherwise(F.lit(NOISE)))
            .drop("_size"))


def cluster_stats(assign: DataFrame, keys=KEYS) -> DataFrame:
    """noise count, number of valid clusters, sentences and largest cluster."""
    sizes = cluster_sizes(assign, keys)
    valid = F.col("cluster_id") != NOISE
    return sizes.groupBy(*keys).agg(
        F.sum(F.when(~valid, F.col("size")).otherwise(0)).cast("bigint").alias("noise_count"),
        F.sum(valid.cast("int")).cast("bigint").alias("n_clusters"),
        F.sum("size").cast("bigint").alias("sentences"),
        F.coalesce(F.max(F.when(valid, F.col("size"))), F.lit(0)).cast("bigint").alias("largest"),
    )


def _with_vectors(members: DataFrame, vectors: DataFrame | None, vec_col: str) -> DataFrame:
    """Members with their vectors: joined by sentence_id unless the members
    already carry the vector column (then no join at all)."""
    if vectors is None or vec_col in members.columns:
        return members
    # Sentence ids repeat across runs and corpora; vectors may carry the keys.
    on = [c for c in (*KEYS, "sentence_id") if c in vectors.columns]
    return members.join(vectors, on)


def centroids(members: DataFrame, vectors: DataFrame | None, keys=KEYS,
              vec_col: str = "embedding") -> DataFrame:
    """Mean of the original (not reduced) vectors per valid cluster, not
    re-normalised: (keys, cluster_id, centroid ARRAY<DOUBLE>). Summarizer keeps
    one vector-sized buffer per cluster and combines partially before the
    shuffle; nothing is exploded per dimension."""
    j = _with_vectors(members.filter(F.col("cluster_id") != NOISE), vectors, vec_col)
    return (j.groupBy(*keys, "cluster_id")
            .agg(Summarizer.mean(array_to_vector(F.col(vec_col))).alias("_c"))
            .select(*keys, "cluster_id", vector_to_array("_c").alias("centroid")))


def top_evidence(members: DataFrame, vectors: DataFrame | None, cents: DataFrame,
                 k: int = NEAREST_K, keys=KEYS, vec_col: str = "embedding", dim: int | None = None, link: str | None = None) -> DataFrame:
    """The k sentences closest (cosine) to their cluster centroid: (keys,
    cluster_id, rank, sentence_id, sentence, similarity). Ties broken by
    sentence_id. The centroid side has one row per cluster. ``dim`` is the vectors'
    width; unknown, it is read off one row of the vectors (before any join).

    With ``link`` members meet ``vectors`` by that column, and vectors meet the clusters that have them rather than the sentences: the k best
    of these, each by its first sentence, hold the k best sentences, so only they are looked up among the members."""
    valid = members.filter(F.col("cluster_id") != NOISE)
    d = dim or dim_of(members if vectors is None or vec_col in members.columns else vectors, vec_col)
    w = Window.partitionBy(*keys, "cluster_id").orderBy(F.col("similarity").desc(), "sentence_id")
    if link is None:
        j = _with_vectors(valid, vectors, vec_col).join(cents, [*keys, "cluster_id"])
        j = with_cosine(j, vec_col, "centroid", "similarity", d).select(
            *keys, "cluster_id", "sentence_id", "sentence", "similarity")
    else:
        at = valid.groupBy(*keys, "cluster_id", link).agg(F.min("sentence_id").alias("sentence_id")).join(vectors, link).join(cents, [*keys, "cluster_id"])
        at = with_cosine(at, vec_col, "centroid", "similarity", d).select(*keys, "cluster_id", link, "sentence_id", "similarity")
        best = at.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(*keys, "cluster_id", link, "similarity")
        # Stored, so that its size is known and the members' text stays where it is.
        j = valid.select(*keys, "cluster_id", link, "sentence_id", "sentence").join(written(best, "evidence-best"), [*keys, "cluster_id", link])
    return j.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k) \
            .select(*keys, "cluster_id", "rank", "sentence_id", "sentence", "similarity")


def topic_papers(members: DataFrame, keys=KEYS) -> DataFrame:
    """Long form of the topics' paper lists: distinct (keys, cluster, paper).
    Kept long because one topic may span every paper of a corpus."""
    return members.filter(F.col("cluster_id") != NOISE).select(*keys, "cluster_id", "paper_id").distinct()


def topic_summary(members: DataFrame, vectors: DataFrame, k: int = NEAREST_K,
                  keys=KEYS, vec_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """members(keys, sentence_id, paper_id, sentence, cluster_id) ->
    (topics, topic_papers). topics: keys, cluster_id, size, paper_count,
    centroid, top_sentences (k, closest first), label ``Topic <id>``."""
    valid = _with_vectors(members.filter(F.col("cluster_id") != NOISE), vectors, vec_col)
    # Members meet their vectors once; centroids and evidence read the stored join.
    valid = written(valid.select(*keys, "cluster_id", "sentence_id", "paper_id", "sentence", vec_col), "topic-members")
    cents = written(centroids(valid, None, keys, vec_col), "topic-centroids")
    ev = top_evidence(valid, None, cents, k, keys, vec_col)
    papers = topic_papers(valid, keys)
    return assemble_topics(valid, cents, ev, papers, keys), papers


def assemble_topics(valid: DataFrame, cents: DataFrame, ev: DataFrame, papers: DataFrame,
                    keys=KEYS) -> DataFrame:
    """Topic records from the parts: size, distinct papers, centroid, the
    evidence sentences in rank order and the default label. Size and papers come from one aggregate
    over (cluster, paper); ``papers`` is the long list that the caller keeps."""
    ev_arr = ev.groupBy(*keys, "cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("_ev"))
    per = valid.groupBy(*keys, "cluster_id", "paper_id").agg(F.count(F.lit(1)).alias("_n"))
    sizes = per.groupBy(*keys, "cluster_id").agg(F.sum("_n").alias("size"), F.count(F.lit(1)).alias("paper_count"))
    return (sizes.join(cents, [*keys, "cluster_id"])
            .join(ev_arr, [*keys, "cluster_id"])
            .select(*keys, F.col("cluster_id").cast("int").alias("cluster_id"),
                    F.col("size").cast("int").alias("size"),
                    F.col("paper_count").cast("int").alias("paper_count"),
                    "centroid",
                    F.transform("_ev", lambda x: x["sentence"]).alias("top_sentences"),
                    fmt(DEFAULT_TOPIC_LABEL, id=F.col("cluster_id")).alias("label")))


def _first_ranks(ranked: DataFrame, cap: int | None) -> DataFrame:
    return ranked if cap is None else ranked.filter(F.col("topic_rank") <= cap)


def topics_ranked(topics: DataFrame, cap: int | None = None, keys=KEYS) -> DataFrame:
    """Size desc, ties by cluster_id; adds 1-based ``topic_rank``; with ``cap`` only the
    first so many per (corpus, run) (the reference keeps ``MAX_TOPICS``)."""
    w = Window.partitionBy(*keys).orderBy(F.col("size").desc(), "cluster_id")
    return _first_ranks(topics.withColumn("topic_rank", F.row_number().over(w)), cap)


def chart_sizes(ranked: DataFrame, top: int | None = None, keys=KEYS) -> DataFrame:
    return _first_ranks(ranked, top).select(
        *keys, "topic_rank", fmt(TOPIC_CODE, id=F.col("cluster_id")).alias("topic"), "size")


def chart_similarity(ranked: DataFrame, top: int = HEATMAP_TOP, keys=KEYS) -> DataFrame:
    """Pairwise cosine of the top-``top`` centroids per key (the chart is defined on that many): at most
    top^2 pairs per key through an equi-join on the key (not a cross join)."""
    t = _first_ranks(ranked, top).select(*keys, "topic_rank", "cluster_id", "centroid")
    a = t.select(*keys, F.col("topic_rank").alias("i"), F.col("cluster_id").alias("cluster_i"),
                 F.col("centroid").alias("ca"))
    b = t.select(*keys, F.col("topic_rank").alias("j"), F.col("cluster_id").alias("cluster_j"),
                 F.col("centroid").alias("cb"))
    return a.join(b, list(keys)).select(*keys, "i", "j", "cluster_i", "cluster_j",
                                        cosine("ca", "cb").alias("similarity"))


def chart_map(ranked: DataFrame, top: int | None = None, keys=KEYS) -> DataFrame:
    """Top topics on the unit circle (not a real distance map): x = cos(2 pi
    i / n), y = sin(...), marker = max(8, min(40, size // 5))."""
    t = _first_ranks(ranked, top)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    ang = 2 * F.pi() * (F.col("topic_rank") - 1) / F.col("_n")
    return (t.withColumn("_n", n)
            .select(*keys, "topic_rank", fmt(TOPIC_CODE, id=F.col("cluster_id")).alias("topic"),
                    F.cos(ang).alias("x"), F.sin(ang).alias("y"),
                    F.greatest(F.lit(8), F.least(F.lit(40), F.floor(F.col("size") / 5))).cast("int").alias("marker")))
