"""Abstract-run versus title-run theme comparison.

Each abstract theme takes its most similar title theme (cosine of theme
vectors; lowest title index on ties); when several abstract themes pick the
same title theme, the first in abstract order keeps it (the reference
computes every match before any claim, so the "used" mask never applies --
kept). Matched pairs at similarity >= 0.40 CONVERGE, others DIVERGE; unmatched
abstract themes are ABSTRACT ONLY and unclaimed title themes TITLE ONLY (the
reference drops title index 0 from the claimed set; fixed here).

The pairing is an equi-join on corpus_id between the two runs' themes: at
most (themes per corpus)^2 rows per corpus, and themes per corpus are bounded
by the 120-topic cap."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vec import cosine

# ---------------------------------------------------------------------------
# Fixed values from the reference.
CONVERGENCE_THRESHOLD = 0.40
CLASSES = ["CONVERGED", "DIVERGED", "ABSTRACT ONLY", "TITLE ONLY"]
# ---------------------------------------------------------------------------


def theme_vectors_from_centroids(themes: DataFrame, tmap: DataFrame, topics: DataFrame,
                                 keys=("corpus_id", "run_key")) -> DataFrame:
    """A theme's vector = mean of its found member topics' centroids (the
    alternative to embedding the theme name; both are pluggable)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    m = tmap.join(topics.select(*keys, "cluster_id", "centroid"), [*keys, "cluster_id"])
    v = m.groupBy(*keys, "theme_name").agg(Summarizer.mean(array_to_vector("centroid")).alias("_v"))
    return themes.join(v.select(*keys, "theme_name", vector_to_array("_v").alias("vector")),
                       [*keys, "theme_name"], "left")


def theme_vectors_from_names(themes: DataFrame, embedder=None) -> DataFrame:
    """A theme's vector = its name embedded (the reference's choice); a run
    with no themes simply has no rows. Default embedder: hashed term counts."""
    from .embed import hashed_tf
    emb = embedder or (lambda df, col: hashed_tf(df, col))
    return emb(themes, "theme_name").withColumnRenamed("embedding", "vector").withColumn(
        "vector", F.col("vector").cast("array<double>"))


def best_match(abstract: DataFrame, title: DataFrame) -> DataFrame:
    """abstract/title: (corpus_id, theme_rank, theme_name, total_sentences,
    paper_count, vector). Per abstract theme: best title theme or NULL."""
    a = abstract.select("corpus_id", F.col("theme_rank").alias("a_idx"), F.col("vector").alias("va"))
    t = title.select("corpus_id", F.col("theme_rank").alias("t_idx"), F.col("vector").alias("vt"))
    p = a.join(t, "corpus_id").withColumn("sim", cosine("va", "vt"))
    w = Window.partitionBy("corpus_id", "a_idx").orderBy(F.col("sim").desc(), "t_idx")
    best = p.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).select("corpus_id", "a_idx", "t_idx", "sim")
    return abstract.select("corpus_id", F.col("theme_rank").alias("a_idx")).join(best, ["corpus_id", "a_idx"], "left")


def claim_match(matches: DataFrame) -> DataFrame:
    """The first abstract theme (in order) to pick a title theme keeps it."""
    w = Window.partitionBy("corpus_id", "t_idx").orderBy("a_idx")
    r = F.when(F.col("t_idx").isNotNull(), F.row_number().over(w))
    return matches.withColumn("_r", r).withColumn(
        "t_idx", F.when(F.col("_r") == 1, F.col("t_idx"))).drop("_r")


def comparison(abstract: DataFrame, title: DataFrame, threshold: float = CONVERGENCE_THRESHOLD) -> DataFrame:
    """Rows: abstract themes in order, then unclaimed title themes in order.
    Columns: corpus_id, row_order, abstract_theme, abstract_sentences,
    abstract_papers, title_theme, title_sentences, title_papers, similarity
    (rounded to 3, NULL when unmatched), convergence."""
    claimed = claim_match(best_match(abstract, title))
    a = abstract.select("corpus_id", F.col("theme_rank").alias("a_idx"), F.col("theme_name").alias("abstract_theme"),
                        F.col("total_sentences").alias("abstract_sentences"), F.col("paper_count").alias("abstract_papers"))
    t = title.select("corpus_id", F.col("theme_rank").alias("t_idx"), F.col("theme_name").alias("title_theme"),
                     F.col("total_sentences").alias("title_sentences"), F.col("paper_count").alias("title_papers"))
    rows = claimed.join(a, ["corpus_id", "a_idx"]).join(t, ["corpus_id", "t_idx"], "left")
    matched = F.col("title_theme").isNotNull()
    left = rows.select(
        "corpus_id", F.col("a_idx").cast("bigint").alias("row_order"),
        "abstract_theme", "abstract_sentences", "abstract_papers", "title_theme", "title_sentences", "title_papers",
        F.when(matched, F.round("sim", 3)).alias("similarity"),
        F.when(~matched, "ABSTRACT ONLY").when(F.col("sim") >= threshold, "CONVERGED")
         .otherwise("DIVERGED").alias("convergence"))
    n_abs = abstract.groupBy("corpus_id").agg(F.count(F.lit(1)).alias("_na"))
    used = claimed.filter(F.col("t_idx").isNotNull()).select("corpus_id", "t_idx")
    right = (t.join(used, ["corpus_id", "t_idx"], "left_anti").join(n_abs, "corpus_id", "left")
             .select("corpus_id", (F.coalesce("_na", F.lit(0)) + F.col("t_idx")).cast("bigint").alias("row_order"),
                     F.lit(None).cast("string").alias("abstract_theme"),
                     F.lit(None).cast("bigint").alias("abstract_sentences"),
                     F.lit(None).cast("bigint").alias("abstract_papers"),
                     "title_theme", "title_sentences", "title_papers",
                     F.lit(None).cast("double").alias("similarity"), F.lit("TITLE ONLY").alias("convergence")))
    return left.unionByName(right)


def convergence_counts(comp: DataFrame) -> DataFrame:
    return comp.groupBy("corpus_id").agg(*[
        F.sum((F.col("convergence") == c).cast("int")).cast("bigint").alias(c.lower().replace(" ", "_"))
        for c in CLASSES])
