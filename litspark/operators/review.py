"""Human review table: rows built from labels, themes or the taxonomy map,
bulk approve/reject, the boilerplate auto-flag, and the parse of a submitted
review into a theme map. The reference's row-number-as-cluster-id slip is
fixed by carrying ``cluster_id`` in every row."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import DEFAULT_TOPIC_LABEL, TAXONOMY_EVIDENCE, fmt
from ..functions.text import py_strip
from ..session import KEYS

# ---------------------------------------------------------------------------
# Fixed values from the reference.
MAX_REVIEW_ROWS = 200
MAX_SNAPSHOT_LABELS = 100
APPROVE_TOKENS = ["yes", "y", "1", "true"]
BOILERPLATE_SIGNALS = ["copyright", "springer", "elsevier", "rights reserved", "licence",
                       "open access", "publisher"]
AUTO_FLAG_REASON = "Auto-flagged: boilerplate"
# ---------------------------------------------------------------------------

REVIEW_COLUMNS = ["row_no", "topic_label", "top_evidence", "sentences", "papers", "approve",
                  "rename_to", "reasoning", "cluster_id"]


def _first(arr: str):
    return F.coalesce(F.element_at(F.col(arr), 1), F.lit(""))


def review_labels(labels: DataFrame, cap: int | None = None, keys=KEYS) -> DataFrame:
    """Labelled topics in rank order (with ``cap`` the first so many; the reference shows ``MAX_REVIEW_ROWS``): label (or ``Topic id``),
    first evidence sentence, sizes, Approve = yes."""
    return (labels if cap is None else labels.filter(F.col("topic_rank") <= cap)).select(
        *keys, F.col("topic_rank").cast("int").alias("row_no"),
        F.coalesce("label", fmt(DEFAULT_TOPIC_LABEL, id=F.col("cluster_id"))).alias("topic_label"),
        _first("top_sentences").alias("top_evidence"),
        F.col("size").cast("bigint").alias("sentences"),
        F.col("paper_count").cast("bigint").alias("papers"),
        F.lit("yes").alias("approve"), F.lit("").alias("rename_to"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.col("cluster_id").cast("int").alias("cluster_id"))


def review_themes(themes: DataFrame, keys=KEYS) -> DataFrame:
    return themes.select(
        *keys, F.col("theme_rank").cast("int").alias("row_no"), F.col("theme_name").alias("topic_label"),
        _first("representative_sentences").alias("top_evidence"),
        F.col("total_sentences").cast("bigint").alias("sentences"),
        F.col("paper_count").cast("bigint").alias("papers"),
        F.lit("yes").alias("approve"), F.lit("").alias("rename_to"), F.lit("").alias("reasoning"),
        F.lit(None).cast("int").alias("cluster_id"))


def _tax_evidence():
    return fmt(TAXONOMY_EVIDENCE, match=F.coalesce("pajais_match", F.lit("NOVEL")),
               reasoning=F.coalesce("reasoning", F.lit("")))


def review_taxonomy(tax: DataFrame, keys=KEYS, papers_fallback: bool = True) -> DataFrame:
    papers = F.coalesce(F.col("paper_count"), F.col("sub_topics")) if papers_fallback else F.col("paper_count")
    return tax.select(
        *keys, F.col("theme_rank").cast("int").alias("row_no"), F.col("theme_name").alias("topic_label"),
        _tax_evidence().alias("top_evidence"),
        F.col("total_sentences").cast("bigint").alias("sentences"),
        papers.cast("bigint").alias("papers"),
        F.lit("yes").alias("approve"), F.lit("").alias("rename_to"),
        F.coalesce("reasoning", F.lit("")).alias("reasoning"),
        F.lit(None).cast("int").alias("cluster_id"))


def phase_snapshot(df: DataFrame, phase: str, keys=KEYS, cap: int | None = None) -> DataFrame:
    """Read-only view of one phase: ``labels`` (with ``cap`` the first so many, ``MAX_SNAPSHOT_LABELS`` in the reference; Approve blank, the
    confidence in its own column instead of under Approve), ``themes``
    (papers fall back to sub_topics) or ``taxonomy``."""
    if phase == "labels":
        conf = df.select(*keys, "cluster_id", "confidence")
        return (review_labels(df, cap, keys).withColumn("approve", F.lit(""))
                .join(conf, [*keys, "cluster_id"], "left"))
    if phase == "themes":
        sub = F.col("sub_topics") if "sub_topics" in df.columns else F.lit(None)
        d = df.withColumn("paper_count", F.coalesce(F.col("paper_count"), sub))
        return review_themes(d, keys)
    if phase == "taxonomy":
        return review_taxonomy(df, keys, papers_fallback=False)
    raise ValueError(f"unknown phase {phase!r}")


def set_approve(review: DataFrame, value: str) -> DataFrame:
    return review.withColumn("approve", F.lit(value))


def approve_all(review: DataFrame) -> DataFrame:
    return set_approve(review, "yes")


def reject_all(review: DataFrame) -> DataFrame:
    return set_approve(review, "no")


def auto_flag(review: DataFrame) -> DataFrame:
    """Rows whose label or evidence mentions publisher boilerplate get
    Approve = no (others yes); a blank reasoning is filled for flagged rows."""
    text = F.lower(F.concat(F.coalesce("topic_label", F.lit("")), F.lit(" "),
                            F.coalesce("top_evidence", F.lit(""))))
    flagged = F.lit(False)
    for s in BOILERPLATE_SIGNALS:
        flagged = flagged | text.contains(s)
    blank = F.coalesce(py_strip("reasoning"), F.lit("")) == ""
    return (review.withColumn("_bp", flagged)
            .withColumn("approve", F.when(F.col("_bp"), "no").otherwise("yes"))
            .withColumn("reasoning", F.when(F.col("_bp") & blank, F.lit(AUTO_FLAG_REASON)).otherwise(F.col("reasoning")))
            .drop("_bp"))


def theme_map(review: DataFrame, keys=KEYS) -> DataFrame:
    """Approved rows (Approve stripped and lower-cased in yes/y/1/true) grouped
    by Rename To when non-blank, else by the label; members keep row order;
    themes are numbered by first appearance. Long form: (keys, theme_name,
    theme_pos, member_pos, cluster_id). NULL Rename To counts as blank."""
    ok = F.lower(F.coalesce(py_strip("approve"), F.lit(""))).isin(APPROVE_TOKENS)
    rename = F.coalesce(py_strip("rename_to"), F.lit(""))
    name = F.when(rename != "", rename).otherwise(F.coalesce(py_strip("topic_label"), F.lit("")))
    a = review.filter(ok).select(*keys, "row_no", "cluster_id", name.alias("theme_name"))
    first = a.groupBy(*keys, "theme_name").agg(F.min("row_no").alias("_first"))
    first = first.withColumn("theme_pos", F.row_number().over(Window.partitionBy(*keys).orderBy("_first")))
    w = Window.partitionBy(*keys, "theme_name").orderBy("row_no")
    return (a.join(first, [*keys, "theme_name"])
            .withColumn("member_pos", F.row_number().over(w))
            .select(*keys, "theme_name", F.col("theme_pos").cast("int"), F.col("member_pos").cast("int"),
                    F.col("cluster_id").cast("int")))
