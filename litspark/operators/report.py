"""Report tables: theme lines and the novel list for the narrative, cluster
and taxonomy summaries, per-paper results, mapped/novel lines, the research
agenda and narrative paragraphs. Prose generation itself is not built."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import (AGENDA_LINE, MAPPED_LINE, MAPPED_TAG, NOVEL_LINE, NOVEL_TAG, THEME_LINE,
                                 fmt)
from ..functions.text import py_strip
from ..session import KEYS

# Fixed values from the reference.
EVIDENCE_CHARS = 120
NONE_IDENTIFIED = "none identified"


def _tax_lookup(tax: DataFrame, keys):
    return tax.select(*keys, "theme_name", F.col("is_novel").alias("_nov"), F.col("pajais_match").alias("_match"))


def theme_lines(themes: DataFrame, tax: DataFrame, keys=KEYS) -> DataFrame:
    """``- name (n sentences) [NOVEL]`` or ``[PAJAIS: match]``; a theme with no
    taxonomy row reads ``[PAJAIS: NOVEL]``."""
    j = themes.join(_tax_lookup(tax, keys), [*keys, "theme_name"], "left")
    tag = F.when(F.coalesce("_nov", F.lit(False)), F.lit(NOVEL_TAG)).otherwise(
        fmt(MAPPED_TAG, match=F.coalesce("_match", F.lit("NOVEL"))))
    line = fmt(THEME_LINE, name=F.col("theme_name"), n=F.col("total_sentences"), tag=tag)
    return j.select(*keys, "theme_rank", "theme_name", line.alias("line"))


def novel_list(themes: DataFrame, tax: DataFrame, keys=KEYS) -> DataFrame:
    j = themes.join(_tax_lookup(tax, keys), [*keys, "theme_name"], "left")
    nov = F.coalesce("_nov", F.lit(False))
    names = F.transform(F.array_sort(F.collect_list(F.when(nov, F.struct("theme_rank", "theme_name")))),
                        lambda x: x["theme_name"])
    g = j.groupBy(*keys).agg(names.alias("_n"))
    return g.select(*keys, F.when(F.size("_n") > 0, F.array_join("_n", ", "))
                    .otherwise(F.lit(NONE_IDENTIFIED)).alias("novel_list"))


def rq5_cluster_summary(labels: DataFrame, keys=KEYS, evidence_chars: int | None = None) -> DataFrame:
    """One row per topic; ``evidence_chars`` cuts the evidence (the reference shows ``EVIDENCE_CHARS``)."""
    evidence = F.coalesce(F.element_at("top_sentences", 1), F.lit(""))
    return labels.select(
        *keys, "cluster_id", F.coalesce("label", F.lit("")).alias("label"),
        F.col("size").alias("sentence_count"), "paper_count",
        F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence"), "winning_model",
        (evidence if evidence_chars is None else F.substring(evidence, 1, evidence_chars)).alias("top_evidence"))


def paper_results(labels: DataFrame, papers_long: DataFrame, papers: DataFrame, keys=KEYS) -> DataFrame:
    """One row per (topic, paper) with the paper's title and year; a paper
    may appear under several topics; unknown papers get NULL title/year.
    The topic-paper table is long, so nothing is collected per topic."""
    lab = labels.select(*keys, "cluster_id", F.col("label").alias("cluster_label"))
    p = papers.select("corpus_id", "paper_id", "title", "year")
    return (papers_long.join(lab, [*keys, "cluster_id"])
            .join(p, ["corpus_id", "paper_id"], "left")
            .select(*keys, F.col("paper_id").alias("paper_index"), "cluster_id", "cluster_label", "title", "year"))


def rq6_taxonomy_summary(tax: DataFrame, keys=KEYS) -> DataFrame:
    return tax.select(
        *keys, "theme_name", F.coalesce("pajais_match", F.lit("NOVEL")).alias("pajais_category"),
        F.coalesce("is_novel", F.lit(False)).alias("is_novel"),
        F.round(F.coalesce("match_confidence", F.lit(0.0)), 3).alias("confidence"),
        F.col("total_sentences").alias("sentence_count"), "paper_count", "sub_topics", "reasoning")


def rq7_taxonomy_summary(tax: DataFrame, keys=KEYS) -> DataFrame:
    return rq6_taxonomy_summary(tax, keys).select(
        *keys, "theme_name", "pajais_category", "is_novel", "sentence_count", "paper_count")


def mapped_novel(tax: DataFrame, keys=KEYS) -> DataFrame:
    """One line per theme, split by is_novel, with per-key totals."""
    nov = F.coalesce("is_novel", F.lit(False))
    mapped_line = fmt(MAPPED_LINE, name=F.col("theme_name"), match=F.coalesce("pajais_match", F.lit("")),
                      conf=F.round(F.coalesce("match_confidence", F.lit(0.0)), 2),
                      n=F.col("total_sentences"), papers=F.col("paper_count"))
    novel_line = fmt(NOVEL_LINE, name=F.col("theme_name"), n=F.col("total_sentences"), papers=F.col("paper_count"))
    allw = Window.partitionBy(*keys)
    return tax.select(
        *keys, "theme_rank", "theme_name", F.when(nov, "NOVEL").otherwise("MAPPED").alias("kind"),
        F.when(nov, novel_line).otherwise(mapped_line).alias("line"),
        F.count(F.lit(1)).over(allw).alias("total"),
        F.sum((~nov).cast("int")).over(allw).cast("bigint").alias("mapped"),
        F.sum(nov.cast("int")).over(allw).cast("bigint").alias("novel"))


def agenda(tax: DataFrame, keys=KEYS) -> DataFrame:
    """Novel themes numbered 1.. in theme order: ``n. name``."""
    w = Window.partitionBy(*keys).orderBy("theme_rank")
    n = tax.filter(F.coalesce("is_novel", F.lit(False))).withColumn("item", F.row_number().over(w))
    return n.select(*keys, "item", "theme_name", fmt(AGENDA_LINE, i=F.col("item"), name=F.col("theme_name")).alias("line"))


def paragraphs(df: DataFrame, text_col: str = "text", id_cols=("doc_id",)) -> DataFrame:
    """Split text on blank lines, strip, escape & < > for markup, drop empty
    pieces: (ids, para_no, paragraph)."""
    parts = df.select(*id_cols, F.posexplode(F.split(F.col(text_col), "\n\n")).alias("para_no", "_p"))
    esc = F.replace(F.replace(F.replace(py_strip("_p"), F.lit("&"), F.lit("&amp;")),
                              F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return parts.select(*id_cols, "para_no", esc.alias("paragraph")).filter(F.col("paragraph") != "")
