"""Themes: reviewer-approved topic groups consolidated into themes, ranked,
with coverage and the topics no theme covers. Inputs are the long theme map
(keys, theme_name, theme_pos, member_pos, cluster_id), the topic table and
the long topic-paper table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import TOPIC_CODE, fmt
from ..session import KEYS

# Fixed values from the reference.
NEAREST_K = 3
SATURATION_TOP = 5
SATURATION_SHARE = 0.6


def theme_members(tmap: DataFrame, topics: DataFrame, keys=KEYS) -> DataFrame:
    """Theme map LEFT JOIN topics: unknown ids find no topic (``found`` false)
    but the theme is kept; a repeated or shared id joins once per mention."""
    t = topics.select(*keys, "cluster_id", "size", "label", "top_sentences", F.lit(True).alias("found"))
    return (tmap.join(t, [*keys, "cluster_id"], "left")
            .withColumn("found", F.coalesce("found", F.lit(False))))


def consolidate(tmap: DataFrame, topics: DataFrame, papers: DataFrame, keys=KEYS) -> DataFrame:
    """(keys, theme_name, theme_pos, cluster_ids, merged_topic_labels,
    total_sentences, paper_count, representative_sentences, sub_topics).
    Sizes and papers are two aggregates joined afterwards, so exploding the
    paper lists cannot multiply the size sum."""
    m = theme_members(tmap, topics, keys)
    found = F.col("found")

    def ordered(c, cond=None):
        item = F.struct(F.col("member_pos").alias("p"), c.alias("v"))
        if cond is not None:
            item = F.when(cond, item)   # collect_list skips NULL: unknown ids add nothing
        return F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"])

    a = m.groupBy(*keys, "theme_name", "theme_pos").agg(
        ordered(F.col("cluster_id")).alias("cluster_ids"),
        ordered(F.coalesce("label", fmt(TOPIC_CODE, id=F.col("cluster_id"))), found).alias("merged_topic_labels"),
        F.coalesce(F.sum(F.when(found, F.col("size"))), F.lit(0)).cast("bigint").alias("total_sentences"),
        F.sum(found.cast("int")).cast("int").alias("sub_topics"),
        F.slice(F.flatten(ordered(F.coalesce("top_sentences", F.array().cast("array<string>")), found)),
                1, NEAREST_K).alias("representative_sentences"),
    )
    pm = m.filter(found).select(*keys, "theme_name", "cluster_id").distinct()
    pc = (pm.join(papers.select(*keys, "cluster_id", "paper_id"), [*keys, "cluster_id"])
          .groupBy(*keys, "theme_name").agg(F.count_distinct("paper_id").alias("paper_count")))
    return (a.join(pc, [*keys, "theme_name"], "left")
            .select(*keys, "theme_name", "theme_pos", "cluster_ids", "merged_topic_labels", "total_sentences",
                    F.coalesce("paper_count", F.lit(0)).cast("bigint").alias("paper_count"),
                    "representative_sentences", "sub_topics"))


def themes_ranked(themes: DataFrame, keys=KEYS) -> DataFrame:
    """total_sentences desc, ties in theme-map order; adds ``theme_rank``."""
    w = Window.partitionBy(*keys).orderBy(F.col("total_sentences").desc(), "theme_pos")
    return themes.withColumn("theme_rank", F.row_number().over(w).cast("int"))


def theme_coverage(ranked: DataFrame, top: int = SATURATION_TOP, share: float = SATURATION_SHARE,
                   keys=KEYS) -> DataFrame:
    """Share of sentences per theme; saturation when the top ``top`` themes
    hold more than ``share`` of all theme sentences."""
    allw = Window.partitionBy(*keys)
    pct = F.col("total_sentences") / F.sum("total_sentences").over(allw)
    d = ranked.withColumn("pct", pct)
    top_share = F.sum(F.when(F.col("theme_rank") <= top, F.col("pct"))).over(allw)
    return d.select(*keys, "theme_name", "theme_rank", "total_sentences",
                    F.round("pct", 6).alias("pct"), F.round(top_share, 6).alias("top_share"),
                    (top_share > share).alias("saturated"))


def uncovered(tmap: DataFrame, topics: DataFrame, keys=KEYS) -> DataFrame:
    """Topics no theme mentions, largest first (left anti join)."""
    return (topics.join(tmap.select(*keys, "cluster_id"), [*keys, "cluster_id"], "left_anti")
            .select(*keys, "cluster_id", "size", "label"))
