"""Mapping themes onto a fixed research taxonomy (or flagging them NOVEL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import THEME_BLOCK, fmt
from ..functions.vec import cosine
from ..session import KEYS
from .council import explode_items, parse_json_array

# ---------------------------------------------------------------------------
# The 25 categories of the PAJAIS classification scheme for IS
# research (Jiang et al., 2019), numbered 1..25 in this order, and the
# fallback used when a theme got no mapping.
CATEGORIES = [
    "IS Strategy and Management",
    "IT Adoption and Diffusion",
    "E-Commerce and Digital Markets",
    "Business Intelligence and Analytics",
    "Knowledge Management",
    "IT and Organizational Change",
    "Supply Chain and ERP Systems",
    "Healthcare IT",
    "Mobile and Wireless Computing",
    "Social Media and Web 2.0",
    "Security and Privacy",
    "Cloud Computing",
    "Big Data and Data Mining",
    "Artificial Intelligence and Machine Learning",
    "Human-Computer Interaction",
    "Software Development and Engineering",
    "IT Governance and Outsourcing",
    "Digital Innovation and Entrepreneurship",
    "IS Education and Research Methods",
    "Collaborative Systems and CSCW",
    "Open Source and Crowdsourcing",
    "IT and Society",
    "Financial Technology",
    "Smart Cities and IoT",
    "Agile and DevOps Practices",
]
NOVEL = "NOVEL"
TAXONOMY_FALLBACK = {"pajais_match": NOVEL, "is_novel": True, "match_confidence": 0.0,
                     "reasoning": "Taxonomy validation threshold unmet"}
# ---------------------------------------------------------------------------

TAXONOMY_SCHEMA = T.StructType([
    T.StructField("theme_name", T.StringType()),
    T.StructField("pajais_match", T.StringType()),
    T.StructField("match_confidence", T.DoubleType()),
    T.StructField("is_novel", T.BooleanType()),
    T.StructField("reasoning", T.StringType()),
])


def taxonomy_dim(spark) -> DataFrame:
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(CATEGORIES)],
                                 "category_no int, category string")


def theme_block(themes: DataFrame) -> DataFrame:
    """``THEME: name`` then ``Sentences: `` + the first two representative
    sentences joined by ``; ``."""
    first_two = F.slice(F.coalesce("representative_sentences", F.array().cast("array<string>")), 1, 2)
    return themes.withColumn("block", fmt(THEME_BLOCK, name=F.col("theme_name"),
                                          sentences=F.array_join(first_two, "; ")))


def classify_theme(themes: DataFrame, embedder, threshold: float = 0.1, keys=KEYS) -> DataFrame:
    """Offline classifier: cosine between a theme vector (name + evidence,
    embedded with ``embedder``) and each category name's vector; the best
    category (lowest number on ties) wins unless its similarity is under
    ``threshold`` -> NOVEL with confidence 0. The category names (a fixed 25 rows) are
    embedded once and joined to every theme."""
    text = F.concat_ws(" ", F.col("theme_name"), F.array_join(
        F.coalesce("representative_sentences", F.array().cast("array<string>")), " "))
    t = embedder(themes.select(*keys, "theme_name", text.alias("_text")), "_text").withColumnRenamed("embedding", "_tv")
    cats = taxonomy_dim(themes.sparkSession).select(F.col("category_no").alias("no"), F.col("category").alias("name"))
    pairs = t.join(F.broadcast(embedder(cats, "name"))).withColumn("sim", cosine("_tv", "embedding"))
    w = Window.partitionBy(*keys, "theme_name").orderBy(F.col("sim").desc(), "no")
    best = pairs.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    novel = F.col("sim") < threshold
    return best.select(
        *keys, "theme_name",
        F.when(novel, F.lit(NOVEL)).otherwise(F.col("name")).alias("pajais_match"),
        F.when(novel, F.lit(0.0)).otherwise(F.round("sim", 6)).alias("match_confidence"),
        novel.alias("is_novel"),
        F.when(novel, F.lit("no category above the similarity threshold"))
         .otherwise(F.lit("closest category by cosine similarity")).alias("reasoning"))


def taxonomy_from_responses(responses: DataFrame, keys=KEYS) -> DataFrame:
    p = parse_json_array(responses, "response", TAXONOMY_SCHEMA)
    return explode_items(p, [*keys, "batch"])


def merge_taxonomy(themes: DataFrame, mapped: DataFrame, keys=KEYS) -> DataFrame:
    """Items with a theme_name, LAST wins per name; themes left join them;
    a theme without an item gets the NOVEL fallback. ``valid_category``
    flags matches that are neither NOVEL nor one of the 25 names (the
    reference never checks)."""
    order = [F.col(c).desc() for c in ("batch", "item_pos") if c in mapped.columns]
    w = Window.partitionBy(*keys, "theme_name").orderBy(*order) if order else \
        Window.partitionBy(*keys, "theme_name").orderBy(F.lit(0))
    m = (mapped.filter(F.col("theme_name").isNotNull())
         .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
         .select(*keys, "theme_name", F.col("pajais_match").alias("_m"), F.col("match_confidence").alias("_c"),
                 F.col("is_novel").alias("_n"), F.col("reasoning").alias("_why"), F.lit(True).alias("_found")))
    j = themes.join(m, [*keys, "theme_name"], "left")
    f = F.col("_found").isNotNull()
    fb = TAXONOMY_FALLBACK
    return j.select(
        *[c for c in themes.columns],
        F.when(f, F.col("_m")).otherwise(F.lit(fb["pajais_match"])).alias("pajais_match"),
        F.when(f, F.col("_c")).otherwise(F.lit(fb["match_confidence"])).alias("match_confidence"),
        F.when(f, F.col("_n")).otherwise(F.lit(fb["is_novel"])).alias("is_novel"),
        F.when(f, F.col("_why")).otherwise(F.lit(fb["reasoning"])).alias("reasoning"),
        (F.col("_m").isNull() | F.col("_m").isin(CATEGORIES + [NOVEL])).alias("valid_category"),
    )


def taxonomy_counts(tax: DataFrame, keys=KEYS) -> DataFrame:
    """Themes, NOVEL and MAPPED counts and the NOVEL names in theme order."""
    nov = F.coalesce(F.col("is_novel"), F.lit(False))
    order = "theme_rank" if "theme_rank" in tax.columns else "theme_pos"
    return tax.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("themes"),
        F.sum(nov.cast("int")).cast("bigint").alias("novel"),
        F.sum((~nov).cast("int")).cast("bigint").alias("mapped"),
        F.transform(F.array_sort(F.collect_list(F.when(nov, F.struct(F.col(order).alias("o"), F.col("theme_name").alias("n"))))),
                    lambda x: x["n"]).alias("novel_names"),
    )
