"""Text preparation: run texts, boilerplate removal, sentence splitting, the
sentence table and corpus statistics. Narrow per-row work plus partial
aggregates; nothing here shuffles raw text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import (
    MIN_SENTENCE_CHARS,
    py_strip,
    restore_dots,
    sentence_array_expr,
    strip_boilerplate_expr,
)

# ---------------------------------------------------------------------------
# Which paper columns make up the text of each run, in order
# (Abstract before Title). Author Keywords are never used.
RUN_CONFIGS = {
    "abstract": ["abstract"],
    "title": ["title"],
    "combined": ["abstract", "title"],
}
# ---------------------------------------------------------------------------

# sentence_id = paper_id * 2^20 + position of the sentence in its paper: a
# stable, globally unique id that sorts in (paper, position) order without a
# window over the whole table.
SENTENCE_ID_SHIFT = 1 << 20


def discover_columns(columns: list[str]) -> dict[str, str | None]:
    """First column whose lower-case name contains "abstract"; first whose
    lower-case name equals "title". Driver-side schema inspection only."""
    abstract = next((c for c in columns if "abstract" in c.lower()), None)
    title = next((c for c in columns if c.lower() == "title"), None)
    return {"abstract": abstract, "title": title}


def run_text(papers: DataFrame, run_key: str, id_col: str = "paper_id") -> DataFrame:
    """(corpus_id, run_key, paper_id, text): the run's non-NULL columns joined
    by one space; a column missing from the table is ignored."""
    cols = [c for c in RUN_CONFIGS[run_key] if c in papers.columns]
    text = F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]) if cols else F.lit("")
    return papers.select("corpus_id", F.lit(run_key).alias("run_key"), id_col, text.alias("text"))


def run_texts(papers: DataFrame, run_keys=("abstract", "title", "combined"),
              id_col: str = "paper_id") -> DataFrame:
    out = None
    for k in run_keys:
        t = run_text(papers, k, id_col)
        out = t if out is None else out.unionByName(t)
    return out


def strip_boilerplate(df: DataFrame, col: str = "text") -> DataFrame:
    """Replace every boilerplate match with one space, then strip."""
    return df.withColumn(col, strip_boilerplate_expr(col))


def split_sentences(df: DataFrame, col: str = "text") -> DataFrame:
    """One row per raw sentence piece with its 0-based position: the text
    column is replaced by (``pos``, ``raw``). Not yet stripped or filtered."""
    keep = [c for c in df.columns if c != col]
    return (df.select(*keep, F.posexplode(sentence_array_expr(col)).alias("pos", "raw"))
            .withColumn("raw", restore_dots("raw")))


def min_len(df: DataFrame, col: str = "sentence", n: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """Keep sentences strictly longer than ``n`` characters."""
    return df.filter(F.length(col) > n)


def sentence_table(texts: DataFrame, id_col: str = "paper_id",
                   n: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """texts(keys, paper_id, text) -> (keys, sentence_id, paper_id, sentence):
    boilerplate stripped, split, each piece stripped, kept when longer than
    ``n``. Sentence order is (paper, position), encoded in ``sentence_id``."""
    keys = [c for c in texts.columns if c not in (id_col, "text")]
    pieces = split_sentences(strip_boilerplate(texts, "text"), "text")
    out = pieces.select(
        *keys,
        F.when(F.col("pos") < SENTENCE_ID_SHIFT, F.col(id_col) * F.lit(SENTENCE_ID_SHIFT) + F.col("pos"))
         .otherwise(F.raise_error(F.lit("a paper has more sentences than sentence ids allow")).cast("long")).alias("sentence_id"),
        F.col(id_col).alias("paper_id"),
        py_strip("raw").alias("sentence"),
    )
    return min_len(out, "sentence", n)


def corpus_stats(papers: DataFrame, n: int = MIN_SENTENCE_CHARS) -> DataFrame:
    """Per corpus: papers (all rows), abstract and title sentence counts, the
    column list, sorted distinct years and the year range. One row per corpus
    even when it has no years (the reference omits the counts then)."""
    sent = sentence_table(run_texts(papers, ("abstract", "title")), n=n)
    counts = sent.groupBy("corpus_id").agg(
        F.sum(F.when(F.col("run_key") == "abstract", 1).otherwise(0)).alias("abstract_sentences"),
        F.sum(F.when(F.col("run_key") == "title", 1).otherwise(0)).alias("title_sentences"),
    )
    has_year = "year" in papers.columns
    year = F.col("year").cast("int") if has_year else F.lit(None).cast("int")
    per = papers.groupBy("corpus_id").agg(
        F.count(F.lit(1)).alias("papers"),
        F.sort_array(F.collect_set(year)).alias("years"),
        F.min(year).alias("min_year"),
        F.max(year).alias("max_year"),
    )
    cols = [c for c in papers.columns if c not in ("corpus_id", "row_id", "paper_id", "sr_no")]
    return (
        per.join(counts, "corpus_id", "left")
        .select(
            "corpus_id",
            "papers",
            F.coalesce("abstract_sentences", F.lit(0)).cast("bigint").alias("abstract_sentences"),
            F.coalesce("title_sentences", F.lit(0)).cast("bigint").alias("title_sentences"),
            F.array(*[F.lit(c) for c in cols]).alias("columns"),
            "years",
            "min_year",
            "max_year",
        )
    )
