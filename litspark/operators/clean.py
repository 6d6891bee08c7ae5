"""Metadata cleaning of a raw bibliographic export (order matters). Every step
is a narrow projection/filter except dedupe (one aggregate) and the final
ordering/numbering (one range sort)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import ensure_checkpoint_dir
from ..sources.papers import RAW_FIELDS

# ---------------------------------------------------------------------------
# The cleaning rules of the reference script.
MIN_YEAR = 1900
MIN_TITLE_CHARS = 5          # titles must be strictly longer
SOURCE_JUNK_REGEX = r"(?U)^\s*(?:pp\.|pages?|p\.)?\s*\d+"   # matched at start, case-sensitive
KEY_FIELDS = ["authors", "title", "source_title"]
TEXT_FIELDS = ["authors", "title", "abstract", "author_keywords", "source_title"]
PAPER_FIELDS = ["authors", "title", "abstract", "author_keywords", "cited_by", "source_title", "year"]
# ---------------------------------------------------------------------------


class MissingColumns(ValueError):
    pass


def clean_select(raw: DataFrame) -> DataFrame:
    missing = [c for c in RAW_FIELDS if c not in raw.columns]
    if missing:
        raise MissingColumns(f"missing columns: {missing}")
    return raw.select("corpus_id", "row_id", *RAW_FIELDS)


def number(c: str):
    """A plain or exponent number in outer white space as DOUBLE, else NULL. The pattern keeps
    out what only Java reads as a number (``5d``, ``2015f``, hexadecimal), and what is not finite."""
    d = F.expr(f"try_cast(`{c}` AS DOUBLE)")
    plain = F.col(c).rlike(r"^[ \t\r\n]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?[ \t\r\n]*$")
    return F.when(plain & ~F.isnan(d) & (F.abs(d) < F.lit(float("inf"))), d)


def valid_year(c: str, current_year: int):
    return F.coalesce(number(c).between(MIN_YEAR, current_year), F.lit(False))


def valid_cited(c: str):
    return F.coalesce((number(c) >= 0) & (number(c) < F.lit(9e18)), F.lit(False))


def clean_year(df: DataFrame, current_year: int) -> DataFrame:
    """Numeric coercion (non-numeric -> dropped), keep 1900..current_year,
    truncate to int. ``current_year`` is a parameter for determinism."""
    return df.filter(valid_year("year", current_year)).withColumn("year", number("year").cast("int"))


def clean_cited(df: DataFrame) -> DataFrame:
    return df.filter(valid_cited("cited_by")).withColumn("cited_by", number("cited_by").cast("long"))


def clean_strip(df: DataFrame, cols=TEXT_FIELDS) -> DataFrame:
    """Unicode whitespace strip (Python ``str.strip``); NULL stays NULL."""
    return df.select(*[py_strip(c).alias(c) if c in cols else F.col(c) for c in df.columns])


def clean_required_text(df: DataFrame) -> DataFrame:
    """Drop NULL/empty authors and source, and titles of 5 characters or less."""
    return df.filter(
        (F.length("authors") > 0)
        & (F.length("title") > MIN_TITLE_CHARS)
        & (F.length("source_title") > 0)
    )


def clean_source_regex(df: DataFrame) -> DataFrame:
    """Drop sources that start like a page reference (pp./page(s)/p. digits)."""
    return df.filter(~F.col("source_title").rlike(SOURCE_JUNK_REGEX))


def clean_key_nulls(df: DataFrame) -> DataFrame:
    return df.dropna(subset=KEY_FIELDS)


def clean_dedupe(df: DataFrame) -> DataFrame:
    """Exact duplicate rows (NULLs equal), keep the first in file order. One
    aggregate over all fields; partial aggregation collapses copies map-side,
    so a hot duplicated row does not reach one reducer in full."""
    return df.groupBy("corpus_id", *PAPER_FIELDS).agg(F.min("row_id").alias("row_id")) \
             .select("corpus_id", "row_id", *PAPER_FIELDS)


def order_columns():
    return [F.col("corpus_id"), F.col("cited_by").desc(), F.col("year").desc(), F.col("row_id")]


def sequence(df: DataFrame, order_cols, name: str = "seq", group_col: str | None = None) -> DataFrame:
    """Exact consecutive numbering 1..n in ``order_cols`` order (per
    ``group_col`` if given), without a single-partition window over the data.

    Range sort (a unique tie-break column keeps a hot key splittable), one
    reliable checkpoint to fix partitions and their order, then per-partition
    row counts (one row per partition: a bounded table) give each partition's
    offset. ``monotonically_increasing_id`` = partition << 33 | row."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    # Persist while checkpointing so the sort runs once, then drop the cache.
    sorted_ = df.orderBy(*order_cols).persist()
    m = sorted_.checkpoint(eager=True)
    sorted_.unpersist()
    m = m.withColumn("_mid", F.monotonically_increasing_id())
    m = m.withColumn("_p", F.shiftright("_mid", 33)).withColumn(
        "_i", F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = m.groupBy("_p").agg((F.max("_i") + 1).alias("_n"))
    w = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    out = m.join(F.broadcast(offs), "_p").withColumn(name, F.col("_off") + F.col("_i") + 1)
    if group_col is not None:
        first = out.groupBy(group_col).agg(F.min(name).alias("_first"))
        out = out.join(first, group_col).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return out.drop("_mid", "_p", "_i", "_off")


def clean_order_seq(df: DataFrame) -> DataFrame:
    """Sort Cited by desc, Year desc, ties in file order; Sr No 1..n per corpus."""
    out = sequence(df, order_columns(), "sr_no", group_col="corpus_id")
    return out.select("corpus_id", F.col("sr_no").cast("int").alias("sr_no"), "row_id", *PAPER_FIELDS)


def clean_rows(raw: DataFrame, current_year: int) -> DataFrame:
    """All row-level cleaning steps (before ordering/numbering)."""
    df = clean_select(raw)
    df = clean_year(df, current_year)
    df = clean_cited(df)
    df = clean_strip(df)
    df = clean_required_text(df)
    df = clean_source_regex(df)
    df = clean_key_nulls(df)
    return clean_dedupe(df)


def clean_papers(raw: DataFrame, current_year: int) -> DataFrame:
    """raw export -> clean papers (corpus_id, sr_no, row_id, fields...)."""
    return clean_order_seq(clean_rows(raw, current_year))


def papers_view(clean: DataFrame) -> DataFrame:
    """Clean papers as the pipeline's paper table: paper_id = Sr No - 1 (the
    position in the cleaned export, which later stages refer to)."""
    return clean.withColumn("paper_id", (F.col("sr_no") - 1).cast("bigint"))


# Audit: row count after each step, in one pass over the data.
AUDIT_STEPS = [
    (1, "loaded"), (2, "selected"), (3, "year"), (4, "cited_by"), (5, "authors"),
    (6, "title"), (7, "abstract"), (8, "author_keywords"), (9, "source_title"),
    (10, "key_fields"), (11, "dedupe"), (12, "final"),
]


def clean_audit(raw: DataFrame, current_year: int) -> DataFrame:
    """(corpus_id, step, name, rows, min_value, max_value) with cumulative
    pass flags per row and one aggregate; the dedupe step is a distinct count
    over the survivors. The value range is the year range after the year step
    and the citation range after the citation step (NULL elsewhere)."""
    df = clean_select(raw)
    y, c = number("year"), number("cited_by")
    s = {k: py_strip(k) for k in TEXT_FIELDS}
    p3 = valid_year("year", current_year)
    p4 = p3 & valid_cited("cited_by")
    p5 = p4 & (F.length(s["authors"]) > 0)
    p6 = p5 & (F.length(s["title"]) > MIN_TITLE_CHARS)
    p9 = p6 & (F.length(s["source_title"]) > 0) & ~s["source_title"].rlike(SOURCE_JUNK_REGEX)
    p9 = F.coalesce(p9, F.lit(False))
    row = F.struct(s["authors"], s["title"], s["abstract"], s["author_keywords"],
                   c.cast("long"), s["source_title"], y.cast("int"))
    agg = df.groupBy("corpus_id").agg(
        F.count(F.lit(1)).alias("n1"),
        F.count(F.lit(1)).alias("n2"),
        F.sum(F.coalesce(p3, F.lit(False)).cast("int")).alias("n3"),
        F.sum(F.coalesce(p4, F.lit(False)).cast("int")).alias("n4"),
        F.sum(F.coalesce(p5, F.lit(False)).cast("int")).alias("n5"),
        F.sum(F.coalesce(p6, F.lit(False)).cast("int")).alias("n6"),
        F.sum(F.coalesce(p6, F.lit(False)).cast("int")).alias("n7"),
        F.sum(F.coalesce(p6, F.lit(False)).cast("int")).alias("n8"),
        F.sum(p9.cast("int")).alias("n9"),
        F.sum(p9.cast("int")).alias("n10"),
        F.count_distinct(F.when(p9, row)).alias("n11"),
        F.min(F.when(p3, y.cast("int"))).alias("lo3"), F.max(F.when(p3, y.cast("int"))).alias("hi3"),
        F.min(F.when(p4, c.cast("long"))).alias("lo4"), F.max(F.when(p4, c.cast("long"))).alias("hi4"),
    ).withColumn("n12", F.col("n11"))
    no = F.lit(None).cast("bigint")

    def rng(i: int, side: str):
        return F.col(f"{side}{i}").cast("bigint") if i in (3, 4) else no

    steps = F.array(*[
        F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"n{i}").cast("bigint").alias("rows"),
                 rng(i, "lo").alias("min_value"), rng(i, "hi").alias("max_value"))
        for i, n in AUDIT_STEPS
    ])
    return agg.select("corpus_id", F.inline(steps))


def clean_summary(clean: DataFrame) -> DataFrame:
    return clean.groupBy("corpus_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count("abstract").alias("with_abstract"),
        F.count("author_keywords").alias("with_keywords"),
        F.count_distinct("source_title").alias("sources"),
        F.min("year").alias("min_year"),
        F.max("year").alias("max_year"),
        F.min("cited_by").alias("min_cited_by"),
        F.max("cited_by").alias("max_cited_by"),
    )
