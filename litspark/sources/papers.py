"""Paper sources: the tolerant/strict bibliographic CSV reader and the
deterministic views of the driver's ``documents`` table that stand in for a
journal export (no journal CSV ships with the test data)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import spread, table_path

# ---------------------------------------------------------------------------
# The export's header names, in export order, and the snake-case
# names used inside the engine.
EXPORT_COLUMNS = [
    ("Authors", "authors"),
    ("Title", "title"),
    ("Abstract", "abstract"),
    ("Author Keywords", "author_keywords"),
    ("Cited by", "cited_by"),
    ("Source title", "source_title"),
    ("Year", "year"),
]
# Tokens a pandas CSV read turns into missing values (pandas' documented
# default `na_values`), applied after Spark's own empty-string-to-NULL.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]
# ---------------------------------------------------------------------------

RAW_FIELDS = [snake for _, snake in EXPORT_COLUMNS]
OVERFLOW = "_overflow"


class MalformedCsv(ValueError):
    pass


def _na_to_null(c: str):
    col = F.col(f"`{c}`")
    return F.when(col.isin(NA_TOKENS), F.lit(None).cast("string")).otherwise(col)


def _file_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(file, rank): the files under ``path`` in name order (a listing; no content is read)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("_file"))
    return files.select("_file", (F.row_number().over(Window.orderBy("_file")) - 1).cast("long").alias("_rank"))


def read_papers(spark: SparkSession, path: str, strict: bool = False,
                corpus_id: str = "default") -> DataFrame:
    """Read a bibliographic export as all-STRING columns plus ``row_id`` (file
    order: files by name, then position) and ``corpus_id``.

    Columns are found by the names in the header, in any order and among any
    others; one that the header lacks is missing from the result, so the cleaning
    step reports it. All files of ``path`` must have the first file's header (Spark
    checks each and raises). Tolerant mode (the loader's behaviour): rows with too
    many fields are skipped, rows with too few are padded with NULL; strict mode
    raises on the former. Spark marks both kinds as malformed; the marked text is parsed again
    with one more column to tell them apart. Quoted multi-line fields and
    doubled quotes are honoured."""
    options = {"multiLine": "true", "escape": '"', "encoding": "UTF-8"}
    header = spark.read.options(header="true", **options).csv(path).columns
    bad = "_malformed"
    schema = T.StructType([T.StructField(h, T.StringType()) for h in [*header, bad]])
    rows = (spark.read.schema(schema).options(header="true", mode="PERMISSIVE", enforceSchema="false",
                                              columnNameOfCorruptRecord=bad, **options).csv(path)
            .withColumn("_file", F.col("_metadata.file_path")).withColumn("_mid", F.monotonically_increasing_id()))
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(header) + 1)])
    again = F.from_csv(F.col(bad), wide.simpleString()[len("struct<"):-1].replace(":", " "), options)
    rows = rows.withColumn(OVERFLOW, F.when(F.col(bad).isNotNull(), again[f"c{len(header)}"]))
    # Position within a file: ids grow within a partition and a file lies in one.
    rows = rows.join(_file_ranks(spark, path), "_file").withColumn(
        "row_id", F.col("_rank") * F.lit(1 << 33) + F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1)))
    if strict:
        # (Spark wants a column of the data beside the malformed text.)
        first = rows.filter(F.col(OVERFLOW).isNotNull()).agg(F.min("row_id"), F.max(F.length(f"`{header[0]}`"))).first()[0]
        if first is not None:
            raise MalformedCsv(f"row with too many fields in {path} (row_id={first})")
    rows = rows.filter(F.col(OVERFLOW).isNull())
    return rows.select(
        F.lit(corpus_id).alias("corpus_id"),
        "row_id",
        *[_na_to_null(h).alias(s) for h, s in EXPORT_COLUMNS if h in header],
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(table_path(sf_dir, "documents")))


def _title_expr(text: str = "text"):
    # The whole first line of the text.
    return F.substring_index(F.col(text), "\n", 1)


def papers_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean paper view of ``documents``: paper_id = doc_id, corpus = source,
    Abstract = text, Title = the whole first line, Year = 2010 +
    doc_id % 14, Cited by = n_chars % 200."""
    d = documents(spark, sf_dir)
    return d.select(
        F.col("source").alias("corpus_id"),
        F.col("doc_id").alias("paper_id"),
        F.concat(F.lit("Author"), F.col("doc_id"), F.lit("A, Author"), F.col("doc_id"), F.lit("B")).alias("authors"),
        _title_expr().alias("title"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("author_keywords"),
        (F.col("n_chars") % 200).cast("int").alias("cited_by"),
        F.col("source").alias("source_title"),
        (F.lit(2010) + F.col("doc_id") % 14).cast("int").alias("year"),
    )


def raw_papers_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw-export view of ``documents`` (all STRING, with the junk a real
    export carries) for the cleaning operators. Deterministic, written the same
    way in the DuckDB oracle. Edge values are injected by doc_id residues;
    every document is kept, and rows with doc_id % 50 = 0 appear twice (the
    second copy padded with outer whitespace, so equal only after strip)."""
    d = documents(spark, sf_dir)
    i = F.col("doc_id")
    authors = (F.when(i % 23 == 0, F.lit("   "))
               .otherwise(F.concat(F.lit("Author"), i, F.lit("A, Author"), i, F.lit("B"))))
    title = F.when(i % 29 == 0, F.lit("Short")).otherwise(_title_expr())
    cited = (F.when(i % 19 == 0, F.lit("-1"))
             .when(i % 37 == 0, F.lit("x"))
             .when(i % 59 == 0, F.lit("5d"))
             .when(i % 61 == 0, F.lit("1e3"))
             .when(i % 67 == 0, F.lit("Infinity"))
             .when(i % 71 == 0, F.lit(" NaN "))
             .when(i % 73 == 0, F.lit("3000000000"))
             .otherwise((F.col("n_chars") % 200).cast("string")))
    source = (F.when(i % 41 == 0, F.lit("pp. 12-15"))
              .when(i % 43 == 0, F.lit("3D Research"))
              .otherwise(F.col("source")))
    year = (F.when(i % 17 == 0, F.lit("abc"))
            .when(i % 31 == 0, F.lit("1899"))
            .when(i % 47 == 0, F.lit("2015.5"))
            .when(i % 79 == 0, F.lit("2015f"))
            .otherwise((F.lit(2010) + i % 14).cast("string")))
    abstract = F.when(i % 53 == 0, F.lit(None).cast("string")).otherwise(F.col("text"))
    base = d.select(
        F.col("source").alias("corpus_id"),
        (i * 2).alias("row_id"),
        authors.alias("authors"),
        title.alias("title"),
        abstract.alias("abstract"),
        F.col("lang").alias("author_keywords"),
        cited.alias("cited_by"),
        source.alias("source_title"),
        year.alias("year"),
    )
    dup = base.filter(F.col("row_id") % 100 == 0).select(
        "corpus_id",
        (F.col("row_id") + 1).alias("row_id"),
        "authors",
        F.concat(F.lit("  "), F.col("title"), F.lit(" ")).alias("title"),
        "abstract", "author_keywords", "cited_by", "source_title", "year",
    )
    return base.unionByName(dup)
