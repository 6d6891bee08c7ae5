"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, table_path

# The white space of all word, line and normalisation rules: U+0020 and U+0009-U+000D.
WHITE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def session(df: DataFrame) -> SparkSession:
    """The frame's session, with this package shipped to the Python workers."""
    ship_package(df.sparkSession)
    return df.sparkSession


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage,
    survives lost executors and is shared by several readers."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm-{name}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    return name if name not in df.columns else f"{name}_{uuid.uuid4().hex[:8]}"


_CACHE: dict[str, object] = {}


def release() -> None:
    """Give memory that this worker freed back to the system, where the C library can (workers live on between stages)."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def worker_cache(name: str, make=None):
    """The cache of operator ``name`` in this Python worker. Workers are reused by later stages, so
    a worker keeps one operator's cache at a time: asking for another one lets go of it."""
    if name not in _CACHE:
        _CACHE.clear()
        release()
        _CACHE[name] = make() if make else None
    return _CACHE[name]


def nonnull_text(column: str = "text"):
    """Null texts count as empty everywhere."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` with long ids: ``(id, root)`` for
    every id on an edge, root = smallest id of its component.

    Alternating large-star / small-star rounds: every round rewires each id
    to the smallest id known around it, so the number of rounds is about the
    logarithm of the longest path. Each round is written to the shared folder; a
    hub id never gathers its neighbours in one task because only ``min``
    aggregates (combined before the shuffle) and joins that AQE can split are
    used. Ends when a round changes nothing; raises if ``max_rounds`` do not suffice."""
    e = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
                .filter("a is not null and b is not null and a <> b").distinct(), f"{name}-edges")
    for _ in range(max_rounds):
        # Large star: neighbours above an id are linked to the smallest id around it.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (both.join(low, "a").filter("b > a and b <> m")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        # Small star: an id and its smaller neighbours are linked to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        low2 = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low2, "a")
        new = written(
            small.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
            .unionByName(low2.select("a", F.col("m").alias("b"))).distinct(), f"{name}-round")
        moved = new.join(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
        done = moved.isEmpty()
        e = new
        if done:
            break
    else:
        raise RuntimeError(f"components of {name} did not settle in {max_rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root")
    return roots.unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
