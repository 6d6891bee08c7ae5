"""Session helpers: building a local session for tests/bench and finding the
shared folder that per-round state and lineage cuts are written to."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

# Every topic-level table is keyed by these two columns: one corpus (journal,
# source) analysed under one run configuration (abstract / title / combined).
KEYS = ("corpus_id", "run_key")

_LOCAL_DIRS: dict[str, str] = {}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "litspark") -> SparkSession:
    """Session for tests and the bench. On a cluster, use the cluster's own
    session instead: nothing in the library depends on this builder. The
    checkpoint folder is taken from ``spark.checkpoint.dir`` when configured
    (spark-defaults); only when it is unset is a local one chosen."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting (or ``setCheckpointDir``, if the application called it) names a
    shared folder; it is read, never overridden, and it is an error if there is none: a folder of
    the driver's machine is out of the executors' reach. Only a local master gets one under
    a fresh temporary folder."""
    sc = spark.sparkContext
    d = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir() or _LOCAL_DIRS.get(sc.applicationId)
    if not d:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        d = _LOCAL_DIRS[sc.applicationId] = tempfile.mkdtemp(prefix="litspark-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable by Python workers (Pandas UDFs pickle
    functions by module reference): zip it once per SparkContext and
    ``addPyFile`` it, which is how Spark ships code to executors."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="litspark-pyfiles-")
    zip_path = shutil.make_archive(os.path.join(out, "litspark"), "zip", os.path.dirname(pkg), "litspark")
    sc.addPyFile(zip_path)
    _SHIPPED.add(sc.applicationId)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder below the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of finished rounds: Spark deletes them once the driver's JVM has collected what
    describes them, which a driver with little to do puts off until the disks are full."""
    spark.sparkContext._jvm.System.gc()


def spread(df):
    """Round-robin repartition to the default parallelism when a scan yields
    fewer partitions than that (one unsplittable file: a single row group),
    so per-row work (regexes, tokenising) uses every core. A no-op on large
    inputs, which already have many splits; costs one shuffle otherwise."""
    par = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(par) if df.rdd.getNumPartitions() < par else df


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
