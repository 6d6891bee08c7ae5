"""Stage store: one parquet table per pipeline stage, partitioned by
(corpus_id, run_key), with dynamic partition overwrite so re-running one
corpus/run replaces only its partitions. Replaces the reference's JSON/npy
checkpoint files; reading a missing stage raises ``StageMissing`` naming the
step to run first."""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import KEYS

# Stage order of the pipeline and the step that produces each
# stage (used in error messages and the inventory's "most advanced" rank).
STAGES = ["papers", "sentences", "embeddings", "reduced", "unit_map", "merges", "assignments", "topics", "topic_papers",
          "labels", "theme_map", "themes", "taxonomy", "comparison"]
PRODUCER = {
    "papers": "load papers", "sentences": "load papers", "embeddings": "discovery", "reduced": "discovery",
    "unit_map": "discovery", "merges": "discovery", "assignments": "discovery", "topics": "discovery", "topic_papers": "discovery",
    "labels": "discovery and labelling", "theme_map": "consolidate themes", "themes": "consolidate themes",
    "taxonomy": "taxonomy mapping", "comparison": "comparison",
}
# Review-table precedence: most advanced stage first.
REVIEW_STAGES = ["taxonomy", "themes", "labels"]
RUN_KEY_ORDER = ["abstract", "title", "combined"]


class StageMissing(FileNotFoundError):
    pass


class StageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, stage: str) -> str:
        return f"{self.root}/{stage}"

    def write(self, stage: str, df: DataFrame, partition_by=KEYS) -> None:
        """Replace the partitions (corpus, run) that ``df`` has rows of; others stay."""
        cols = [c for c in partition_by if c in df.columns]
        w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(self.path(stage))
        # A partitioned write without rows leaves no file; keep the columns readable.
        self._write_schema(stage, df)

    def _file_system(self, stage: str):
        """(Hadoop path, its file system): whatever Spark can read, not the driver's disk."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(stage))
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _write_schema(self, stage: str, df: DataFrame) -> None:
        path, fs = self._file_system(f"_schemas/{stage}")
        out = fs.create(path, True)
        try:
            out.write(bytearray(df.schema.json().encode()))
        finally:
            out.close()

    def _schema(self, stage: str) -> T.StructType | None:
        if not self.exists(f"_schemas/{stage}"):
            return None
        text = self.spark.read.text(self.path(f"_schemas/{stage}"), wholetext=True).first()[0]
        return T.StructType.fromJson(json.loads(text))

    def clear(self, stage: str) -> None:
        """Take a stage out of the store."""
        for name in (stage, f"_schemas/{stage}"):
            path, fs = self._file_system(name)
            fs.delete(path, True)

    def exists(self, stage: str) -> bool:
        """Whether the stage was written: asked of the file system that holds ``root`` (any that
        Spark reads). Errors of that file system are raised, not taken as absence."""
        path, fs = self._file_system(stage)
        return fs.exists(path)

    def read(self, stage: str) -> DataFrame:
        if not self.exists(stage):
            raise StageMissing(f"stage '{stage}' not found under {self.root}; run {PRODUCER.get(stage, stage)} first")
        schema = self._schema(stage)
        return (self.spark.read.schema(schema) if schema else self.spark.read).parquet(self.path(stage))

    def remove(self, stage: str, keys: DataFrame, partition_by=KEYS) -> None:
        """Take the partitions of ``keys`` (changed corpora and runs, a bounded list) out of a stage; a rebuilt pair without a row
        would leave its old ones otherwise. A key without ``run_key`` in ``partition_by`` takes the whole corpus."""
        if not self.exists(stage):
            return
        escape = self.spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
        for row in keys.select(*partition_by).distinct().toLocalIterator():
            path, fs = self._file_system("/".join([stage, *(f"{c}={escape(row[c])}" for c in partition_by)]))
            fs.delete(path, True)

    def cached_by(self, stage: str, digests: DataFrame, build) -> DataFrame:
        """Compute-once per (corpus, run): ``digests(corpus_id, run_key, digest)`` tells what each pair is made from. Pairs whose stored digest is
        the same are read, the others built by ``build(pairs)`` in one call; their digests are written last."""
        name = f"{stage}_digests"
        todo = digests
        if self.exists(stage) and self.exists(name):
            todo = digests.join(self.read(name), [*KEYS, "digest"], "left_anti")
        todo = todo.checkpoint()
        if not todo.isEmpty():
            new = build(todo.select(*KEYS)).checkpoint()
            for s in (name, stage):
                self.remove(s, todo)
            self.write(stage, new)
            self.write(name, todo)
        return self.read(stage).join(digests.select(*KEYS), list(KEYS), "left_semi")

    def cached(self, stage: str, build) -> DataFrame:
        """Compute-once: read the stage when it exists, is readable and non-empty, else build it,
        write it and read it back (a stage with a broken file is built again)."""
        if self.exists(stage):
            try:
                df = self.read(stage)
                if not df.isEmpty():
                    return df
            except (Py4JJavaError, PySparkException):
                pass
        self.write(stage, build())
        return self.read(stage)

    def export_json(self, stage: str, path: str) -> None:
        """Write a stage as JSON lines (arrays and structs kept nested)."""
        self.read(stage).write.mode("overwrite").json(path)

    def counts(self) -> DataFrame:
        """(stage, corpus_id, run_key, entries) for every stored stage."""
        out = None
        for s in STAGES:
            if not self.exists(s):
                continue
            df = self.read(s)
            keys = [k for k in KEYS if k in df.columns]
            c = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("entries"))
            if df.isEmpty():  # written without a row: reported as such
                c = self.spark.createDataFrame([tuple([None] * len(keys) + [0])], ", ".join(f"{k} string" for k in keys) + ", entries long")
            for k in KEYS:
                if k not in keys:
                    c = c.withColumn(k, F.lit(None).cast("string"))
            c = c.select(F.lit(s).alias("stage"), *KEYS, "entries")
            out = c if out is None else out.unionByName(c)
        return out

    def files(self) -> DataFrame:
        """Every stored file with its size in KB (file listing as data)."""
        return (self.spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                .load(self.root).select("path", F.round(F.col("length") / 1024, 1).alias("kb")))


def row_digests(rows: DataFrame, keys=KEYS, parameters: str = "") -> DataFrame:
    """``(keys, digest)``: a digest of each key's rows in whatever order, and of the parameters. Two 64-bit hashes of a row are added up
    (so repeated rows count) in wide decimals next to the number of rows; one aggregate, no row leaves its task."""
    cols = sorted(c for c in rows.columns if c not in keys)
    body = F.struct(*[F.col(f"`{c}`") for c in cols])
    total = lambda h: F.sum(h.cast("decimal(38,0)")).cast("string")
    per = rows.groupBy(*keys).agg(F.count("*").cast("string").alias("_n"), total(F.xxhash64(body)).alias("_a"), total(F.xxhash64(F.lit(1), body)).alias("_b"))
    return per.select(*keys, F.sha2(F.concat_ws("|", F.lit(",".join(cols)), F.lit(parameters), "_n", "_a", "_b"), 256).alias("digest"))


def stage_inventory(counts: DataFrame) -> DataFrame:
    """Per (corpus, run): the most advanced of taxonomy > themes > labels,
    reported as ready (n entries) or EMPTY."""
    rank = F.when(F.col("stage") == "taxonomy", 1).when(F.col("stage") == "themes", 2) \
            .when(F.col("stage") == "labels", 3)
    c = counts.withColumn("_rank", rank).filter(F.col("_rank").isNotNull())
    w = Window.partitionBy("corpus_id", "run_key").orderBy("_rank")
    c = c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return c.select("corpus_id", "run_key", F.col("stage").alias("phase"), "entries",
                    F.when(F.col("entries") > 0, F.concat(F.lit("ready ("), F.col("entries"), F.lit(" entries)")))
                     .otherwise(F.lit("EMPTY")).alias("status"))


def best_stage(counts: DataFrame, run_key: str) -> DataFrame:
    """Per corpus: the review-table source -- the best non-empty stage of
    ``run_key``, else of the other run keys in the order abstract, title,
    combined."""
    order = [run_key] + [k for k in RUN_KEY_ORDER if k != run_key]
    key_rank = F.lit(len(order) + 1)
    for i, k in reversed(list(enumerate(order))):
        key_rank = F.when(F.col("run_key") == k, F.lit(i + 1)).otherwise(key_rank)
    st_rank = F.lit(None)
    for i, s in reversed(list(enumerate(REVIEW_STAGES))):
        st_rank = F.when(F.col("stage") == s, F.lit(i + 1)).otherwise(st_rank)
    c = counts.filter(F.col("entries") > 0).withColumn("_k", key_rank).withColumn("_s", st_rank) \
              .filter(F.col("_s").isNotNull())
    w = Window.partitionBy("corpus_id").orderBy("_k", "_s")
    return (c.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
            .select("corpus_id", "run_key", "stage", "entries",
                    (F.col("run_key") != run_key).alias("fallback")))
