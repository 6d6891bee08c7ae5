"""Sentence vectors, dimension reduction and the k-nearest-neighbour graph.

No pretrained transformer is available offline, so the default embedder is
Spark ML's hashed TF-IDF, L2-normalised (768 dimensions like the reference's
model). The embedder is a plug point: any ``(df, col) -> df`` adding an
``embedding ARRAY<FLOAT>`` column works, e.g. ``model_embedder`` (Arrow-
batched iterator UDF, model loaded once per Python worker) or a join to a
supplied vector table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, PCA, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import KEYS, scratch_path, ship_package
from . import blocks

# Fixed values from the reference: embedding width and reduced width.
EMBED_DIM = 768
REDUCED_DIM = 10
KNN_K = 15

# Words are runs of Unicode letters or digits (same rule in every engine).
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def hashed_tfidf(df: DataFrame, col: str = "sentence", dim: int = EMBED_DIM,
                 out: str = "embedding") -> DataFrame:
    """Default embedder: tokens -> hashed term counts -> IDF -> L2 norm ->
    ARRAY<FLOAT>. The (sparse, compact) term counts are written once to the
    shared scratch folder, so fitting the IDF (one distributed aggregate) and
    transforming do not run the upstream text pipeline twice."""
    spark = df.sparkSession
    tok = RegexTokenizer(inputCol=col, outputCol="_tok", pattern=TOKEN_SPLIT, toLowercase=True)
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    path = scratch_path(spark, "tf")
    tf.transform(tok.transform(df)).drop("_tok").write.mode("overwrite").parquet(path)
    counts = spark.read.parquet(path)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(counts)
    nrm = Normalizer(inputCol="_idf", outputCol="_v", p=2.0)
    return (nrm.transform(idf.transform(counts))
            .withColumn(out, vector_to_array("_v", "float32"))
            .drop("_tf", "_idf", "_v"))


def hashed_tf(df: DataFrame, col: str, dim: int = EMBED_DIM, out: str = "embedding") -> DataFrame:
    """Unfitted embedder (hashed term counts): the same text always gets the same vector, whatever
    else is in the table. A term's place is its md5 modulo ``dim``, a hash that other engines have as
    well; counts aren't scaled, which cosines don't need. Used for short strings such as theme and category names."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(col), F.lit(""))), TOKEN_SPLIT), lambda t: t != "")
    place = F.transform(words, lambda t: F.conv(F.substring(F.md5(t.cast("binary")), 1, 4), 16, 10).cast("int") % dim)
    counts = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(F.col("_place"), lambda p: p == i)).cast("float"))
    return df.withColumn("_place", place).withColumn(out, counts).drop("_place")


def model_embedder(load: Callable[[], Callable[[list[str]], "list[list[float]]"]],
                   dim: int, out: str = "embedding"):
    """Embedder backed by a user-supplied model. ``load()`` runs once per
    Python worker (iterator pandas UDF) and returns ``encode(texts) ->
    vectors``; batches move through Arrow. The model is not shipped here."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def _encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        enc = load()
        for s in batches:
            yield pd.Series([list(map(float, v)) for v in enc(s.fillna("").tolist())])

    def embed(df: DataFrame, col: str = "sentence") -> DataFrame:
        ship_package(df.sparkSession)
        return df.withColumn(out, _encode(F.col(col)))

    return embed


def embed(df: DataFrame, col: str = "sentence", embedder=None) -> DataFrame:
    return (embedder or hashed_tfidf)(df, col)


def reduce_dims(df: DataFrame, k: int = REDUCED_DIM, vec_col: str = "embedding",
                prefix: str = "c") -> DataFrame:
    """PCA to k dimensions (the reference uses UMAP; its stochastic layout is
    not rebuilt, so distance thresholds are parameters to tune). The fit is
    one distributed covariance aggregate (d x d, d = vector width); the
    projection is a narrow map. Output: k scalar DOUBLE columns."""
    v = df.withColumn("_v", array_to_vector(F.col(vec_col)))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    p = model.transform(v).withColumn("_p", vector_to_array("_p"))
    return p.select(*[c for c in df.columns], *[F.col("_p")[i].alias(f"{prefix}{i}") for i in range(k)])


def components_certificate(df: DataFrame, k: int = REDUCED_DIM, vec_col: str = "embedding", prefix: str = "c") -> DataFrame:
    """One row ``(i, uncorrelated, principal, descending)`` per reduced coordinate, from the vectors and the coordinates alone: no covariance with a later one;
    the covariances with the vector's entries have the length of its variance, as only a unit eigenvector's projection has; and a
    variance above 0, not below the next one's nor (the first) below any single entry's."""
    dim = df.select(F.size(vec_col)).first()
    dim = dim[0] if dim else 0
    x = [F.col(vec_col)[d].cast("double") for d in range(dim)]
    c = [F.col(f"{prefix}{i}") for i in range(k)]
    # One aggregate a coordinate: the row of covariances with the entries stays small enough to be compiled.
    aggs = [F.covar_pop(c[i], x[d]).alias(f"x{i}_{d}") for i in range(k) for d in range(dim)]
    aggs += [F.covar_pop(c[i], c[j]).alias(f"v{i}_{j}") for i in range(k) for j in range(i, k)] + [F.var_pop(v).alias(f"s{d}") for d, v in enumerate(x)]
    r = df.agg(*aggs).first().asDict()
    tol = 1e-6 * (1e-12 + (r["v0_0"] or 0.0))
    rows = []
    for i in range(k):
        var = r[f"v{i}_{i}"] or 0.0
        length = sum((r[f"x{i}_{d}"] or 0.0) ** 2 for d in range(dim)) ** 0.5
        nxt = r[f"v{i + 1}_{i + 1}"] if i + 1 < k else 0.0
        rows.append((i, all(abs(r[f"v{i}_{j}"] or 0.0) <= tol for j in range(i + 1, k)), abs(length - var) <= tol and var > 0,
                     var >= (nxt or 0.0) - tol and (i > 0 or all(var >= (r[f"s{d}"] or 0.0) - tol for d in range(dim)))))
    return df.sparkSession.createDataFrame(rows, "i int, uncorrelated boolean, principal boolean, descending boolean")


def knn_graph(points: DataFrame, k: int = KNN_K, keys=KEYS, vec_col: str = "vec",
              id_col: str = "sentence_id", metric: str = "cosine", block: int = blocks.SIZE,
              stats: dict | None = None) -> DataFrame:
    """Exact k nearest neighbours within each key: (keys, src, dst, distance,
    rank[, similarity]); ties by ``dst``. ``metric='cosine'`` normalises the vectors first
    (Euclidean order on unit vectors is cosine order) and adds ``similarity``.

    The search runs over pairs of bounded blocks (``blocks``): a hot key is as many tasks as its
    blocks need, and pairs of blocks whose balls are farther apart than the neighbours
    known already are left out. ``stats`` gets the pairs of points compared."""
    v = F.col(vec_col).cast("array<double>")
    if metric == "cosine":
        nrm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x * x))
        v = F.when(nrm > 0, F.transform(v, lambda x: x / nrm)).otherwise(v)
    pts = points.select(*keys, F.col(id_col).cast("long").alias("id"), v.alias("x"), F.lit(1.0).alias("w"))
    out = blocks.neighbours(blocks.blocks(pts, keys, block), k, keys, stats=stats)
    out = out.select(*keys, "src", "dst", F.sqrt("d").alias("distance"), F.col("rank").cast("int").alias("rank"))
    if metric == "cosine":
        out = out.withColumn("similarity", 1.0 - F.col("distance") * F.col("distance") / 2.0)
    return out
