"""Registered queries of the operators that learn something from the whole tables (sentence boundaries, neighbour
graphs, term vectors, reliabilities). Their SQL is in ``learnt_oracle``."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..functions.vec import dim_of
from ..operators import embed, graph_voice, lsa, manifold, punkt, reliability, seeded_bayes, summaries, taxonomy, text
from ..session import KEYS, table_path
from ..sources.papers import papers_from_documents
from . import derived as D
from .queries import q, r6

#: Radius of the clustering features of the given unit vectors.
VECTOR_RADIUS = 1.3


def _documents(spark, sf_dir):
    return spark.read.parquet(table_path(sf_dir, "documents")).select("lang", "doc_id", "text")


def _punkt(spark, sf_dir) -> dict:
    """The learnt tables per language, one training per session and input."""
    built: dict = {}

    def stage(name):
        def build():
            if not built:
                built.update(punkt.train(_documents(spark, sf_dir), ["lang"], "doc_id"))
            return built[name]
        return D._stage(spark, sf_dir, f"punkt-{name}", build)

    return {name: stage(name) for name in ("types", "collocations", "starters")}


@q("punkt_types")
def punkt_types(spark, sf_dir):
    t = _punkt(spark, sf_dir)["types"]
    return t.select("lang", "type", "with_dot", "plain", "upper_inside", "lower_seen", "starts", r6("ratio").alias("ratio"), r6("score").alias("score"), "abbreviation")


@q("punkt_collocations")
def punkt_collocations(spark, sf_dir):
    return _punkt(spark, sf_dir)["collocations"].withColumn("ratio", r6("ratio"))


@q("punkt_starters")
def punkt_starters(spark, sf_dir):
    return _punkt(spark, sf_dir)["starters"].withColumn("ratio", r6("ratio"))


@q("punkt_dots")
def punkt_dots(spark, sf_dir):
    d = punkt.dots(_documents(spark, sf_dir), _punkt(spark, sf_dir), ["lang"], "doc_id")
    return d.withColumnRenamed("id", "doc_id")


@q("punkt_differences")
def punkt_differences(spark, sf_dir):
    """Sentences that the learnt boundaries give and the plain rule doesn't (``learnt``), and the other way round, per text."""
    docs = _documents(spark, sf_dir)
    learnt = punkt.sentences(docs, _punkt(spark, sf_dir), ["lang"], "doc_id").groupBy("doc_id", "sentence").agg(F.count("*").alias("a"))
    pieces = text.split_sentences(docs.select("doc_id", F.col("text")))
    plain = pieces.select("doc_id", py_strip("raw").alias("sentence")).filter(F.length("sentence") > text.MIN_SENTENCE_CHARS).groupBy("doc_id", "sentence").agg(F.count("*").alias("b"))
    j = learnt.join(plain, ["doc_id", "sentence"], "full_outer")
    more = (F.coalesce("a", F.lit(0)) - F.coalesce("b", F.lit(0))).cast("long")
    return j.select("doc_id", "sentence", more.alias("more")).filter("more <> 0")


# -- the neighbour-graph reducer -----------------------------------------------------

def _points(spark, sf_dir):
    return D.emb_rows(spark, sf_dir).join(D.emb_vectors(spark, sf_dir), "sentence_id").select(*KEYS, "sentence_id", F.col("embedding").alias("vec"))


def _exact(spark, sf_dir):
    return D._stage(spark, sf_dir, "knn-exact", lambda: embed.knn_graph(_points(spark, sf_dir), embed.KNN_K))


@q("nn_descent")
def nn_descent(spark, sf_dir):
    """Approximate neighbours held against the exact ones: per corpus the edges and whether nine tenths of the exact ones were found."""
    found = manifold.nn_descent(_points(spark, sf_dir), embed.KNN_K)
    exact = _exact(spark, sf_dir)
    j = exact.select(*KEYS, "src", "dst").join(found.select(*KEYS, "src", "dst", F.lit(1).alias("hit")), [*KEYS, "src", "dst"], "left")
    edges = found.groupBy(*KEYS).agg(F.count("*").alias("edges"))
    return j.groupBy(*KEYS).agg((F.sum(F.coalesce("hit", F.lit(0))) >= 0.9 * F.count("*")).alias("recall_reached")).join(edges, list(KEYS))


@q("fuzzy_graph")
def fuzzy_graph(spark, sf_dir):
    return manifold.fuzzy_graph(_exact(spark, sf_dir), embed.KNN_K).withColumn("weight", r6("weight"))


@q("layout")
def layout(spark, sf_dir):
    """Principal components moved along the fuzzy graph (the given vectors have no spectral structure; see README)."""
    start = D.emb_rows(spark, sf_dir).join(embed.reduce_dims(D.emb_vectors(spark, sf_dir), embed.REDUCED_DIM).drop("embedding"), "sentence_id")
    y = manifold.layout(manifold.fuzzy_graph(_exact(spark, sf_dir), embed.KNN_K), embed.REDUCED_DIM, start=start)
    return y.select(*KEYS, "sentence_id", *[r6(f"c{i}").alias(f"c{i}") for i in range(embed.REDUCED_DIM)])


# -- clustering features -------------------------------------------------------------

@q("summaries_certificate")
def summaries_certificate(spark, sf_dir):
    """Clustering features of the vectors, held against the vectors: per corpus the points, their spread as the features add it up, the points that
    the map has once, those beyond their feature's ball, and whether the features are fewer."""
    points = _points(spark, sf_dir)
    k = dim_of(points, "vec")
    points = points.select(*KEYS, "sentence_id", *[F.col("vec")[i].cast("double").alias(f"c{i}") for i in range(k)])
    s, umap = summaries.summarise(points, k, VECTOR_RADIUS)
    centre = s.groupBy(*KEYS).agg(F.sum("n").alias("points"), F.sum("sse").alias("inside"), F.count("*").alias("features"),
                                  *[(F.sum(F.col("n") * F.col("mean")[i]) / F.sum("n")).alias(f"m{i}") for i in range(k)])
    away = sum((F.col("n") * (F.col("mean")[i] - F.col(f"m{i}")) * (F.col("mean")[i] - F.col(f"m{i}")) for i in range(k)), F.lit(0.0))
    spread = s.join(centre, list(KEYS)).groupBy(*KEYS, "points", "inside", "features").agg(F.sum(away).alias("outside"))
    own = points.join(umap, [*KEYS, "sentence_id"]).join(s.select(*KEYS, "cid", "mean", "ball"), [*KEYS, "cid"])
    far = sum(((F.col(f"c{i}") - F.col("mean")[i]) * (F.col(f"c{i}") - F.col("mean")[i]) for i in range(k)), F.lit(0.0))
    held = own.groupBy(*KEYS).agg(F.count_distinct("sentence_id").alias("assigned"), F.count_if(F.sqrt(far) > F.col("ball") + 1e-9).alias("beyond"))
    return spread.join(held, list(KEYS)).select(*KEYS, "points", F.round(F.col("inside") + F.col("outside"), 6).alias("spread"), "assigned", "beyond",
                                                (F.col("features") < F.col("points")).alias("fewer"))


# -- council -------------------------------------------------------------------------

@q("propose_graph_labels")
def propose_graph_labels(spark, sf_dir):
    m = D.emb_topics(spark, sf_dir)[0]
    return graph_voice.graph_labeller(m).select(*KEYS, "cluster_id", "model_idx", "label", r6("confidence").alias("confidence"))


@q("arbitrate_learnt")
def arbitrate_learnt(spark, sf_dir):
    a = reliability.arbitrate_learnt(D.labelled_topics(spark, sf_dir)[1])
    return a.select(*KEYS, "cluster_id", "label", r6("confidence").alias("confidence"), "reasoning", "winning_model")


@q("voice_rates")
def voice_rates(spark, sf_dir):
    a = reliability.agreement(D.labelled_topics(spark, sf_dir)[1])
    return reliability.rates(a).select(*KEYS, F.posexplode("rates").alias("model_idx", "rate")).withColumn("rate", r6("rate"))


# -- learnt vectors ------------------------------------------------------------------

@q("term_vectors_certificate")
def term_vectors_certificate(spark, sf_dir):
    """What holds of the term vectors of all abstracts' sentences (see ``lsa.certificate``)."""
    s = text.sentence_table(text.run_text(papers_from_documents(spark, sf_dir), "abstract"))
    matrix = lsa.written(lsa.cells(s.select(F.col("sentence_id").alias("sentence_key"), "sentence")), "lsa-matrix")
    chunks = lsa.packed(matrix)
    c = lsa.certificate(matrix, *lsa.term_vectors(matrix, chunks=chunks), chunks=chunks)
    chunks.unpersist()
    return c.withColumn("squares", F.round("squares", 3))


# -- categories learnt from seeds ------------------------------------------------------

_BAYES: dict = {}


def _bayes(spark, sf_dir) -> seeded_bayes.Model:
    """Learnt from all abstracts' sentences; seeds are the categories' names and the names of the themes that responses mapped."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _BAYES:
        s = text.sentence_table(text.run_text(papers_from_documents(spark, sf_dir), "abstract"))
        seeds = seeded_bayes.name_seeds(spark).unionByName(seeded_bayes.mapped_seeds(D.emb_taxonomy(spark, sf_dir)[0]))
        _BAYES[key] = seeded_bayes.learn(seeded_bayes.cells(s), seeds)
    return _BAYES[key]


@q("classify_theme_learnt")
def classify_theme_learnt(spark, sf_dir):
    return seeded_bayes.classify(D.emb_themes(spark, sf_dir)[0], _bayes(spark, sf_dir)).withColumn("match_confidence", r6("match_confidence"))


@q("category_shares")
def category_shares(spark, sf_dir):
    return seeded_bayes.shares(spark, _bayes(spark, sf_dir)).withColumn("sentences", F.round("sentences", 3))


@q("taxonomy_changes")
def taxonomy_changes(spark, sf_dir):
    """Themes that the learnt categories put elsewhere than the cosine with the category names does, per corpus and run."""
    th = D.emb_themes(spark, sf_dir)[0]
    a = taxonomy.classify_theme(th, embed.hashed_tf).select(*KEYS, "theme_name", F.col("pajais_match").alias("by_name"))
    j = a.join(seeded_bayes.classify(th, _bayes(spark, sf_dir)), [*KEYS, "theme_name"])
    return j.groupBy(*KEYS).agg(F.count("*").alias("themes"), F.count_if(F.col("by_name") != F.col("pajais_match")).alias("changed"),
                                F.count_if((F.col("by_name") == "NOVEL") & ~F.col("is_novel")).alias("newly_mapped"),
                                F.count_if((F.col("by_name") != "NOVEL") & F.col("is_novel")).alias("newly_novel"))
