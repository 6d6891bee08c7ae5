"""Categories learnt from seeds: multinomial naive Bayes by expectation-maximisation over all sentences (Nigam et al. 2000).

A category begins with a few seed words: those of its name and of the themes a reviewer already mapped to it. Sentences that hold seeds start in their
categories, by share of seed words; all others start in class 0, the texts that no category speaks of. Rounds then count words by the
sentences' posteriors, with the seeds as extra counts, and give every sentence its posterior under those counts. A theme is scored by the
posterior of its words; class 0 winning makes it NOVEL.

The corpus is a table of cells ``(sid, term, tf)``, packed once into chunks of whole texts that stay where they are. In a round such a chunk meets the terms it holds, one column a
class (26 at most), gives its texts their posteriors and adds up their words, so what moves is a row per chunk and term, not per cell; the sums are written to the
shared folder. The driver sees one row of totals a round. The table of terms is broadcast only while its size, known by count, is small.

Defined results: categories none of whose seeds occur take no part, nor do seeds of no category; null texts have no words; repeated sentences count each time; ties go to the
category with the smallest number, before class 0; without sentences or seeds every theme is NOVEL, as is one without a known word."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import py_strip
from ..session import KEYS
from . import cells as C
from .blocks import written
from .council import STOP_WORDS
from .embed import TOKEN_SPLIT
from .taxonomy import CATEGORIES, NOVEL, taxonomy_dim

ROUNDS = 5
#: Count added to every (term, category), and to a category's seeds.
SMOOTH = 0.01
SEED_COUNT = 5.0
MIN_SENTENCES = 2
#: Largest table of terms that a round sends to all tasks; beyond it terms and cells meet in a shuffle.
BROADCAST_BYTES = 32 << 20
#: Cells of a chunk: a ``CHUNKS``th of all within these bounds, the last text's to its end.
LEAST_CELLS, MOST_CELLS, CHUNKS = 1 << 17, 1 << 23, 32


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), TOKEN_SPLIT), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def cells(sentences: DataFrame, col: str = "sentence", id_col: str = "sentence_id", min_sentences: int = MIN_SENTENCES) -> DataFrame:
    """``(sid, term, tf)`` of the terms that ``min_sentences`` sentences have, stored."""
    tf, _ = C.counted(sentences.select(F.col(id_col).alias("sid"), col), "sid", _words(F.col(col)), min_sentences, "bayes")
    return written(tf.drop("n"), "bayes-cells")


def name_seeds(spark) -> DataFrame:
    """``(category_no, term)`` from the categories' names."""
    return taxonomy_dim(spark).select("category_no", F.explode(_words(F.col("category"))).alias("term")).distinct()


def mapped_seeds(mapped: DataFrame) -> DataFrame:
    """``(category_no, term)`` from themes already mapped: the words of their names."""
    dim = taxonomy_dim(mapped.sparkSession)
    return mapped.join(F.broadcast(dim), F.col("pajais_match") == F.col("category")).select(
        "category_no", F.explode(_words(py_strip("theme_name"))).alias("term")).distinct()


class Model:
    """``terms(term, l<class>...)``: log probabilities of the words; ``classes``, 0 first; ``prior`` their log shares; ``sentences`` expected in each,
    ``seeds`` that occur."""

    def __init__(self, terms: DataFrame, n_terms: int, classes: list[int], prior: dict, sentences: dict, seeds: dict):
        self.terms, self.n_terms, self.classes, self.prior, self.sentences, self.seeds = terms, n_terms, classes, prior, sentences, seeds


def _posterior(scores: DataFrame, id_cols: list[str], model: Model) -> DataFrame:
    """``id_cols, p<class>...`` of ``id_cols, z<class>...`` (sums of log probabilities)."""
    z = {c: F.col(f"z{c}") + F.lit(model.prior[c]) for c in model.classes}
    t = scores.select(*id_cols, *[z[c].alias(f"z{c}") for c in model.classes])
    t = t.withColumn("_top", F.greatest(*[F.col(f"z{c}") for c in model.classes], F.lit(float("-inf"))))
    t = t.select(*id_cols, *[F.exp(F.col(f"z{c}") - F.col("_top")).alias(f"e{c}") for c in model.classes])
    total = sum((F.col(f"e{c}") for c in model.classes), F.lit(0.0))
    return t.select(*id_cols, *[(F.col(f"e{c}") / total).alias(f"p{c}") for c in model.classes])


def posteriors(counts: DataFrame, id_cols: list[str], model: Model) -> DataFrame:
    """``id_cols, p<class>...`` of ``counts(id_cols, term, tf)``: texts without a known word have no row."""
    small = model.n_terms * 8 * (len(model.classes) + 2) <= BROADCAST_BYTES
    j = counts.join(F.broadcast(model.terms) if small else model.terms, "term")
    z = j.groupBy(*id_cols).agg(*[F.sum(F.col("tf") * F.col(f"l{c}")).alias(f"z{c}") for c in model.classes])
    return _posterior(z, id_cols, model)


def _packed(corpus: DataFrame) -> DataFrame:
    """The cells in chunks of whole texts (see ``cells.packed``)."""
    return C.packed(corpus, "sid", "tf", "<i4", max(LEAST_CELLS, min(MOST_CELLS, corpus.count() // CHUNKS)))


def _counted(chunks: DataFrame, needs: DataFrame, terms: DataFrame, classes: list[int], prior: dict | None, small: bool) -> DataFrame:
    """``(term, n<class>...)``: the words by the texts' posteriors, and in the row without a term the texts. ``terms(term, l<class>...)`` are log
    probabilities; without ``prior`` they tell seeds: a text is shared out by its seed words, to class 0 where there is none. A chunk
    is met by those rows of ``terms`` that it needs, and gives back as many."""
    cols, log_share = [f"l{c}" for c in classes], None if prior is None else [prior[c] for c in classes]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["term", *[f"n{c}" for c in classes]]
        if not left.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.string())] + [pa.array([], pa.float64())] * len(classes), names)
        starts, at, tf = (np.frombuffer(left[c][0].as_buffer(), k) for c, k in (("starts", "<i8"), ("at", "<i4"), ("tf", "<i4")))
        terms, tf = left["terms"].combine_chunks().flatten(), tf.astype(float)
        scores, place = np.zeros((len(classes), len(terms))), right["at"].to_numpy()
        for k, c in enumerate(cols):
            scores[k, place] = right[c].to_numpy()
        z = np.stack([np.add.reduceat(s[at] * tf, starts) for s in scores], axis=1)
        if log_share is None:
            none = z.sum(axis=1) == 0
            z[none, 0] = 1.0
        else:
            z += log_share
            z = np.exp(z - z.max(axis=1, keepdims=True))
        z /= z.sum(axis=1, keepdims=True)
        text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(at))))
        if left["nameless"][0].as_py() >= 0:  # such a text counts, its words don't
            tf[text == left["nameless"][0].as_py()] = 0.0
        n = [pa.array(np.append(np.bincount(at, tf * z[text, k], len(terms)), z[:, k].sum())) for k in range(len(classes))]
        return pa.Table.from_arrays([pa.concat_arrays([terms, pa.nulls(1, terms.type)]), *n], names)

    met = needs.join(F.broadcast(terms) if small else terms, "term").select("of", "at", *cols)
    found = chunks.drop("ids").groupBy("chunk").cogroup(met.groupBy("of")).applyInArrow(run, "term string, " + ", ".join(f"n{c} double" for c in classes))
    return found.groupBy("term").agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in classes])


def learn(corpus: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> Model:
    """The model of ``corpus(sid, term, tf)`` and ``seeds(category_no, term)``; both are read several times, so give stored tables."""
    chunks = _packed(corpus)
    needs = C.needs(chunks, "bayes-needs")
    vocabulary = written(needs.select("term").distinct(), "bayes-terms")
    n_terms = vocabulary.count()
    seeds = seeds.filter(F.col("category_no").between(1, len(CATEGORIES)))
    seeds = written(seeds.select("category_no", "term").distinct().join(vocabulary, "term", "left_semi"), "bayes-seeds")
    # At most one row a category.
    held = {r["category_no"]: r["n"] for r in seeds.groupBy("category_no").agg(F.count("*").alias("n")).collect()}
    classes = [0, *sorted(held)]
    extra = seeds.groupBy("term").agg(*[F.max(F.when(F.col("category_no") == c, SEED_COUNT).otherwise(0.0)).alias(f"s{c}") for c in classes[1:]], F.lit(0.0).alias("s0"))
    small = n_terms * 8 * (len(classes) + 2) <= BROADCAST_BYTES
    terms = extra.select("term", *[(F.col(f"s{c}") / SEED_COUNT).alias(f"l{c}") for c in classes])
    log_share = None
    for _ in range(rounds):
        n = _counted(chunks, needs, terms, classes, log_share, small).join(extra, "term", "left")
        n = written(n.select("term", *[F.when(F.col("term").isNull(), F.col(f"n{c}")).otherwise(
            F.col(f"n{c}") + F.coalesce(f"s{c}", F.lit(0.0)) + SMOOTH).alias(f"n{c}") for c in classes]), "bayes-model")
        texts = n.filter("term is null").first()
        n = n.filter("term is not null")
        words = n.agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in classes]).first()
        sentences = {c: texts[f"n{c}"] if texts else 0.0 for c in classes}
        whole = sum(sentences.values()) + len(classes)
        log_share = {c: math.log((sentences[c] + 1) / whole) for c in classes}
        terms = n.select("term", *[(F.log(f"n{c}") - math.log(words[f"n{c}"] or 1.0)).alias(f"l{c}") for c in classes])
    chunks.unpersist()
    return Model(terms, n_terms, classes, log_share, sentences, held)


def shares(spark, model: Model) -> DataFrame:
    """``(category_no, seeds, sentences)``: seed words that occur, and sentences expected in the class."""
    return spark.createDataFrame([(c, model.seeds.get(c, 0), float(model.sentences[c])) for c in model.classes], "category_no int, seeds long, sentences double")


def classify(themes: DataFrame, model: Model, keys=KEYS) -> DataFrame:
    """``taxonomy.classify_theme`` by posterior, in its shape: the words of a theme's name and evidence decide."""
    text = F.concat_ws(" ", F.col("theme_name"), F.array_join(F.coalesce("representative_sentences", F.array().cast("array<string>")), " "))
    id_cols = [*keys, "theme_name"]
    counts = themes.select(*id_cols, F.explode(_words(text)).alias("term")).groupBy(*id_cols, "term").agg(F.count("*").alias("tf"))
    p = posteriors(counts, id_cols, model)
    order = [*model.classes[1:], 0]
    best = F.greatest(*[F.col(f"p{c}") for c in order], F.lit(0.0))
    choice = F.coalesce(*[F.when(F.col(f"p{c}") == best, F.lit(c)) for c in order])
    p = p.select(*[F.col(c).alias(f"_{c}") for c in id_cols], best.alias("_p"), choice.alias("_c"))
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in id_cols]
    names = F.array(*[F.lit(c) for c in CATEGORIES])
    novel = F.coalesce(F.col("_c"), F.lit(0)) == 0
    return themes.select(*id_cols).join(p, on, "left").select(
        *id_cols, F.when(novel, F.lit(NOVEL)).otherwise(F.get(names, F.col("_c") - 1)).alias("pajais_match"),
        F.when(novel, 0.0).otherwise(F.round("_p", 6)).alias("match_confidence"), novel.alias("is_novel"),
        F.when(F.col("_c").isNull(), "no known word").when(novel, "texts outside the categories are likelier")
         .otherwise("most probable category by its learnt words").alias("reasoning"))
