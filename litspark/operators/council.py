"""Topic labelling by a council of three label proposals and an arbiter.

The remote language models of the reference are not called. Proposals and
decisions arrive either as supplied model response text (parsed here with
the same tolerance as the reference) or from three offline labellers written
as Spark aggregates. Everything around them is relational: batching, prompt
text for offline batch inference, first/last-match lookups, fallbacks,
merging, win counts and the label quality gate. All tables are keyed by
(corpus_id, run_key) and hold at most a few rows per topic."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.formats import (DEFAULT_TOPIC_LABEL, EVIDENCE_LINE, PROPOSAL_BLOCK_HEAD, PROPOSAL_LINE,
                                 TOPIC_BLOCK_HEAD, fmt)
from ..functions.text import py_strip
from ..session import KEYS, ship_package
from .blocks import written
from .cells import CHUNK_WORDS, runs
from .embed import TOKEN_SPLIT

# ---------------------------------------------------------------------------
# Fixed values from the reference.
NEAREST_K = 3
LABEL_BATCH_SIZE = 15
LABEL_BATCH_SIZE_SMALL = 10      # for a voice whose name contains "qwen"
ARBITER_BATCH_SIZE = 10
TAXONOMY_BATCH_SIZE = 20
COUNCIL_MODELS = ["llama-3.3-70b-versatile", "llama-3.1-8b-instant", "qwen/qwen3-32b"]
PROPOSAL_FALLBACK = {"label": "Unlabeled", "reasoning": "Fallback configuration assignment",
                     "confidence": 0.5}
COUNCIL_FALLBACK = {"confidence": 0.5, "reasoning": "Council fallback mapping active",
                    "winning_model": 0}     # label: "Topic <id>"
UNLABELLED_PREFIX = "Topic "
UNLABELLED_WARN_SHARE = 0.15
# ---------------------------------------------------------------------------

PROPOSAL_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("category", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("niche", T.BooleanType()),
])
DECISION_SCHEMA = T.StructType([
    T.StructField("cluster_id", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("winning_model", T.IntegerType()),
])


def model_rows(names=COUNCIL_MODELS) -> list[tuple[int, str, int]]:
    """(model_idx 0.., model_name, batch_size): the smaller batch for a voice
    whose name contains "qwen"."""
    return [(i, n, LABEL_BATCH_SIZE_SMALL if "qwen" in n.lower() else LABEL_BATCH_SIZE)
            for i, n in enumerate(names)]


def models(spark, names=COUNCIL_MODELS) -> DataFrame:
    return spark.createDataFrame(model_rows(names), "model_idx int, model_name string, batch_size int")


# -- prompt preparation ------------------------------------------------------

def topic_block(topics: DataFrame) -> DataFrame:
    """``TOPIC id (size=, papers=):`` then one ``  - sentence`` line per
    evidence sentence (at most 3)."""
    lines = F.array_join(F.transform(F.slice("top_sentences", 1, NEAREST_K),
                                     lambda s: fmt(EVIDENCE_LINE, sentence=s)), "\n")
    head = fmt(TOPIC_BLOCK_HEAD, id=F.col("cluster_id"), size=F.col("size"), papers=F.col("paper_count"))
    return topics.withColumn("block", F.when(F.size(F.slice("top_sentences", 1, NEAREST_K)) > 0,
                                             F.concat(head, F.lit("\n"), lines)).otherwise(head))


def batch_rows(df: DataFrame, size, order_col: str = "topic_rank") -> DataFrame:
    """batch = floor((rank - 1) / size) for a 1-based rank column; ``size``
    may be a number or a column (per-model batch sizes)."""
    sz = F.lit(size) if isinstance(size, int) else F.col(size) if isinstance(size, str) else size
    return df.withColumn("batch", F.floor((F.col(order_col) - 1) / sz).cast("int"))


def batch_prompt(blocks: DataFrame, template: str, group=KEYS, order_col: str = "topic_rank",
                 text_col: str = "block", placeholder: str = "{topics_text}") -> DataFrame:
    """One prompt per (group, batch): the blocks in order joined by a blank
    line and put into ``template``."""
    g = blocks.groupBy(*group, "batch").agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(text_col).alias("t")))).alias("_b"))
    text = F.array_join(F.transform("_b", lambda x: x["t"]), "\n\n")
    return g.select(*group, "batch", F.replace(F.lit(template), F.lit(placeholder), text).alias("prompt"))


# -- response parsing ----------------------------------------------------------

def clean_response(c) -> F.Column:
    """Strip ``<think>..</think>`` blocks and code fences, then keep the text
    from the first ``[`` to the last ``]`` if there is one."""
    col = F.col(c) if isinstance(c, str) else c
    t = py_strip(F.regexp_replace(col, r"(?s)<think>.*?</think>", ""))
    t = py_strip(F.regexp_replace(t, r"(?U)```(?:json)?\s*", ""))
    t = py_strip(F.regexp_replace(t, r"`+$", ""))
    arr = F.regexp_extract(t, r"(?s)\[.*\]", 0)
    return F.when(arr != "", arr).otherwise(t)


def _typed(item, schema: T.StructType):
    """The fields of a parsed object, each cast on its own: a value that isn't of its field's
    type leaves that field NULL and the others as they are (numbers may come as text, integers as 2.0)."""
    def cast(f: T.StructField):
        c = item[f.name]
        if isinstance(f.dataType, T.StringType):
            return c.alias(f.name)
        if isinstance(f.dataType, T.IntegerType):
            d = c.try_cast("double")
            return F.when(d == F.floor(d), d.try_cast("int")).alias(f.name)
        return c.try_cast(f.dataType).alias(f.name)

    return F.struct(*[cast(f) for f in schema.fields])


def parse_json_array(df: DataFrame, text_col: str, schema: T.StructType) -> DataFrame:
    """Adds ``items ARRAY<schema>``: NULL when the text is not a JSON array
    (an object, truncated JSON, prose) -- such a batch yields no rows, the
    others proceed. The array is read as text elements first and each
    element by itself, so one that is no object is a NULL item and costs no other."""
    cand = clean_response(text_col)
    elements = F.when(cand.startswith("["), F.from_json(cand, T.ArrayType(T.StringType())))
    as_text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    items = F.transform(elements, lambda e: F.when(e.startswith("{"), _typed(F.from_json(e, as_text), schema)))
    return df.withColumn("items", items)


def explode_items(parsed: DataFrame, keep) -> DataFrame:
    """One row per parsed item with its position in the batch."""
    return parsed.select(*keep, F.posexplode("items").alias("item_pos", "item")).filter(
        F.col("item").isNotNull()).select(*keep, "item_pos", "item.*")


def isolate_failures(parsed: DataFrame, keep) -> DataFrame:
    """Error table: one row per batch whose response could not be parsed."""
    return parsed.filter(F.col("items").isNull()).select(*keep, F.lit("unparseable response").alias("error"))


# -- proposals -----------------------------------------------------------------

def proposals_from_responses(responses: DataFrame, keys=KEYS) -> DataFrame:
    """responses(keys, model_idx, batch, response) -> proposal items in
    response order: (keys, model_idx, batch, item_pos, cluster_id STRING, ...)."""
    p = parse_json_array(responses, "response", PROPOSAL_SCHEMA)
    return explode_items(p, [*keys, "model_idx", "batch"])


def proposal_lookup(ranked: DataFrame, proposals: DataFrame, n_models: int = len(COUNCIL_MODELS),
                    keys=KEYS) -> DataFrame:
    """Per (topic, model): the FIRST item whose id equals the topic id as a
    string, else the fallback proposal. Each topic row is repeated once per
    voice (a fixed fan-out of ``n_models``), then left-joined."""
    first = Window.partitionBy(*keys, "model_idx", "cluster_id").orderBy("batch", "item_pos")
    p = (proposals.filter(F.col("cluster_id").isNotNull())
         .withColumn("_r", F.row_number().over(first)).filter(F.col("_r") == 1)
         .select(*keys, "model_idx", F.col("cluster_id").alias("_cid"),
                 F.col("label").alias("_label"), F.col("confidence").alias("_conf"),
                 F.col("reasoning").alias("_reason"), F.lit(True).alias("_found")))
    tm = ranked.select(*keys, "cluster_id", "size", "topic_rank",
                       F.explode(F.array(*[F.lit(i) for i in range(n_models)])).alias("model_idx"))
    tm = tm.withColumn("_cid", F.col("cluster_id").cast("string"))
    j = tm.join(p, [*keys, "model_idx", "_cid"], "left")
    found = F.col("_found").isNotNull()
    return j.select(
        *keys, "cluster_id", "size", "topic_rank", "model_idx",
        F.when(found, F.col("_label")).otherwise(F.lit(PROPOSAL_FALLBACK["label"])).alias("label"),
        F.when(found, F.col("_conf")).otherwise(F.lit(PROPOSAL_FALLBACK["confidence"])).alias("confidence"),
        F.when(found, F.col("_reason")).otherwise(F.lit(PROPOSAL_FALLBACK["reasoning"])).alias("reasoning"),
    )


def collect_proposals(looked_up: DataFrame, keys=KEYS) -> DataFrame:
    """Per topic: ``proposals`` array in model order (3 entries)."""
    return looked_up.groupBy(*keys, "cluster_id", "size", "topic_rank").agg(
        F.array_sort(F.collect_list(F.struct("model_idx", "label", "confidence", "reasoning"))).alias("proposals"))


def proposal_block(collected: DataFrame) -> DataFrame:
    """``TOPIC id (size=):`` then ``  Model k: label | reasoning`` lines."""
    lines = F.array_join(F.transform("proposals", lambda p: fmt(
        PROPOSAL_LINE, k=p["model_idx"] + 1, label=F.coalesce(p["label"], F.lit("?")),
        reasoning=F.coalesce(p["reasoning"], F.lit("")))), "\n")
    head = fmt(PROPOSAL_BLOCK_HEAD, id=F.col("cluster_id"), size=F.col("size"))
    return collected.withColumn("block", F.concat(head, F.lit("\n"), lines))


def arbitrate(looked_up: DataFrame, keys=KEYS) -> DataFrame:
    """Offline arbiter: majority on the normalised label, then the highest
    confidence, then the lowest model index; fallback proposals never win. When several
    voices spoke and no two agree, ``winning_model`` is 0. ``reliability.arbitrate_learnt`` weighs the voices instead.
    Output has the decision shape (cluster_id STRING, label, confidence,
    reasoning, winning_model 0..3) plus ``item_pos`` for last-wins lookup."""
    p = looked_up.filter(F.col("label") != PROPOSAL_FALLBACK["label"]).withColumn(
        "_norm", F.lower(py_strip("label")))
    votes = Window.partitionBy(*keys, "cluster_id", "_norm")
    p = p.withColumns({"_votes": F.count(F.lit(1)).over(votes), "_spoke": F.count(F.lit(1)).over(Window.partitionBy(*keys, "cluster_id"))})
    best = Window.partitionBy(*keys, "cluster_id").orderBy(
        F.col("_votes").desc(), F.col("confidence").desc_nulls_last(), F.col("model_idx"))
    p = p.withColumn("_r", F.row_number().over(best)).filter(F.col("_r") == 1)
    return p.select(
        *keys, F.col("cluster_id").cast("string").alias("cluster_id"), "label", "confidence",
        F.concat(F.lit("chosen by "), F.col("_votes"), F.lit(" of 3 voices")).alias("reasoning"),
        F.when((F.col("_votes") == 1) & (F.col("_spoke") > 1), 0).otherwise(F.col("model_idx") + 1).cast("int").alias("winning_model"),
        F.col("topic_rank").alias("item_pos"))


def decisions_from_responses(responses: DataFrame, keys=KEYS) -> DataFrame:
    p = parse_json_array(responses, "response", DECISION_SCHEMA)
    return explode_items(p, [*keys, "batch"])


def council_lookup(decisions: DataFrame, keys=KEYS) -> DataFrame:
    """Valid decisions (with an id); the LAST one wins per id."""
    order = [c for c in ("batch", "item_pos") if c in decisions.columns]
    w = Window.partitionBy(*keys, "cluster_id").orderBy(*[F.col(c).desc() for c in order])
    return (decisions.filter(F.col("cluster_id").isNotNull())
            .withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1).drop("_r"))


def merge_council(topics: DataFrame, decisions: DataFrame, collected: DataFrame | None = None,
                  keys=KEYS) -> DataFrame:
    """All topics left join the decisions (by id as a string); decision
    fields override, defaults otherwise; ``council_proposals`` = the proposal
    labels in model order (empty when the topic had none). The integer
    cluster_id of the topic is kept."""
    d = council_lookup(decisions, keys).select(
        *keys, F.col("cluster_id").alias("_cid"), F.col("label").alias("_label"),
        F.col("confidence").alias("_conf"), F.col("reasoning").alias("_reason"),
        F.col("winning_model").alias("_win"), F.lit(True).alias("_found"))
    j = topics.withColumn("_cid", F.col("cluster_id").cast("string")).join(d, [*keys, "_cid"], "left")
    found = F.col("_found").isNotNull()
    out = j.select(
        *[c for c in topics.columns if c != "label"],
        F.when(found, F.coalesce("_label", "label"))
         .otherwise(fmt(DEFAULT_TOPIC_LABEL, id=F.col("cluster_id"))).alias("label"),
        F.when(found, F.col("_conf")).otherwise(F.lit(COUNCIL_FALLBACK["confidence"])).alias("confidence"),
        F.when(found, F.col("_reason")).otherwise(F.lit(COUNCIL_FALLBACK["reasoning"])).alias("reasoning"),
        F.when(found, F.col("_win")).otherwise(F.lit(COUNCIL_FALLBACK["winning_model"])).cast("int").alias("winning_model"),
    )
    if collected is None:
        return out.withColumn("council_proposals", F.array().cast("array<string>"))
    props = collected.select(*keys, "cluster_id",
                             F.transform("proposals", lambda p: p["label"]).alias("council_proposals"))
    return (out.join(props, [*keys, "cluster_id"], "left")
            .withColumn("council_proposals",
                        F.coalesce("council_proposals", F.array().cast("array<string>"))))


def model_wins(decisions: DataFrame, ranked: DataFrame, keys=KEYS) -> DataFrame:
    """Wins per voice (1..3), synthesised (0) and decisions / topics."""
    valid = decisions.filter(F.col("cluster_id").isNotNull())
    w = valid.groupBy(*keys).agg(
        *[F.sum((F.col("winning_model") == m).cast("int")).alias(f"wins_model_{m}") for m in (1, 2, 3)],
        F.sum((F.col("winning_model") == 0).cast("int")).alias("synthesised"),
        F.count(F.lit(1)).alias("decisions"))
    t = ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("topics"))
    cols = ["wins_model_1", "wins_model_2", "wins_model_3", "synthesised", "decisions"]
    return t.join(w, list(keys), "left").select(
        *keys, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in cols], F.col("topics").cast("bigint"))


def label_quality(labels: DataFrame, warn_share: float = UNLABELLED_WARN_SHARE, keys=KEYS) -> DataFrame:
    """Labelled = non-blank and not starting ``Topic ``. FAIL when nothing is
    labelled, WARN when more than ``warn_share`` are not, else OK."""
    lab = F.coalesce(py_strip("label"), F.lit(""))
    ok = (lab != "") & ~lab.startswith(UNLABELLED_PREFIX)
    g = labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("topics"),
                                  F.sum(ok.cast("int")).alias("labelled"))
    share = (F.col("topics") - F.col("labelled")) / F.col("topics")
    return g.select(
        *keys, F.col("topics").cast("bigint"), F.col("labelled").cast("bigint"),
        (F.col("topics") - F.col("labelled")).cast("bigint").alias("unlabelled"),
        F.round(share, 6).alias("fallback_share"),
        F.when((F.col("topics") == 0) | (F.col("labelled") == 0), "FAIL")
         .when(share > warn_share, "WARN").otherwise("OK").alias("status"))


# -- offline labellers (the three voices, as Spark aggregates) ---------------

#: Function words that end a key phrase (they are never dropped: a phrase of them ranks last).
STOP_WORDS = [
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "for", "from", "had", "has", "have", "he", "her", "his",
    "i", "if", "in", "into", "is", "it", "its", "may", "more", "no", "not", "of", "on", "or", "our", "she", "so", "such", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "which", "who",
    "will", "with", "you",
]


def _words(df: DataFrame, col: str = "sentence"):
    return F.filter(F.split(F.lower(F.col(col)), TOKEN_SPLIT), lambda w: w != "")


def gram_counts(members: DataFrame, keys=KEYS) -> DataFrame:
    """``(keys, cluster_id, gram, two, n, n_all)``, written: the words and (``two``) bigrams of each cluster, counted in it and in all clusters of the key. One
    pass over the texts, counted in runs of them; what is left is dealt by a hash of key and gram, so both counts are made in the same place."""
    ship_package(members.sparkSession)
    topic = [*keys, "cluster_id"]
    valid = members.filter(F.col("cluster_id") != -1)
    schema = T.StructType([*[members.schema[c] for c in topic], T.StructField("gram", T.StringType()), T.StructField("two", T.BooleanType()), T.StructField("n", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, topic[0], lambda b: len(b["t"].flatten()), CHUNK_WORDS, False):
            at = np.zeros(t.num_rows, np.int64)
            for c in topic:
                code = t[c].combine_chunks().dictionary_encode(null_encoding="encode")
                at = at * len(code.dictionary) + code.indices.to_numpy()
            first, at = np.unique(at, return_index=True, return_inverse=True)[1:]
            held = t["t"].combine_chunks()
            word, row = held.flatten().dictionary_encode(), np.repeat(np.arange(t.num_rows), held.value_lengths().fill_null(0).to_numpy())
            size, one = max(1, len(word.dictionary)), at[row] * max(1, len(word.dictionary)) + word.indices.to_numpy()
            side = row[:-1] == row[1:]
            for two, cell in ((False, one), (True, one[:-1][side] * size + word.indices.to_numpy()[1:][side])):
                cell, n = np.unique(cell, return_counts=True)
                gram = word.dictionary.take(pa.array(cell % size))
                if two:
                    cell = cell // size
                    gram = pc.binary_join_element_wise(word.dictionary.take(pa.array(cell % size)), gram, " ")
                of = pa.array(first[cell // size])
                out = pa.Table.from_arrays([*[t[c].combine_chunks().take(of) for c in topic], gram, pa.array(np.full(len(n), two)), pa.array(n.astype(np.int64))], names=schema.names)
                yield from out.to_batches(max_chunksize=1 << 16)

    at = valid.select(*topic, _words(valid).alias("t")).mapInArrow(count, schema).withColumn("_h", F.xxhash64(*keys, "gram", "two")).repartition("_h")
    n = at.groupBy("_h", *topic, "gram", "two").agg(F.sum("n").alias("n"))
    every = F.sum("n").over(Window.partitionBy("_h", *keys, "gram", "two"))
    return written(n.withColumn("n_all", every).drop("_h"), "gram-counts")


def ctfidf_labeller(members: DataFrame, top: int = 3, keys=KEYS, counts: DataFrame | None = None) -> DataFrame:
    """Voice 1: top c-TF-IDF terms per cluster (Grootendorst 2022):
    w(t,c) = tf(t,c) * log(1 + A / tf(t)), A = mean words per cluster. ``counts`` are ``gram_counts`` that are
    stored already. The ranking keeps its first rows before the shuffle as well as after."""
    counts = gram_counts(members, keys) if counts is None else counts
    tc = counts.filter("not two").select(*keys, "cluster_id", F.col("gram").alias("term"), F.col("n").alias("tf"), F.col("n_all").alias("tf_all"))
    per = tc.groupBy(*keys, "cluster_id").agg(F.sum("tf").alias("words"))
    avg = per.groupBy(*keys).agg(F.avg("words").alias("A"))
    s = (tc.join(avg, list(keys))
         .withColumn("score", F.col("tf") * F.log(1 + F.col("A") / F.col("tf_all"))))
    total = s.groupBy(*keys, "cluster_id").agg(F.sum("score").alias("_all"))
    w = Window.partitionBy(*keys, "cluster_id").orderBy(F.round("score", 9).desc(), "term")
    s = s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= top).join(total, [*keys, "cluster_id"])
    return s.groupBy(*keys, "cluster_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]), " ").alias("label"),
        F.round(F.sum("score") / F.max("_all"), 3).alias("confidence"),
    ).select(*keys, F.lit(0).alias("model_idx"), "cluster_id", "label", F.lit("c-TF-IDF").alias("category"),
             "confidence", F.lit("top class-based TF-IDF terms").alias("reasoning"), F.lit(False).alias("niche"))


def bigram_labeller(members: DataFrame, min_count: int = 2, keys=KEYS, counts: DataFrame | None = None) -> DataFrame:
    """Voice 2: the bigram most specific to the cluster (those seen ``min_count`` times first;
    then count in cluster / count in corpus; then count; then text). Single words rank
    after all bigrams, so every cluster with a word gets a label. Only a cluster's first kind (bigrams before
    words, frequent before rare) can win, so only its rows are ranked."""
    counts = gram_counts(members, keys) if counts is None else counts
    kinds = counts.withColumn("_kind", 2 * F.col("two").cast("int") + (F.col("n") >= min_count).cast("int"))
    first = written(kinds.groupBy(*keys, "cluster_id").agg(F.max("_kind").alias("_kind")), "gram-kinds")
    bc = kinds.join(first, [*keys, "cluster_id", "_kind"]).select(*keys, "cluster_id", F.col("gram").alias("bigram"), "two", "n", "n_all")
    s = bc.withColumn("rel", F.col("n") / F.col("n_all"))
    w = Window.partitionBy(*keys, "cluster_id").orderBy(F.col("rel").desc(), F.col("n").desc(), "bigram")
    s = s.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return s.select(*keys, F.lit(1).alias("model_idx"), "cluster_id", F.col("bigram").alias("label"),
                    F.lit("bigram").alias("category"), F.round("rel", 3).alias("confidence"),
                    F.lit("most specific bigram").alias("reasoning"), F.lit(False).alias("niche"))


def phrase_labeller(evidence: DataFrame, keys=KEYS) -> DataFrame:
    """Voice 3: RAKE-style key phrase of the evidence sentences. Runs of function words and runs
    of other words alternate; a phrase's score = sum of degree/frequency of its words
    over the cluster's evidence, and phrases of function words rank last."""
    toks = evidence.select(*keys, "cluster_id", "rank", F.posexplode(_words(evidence)).alias("pos", "w"))
    sw = Window.partitionBy(*keys, "cluster_id", "rank").orderBy("pos")   # one evidence sentence
    toks = toks.withColumn("stop", F.col("w").isin(STOP_WORDS))
    toks = toks.withColumn("_new", (~F.col("stop").eqNullSafe(F.lag("stop").over(sw))).cast("int"))
    toks = toks.withColumn("_run", F.sum("_new").over(sw))
    ph = toks.groupBy(*keys, "cluster_id", "rank", "_run").agg(
        F.array_sort(F.collect_list(F.struct("pos", "w"))).alias("_p"), F.first("stop").alias("stop"))
    ph = ph.withColumn("words", F.transform("_p", lambda x: x["w"])).withColumn("plen", F.size("words"))
    pw = ph.select(*keys, "cluster_id", "rank", "_run", "plen", F.explode("words").alias("w"))
    ws = pw.groupBy(*keys, "cluster_id", "w").agg(F.count(F.lit(1)).alias("freq"), F.sum("plen").alias("deg"))
    sc = (pw.join(ws, [*keys, "cluster_id", "w"])
          .groupBy(*keys, "cluster_id", "rank", "_run").agg(F.round(F.sum(F.col("deg") / F.col("freq")), 9).alias("score")))
    ph = ph.join(sc, [*keys, "cluster_id", "rank", "_run"]).withColumn("phrase", F.array_join("words", " "))
    w = Window.partitionBy(*keys, "cluster_id").orderBy("stop", F.col("score").desc(), "rank", "_run")
    tot = Window.partitionBy(*keys, "cluster_id")   # phrases of at most three evidence sentences
    ph = ph.withColumn("_all", F.sum("score").over(tot)).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == 1)
    return ph.select(*keys, F.lit(2).alias("model_idx"), "cluster_id", F.col("phrase").alias("label"),
                     F.lit("key phrase").alias("category"), F.round(F.col("score") / F.col("_all"), 3).alias("confidence"),
                     F.lit("highest scoring evidence phrase").alias("reasoning"), F.lit(False).alias("niche"))


def offline_proposals(members: DataFrame, evidence: DataFrame, ranked: DataFrame, keys=KEYS) -> DataFrame:
    """The three offline voices for the ranked (capped) topics, in the
    proposal-item shape with batch/item_pos from the topic rank."""
    counts = gram_counts(members, keys)
    allp = (ctfidf_labeller(members, keys=keys, counts=counts)
            .unionByName(bigram_labeller(members, keys=keys, counts=counts))
            .unionByName(phrase_labeller(evidence, keys=keys)))
    r = ranked.select(*keys, "cluster_id", "topic_rank")
    return allp.join(r, [*keys, "cluster_id"]).select(
        *keys, "model_idx", F.lit(0).alias("batch"), F.col("topic_rank").alias("item_pos"),
        F.col("cluster_id").cast("string").alias("cluster_id"), "label", "category",
        F.col("confidence").cast("double"), "reasoning", "niche")
