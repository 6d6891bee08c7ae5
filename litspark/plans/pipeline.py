"""End-to-end composition, per run key and for many corpora at once:

papers -> run text -> sentences -> vectors -> reduced vectors -> Ward
  -> size filter -> topics (+ long topic-paper table, evidence)
  -> three voices + arbiter -> labels -> review -> themes -> taxonomy
  -> abstract-vs-title comparison

Each stage is a lazy DataFrame function; ``Pipeline`` materialises the stage
tables (sentences, embeddings, assignments, topics, labels, themes, taxonomy)
through a ``StageStore`` so a re-run starts from what exists."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean, cluster, compare, council, embed, review, taxonomy, text, themes, topics
from ..session import KEYS
from ..sources.papers import read_papers
from ..sources.store import StageStore, row_digests

# The Ward cut of the reference (1.5) is for its 10-d UMAP space. In the
# hashed TF-IDF + PCA space it is a parameter to tune per corpus; this default
# separates topics of template-like abstracts (see tests/test_end_to_end.py).
DEFAULT_THRESHOLD = cluster.DISTANCE_THRESHOLD
#: Stages made from a pair's assignments.
MADE = ("topics", "topic_papers", "labels", "themes", "theme_map", "taxonomy")


def sentences(papers: DataFrame, run_key: str) -> DataFrame:
    return text.sentence_table(text.run_text(papers, run_key))


def vectors_and_reduced(sent: DataFrame, embedder=None, k: int = embed.REDUCED_DIM):
    """sentences -> (vectors with sentence text, reduced points c0..c{k-1})."""
    vec = embed.embed(sent, "sentence", embedder).select(*KEYS, "sentence_id", "paper_id", "sentence", "embedding")
    vec = vec.checkpoint()
    red = embed.reduce_dims(vec.select(*KEYS, "sentence_id", "embedding"), k)
    return vec, red.select(*KEYS, "sentence_id", *[f"c{i}" for i in range(k)])


def discover(sent: DataFrame, threshold: float = DEFAULT_THRESHOLD, embedder=None,
             k: int = embed.REDUCED_DIM, min_size: int = topics.MIN_CLUSTER_SIZE,
             micro_cell: float | None = None, precomputed=None, assign: DataFrame | None = None):
    """sentences -> (vectors, members, topics, topic_papers, evidence, ranked).
    ``precomputed`` = (vectors, reduced points) reuses stored stages; ``assign`` given clusters."""
    vec, pts = precomputed if precomputed is not None else vectors_and_reduced(sent, embedder, k)
    if assign is None:
        assign = cluster.ward(pts, k, threshold, micro_cell=micro_cell)
    # Vectors are joined to their clusters once and materialised; centroids
    # and evidence read them without another shuffle of the wide vectors.
    with_vec = vec.join(assign, [*KEYS, "sentence_id"])
    with_vec = topics.drop_small(with_vec, min_size).checkpoint()
    members = with_vec.drop("embedding")
    valid = with_vec.filter(F.col("cluster_id") != topics.NOISE)
    cents = topics.centroids(valid, None).checkpoint()
    ev = topics.top_evidence(valid, None, cents).checkpoint()
    p = topics.topic_papers(members)
    t = topics.assemble_topics(members.filter(F.col("cluster_id") != topics.NOISE), cents, ev, p).checkpoint()
    ranked = topics.topics_ranked(t).checkpoint()
    return vec, members, t, p, ev, ranked


def label(members: DataFrame, evidence: DataFrame, ranked: DataFrame,
          proposal_responses: DataFrame | None = None, arbiter_responses: DataFrame | None = None) -> DataFrame:
    """Council labels. Proposals come from supplied responses (keys,
    model_idx, batch, response) or the offline voices; decisions from
    supplied arbiter responses (keys, batch, response) or the offline rule."""
    if proposal_responses is not None:
        props = council.proposals_from_responses(proposal_responses)
    else:
        props = council.offline_proposals(members, evidence, ranked)
    looked = council.proposal_lookup(ranked, props)
    collected = council.collect_proposals(looked)
    if arbiter_responses is not None:
        dec = council.decisions_from_responses(arbiter_responses)
    else:
        dec = council.arbitrate(looked)
    return council.merge_council(ranked, dec, collected)


def consolidate(labels: DataFrame, topic_papers: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """Review table (optionally with reviewer decisions: keys, cluster_id,
    approve, rename_to) -> theme map -> ranked themes."""
    rv = review.review_labels(labels)
    if decisions is not None:
        rv = rv.drop("approve", "rename_to").join(
            decisions.select(*KEYS, "cluster_id", "approve", "rename_to"), [*KEYS, "cluster_id"], "left")
    tmap = review.theme_map(rv)
    return themes.themes_ranked(themes.consolidate(tmap, labels, topic_papers)), tmap


def map_taxonomy(th: DataFrame, responses: DataFrame | None = None, embedder=None,
                 threshold: float = 0.1) -> DataFrame:
    if responses is not None:
        mapped = taxonomy.taxonomy_from_responses(responses)
    else:
        mapped = taxonomy.classify_theme(th, embedder or embed.hashed_tf, threshold)
    return taxonomy.merge_taxonomy(th, mapped)


def compare_runs(th: DataFrame, tmap: DataFrame | None = None, labels: DataFrame | None = None, embedder=None) -> DataFrame:
    """Themes compared by their embedded names; with a theme map and labels, by the
    mean of their topics' centroids."""
    v = compare.theme_vectors_from_names(th, embedder) if tmap is None else compare.theme_vectors_from_centroids(th, tmap, labels)
    return compare.comparison(v.filter(F.col("run_key") == "abstract").drop("run_key"),
                              v.filter(F.col("run_key") == "title").drop("run_key"))


@dataclass
class Pipeline:
    """Stage-stored run over a paper table (corpus_id, paper_id, title,
    abstract, ...): every stage is kept under ``root`` partitioned by
    (corpus_id, run_key) and read back by later stages. A (corpus, run) is built
    once: a call builds those that it asks for and the store lacks, and leaves the others'
    partitions as they are. IDF and PCA are fitted over what a call builds together; stored
    vectors are never fitted again, so a corpus added later changes no other.

    What a pair was made from is kept as an order-free digest of its texts and the embedder; a pair whose papers
    changed is built again with everything after it, the others aren't. Ward's merges are kept up to ``tree_height`` (the
    threshold, if higher), so any lower threshold is a cut of the stored tree."""
    spark: SparkSession
    root: str
    threshold: float = DEFAULT_THRESHOLD
    embedder: object = None
    tree_height: float = 0.0
    store: StageStore = field(init=False)

    def __post_init__(self):
        self.store = StageStore(self.spark, self.root)

    def _keys(self, stage: str) -> DataFrame:
        return self.store.read(stage).select(*KEYS).distinct()

    def load_export(self, path: str, corpus_id: str, current_year: int, strict: bool = False) -> DataFrame:
        """A raw bibliographic export -> cleaned papers, stored as one corpus."""
        raw = read_papers(self.spark, path, strict, corpus_id)
        papers = clean.papers_view(clean.clean_papers(raw, current_year))
        self.store.write("papers", papers, partition_by=("corpus_id",))
        return self.store.read("papers").filter(F.col("corpus_id") == corpus_id)

    def run_export(self, path: str, corpus_id: str, current_year: int, run_keys=("abstract", "title")) -> tuple[DataFrame, DataFrame]:
        """Raw export -> clean -> statistics and labelled topics, in one call."""
        papers = self.load_export(path, corpus_id, current_year)
        return text.corpus_stats(papers), self.discover_and_label(papers, run_keys).filter(F.col("corpus_id") == corpus_id)

    def discover_and_label(self, papers: DataFrame | None, run_keys=("abstract",)) -> DataFrame:
        """Labels of the asked (corpus, run) pairs; without papers, of all whose vectors are stored."""
        if papers is None:
            wanted = self._keys("embeddings")
        else:
            wanted = papers.select("corpus_id").distinct().select(
                "corpus_id", F.explode(F.array(*map(F.lit, run_keys))).alias("run_key"))
        wanted = wanted.checkpoint()
        if papers is not None:
            made = self._digests(papers, wanted, run_keys).checkpoint()
            if self.store.exists("digests"):
                # Pairs that changed, and those stored without a digest, go with all that was made of them.
                old = self._keys("embeddings").join(made, list(KEYS), "left_semi").join(
                    self.store.read("digests").join(made, [*KEYS, "digest"], "left_semi"), list(KEYS), "left_anti").checkpoint()
                for st in ("digests", "assignments", *MADE, "merges", "unit_map", "reduced", "embeddings", "sentences"):
                    self.store.remove(st, old)
                self.store.remove("comparison", old, ("corpus_id",))
        todo = wanted
        if self.store.exists("assignments"):
            todo = wanted.join(self._keys("assignments"), list(KEYS), "left_anti")
        todo = todo.checkpoint()
        if not todo.isEmpty():
            self._build(papers, todo, run_keys)
            if papers is not None:
                self.store.write("digests", made.join(todo, list(KEYS), "left_semi"))
        return self.store.read("labels").join(wanted, list(KEYS), "left_semi")

    def _digests(self, papers: DataFrame, wanted: DataFrame, run_keys) -> DataFrame:
        """What each wanted (corpus, run) is made from; a pair without papers has none."""
        texts = text.run_texts(papers, run_keys).join(wanted, list(KEYS), "left_semi")
        name = getattr(self.embedder, "__qualname__", None) or (type(self.embedder).__qualname__ if self.embedder else "default")
        return row_digests(texts, KEYS, f"{name} {embed.REDUCED_DIM} {text.MIN_SENTENCE_CHARS}")

    def _assigned(self, points: DataFrame, todo: DataFrame) -> DataFrame:
        """Clusters at the threshold, cut from the stored tree where it is high enough, else from one built now."""
        have = None
        if self.store.exists("unit_map"):
            high = self.store.read("unit_map").filter(F.col("built_to") >= self.threshold)
            have = high.select(*KEYS).distinct().join(todo, list(KEYS), "left_semi")
        new = todo if have is None else todo.join(have, list(KEYS), "left_anti")
        new = new.checkpoint()
        if not new.isEmpty():
            height = max(self.threshold, self.tree_height)
            umap, merges = cluster.merge_tree(points.join(new, list(KEYS), "left_semi"), embed.REDUCED_DIM, height)
            for st in ("merges", "unit_map"):
                self.store.remove(st, new)
            self.store.write("merges", merges)
            self.store.write("unit_map", umap.withColumn("built_to", F.lit(float(height))))
        tree = [self.store.read(st).join(todo, list(KEYS), "left_semi") for st in ("unit_map", "merges")]
        return cluster.cut_tree(*tree, self.threshold)

    def _build(self, papers: DataFrame | None, todo: DataFrame, run_keys) -> None:
        new = todo
        if self.store.exists("embeddings"):
            # Re-clustering (another threshold) reuses the stored vectors and the reduced points.
            new = todo.join(self._keys("embeddings"), list(KEYS), "left_anti")
        if papers is not None and not new.isEmpty():
            sent = None
            for rk in run_keys:
                mine = new.filter(F.col("run_key") == rk).select("corpus_id")
                s = sentences(papers.join(mine, "corpus_id", "left_semi"), rk)
                sent = s if sent is None else sent.unionByName(s)
            self.store.write("sentences", sent)
            sent = self.store.read("sentences").join(new, list(KEYS), "left_semi")
            vec, red = vectors_and_reduced(sent, self.embedder)
            self.store.write("embeddings", vec)
            self.store.write("reduced", red)
        mine = [self.store.read(s).join(todo, list(KEYS), "left_semi") for s in ("sentences", "embeddings", "reduced")]
        vec, members, t, p, ev, ranked = discover(mine[0], self.threshold, self.embedder, precomputed=(mine[1], mine[2]),
                                                  assign=self._assigned(mine[2], todo))
        self.store.write("topic_papers", p)
        self.store.write("topics", ranked)
        self.store.write("labels", label(members, ev, ranked))
        # Last: a pair with assignments is done, also one without a topic.
        self.store.write("assignments", members.select(*KEYS, "sentence_id", "paper_id", "cluster_id"))

    def recluster(self, threshold: float) -> DataFrame:
        """A new cut: assignments and everything after them are made again from the stored merges (built anew only if the
        threshold is above what they were built to); vectors and reduced points stay."""
        self.threshold = threshold
        for st in ("assignments", *MADE, "comparison"):
            self.store.clear(st)
        return self.discover_and_label(None)

    def themes(self, decisions: DataFrame | None = None) -> DataFrame:
        th, tmap = consolidate(self.store.read("labels"), self.store.read("topic_papers"), decisions)
        self.store.write("theme_map", tmap)
        self.store.write("themes", th)
        return self.store.read("themes")

    def compare(self) -> DataFrame:
        """Abstract-run versus title-run themes per corpus (needs both runs)."""
        comp = compare_runs(self.store.read("themes"), embedder=self.embedder)
        self.store.write("comparison", comp, partition_by=("corpus_id",))
        return self.store.read("comparison")

    def taxonomy(self, responses: DataFrame | None = None) -> DataFrame:
        tax = map_taxonomy(self.store.read("themes"), responses)
        self.store.write("taxonomy", tax)
        return self.store.read("taxonomy")
