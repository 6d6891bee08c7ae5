"""Mixing sources to target weights by hierarchical budgeting (DataFrame and SQL functions only).

Rows lie in a tree domain - language - source. A token budget goes down the tree: at each node
it is shared among the children by weight; a child takes no more than its rows can give in
``max_epochs`` passes, and what it cannot take goes to its siblings by weight; only what all
of them together cannot take is missing at their parent and so goes to the parent's siblings. A
leaf's allotment is a number of full epochs and a token prefix of one more, whose order is a hash of seed,
epoch, id and text; the prefix is the longest within the allotment.

Shares among the children of a node come from one window over the aggregated tree: with children in
order of capacity over weight, those that saturate come first. The cut in a leaf is found without sorting
it: tokens are summed per leaf and hash bucket, buckets are accumulated, and only the bucket
in which the allotment ends is ordered. Rows are then picked by comparing their hash with the leaf's cut, so
texts aren't shuffled. The leaf table has one row per source; Spark broadcasts it only if it is small.

Defined results: null or empty texts have no tokens (such rows come with the prefix they fall in); null
domain, language or source count as ''; equal rows are picked together; weights not given are 1; an
empty table gives an empty table. The domain is always derived from the source; extra columns pass through ``mixed``.
Weights are positive integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, table, written

TREE = ("domain", "lang", "source")
BUDGET_PERCENT = 50
MAX_EPOCHS = 2
SEED = 11
#: Integer weights per level; other names weigh 1.
WEIGHTS = {
    "domain": {"domain0": 5, "domain1": 3, "domain2": 1},
    "lang": {"en": 2, "de": 3, "fr": 2, "es": 4},
    "source": {"src0": 1, "src1": 4, "src2": 2},
}
DOMAINS = 4
BUCKET_DIGITS = 3


def domain(source: str = "source"):
    """The domain of a source: its number modulo ``DOMAINS`` (no number: 'other')."""
    number = F.regexp_extract(F.coalesce(F.col(source), F.lit("")), r"([0-9]+)$", 1)
    return F.when(number == "", F.lit("other")).otherwise(F.concat(F.lit("domain"), (F.pmod(F.expr(
        f"try_cast(right({number_sql(source)}, 9) as int)"), F.lit(DOMAINS))).cast("string")))


def number_sql(source: str) -> str:
    return f"regexp_extract(coalesce({source}, ''), '([0-9]+)$', 1)"


def _located(documents: DataFrame) -> DataFrame:
    """The tree columns without nulls, the tokens (words) and a digest of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), domain().alias("domain"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TREE[1:]],
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_tokens"), F.md5(text.cast("binary")).alias("digest"))


def order_key(epoch, seed: int):
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")).cast("binary"))


def _share(nodes: DataFrame, parent: list[str], level: str, weights: dict[str, int]) -> DataFrame:
    """Adds ``share`` to ``nodes(parent..., level, cap, target of the parent)``: water filling among siblings."""
    known = weights.get(level, {})
    w = F.coalesce(F.create_map(*[F.lit(x) for kv in known.items() for x in kv])[F.col(level)], F.lit(1)) if known else F.lit(1)
    nodes = nodes.withColumn("w", w.cast("long"))
    # All siblings together: one row per node, after aggregation.
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    before = group.orderBy(F.col("cap") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
    nodes = (nodes.withColumn("give", F.least(F.col("target"), F.sum("cap").over(group)))
             .withColumn("left_t", F.col("give") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
             .withColumn("left_w", F.sum("w").over(group) - F.coalesce(F.sum("w").over(before), F.lit(0)))
             .withColumn("full", F.col("cap") * F.col("left_w") <= F.col("left_t") * F.col("w")))
    # Beyond the first child that does not saturate, what is left then is shared by weight.
    stop = F.min(F.when(~F.col("full"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col(level).alias("n"), "left_t", "left_w"))).over(group)
    nodes = nodes.withColumn("stop", stop)
    at = F.struct((F.col("cap") / F.col("w")).alias("r"), F.col(level).alias("n"))
    rest = F.struct(F.col("stop.r").alias("r"), F.col("stop.n").alias("n"))
    share = F.when(F.col("stop").isNull() | (at < rest), F.col("cap")).otherwise(F.expr("(stop.left_t * w) div stop.left_w"))
    return nodes.withColumn("share", share).drop("w", "give", "left_t", "left_w", "full", "stop")


def allotments(leaves: DataFrame, budget: int, weights: dict, max_epochs: int) -> DataFrame:
    """``leaves(domain, lang, source, tokens)`` with ``share``, the full ``epochs`` and the ``rest`` of the next one."""
    cap = F.sum("tokens").cast("long") * max_epochs
    d = _share(leaves.groupBy("domain").agg(cap.alias("cap")).withColumn("target", F.lit(budget).cast("long")), [], "domain", weights)
    l = leaves.groupBy("domain", "lang").agg(cap.alias("cap")).join(d.select("domain", F.col("share").alias("target")), "domain")
    l = _share(l, ["domain"], "lang", weights)
    s = leaves.withColumn("cap", F.col("tokens") * max_epochs).join(l.select("domain", "lang", F.col("share").alias("target")), ["domain", "lang"])
    s = _share(s, ["domain", "lang"], "source", weights)
    epochs = F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(max_epochs)).cast("int")
    return s.select(*TREE, "tokens", "share", epochs.alias("epochs"), (F.col("share") - epochs * F.col("tokens")).alias("rest"))


def cuts(rows: DataFrame, budget_percent: int = BUDGET_PERCENT, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per leaf: its full epochs and the largest key of the next epoch's prefix (null: none), from written ``_located`` rows."""
    leaves = written(rows.groupBy(*TREE).agg(F.sum("n_tokens").alias("tokens")), "mix-leaves")
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    plan = written(allotments(leaves, total * budget_percent // 100, weights, max_epochs), "mix-plan")
    part = (rows.join(plan.filter("rest > 0").select(*TREE, "epochs", "rest"), list(TREE))
            .withColumn("key", order_key(F.col("epochs"), seed)).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS)))
    sums = part.groupBy(*TREE, "bucket").agg(F.sum("n_tokens").alias("t"), F.max("rest").alias("rest"))
    w = Window.partitionBy(*TREE).orderBy("bucket")
    ends = sums.withColumn("upto", F.sum("t").over(w)).withColumn("base", F.col("upto") - F.col("t"))
    # The bucket in which the prefix ends: the first that goes beyond, or the last one.
    edge = ends.filter(F.col("upto") > F.col("rest")).groupBy(*TREE).agg(F.min(F.struct("bucket", "base")).alias("e"))
    edge = written(edge.select(*TREE, F.col("e.bucket").alias("bucket"), F.col("e.base").alias("base")), "mix-edge")
    within = Window.partitionBy(*TREE).orderBy("key")  # rows of one bucket of each leaf
    inside = (part.join(edge, [*TREE, "bucket"]).groupBy(*TREE, "bucket", "key", "rest", "base").agg(F.sum("n_tokens").alias("t"))
              .withColumn("sum", F.col("base") + F.sum("t").over(within)).filter(F.col("sum") <= F.col("rest"))
              .groupBy(*TREE).agg(F.max("key").alias("last")))
    # Without a row of that bucket in the prefix, everything below the bucket is in it.
    cut = edge.join(inside, list(TREE), "left").select(*TREE, F.coalesce("last", F.col("bucket")).alias("cut"))
    whole = F.when(F.col("rest") > 0, F.coalesce("cut", F.lit("g")))  # above every hexadecimal key
    return written(plan.join(cut, list(TREE), "left").select(*TREE, "epochs", whole.alias("cut")), "mix-cuts")


def _copies(rows: DataFrame, leaf_cuts: DataFrame, seed: int) -> DataFrame:
    extra = F.when(F.col("cut").isNotNull() & (order_key(F.col("epochs"), seed) <= F.col("cut")), F.lit(1)).otherwise(F.lit(0))
    return rows.join(leaf_cuts, list(TREE)).withColumn("copies", F.col("epochs") + extra).filter("copies > 0")


def mixture(documents: DataFrame, budget_percent: int = BUDGET_PERCENT, weights: dict = WEIGHTS, max_epochs: int = MAX_EPOCHS,
            seed: int = SEED) -> DataFrame:
    """``(doc_id, domain, lang, source, n_tokens, copies)`` of the rows in the mixture; ``copies`` is how often each comes."""
    rows = written(_located(documents), "mix-rows")
    out = _copies(rows, cuts(rows, budget_percent, weights, max_epochs, seed), seed)
    return out.select("doc_id", *TREE, "n_tokens", "copies")


def mixed(documents: DataFrame, budget_percent: int, weights: dict = WEIGHTS, seed: int = SEED) -> DataFrame:
    """The rows of a one-epoch mixture, with the columns of ``documents``."""
    rows = written(_located(documents), "mix-rows")
    table_ = cuts(rows, budget_percent, weights, 1, seed).select(*[F.col(c).alias(f"m_{c}") for c in TREE], F.col("epochs").alias("m_epochs"), F.col("cut").alias("m_cut"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    inner = documents.withColumn("m_row", F.struct(*[F.col(f"`{c}`") for c in documents.columns]))
    inner = inner.select("m_row", F.col("doc_id").cast("long").alias("doc_id"), domain().alias("domain"),
                         *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in TREE[1:]], F.md5(text.cast("binary")).alias("digest"))
    on = [inner[c] == table_[f"m_{c}"] for c in TREE]
    picked = inner.join(table_, on).filter((F.col("m_epochs") > 0) | (F.col("m_cut").isNotNull() & (order_key(F.col("m_epochs"), seed) <= F.col("m_cut"))))
    return picked.select(*[F.col("m_row").getField(c).alias(c) for c in documents.columns])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _sql_share(name: str, source: str, parent: str, level: str, weights: dict) -> str:
    known = " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.get(level, {}).items())
    w = f"CASE {level} {known} ELSE 1 END" if known else "1"
    by = f"PARTITION BY {parent} " if parent else ""
    return f"""
{name}_a AS (SELECT *, CAST({w} AS BIGINT) AS w FROM {source}),
{name}_b AS (SELECT *, CAST(cap AS DOUBLE) / w AS r, row_number() OVER ({by}ORDER BY CAST(cap AS DOUBLE) / w, {level}) AS i,
  least(target, sum(cap) OVER ({by})) - coalesce(sum(cap) OVER ({by}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_t,
  sum(w) OVER ({by}) - coalesce(sum(w) OVER ({by}ORDER BY CAST(cap AS DOUBLE) / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_w
  FROM {name}_a),
{name}_c AS (SELECT *, min(CASE WHEN NOT (cap * left_w <= left_t * w) THEN i END) OVER ({by}) AS stop FROM {name}_b),
{name} AS (SELECT *, CAST(CASE WHEN stop IS NULL OR i < stop THEN cap ELSE
  (max(CASE WHEN i = stop THEN left_t END) OVER ({by}) * w) // (max(CASE WHEN i = stop THEN left_w END) OVER ({by})) END AS BIGINT) AS share FROM {name}_c)"""


ORACLE = f"""
WITH rows_ AS (
  SELECT doc_id, CASE WHEN regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) = '' THEN 'other'
      ELSE 'domain' || CAST(CAST(right(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1), 9) AS INTEGER) % {DOMAINS} AS VARCHAR) END AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n_tokens, md5(coalesce(text, '')) AS digest
  FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM rows_ GROUP BY ALL),
d0 AS (SELECT domain, CAST(sum(tokens) * {MAX_EPOCHS} AS BIGINT) AS cap,
  (SELECT CAST(sum(tokens) * {BUDGET_PERCENT} // 100 AS BIGINT) FROM leaves) AS target FROM leaves GROUP BY domain),
{_sql_share("d", "d0", "", "domain", WEIGHTS)},
l0 AS (SELECT x.domain, x.lang, CAST(sum(x.tokens) * {MAX_EPOCHS} AS BIGINT) AS cap, any_value(d.share) AS target
  FROM leaves x JOIN d ON x.domain = d.domain GROUP BY x.domain, x.lang),
{_sql_share("l", "l0", "domain", "lang", WEIGHTS)},
s0 AS (SELECT x.domain, x.lang, x.source, x.tokens, x.tokens * {MAX_EPOCHS} AS cap, l.share AS target
  FROM leaves x JOIN l ON x.domain = l.domain AND x.lang = l.lang),
{_sql_share("s", "s0", "domain, lang", "source", WEIGHTS)},
plan AS (SELECT domain, lang, source, CAST(CASE WHEN tokens > 0 THEN share // tokens ELSE {MAX_EPOCHS} END AS BIGINT) AS epochs,
  share - (CASE WHEN tokens > 0 THEN share // tokens ELSE {MAX_EPOCHS} END) * tokens AS rest FROM s),
keyed AS (SELECT r.*, p.epochs, p.rest,
  md5('{SEED}' || ':' || CAST(p.epochs AS VARCHAR) || ':' || coalesce(CAST(r.doc_id AS VARCHAR), '') || ':' || r.digest) AS key
  FROM rows_ r JOIN plan p ON r.domain = p.domain AND r.lang = p.lang AND r.source = p.source),
picked AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + (CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END) AS INTEGER) AS copies
FROM picked WHERE epochs + (CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END) > 0
"""
