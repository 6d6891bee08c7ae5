"""Synthetic bibliographic corpus for end-to-end tests: topics x papers per
topic, each abstract four template sentences with fillers. Deterministic at
any scale (choices come from ``xxhash64`` of the row and a seed), so it is
the same distribution as the reference's generator, not the same draws."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Topic templates and placeholder fillers of the reference's
# synthetic export. (The reference defines "practice" twice; the second list
# is the one in effect and is the one given here.)
TOPIC_TEMPLATES = {
    "E-Commerce and Consumer Behavior": [
        "This study examines {aspect} in the context of online consumer purchasing decisions.",
        "We investigate how {tech} influences trust and loyalty in e-commerce platforms.",
        "The findings suggest that {factor} significantly mediates {outcome} for digital shoppers.",
        "Our empirical analysis of {n} consumers reveals important insights about {behavior}.",
        "Results indicate that {aspect} is a critical determinant of repeat purchase intentions.",
    ],
    "Artificial Intelligence and Machine Learning": [
        "This paper proposes a novel {method} for {task} using deep neural networks.",
        "We apply machine learning techniques to analyse {domain} at scale.",
        "The proposed {framework} achieves state-of-the-art performance on {benchmark}.",
        "Our experiments demonstrate that {approach} outperforms existing baselines in {metric}.",
        "We present a {model} that combines {tech1} and {tech2} for improved {outcome}.",
    ],
    "Security and Privacy in IS": [
        "This research investigates {threat} vulnerabilities in enterprise information systems.",
        "We propose a {protocol} for protecting user data against {attack} attacks.",
        "Our framework addresses privacy concerns related to {tech} in organisational contexts.",
        "Findings from {n} firms indicate that {practice} reduces security breach probability.",
        "The study develops a {model} for assessing cyber risk in {sector} organisations.",
    ],
    "Mobile Computing and Apps": [
        "This study explores user adoption of {service} on mobile devices across {context}.",
        "We examine how {feature} affects engagement with mobile {type} applications.",
        "A survey of {n} mobile users reveals that {factor} drives sustained app usage.",
        "Our analysis shows that {aspect} moderates the relationship between usability and adoption.",
        "Results confirm that {design} principles improve task completion rates in mobile {domain}.",
    ],
    "Knowledge Management Systems": [
        "This paper examines how {tool} supports knowledge sharing in distributed organisations.",
        "We investigate the role of {factor} in facilitating tacit knowledge transfer.",
        "Our case study of {sector} firms demonstrates the impact of {system} on innovation.",
        "Findings suggest that {practice} enhances knowledge retention and organisational learning.",
        "We develop a {framework} for measuring knowledge management maturity in {context}.",
    ],
}
FILLERS = {
    "aspect": ["perceived usefulness", "interface design", "social influence", "personalisation"],
    "tech": ["AI recommendations", "blockchain", "augmented reality", "chatbots", "IoT"],
    "factor": ["trust", "ease of use", "perceived risk", "social norms", "habit"],
    "outcome": ["satisfaction", "loyalty", "engagement", "conversion rate", "retention"],
    "n": ["350", "420", "512", "278", "634", "189"],
    "behavior": ["impulsive buying", "review generation", "subscription renewal", "cart abandonment"],
    "method": ["convolutional neural network", "transformer model", "hybrid approach", "ensemble"],
    "task": ["sentiment analysis", "fraud detection", "demand forecasting", "anomaly detection"],
    "domain": ["customer reviews", "financial transactions", "social media data", "log files"],
    "framework": ["multi-layer architecture", "federated learning approach", "attention mechanism"],
    "benchmark": ["standard IS datasets", "cross-industry evaluations", "held-out test sets"],
    "approach": ["the proposed system", "our integrated model", "the hybrid algorithm"],
    "metric": ["accuracy", "F1 score", "AUC-ROC", "precision-recall"],
    "model": ["predictive model", "classification framework", "decision support system"],
    "tech1": ["natural language processing", "graph neural networks", "transfer learning"],
    "tech2": ["reinforcement learning", "attention mechanisms", "contrastive learning"],
    "threat": ["SQL injection", "phishing", "ransomware", "insider threat", "zero-day"],
    "protocol": ["end-to-end encryption protocol", "zero-trust framework", "RBAC scheme"],
    "attack": ["man-in-the-middle", "credential stuffing", "social engineering"],
    "practice": ["communities of practice", "mentoring programmes", "knowledge audits"],
    "sector": ["financial", "healthcare", "retail", "manufacturing", "public"],
    "service": ["mobile banking", "health tracking", "food delivery", "ride-sharing"],
    "type": ["productivity", "entertainment", "social", "fitness", "finance"],
    "design": ["minimalist", "gesture-based", "voice-first", "adaptive"],
    "context": ["emerging markets", "enterprise settings", "SMEs", "educational institutions"],
    "feature": ["push notifications", "gamification", "offline mode", "dark mode"],
    "tool": ["enterprise wikis", "document management systems", "AI-assisted search"],
    "system": ["integrated KMS", "AI-powered platform", "collaborative intranet"],
}
SOURCE_TITLE = "Electronic Markets"
SENTENCES_PER_ABSTRACT = 4
MAX_CITED = 200
# ---------------------------------------------------------------------------


def _pick(options: list[str], seed: int, *parts) -> F.Column:
    arr = F.array(*[F.lit(o) for o in options])
    idx = F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(len(options))) + 1
    return F.element_at(arr, idx.cast("int"))


def _fill(template: F.Column, seed: int, *parts) -> F.Column:
    out = template
    for key, options in FILLERS.items():
        out = F.replace(out, F.lit("{" + key + "}"), _pick(options, seed, *parts, F.lit(key)))
    return out


def gen_corpus(spark: SparkSession, papers_per_topic: int = 20, seed: int = 42,
               corpus_id: str = "synthetic") -> DataFrame:
    """Clean paper table (corpus_id, sr_no, paper_id, authors, title,
    abstract, author_keywords, cited_by, source_title, year, topic)."""
    topics = list(TOPIC_TEMPLATES)
    n = len(topics) * papers_per_topic
    base = spark.range(n).select((F.col("id") + 1).alias("sr"),
                                 (F.col("id") / papers_per_topic).cast("int").alias("t"))
    topic = F.element_at(F.array(*[F.lit(t) for t in topics]), F.col("t") + 1)
    templates = F.element_at(F.array(*[F.array(*[F.lit(s) for s in TOPIC_TEMPLATES[t]]) for t in topics]),
                             F.col("t") + 1)
    sents = []
    for s in range(SENTENCES_PER_ABSTRACT):
        idx = (F.pmod(F.xxhash64(F.lit(seed), F.col("sr"), F.lit(s), F.lit("template")), F.lit(5)) + 1).cast("int")
        sents.append(_fill(F.element_at(templates, idx), seed, F.col("sr"), F.lit(s)))
    year = (F.lit(2010) + F.col("sr") % 14).cast("int")
    return base.select(
        F.lit(corpus_id).alias("corpus_id"),
        F.col("sr").cast("int").alias("sr_no"),
        (F.col("sr") - 1).alias("paper_id"),
        F.concat(F.lit("Author"), F.col("sr"), F.lit("A, Author"), F.col("sr"), F.lit("B")).alias("authors"),
        F.concat(topic, F.lit(": A Study of "), _pick(FILLERS["aspect"], seed, F.col("sr"), F.lit("title")),
                 F.lit(" ("), year, F.lit(")")).alias("title"),
        F.concat_ws(" ", *sents).alias("abstract"),
        F.replace(F.lower(topic), F.lit(" "), F.lit("; ")).alias("author_keywords"),
        F.pmod(F.xxhash64(F.lit(seed), F.col("sr"), F.lit("cited")), F.lit(MAX_CITED + 1)).cast("int").alias("cited_by"),
        F.lit(SOURCE_TITLE).alias("source_title"),
        year.alias("year"),
        topic.alias("topic"),
    )
