"""Personal data: patterns, and terms that give protected entities away.

Base spans (e-mail, ip, card, phone) come from patterns. Their values are the
protected entities. Over the whole corpus, with N rows, a term t reveals the share

    PMI(t; e) / IC(e) = log2(N c(t,e) / (c(t) c(e))) / log2(N / c(e))

of the information that an entity e holds, c counting documents; that is 1 + log2(c(t,e) / c(t)) / IC(e).
A cautious estimate of it decides, over distinct texts (copies are no evidence) and with one joint text
taken off, as a text is no evidence on itself:

    lower = 1 + log2((c'(t,e) - 1) / c'(t)) / log2(N' / c'(e))

In a document with e, a term is generalised from ``GENERALISE`` on and removed from ``REMOVE`` on. Every
entity is scored; with a single joint text the estimate is minus infinity.

One scan finds spans, terms and partial term counts (counted in the task, flushed
at a fixed size), a second one the terms of texts that occur more than once; the rest are aggregates
and joins on (entity, term) and the row, without texts. Entities are kept as digests, not in the clear.

Key-like tokens (passwords, access tokens) have no form of their own but carry much information: a run of ``KEY_LENGTH`` or more letters, digits
and ``_+/=-`` with a letter and a digit in it is a span of kind ``key`` if its surprise, by the corpus's own counts of neighbouring
bytes, is ``KEY_BITS`` bits or more, and ``KEY_RATIO`` times what the corpus has a byte. These counts are a table of fixed size, over all texts. Keys are hidden themselves; they give no evidence against terms.

Defined results: a null text counts as empty (no spans); repeated rows give repeated
rows, count as documents in the ratio and once in the estimate; an empty table gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import nonnull_text, release, session, table, worker_cache, written
from .units import text_bytes

GENERALISE = 0.8
REMOVE = 0.95
KINDS = ("email", "ip", "card", "phone")
FLUSH_TERMS = 300_000
COPY_BITS = 24         # prefilter of texts by digest: 2^24 bits

# The patterns of the base kinds. A run that cannot begin a match is consumed by the
# second branch, so a long run without a match costs one pass, not one per character.
_EMAIL = re.compile(r"([A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)|[A-Za-z0-9._%+-]++")
_IP = re.compile(r"([0-9]++(?:\.[0-9]++){3})|[0-9]++")
_CARD = re.compile(r"([0-9](?:[\x20-]?[0-9])++)")
_PHONE = re.compile(r"(\+[0-9][\x20().0-9-]+[0-9])")
_DIGIT = re.compile("[0-9]")
#: Least length of a key, the bits that nobody guesses, and how much denser than the corpus they lie.
KEY_LENGTH, KEY_BITS, KEY_RATIO = 16, 80.0, 1.5
_KEY = re.compile(r"[A-Za-z0-9_+/=-]{%d,}+" % KEY_LENGTH)
_LETTER = re.compile("[A-Za-z]")
_TERM = re.compile(r"[^\W_]+")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, value) by kind, then start; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(0, *m.span(1), m[1].lower()) for m in _EMAIL.finditer(text) if m[1]]
    if not _DIGIT.search(text):
        return out
    if "." in text:
        out += [(1, *m.span(1), m[1]) for m in _IP.finditer(text) if m[1] and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[1].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[1].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span(1), digits))
    if "+" in text:
        for m in _PHONE.finditer(text):
            digits = "".join(_DIGIT.findall(m[1]))
            if 8 <= len(digits) <= 15:
                out.append((3, *m.span(1), digits))
    return out


def byte_pairs(documents: DataFrame) -> tuple[np.ndarray, float]:
    """Bits of each byte behind each other one (256 x 256) and their mean in the corpus, by the counts of neighbouring bytes over all texts: 65,536 sums at most
    come to the driver, whatever the input."""
    session(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            ends, data = text_bytes(b.column(0))
            data = data[ends[0]:ends[-1]]
            for a in range(0, max(0, len(data) - 1), 1 << 20):  # the last byte of a text and the first of the next one are a pair as well
                part = data[a:a + (1 << 20) + 1].astype(np.uint16)
                total += np.bincount(part[:-1] << 8 | part[1:], minlength=1 << 16)
        release()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(total[at])], ["pair", "n"])

    rows = documents.select(nonnull_text().alias("text")).mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << 16)
    counts[[r.pair for r in rows]] = [r.n for r in rows]
    counts = counts.reshape(256, 256)
    bits = -np.log2((counts + 0.5) / (counts + 0.5).sum(1, keepdims=True))
    return bits, float((counts * bits).sum() / max(1.0, counts.sum()))


def key_spans(text: str, bits: np.ndarray, mean: float, found: list) -> list[tuple[int, int, int, str]]:
    """Spans of kind ``key`` (numbered behind the base kinds) that no base span overlaps."""
    out = []
    for m in _KEY.finditer(text):
        if not (_DIGIT.search(m[0]) and _LETTER.search(m[0])) or any(a < m.end() and m.start() < b for _, a, b, _ in found):
            continue
        x = np.frombuffer(m[0].encode(), np.uint8)
        if bits[x[:-1], x[1:]].sum() >= max(KEY_BITS, KEY_RATIO * mean * (len(x) - 1)):
            out.append((len(KINDS), *m.span(), m[0]))
    return out


def spans_text(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def terms(text: str, spans: list) -> dict[str, list[int]]:
    """Lower-case terms outside the base spans, with (start, end) pairs laid flat."""
    covered = sorted((a, b) for _, a, b, _ in spans)
    out: dict[str, list[int]] = {}
    k = 0
    top = -1
    for m in _TERM.finditer(text):
        a, b = m.span()
        while k < len(covered) and covered[k][0] < b:
            top = max(top, covered[k][1])
            k += 1
        if a >= top:
            out.setdefault(m[0].lower(), []).extend((a, b))
    return out


_SCAN = (
    "uid long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, entities array<string>, "
    "terms array<struct<term: string, at: array<int>>>, term string, n long, digest string, extra long, keys string, n_key long")
_TERMS = pa.list_(pa.struct([("term", pa.string()), ("at", pa.list_(pa.int32()))]))


def scan(documents: DataFrame, bits: tuple[np.ndarray, float] | None = None) -> DataFrame:
    """Rows of two kinds: one per document (``uid`` set; terms only where it has
    entities; digest of the text) and partial document counts of terms (``term``, ``n``, and how many of
    these, ``extra``, are further copies of a text). ``bits`` finds keys (see ``byte_pairs``)."""
    session(documents)
    kinds = [pa.int64()] * 6 + [pa.string(), pa.list_(pa.string()), _TERMS, pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = ["uid", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "entities", "terms", "term", "n", "digest", "extra", "keys", "n_key"]

    def counted(count: Counter, what: str = "n") -> pa.RecordBatch:
        cols = {"term": pa.array(count.keys(), pa.string()), what: pa.array(count.values(), pa.int64())}
        return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(len(count), t) for c, t in zip(names, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("op4")
        row, count = TaskContext.get().partitionId() << 40, Counter()
        for b in batches:
            out: list[list] = [[] for _ in names]
            for doc, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_py() or ""
                found = base_spans(text)
                own = terms(text, found) if found else {}
                count.update(own.keys() if found else set(map(str.lower, _TERM.findall(text))))
                values = {hashlib.blake2b(f"{KINDS[k]}:{v}".encode(), digest_size=16).hexdigest() for k, _, _, v in found}
                tally = Counter(k for k, *_ in found)
                keys = key_spans(text, *bits, found) if bits is not None else []
                for col, v in zip(out, (row, doc, *(tally[k] for k in range(4)), spans_text((KINDS[k], a, e) for k, a, e, _ in found),
                                        sorted(values), [{"term": t, "at": at} for t, at in own.items()], None, None,
                                        hashlib.md5(text.encode()).hexdigest(), None, spans_text(("key", a, e) for _, a, e, _ in keys), len(keys))):
                    col.append(v)
                row += 1
                if len(count) > FLUSH_TERMS:
                    yield counted(count)
                    count.clear()
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names)
            del b, out
            release()
            yield done
        yield counted(count)

    def run_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Counter()
        for b in batches:
            for more, x in zip(b.column(0).to_pylist(), b.column(1)):
                text = x.as_py()
                found = base_spans(text)
                for t in terms(text, found) if found else set(map(str.lower, _TERM.findall(text))):
                    count[t] += more
                if len(count) > FLUSH_TERMS:
                    yield counted(count, "extra")
                    count.clear()
        yield counted(count, "extra")

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), nonnull_text().alias("text")).mapInArrow(run, _SCAN)
    return rows.unionByName(_copied(documents).mapInArrow(run_copies, _SCAN))


def _copied(documents: DataFrame) -> DataFrame:
    """``(more, text)`` of each text that occurs again, once, and how often it does. A bitmap of fixed size (by
    digest, broadcast) keeps most other texts out of the join."""
    digest = F.md5(nonnull_text().cast("binary"))
    again = documents.select(digest.alias("c_digest")).groupBy("c_digest").agg(F.count("*").alias("n")).filter("n > 1")
    again = written(again.select("c_digest", (F.col("n") - 1).alias("more")), "pii-copies")
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << COPY_BITS))
    bitmap = again.select(slot("c_digest").alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    texts = documents.select(digest.alias("digest"), nonnull_text().alias("text")).withColumn("s", slot("digest"))
    texts = texts.join(F.broadcast(bitmap), F.shiftright("s", 6) == F.col("w")).filter(
        F.expr("bits & shiftleft(1L, cast(s & 63 as int))") != 0)
    return texts.join(again, F.col("digest") == F.col("c_digest")).dropDuplicates(["digest"]).select("more", "text")


def disclosing(rows: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """``(entity, term, ratio, lower, action)`` of the terms that reveal an entity too well, from a written
    ``scan``: the ratio over all documents, and the estimate over distinct texts that decides."""
    docs = rows.filter("uid is not null")
    total, texts = docs.agg(F.count("*"), F.count_distinct("digest")).first()
    some = docs.filter(F.size("entities") > 0)
    once = some.groupBy("digest").agg(F.min("uid").alias("o_uid")).select("o_uid")
    some = some.join(once, F.col("uid") == F.col("o_uid"), "left").select(
        F.explode("entities").alias("entity"), F.col("terms.term").alias("t"), F.col("o_uid").isNotNull().cast("long").alias("own"))
    some = written(some, "entities")
    entity = some.groupBy("entity").agg(F.count("*").alias("n_entity"), F.sum("own").alias("t_entity"))
    # A single joint text gives an estimate of minus infinity whatever the counts, so the pairs of an entity
    # that is in one text needn't be laid out and counted at all.
    more = entity.filter("t_entity > 1").select("entity")
    seen = (some.join(more, "entity", "left_semi").select("entity", "own", F.explode("t").alias("term")).groupBy("entity", "term")
            .agg(F.count("*").alias("n_both"), F.sum("own").alias("t_both")).filter("t_both > 1"))
    seen = written(seen.join(entity, "entity").filter(F.col("t_entity") < texts), "pairs")
    counts = rows.filter("uid is null").groupBy("term").agg(F.sum("n").alias("n_term"), F.coalesce(F.sum("extra"), F.lit(0)).alias("extra"))
    ratio = F.log2(F.lit(float(total)) * F.col("n_both") / (F.col("n_term") * F.col("n_entity"))) / F.log2(F.lit(float(total)) / F.col("n_entity"))
    lower = 1 + F.log2((F.col("t_both") - 1) / (F.col("n_term") - F.col("extra"))) / F.log2(F.lit(float(texts)) / F.col("t_entity"))
    return (seen.join(counts, "term").withColumn("ratio", ratio).withColumn("lower", lower)
            .filter(F.col("lower") >= generalise)
            .select("entity", "term", "ratio", "lower", F.when(F.col("lower") >= remove, "remove").otherwise("generalise").alias("action")))


def find(documents: DataFrame, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """One row per row of ``documents``: counts per kind, digest of the base
    spans, all spans (base kinds first, then ``key``, ``generalise`` and ``remove``), how many of these are of a term or a key, and how many there are."""
    rows = written(scan(documents, byte_pairs(documents)), "pii")
    docs = rows.filter("uid is not null")
    flagged = written(disclosing(rows, generalise, remove), "disclosing")
    hits = (docs.filter(F.size("entities") > 0).select("uid", F.explode("entities").alias("entity"), "terms")
            .join(flagged.select("entity").distinct(), "entity", "left_semi")
            .select("uid", "entity", F.explode("terms").alias("x")).select("uid", "entity", "x.term", "x.at")
            .join(flagged, ["entity", "term"]))
    # A term may be flagged by several entities of the row: the stronger action holds.
    one = hits.groupBy("uid", "term").agg(F.max("action").alias("action"), F.first("at").alias("at"))
    pairs = F.expr("transform(sequence(0, size(at) div 2 - 1), i -> struct(action, at[2 * i] as a, at[2 * i + 1] as b))")
    more = (one.select("uid", F.explode(pairs).alias("s")).groupBy("uid")
            .agg(F.sort_array(F.collect_list("s")).alias("s"))
            .select(F.col("uid").alias("m_uid"), F.size("s").alias("m_n"),
                    F.expr("array_join(transform(s, x -> concat(x.action, ':', x.a, ':', x.b)), ',')").alias("m_spans")))
    return docs.join(more, F.col("uid") == F.col("m_uid"), "left").select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("keys") != "", F.col("keys")), "m_spans").alias("spans"),
        F.coalesce(F.col("m_n").cast("long"), F.lit(0)).cast("long").alias("n_term_spans"), "n_key",
        (sum(F.col(f"n_{k}") for k in (*KINDS, "key")) + F.coalesce(F.col("m_n").cast("long"), F.lit(0))).cast("long").alias("n_spans"))


def redacted(text: str, spans: str):
    """Column: the text of column ``text`` with the spans of column ``spans`` taken
    out or generalised; of overlapping spans the first, longest one shows."""

    @F.pandas_udf(T.StringType())
    def run(texts, marks):
        return texts.combine(marks, _redact)

    return run(nonnull_text(text), F.coalesce(F.col(spans), F.lit("")))


def _redact(text: str, spans: str) -> str:
    out, at = [], 0
    parts = [s.split(":") for s in spans.split(",") if s]
    for kind, a, b in sorted(((k, int(a), int(b)) for k, a, b in parts), key=lambda s: (s[1], -s[2])):
        if a < at:
            at = max(at, b)
            continue
        word = text[a:b]
        mark = "" if kind == "remove" else f"[{kind.upper()}]" if kind != "generalise" else (
            "[NUMBER]" if word.isdigit() else "[NAME]" if word[0].isupper() else "[WORD]")
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
