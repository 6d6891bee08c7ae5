"""N-gram Jaccard join by signature trees.

A document's set holds its distinct word shingles (64-bit hashes of them); two
documents link at a Jaccard similarity of ``PERCENT`` or more; the result is the connected
components of the links.

1. Equal sets form a class; one set per class goes on.
2. Candidate blocks. Under any fixed order of all shingles, linked sets share one
   among their first n - ceil(t n) + 1 (prefix filter). The order here is: shingles known to
   occur in one class first, then the known shared, then the known frequent, each by hash. What is known
   comes from counting the lowest-hash part of each set, kept in a bitmap of fixed size;
   as the order is the same for all sets, the filter is exact whatever the bitmap holds, which
   only decides how few candidates there are. Sets that share a prefix
   shingle are chained in order of size (sorted by range, so a frequent shingle is split over
   partitions), never paired; connected chains are blocks, and no link leaves a block. The sets of
   blocks, few by now, go through the same filter again, ordered by counts of all their shingles.
3. Verification. Every block's sets meet once, in a signature tree: a node holds the OR of its
   sets' bitmaps and the range of their sizes. A dual traversal drops a pair of nodes
   when the largest possible overlap is too small for its sizes, or when all its sets are in
   one component already; what is left at the leaves is compared exactly. Blocks beyond
   ``CHUNK`` sets are cut at random into chunks, twice with different cuts, which joins
   nearly everything; then the sets outside a block's largest component meet all the
   others, chunk by chunk, so no pair of different components stays untested.

Components need a link between two sets, not every link, so a pair that others
have joined isn't tested again; all copies of a class share its component.

Defined results: texts without words (null, empty) have an empty set, n_shingles 0 and a component of their
own; a null ``doc_id`` never names a component unless all its ids are null; repeated
rows give repeated rows; an empty table gives an empty table; extra columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WHITE, components, fresh, nonnull_text, session, table, worker_cache, written
from .units import text_bytes

N = 4
PERCENT = 85
FREQUENT = 32
BITMAP_BITS = 26       # known shingles: 2^26 bits, 8 MB, and as many for frequent ones
ACTIVE_BITS = 24       # prefilter of documents by id: 2^24 bits
CHUNK = 4096
LEAF = 16
FANOUT = 4
BLOCK_BYTES = 1_000_000

_M = np.uint64(0x9E3779B97F4A7C15)


_BASES = (np.uint64(0xC6A4A7935BD1E995), np.uint64(0xD6E8FEB86659FD93))
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in WHITE]] = True


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Two polynomials over the bytes of each word and its length, mixed to 64 bits."""
    which = np.repeat(np.arange(len(starts)), sizes)
    first = np.cumsum(sizes) - sizes
    within = np.arange(len(which)) - first[which]
    letters = data[starts[which] + within].astype(np.uint64) + np.uint64(1)
    out = _spread(sizes.astype(np.uint64) * _M)
    longest = int(sizes.max())
    for base in _BASES:
        power = np.cumprod(np.full(longest, base, np.uint64))
        out = _spread(out * _M + np.add.reduceat(letters * power[within], first))
    return out


def shingle_sets(texts: pa.Array, n: int = N, block_bytes: int = BLOCK_BYTES) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (no nulls), in order, a block of texts at a time."""
    worker_cache("op6")
    if not len(texts):
        return
    ends, data = text_bytes(texts)
    a = 0
    while a < len(texts):
        z = max(a + 1, int(np.searchsorted(ends, ends[a] + block_bytes, side="right")) - 1)
        d = _FOLD[data[ends[a]:ends[z]]]
        rows = ends[a:z + 1] - ends[a]
        word = ~_SPACE[d]
        begin = word.copy()
        begin[1:] &= ~word[:-1]
        first = rows[:-1][rows[:-1] < len(d)]
        begin[first] = word[first]  # a word never goes on in the next text
        stop = word.copy()
        stop[:-1] &= ~word[1:] | begin[1:]
        starts = np.flatnonzero(begin)
        bounds = np.searchsorted(starts, rows)
        if len(starts):
            hashes = _word_hashes(d, starts, np.flatnonzero(stop) + 1 - starts)
            m = max(0, len(hashes) - n + 1)
            grams = hashes[:m] + np.uint64(n)
            for i in range(1, n):
                grams = _spread(grams) * _M + hashes[i:i + m]
            grams = _spread(grams)
        for i, j in zip(bounds.tolist(), bounds[1:].tolist()):
            if j - i >= n:
                yield np.unique(grams[i:j - n + 1])
            elif j > i:  # a short text is one shingle
                h = hashes[i:i + 1] + np.uint64(j - i)
                for k in range(i + 1, j):
                    h = _spread(h) * _M + hashes[k:k + 1]
                yield _spread(h)
            else:
                yield np.zeros(0, np.uint64)
        a = z


def shingle_set(text: str, n: int = N) -> np.ndarray:
    return next(shingle_sets(pa.array([text]), n))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def _texts(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), nonnull_text().alias("text"))


def known(tokens: DataFrame) -> np.ndarray:
    """Two bitmaps over the hash space, shingles known as shared and as frequent, as 64-bit words, from
    all rows of ``tokens(token)``. What comes to the driver has the bitmaps' fixed size at most."""
    slot = F.shiftrightunsigned("token", 64 - BITMAP_BITS)
    counts = (tokens.groupBy("token").agg(F.count("*").alias("c"))
              .filter("c > 1").select(slot.alias("slot"), (F.col("c") >= FREQUENT).alias("often")))
    words = counts.groupBy(F.shiftright("slot", 6).cast("int").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("shared"),
        F.bit_or(F.expr("if(often, shiftleft(1L, cast(slot & 63 as int)), 0L)")).alias("often"))
    t = words.toArrow()
    shared, often = np.zeros(1 << (BITMAP_BITS - 6), np.uint64), np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    at = t["word"].to_numpy()
    shared[at], often[at] = t["shared"].to_numpy().view(np.uint64), t["often"].to_numpy().view(np.uint64)
    return np.stack([shared, often])


def _token_batches(sets_: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for s in sets_:
        if len(s):
            out.append(s)
            size += len(s)
        if size > 1 << 19:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["token"])
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], ["token"])


def known_shared(documents: DataFrame, n: int, percent: int) -> np.ndarray:
    """``known`` over the lowest-hash part (twice the prefix) of every text's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _token_batches(s[:2 * prefix_length(len(s), percent)] for s in shingle_sets(b.column(0), n))

    return known(_texts(documents).select("text").mapInArrow(run, "token long"))


def in_prefix(s: np.ndarray, known: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set in the order (known frequent, known shared, hash)."""
    slot = (s >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)
    word, bit = slot >> 6, (slot & 63).astype(np.uint64)
    kind = ((known[0][word] >> bit) & np.uint64(1)) + ((known[1][word] >> bit) & np.uint64(1))
    return s[np.argsort(kind, kind="stable")[:prefix_length(len(s), percent)]]


def sets(documents: DataFrame, known: np.ndarray, n: int, percent: int) -> DataFrame:
    """``(uid, doc_id, n, cls, digest, prefix)`` per row (digest: of the text); the prefix only where the task meets the class first."""
    shared = documents.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, met, bits = TaskContext.get().partitionId() << 40, set(), shared.value
        for b in batches:
            for a in range(0, b.num_rows, 1024):
                part = b.slice(a, 1024)
                size, cls, own, pre = [], [], [], []
                for x, s in zip(part.column(1), shingle_sets(part.column(1), n)):
                    own.append(hashlib.md5(x.as_buffer()).hexdigest())
                    digest = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                    size.append(len(s))
                    cls.append(digest)
                    pre.append(None if digest in met or not len(s) else in_prefix(s, bits, percent).view(np.int64))
                    met.add(digest)
                m = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(row, row + m), pa.int64()), part.column(0), pa.array(size, pa.int64()), pa.array(cls, pa.binary()),
                     pa.array(own), pa.array(pre, pa.list_(pa.int64()))], ["uid", "doc_id", "n", "cls", "digest", "prefix"])
                row += m

    return _texts(documents).mapInArrow(run, "uid long, doc_id long, n long, cls binary, digest string, prefix array<long>")


def chains(classes: DataFrame, percent: int) -> DataFrame:
    """Edges ``(a, b)`` between neighbours in (shingle, size, class) order that share the shingle and may link
    by size. The sort is by range, so a frequent shingle spans partitions; the one pair
    across each boundary is joined from the partitions' first and last rows."""
    rows = classes.select(F.explode("prefix").alias("token"), "n", "id")
    ordered = rows.repartitionByRange("token", "n", "id").sortWithinPartitions("token", "n", "id")

    def near(token, n, ids):
        same = (token[1:] == token[:-1]) & (100 * n[:-1] >= percent * n[1:]) & (ids[1:] != ids[:-1])
        return ids[:-1][same], ids[1:][same]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last = TaskContext.get().partitionId(), None
        names = ["a", "b", "part", "token", "n"]
        for b in batches:
            if not b.num_rows:
                continue
            cols = [b.column(i).to_numpy() for i in range(3)]
            if last is None:
                yield _row(names, cols[2][0], None, 2 * part, cols[0][0], cols[1][0])
            else:
                cols = [np.r_[x, c] for x, c in zip(last, cols)]
            x, y = near(*cols)
            pair = np.unique(np.stack([x, y], 1), axis=0) if len(x) else np.zeros((0, 2), np.int64)
            m = len(pair)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *(pa.nulls(m, pa.int64()) for _ in range(3))], names)
            last = [c[-1] for c in cols]
        if last is not None:
            yield _row(names, last[2], None, 2 * part + 1, last[0], last[1])

    def _row(names, *v):
        return pa.RecordBatch.from_arrays([pa.array([None if x is None else int(x)], pa.int64()) for x in v], names)

    out = written(ordered.mapInArrow(run, "a long, b long, part long, token long, n long"), "chains")
    # Two rows per partition at most: the ends of the partitions, in order.
    ends = sorted(out.filter("b is null").select("part", "token", "n", "a").collect(), key=lambda r: r.part)
    across = [(x.a, y.a) for x, y in zip(ends, ends[1:])
              if x.part // 2 != y.part // 2 and x.token == y.token and x.a != y.a and 100 * x.n >= percent * y.n]
    edges = out.filter("b is not null").select("a", "b").distinct()
    return edges.unionByName(classes.sparkSession.createDataFrame(across, "a long, b long")) if across else edges


def refined(members: DataFrame, percent: int) -> DataFrame:
    """``members(block, id, set)`` with finer blocks: the same filter within each block, in the order
    that counting all shingles of the members gives. Members that share no prefix shingle
    with another one of their block have no link and go."""

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from _token_batches(np.frombuffer(x.as_buffer(), np.uint64) for x in b.column(0))

    shared = members.sparkSession.sparkContext.broadcast(known(members.select("set").mapInArrow(flat, "token long")))

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            size, pre = [], []
            for block, x in zip(b.column(0).to_pylist(), b.column(2)):
                s = np.frombuffer(x.as_buffer(), np.uint64)
                size.append(len(s))
                own = _spread(np.full(1, block, np.int64).view(np.uint64) + _M)  # shingles of each block for itself
                pre.append(_spread(in_prefix(s, bits, percent) ^ own).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(size, pa.int64()), pa.array(pre, pa.list_(pa.int64()))], ["id", "n", "prefix"])

    rows = members.select("block", "id", "set").mapInArrow(prefixes, "id long, n long, prefix array<long>")
    blocks = components(chains(rows, percent), "refined").select(F.col("id").alias("r_id"), F.col("root").alias("r_block"))
    return members.join(blocks, F.col("id") == F.col("r_id")).select(F.col("r_block").alias("block"), "id", "set")


class SignatureTree:
    """Tree over sets: leaves of ``LEAF`` sets, ``FANOUT`` children per node; a node has the OR of the bitmaps,
    the range of sizes, and the most shingles that one of its sets has beyond its bits."""

    def __init__(self, arrays: list[np.ndarray], bits: int):
        g = len(arrays)
        maps = np.zeros((g, bits), bool)
        at = np.concatenate([a & np.uint64(bits - 1) for a in arrays]).astype(np.int64)
        maps[np.repeat(np.arange(g), [len(a) for a in arrays]), at] = True
        self.maps = np.packbits(maps, axis=1).view(np.uint64)
        self.n = np.array([len(a) for a in arrays])
        self.slack = self.n - np.bitwise_count(self.maps).sum(1)
        # Levels from the leaves up: first and last set of each node, bitmap, size range, slack.
        begin = np.arange(0, g, LEAF)
        level = (begin, np.append(begin[1:], g), np.bitwise_or.reduceat(self.maps, begin), np.minimum.reduceat(self.n, begin),
                 np.maximum.reduceat(self.n, begin), np.maximum.reduceat(self.slack, begin))
        self.levels = [level]
        while len(level[0]) > 1:
            k = np.arange(0, len(level[0]), FANOUT)
            last = np.append(k[1:], len(level[0])) - 1
            level = (level[0][k], level[1][last], np.bitwise_or.reduceat(level[2], k), np.minimum.reduceat(level[3], k),
                     np.maximum.reduceat(level[4], k), np.maximum.reduceat(level[5], k))
            self.levels.append(level)


def link(arrays: list[np.ndarray], labels: np.ndarray, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links that join components: pairs of positions, by dual traversal. Sets with equal ``labels``
    count as joined beforehand."""
    g = len(arrays)
    if g < 2:
        return []
    order = sorted(range(g), key=lambda i: arrays[i][:4].tolist())  # near copies share their lowest hashes
    sets_ = [arrays[i] for i in order]
    comp = np.unique(np.asarray(labels)[order], return_inverse=True)[1]
    bits = 64
    while bits < min(1 << 15, max(map(len, sets_))):
        bits *= 2
    tree = SignatureTree(sets_, bits)
    out: list[tuple[int, int]] = []

    def leaf(a0: int, a1: int, b0: int, b1: int) -> None:
        nx, ny = tree.n[a0:a1, None], tree.n[None, b0:b1]
        x, y = tree.maps[a0:a1, None], tree.maps[None, b0:b1]
        most = np.minimum(nx - np.bitwise_count(x & ~y).sum(2, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(2, dtype=np.int64))
        ok = (100 + percent) * most >= percent * (nx + ny)
        ok &= comp[a0:a1, None] != comp[None, b0:b1]
        for i, j in np.argwhere(ok):
            p, q = a0 + int(i), b0 + int(j)
            if p == q or comp[p] == comp[q]:
                continue
            u, v = sets_[p], sets_[q]
            both = len(np.intersect1d(u, v, assume_unique=True))
            if 100 * both >= percent * (len(u) + len(v) - both):
                comp[comp == comp[q]] = comp[p]
                out.append((order[p], order[q]))

    def visit(depth: int, i: int, j: int) -> None:
        first, end, maps, low, high, slack = tree.levels[depth]
        a, b = comp[first[i]:end[i]], comp[first[j]:end[j]]
        if a[0] == b[0] and (a == a[0]).all() and (b == a[0]).all():
            return
        if i != j:
            if 100 * high[i] < percent * low[j] or 100 * high[j] < percent * low[i]:
                return
            most = int(np.bitwise_count(maps[i] & maps[j]).sum()) + min(int(slack[i]), int(slack[j]))
            if (100 + percent) * most < percent * int(low[i] + low[j]):
                return
        if depth == 0:
            leaf(int(first[i]), int(end[i]), int(first[j]), int(end[j]))
            return
        below = len(tree.levels[depth - 1][0])
        for x in range(FANOUT * i, min(FANOUT * (i + 1), below)):
            for y in range(x if i == j else FANOUT * j, min(FANOUT * (j + 1), below)):
                visit(depth - 1, x, y)

    visit(len(tree.levels) - 1, 0, 0)
    return out


def _linked(members: DataFrame, percent: int) -> DataFrame:
    """Joining links ``(a, b)`` inside each ``key`` of ``members(key, id, label, set)``."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates("id")
        ids = p["id"].to_numpy()
        pairs = link([np.frombuffer(x, np.uint64) for x in p["set"]], p["label"].to_numpy(), percent)
        return pd.DataFrame({"a": [int(ids[i]) for i, _ in pairs], "b": [int(ids[j]) for _, j in pairs]}, dtype="int64")

    return members.groupBy("key").applyInPandas(run, "a long, b long")


def _labelled(members: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    roots = components(edges, name)
    return members.drop("label").join(roots, "id", "left").select("block", "id", "set", F.coalesce("root", "id").alias("label"))


def verified(members: DataFrame, percent: int, chunk: int = CHUNK) -> DataFrame:
    """Joining links over ``members(block, id, set)``; see the module's step 3."""
    sizes = members.groupBy("block").agg(F.count("*").alias("size"))
    members = written(members.join(sizes, "block").withColumn("label", F.col("id")), "members")
    small = members.filter(F.col("size") <= chunk).withColumn("key", F.struct("block", F.lit(0).alias("x"), F.lit(0).alias("y")))
    links = _linked(small, percent)
    if members.filter(F.col("size") > chunk).isEmpty():
        return links
    large = members.filter(F.col("size") > chunk)
    found = None
    for cut in range(2):
        x = F.pmod(F.xxhash64("id", F.lit(cut)), F.ceil(F.col("size") / chunk)).cast("int")
        part = large.withColumn("key", F.struct("block", x.alias("x"), F.lit(cut).alias("y")))
        new = written(_linked(part, percent), f"cut{cut}")
        found = new if found is None else found.unionByName(new)
        large = _labelled(large, found, f"cut{cut}").join(sizes, "block")
    large = written(large, "large")
    share = large.groupBy("block", "label").agg(F.count("*").alias("m"))
    main = share.groupBy("block").agg(F.max(F.struct("m", "label")).alias("top"), F.sum("m").alias("size"))
    main = main.select(F.col("block").alias("b"), F.col("top.label").alias("main"), (F.col("size") - F.col("top.m")).alias("others"), F.col("top.m").alias("m"))
    part = large.join(main, F.col("block") == F.col("b")).filter("others > 0")
    odd = F.col("label") != F.col("main")
    k_odd, k_main = F.ceil(F.col("others") / (chunk // 2)).cast("int"), F.ceil(F.col("m") / (chunk // 2)).cast("int")
    mine = F.when(odd, F.pmod(F.xxhash64("id"), k_odd)).otherwise(F.pmod(F.xxhash64("id"), k_main) + k_odd).cast("int")
    # Chunks 0..k_odd-1 hold the others, the rest the largest component: (odd, odd) and (odd, main) pairs meet.
    part = part.withColumn("c", mine).withColumn("k", F.explode(F.when(
        odd, F.sequence(F.lit(0), k_odd + k_main - 1)).otherwise(F.sequence(F.lit(0), k_odd - 1))))
    part = part.withColumn("key", F.struct("block", F.least("c", "k").alias("x"), F.greatest("c", "k").alias("y")))
    return links.unionByName(found).unionByName(_linked(part, percent))


def membership(documents: DataFrame, n: int = N, percent: int = PERCENT, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``(uid, doc_id, n, cls, digest)`` of every row, and ``(cls, low, root)`` of every class
    with words: its smallest ``doc_id`` and the id of its component."""
    session(documents)
    rows = written(sets(documents, known_shared(documents, n, percent), n, percent), "sets")
    classes = rows.filter("n > 0").groupBy("cls").agg(
        F.min("uid").alias("id"), F.max("n").alias("n"), F.first("prefix", ignorenulls=True).alias("prefix"))
    blocks = written(components(chains(classes, percent), "blocks"), "block-ids")
    slim = written(rows.filter("n > 0").groupBy("cls").agg(F.min(F.struct("uid", "doc_id")).alias("first"), F.min("doc_id").alias("low"))
                   .select("cls", F.col("first.uid").alias("id"), F.col("first.doc_id").alias("first_doc"), "low"), "classes")
    active = written(slim.join(blocks, "id").select("cls", "id", "first_doc", F.col("root").alias("block")), "active")
    members = refined(written(_member_sets(documents, active, n), "member-sets"), percent)
    links = written(verified(members, percent, chunk), "links")
    roots = components(links, "links")
    named = slim.join(roots, "id", "left").select("cls", "low", F.coalesce("root", "id").alias("root"))
    return rows.drop("prefix"), written(named, "components")


def ngram_components(documents: DataFrame, n: int = N, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``documents``."""
    rows, named = membership(documents, n, percent, chunk)
    low = named.groupBy("root").agg(F.min("low").alias("component_id"))
    final = named.join(low, "root").select(F.col("cls").alias("c_cls"), "component_id")
    full = rows.filter("n > 0").join(final, F.col("cls") == F.col("c_cls")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def representatives(documents: DataFrame, n: int = N, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """The rows of ``documents`` that stay when of each component the one with the smallest ``doc_id``
    does (null last, then by text digest); texts without words all stay, equal rows of them once."""
    rows, named = membership(documents, n, percent, chunk)
    key = lambda digest: F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest)
    best = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "digest")).alias("best")
    some = rows.filter("n > 0").join(named, "cls").groupBy("root").agg(best).select("best.doc_id", "best.digest")
    keep = some.unionByName(rows.filter("n = 0").select("doc_id", "digest")).select(key(F.col("digest")).alias("keep_key")).distinct()
    mark = fresh(documents, "row_key")
    marked = documents.withColumn(mark, key(F.md5(nonnull_text().cast("binary"))))
    stay = marked.join(keep, F.col(mark) == F.col("keep_key"), "left_semi")
    return stay.dropDuplicates([mark]).drop(mark)


def _member_sets(documents: DataFrame, active: DataFrame, n: int) -> DataFrame:
    """``(block, id, set)`` of the active classes, from the text of one document of each.
    A bitmap of fixed size (2^24 bits by id hash, broadcast) keeps most other texts out of the join."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(1 << ACTIVE_BITS))
    ids = active.select(F.col("first_doc").alias("doc_id"))
    bitmap = ids.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("bits"))
    texts = _texts(documents).withColumn("s", slot)
    texts = texts.join(F.broadcast(bitmap), F.shiftright("s", 6) == F.col("w")).filter(
        F.expr("bits & shiftleft(1L, cast(s & 63 as int))") != 0).select(F.col("doc_id").alias("d"), "text")
    pairs = texts.join(active, F.col("d").eqNullSafe(F.col("first_doc"))).select("block", "id", "cls", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep, out = [], []
            for i, (cls, s) in enumerate(zip(b.column(2), shingle_sets(b.column(3), n))):
                if hashlib.blake2b(s.tobytes(), digest_size=16).digest() == cls.as_py():  # ids may repeat
                    keep.append(i)
                    out.append(s.tobytes())
            part = b.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.binary())], ["block", "id", "set"])

    return pairs.mapInArrow(run, "block long, id long, set binary").dropDuplicates(["id"])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


#: Every pair that shares a shingle, counted: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM d),
n AS (SELECT d.doc_id, count(s.sh) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = p.x JOIN n ny ON ny.doc_id = p.y WHERE 100 * both_ >= 85 * (nx.n + ny.n - both_)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT r.x AS doc_id, any_value(n.n) AS n_shingles, min(r.y) AS component_id FROM r JOIN n ON n.doc_id = r.x GROUP BY r.x
"""
