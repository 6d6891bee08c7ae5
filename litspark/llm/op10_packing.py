"""Packing documents into fixed-length token sequences.

Texts are encoded in their tasks; a document is its ids and one separator id. Cut
freely means: every full ``length`` ids are a piece, and the rest is one more.
Documents are dealt at random (seeded, by their place in the input: another split of the input gives other groups) into groups of about ``group_documents``;
each group packs its pieces by first-fit decreasing on its own, so no task sees more
than a group and groups run in parallel. First fit looks up the leftmost bin
with room in a tournament tree: every inner node holds the largest room below it, so a
search and an update take one walk between root and leaf.

Ids are those of the ``tokenizers`` library without added special tokens, special
strings in a text as its default has them. Texts are cut into units that the
pretokeniser never joins (``units``); a unit's ids are encoded once per worker and kept in
a bounded memo.

Defined results: a null text counts as empty, so its document is the separator alone;
repeated rows are documents of their own; an empty table gives an empty table;
only ``doc_id`` and ``text`` are read, other columns don't matter.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import nonnull_text, release, session, table, worker_cache
from .op1_token_counts import default_tokenizer
from .units import BLOCK_BYTES, cut, gathered, unit_blocks

LENGTH = 2048
SEPARATOR = 1
GROUP_DOCUMENTS = 1024
SEED = 17
MEMO_UNITS = 350_000
LEARN_UNITS = 4000
#: A digit, Latin units, and the pattern of a vocabulary (``word_bpe_49k``) that makes every digit a piece of its own.
DIGIT = "0"
LATIN = re.compile(r"[\t-\r -~\u00a1-\u024f]*").fullmatch
DIGITS_ALONE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def digits_stand_alone(tok) -> bool:
    """Whether a digit is a piece of its own in any text, without a trace in its neighbours: the text is first cut by ``DIGITS_ALONE``, and before
    that only composed, given single spaces and lower-cased (no character composes with a digit)."""
    rules = json.loads(tok.to_str())
    steps = lambda x, name: x.get(name, [x]) if x else []
    first, *others = steps(rules["pre_tokenizer"], "pretokenizers") or [{}]
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    return (first.get("type") == "Split" and first["pattern"] == {"Regex": DIGITS_ALONE} and first["behavior"] == "Removed" and first["invert"]
            and all(x["type"] == "ByteLevel" and not x["add_prefix_space"] and not x["use_regex"] for x in others)
            and all(x in known for x in steps(rules["normalizer"], "normalizers"))
            and len(tok.encode(DIGIT, add_special_tokens=False).ids) == 1)


class UnitEncoder:
    """ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, memo_units: int = MEMO_UNITS, block_bytes: int = BLOCK_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs one task per core
        from tokenizers import Tokenizer

        self.tok, self.memo_units, self.block_bytes = Tokenizer.from_file(path), memo_units, block_bytes
        self.memo: dict[bytes, bytes] = {}
        added = {i: t.content for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip or t.single_word)}
        self.special_id, self.special = next(iter(added.items()), (0, ""))
        self.odd = re.compile("|".join(map(re.escape, added.values()))).search if added else None
        self.digit_id = self.bare = None
        if digits_stand_alone(self.tok):
            self.digit_id = self.tok.encode(DIGIT, add_special_tokens=False).ids[0]
            self.bare = Tokenizer.from_str(json.dumps(json.loads(self.tok.to_str()) | {"normalizer": None}))

    def learn(self, units: list[bytes]) -> None:
        """Encode units that the memo lacks in one go, between each two a digit, if the vocabulary never joins one with
        its neighbours, or else a special string (which the library never does, but it costs more). With a digit, Latin
        letters need only be lower-cased: they are composed, and white space is no part of a piece."""
        texts = [u.decode() for u in units]
        plain = [i for i, t in enumerate(texts) if self.special and not self.odd(t)]
        if self.digit_id is not None:
            digits, latin, others = [], [], []
            for i in plain:
                (digits if DIGIT in texts[i] else latin if LATIN(texts[i]) else others).append(i)
            self._learn_joined(self.bare, units, [texts[i].lower() for i in latin], latin, DIGIT, self.digit_id)
            self._learn_joined(self.tok, units, [texts[i] for i in others], others, DIGIT, self.digit_id)
            self._learn_joined(self.tok, units, [texts[i] for i in digits], digits, self.special, self.special_id)
        else:
            self._learn_joined(self.tok, units, [texts[i] for i in plain], plain, self.special, self.special_id)
        for k in set(range(len(units))).difference(plain):
            self.memo[units[k]] = np.array(self.tok.encode(texts[k], add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _learn_joined(self, tok, units: list[bytes], texts: list[str], some: list[int], divider: str, divider_id: int) -> None:
        if some:
            ids = np.array(tok.encode_batch_fast([divider.join(texts)], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = ids.tobytes(), (4 * np.flatnonzero(ids == divider_id)).tolist()
            for k, i, j in zip(some, [0, *(x + 4 for x in ends)], [*ends, len(raw)], strict=True):
                self.memo[units[k]] = raw[i:j]

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        for a, z, codes, units, bounds in unit_blocks(texts, self.block_bytes):
            if len(self.memo) > self.memo_units:
                self.memo.clear()
            get = self.memo.get
            if missing := [u for u in units if get(u) is None]:
                for i in range(0, len(missing), LEARN_UNITS):
                    self.learn(missing[i:i + LEARN_UNITS])
            ids, end = gathered(codes, [get(u) for u in units], "<u4")
            first = cut(end, bounds).tolist()
            for i, j in zip(first, first[1:]):
                yield ids[i:j]


def encoder(path: str, memo_units: int = MEMO_UNITS, block_bytes: int = BLOCK_BYTES) -> UnitEncoder:
    return worker_cache(f"op10 {path} {memo_units} {block_bytes}", lambda: UnitEncoder(path, memo_units, block_bytes))


def _mix(x: int) -> int:
    """A 64-bit finaliser (splitmix): neighbouring numbers land far apart."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & 0xFFFFFFFFFFFFFFFF
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & 0xFFFFFFFFFFFFFFFF
    return x ^ (x >> 31)


PIECE = "grp long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(documents: DataFrame, groups: int, length: int = LENGTH, separator: int = SEPARATOR, seed: int = SEED,
           tokenizer: str | None = None, with_ids: bool = False, memo_units: int = MEMO_UNITS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece with the random group of its document; ``with_ids`` adds
    the ids (binary, unsigned 32-bit little-endian). ``memo_units`` and ``block_bytes`` bound a worker's memory."""
    path = tokenizer or default_tokenizer()
    session(documents)
    end = np.array([separator], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(path, memo_units, block_bytes), TaskContext.get().partitionId() << 40
        for b in batches:
            out: list[list] = [[], [], [], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                ids = ids.tobytes() + end
                n, group = len(ids) // 4, _mix(seed ^ _mix(row)) % groups
                row += 1
                for a in range(0, n, length):
                    part = ids[4 * a:4 * (a + length)]
                    for col, v in zip(out, (group, doc, a, len(part) // 4, zlib.crc32(part), n, part if with_ids else None)):
                        col.append(v)
            arrays = [pa.array(c, pa.int64()) for c in out[:6]] + ([pa.array(out[6], pa.binary())] if with_ids else [])
            del b, out  # the texts are done with before the next ones come
            release()
            yield pa.RecordBatch.from_arrays(arrays, names)

    names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * with_ids
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), nonnull_text().alias("text")).mapInArrow(
        run, PIECE + ", ids binary" * with_ids)


def first_fit_decreasing(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece, longest first, each into the leftmost bin with room."""
    order = np.argsort(-lengths, kind="stable")
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    tree = [room] * (2 * size)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k in order.tolist():
        need, node = int(lengths[k]), 1
        while node < size:
            node *= 2
            if tree[node] < need:
                node += 1
        bins[k], offsets[k] = node - size, room - tree[node]
        tree[node] -= need
        node //= 2
        while node:
            most = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == most:
                break
            tree[node] = most
            node //= 2
    return bins, offsets


def pack(documents: DataFrame, length: int = LENGTH, separator: int = SEPARATOR, group_documents: int = GROUP_DOCUMENTS,
         seed: int = SEED, tokenizer: str | None = None, with_ids: bool = False, memo_units: int = MEMO_UNITS,
         block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence.
    ``sequence_id`` is the group times 2^32 plus the bin in the group."""
    groups = max(1, -(-documents.count() // group_documents))
    rows = pieces(documents, groups, length, separator, seed, tokenizer, with_ids, memo_units, block_bytes)

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = first_fit_decreasing(p["length"].to_numpy(), length)
        p["sequence_id"], p["offset"] = (p["grp"].to_numpy() << 32) + bins, offsets
        return p.drop(columns="grp")

    return rows.groupBy("grp").applyInPandas(
        run, PIECE.split(", ", 1)[1] + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
