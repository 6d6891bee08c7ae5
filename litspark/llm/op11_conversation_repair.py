"""Conversation structure repair: the cheapest edits after which a conversation reads ``(s?(ua)+)?``.

Every row of a conversation is kept, given another role or deleted, and empty turns may be inserted anywhere; the
cheapest sequence of edits is a shortest path over four states (nothing yet, after the system turn, after a user turn, after an
assistant turn). The path is found by a Viterbi recurrence of *costs to go*, run in parallel by rank convergence:

1. A conversation's rows, in order, are cut into chunks (``CHUNK`` rows at most). Every chunk runs the
   recurrence from its end to its start at once, from a speculative vector of four costs (as if the conversation ended there).
2. A vector matters only up to a constant: the recurrence adds the same to all that follows. So a chunk is right as
   soon as the vector it assumed and the one that its successor computed *differ only by a constant*. Fix-up passes rerun
   the other chunks from the successor's vector, all conversations together, until none is left. Each pass settles at least the
   last wrong chunk of a conversation; typically the vectors agree after one.
3. The constants are summed (stitched): that gives the cost of the whole. The stitched costs to go drive the trace: at
   each row the ASCII-least edit that lies on a cheapest path. Chunks tell to which state they lead from each of the
   four; these small maps are chained, and then every chunk is traced at once.

A conversation that holds a large part of all rows is many chunks in many tasks. Only vectors, maps and codes (one byte a row)
take part in the recurrence; texts are joined once with the edits. What is sequential by definition, the hash of one
conversation's whole repaired text, streams through a task with one slice in memory.

Defined results: null roles and texts are one space, and a null conversation or turn is one space in the key that picks
the damage; null turns come first; rows of one turn are ordered by role, the first 64 characters and a hash of the text;
repeated rows are rows of their own (and duplicates, by the rule); a null ``conv_id`` is a conversation of its own; an empty
table gives an empty table; only the four columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WHITE, session, table, written

#: Rows of a chunk at most.
CHUNK = 4096
#: Bytes of repaired text that a task holds of one conversation at most.
SLICE = 1 << 20
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
USER = 2
#: The state after an inserted or reroled turn.
NEXT = (2, 2, 3, 2)
#: The state after keeping a turn whose role begins with s (1), u (2), a (3) or otherwise (0).
KEEP = ({}, {0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3})
#: Costs to go at the end: a user turn needs its answer, a system turn a pair.
END = (0, 2 * INSERT, INSERT, 0)

_BACK: dict = {}
_STEP: dict = {}


def _costs(code: int, after: tuple) -> list[int]:
    """Costs to go before a row of ``code`` (4 * role class + fault: 1 truncated, 2 blank, 3 duplicate) from those after it."""
    out = [DELETE + x for x in after]
    if code & 3 < 2:
        late = TRUNCATED * (code & 3)
        keep = KEEP[code >> 2]
        for s in range(4):
            out[s] = min(out[s], REROLE + late + after[NEXT[s]], *([late + after[keep[s]]] if s in keep else []))
    user, other = out[2], out[3]
    out[2], out[3] = min(user, INSERT + other), min(other, INSERT + user)
    return [min(out[0], INSERT + out[2]), min(out[1], INSERT + out[2]), out[2], out[3]]


def back(code: int, after: tuple) -> tuple[tuple, int]:
    """The normalised vector (its least entry is 0) before a row, and the constant taken off."""
    key = code, after
    if key not in _BACK:
        c = _costs(code, after)
        low = min(c)
        _BACK[key] = tuple(x - low for x in c), low
    return _BACK[key]


def step(code: int, after: tuple, state: int) -> tuple[str, int]:
    """The ASCII-least cheapest edits at a row (insertions before it included) and the state they lead to."""
    key = code, after, state
    if key not in _STEP:
        to_go, edits, s = _costs(code, after), "", state
        late, keep = TRUNCATED * (code & 3 == 1), KEEP[code >> 2] if code & 3 < 2 else {}
        while True:
            if to_go[s] == DELETE + after[s]:
                edits += "D"
                break
            if to_go[s] == INSERT + to_go[NEXT[s]]:
                edits, s = edits + "I", NEXT[s]
                continue
            if s in keep and to_go[s] == late + after[keep[s]]:
                edits, s = edits + "K", keep[s]
                break
            edits, s = edits + "R", NEXT[s]
            break
        _STEP[key] = edits, s
    return _STEP[key]


def vectors(codes: bytes, end: tuple) -> tuple[list[tuple], int]:
    """The normalised vectors before each row and at the end, and the sum of the constants."""
    out, total = [end], 0
    for c in reversed(codes):
        v, low = back(c, out[-1])
        out.append(v)
        total += low
    return out[::-1], total


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage that a checksum of (conversation, turn) picks: ``conv, turn, role, text``."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = conversations.select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"),
        (F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20).alias("fate"))
    return d.filter("fate <> 0").select(
        "conv", "turn", F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


_SEGMENT = ("conv long, chunk long, codes binary, assumed array<int>, start array<int>, gain long, blank long, duplicate long, truncated long, "
            "illegal long, first_class int, last_class int, low long, high long, turns long, first_turn long, last_turn long")


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in schema.split(", "))])


def _illegal(a: int, b: int) -> int:
    return (a, b) not in ((1, 2), (2, 3), (3, 2))


def _segments(rows: pa.Table) -> pa.Table:
    """A block of consecutive rows to one chunk for each conversation in it."""
    rows = rows.sort_by("pos")
    conv, turn, pos, code = (rows[c].to_pylist() for c in ("conv", "turn", "pos", "code"))
    out, a = [], 0
    for z in range(1, len(conv) + 1):
        if z < len(conv) and conv[z] == conv[a]:
            continue
        codes = bytes(code[a:z])
        v, gain = vectors(codes, END)
        known = [t for t in turn[a:z] if t is not None]
        cls = [c >> 2 for c in codes]
        out.append((conv[a], pos[a], codes, END, v[0], gain, *(sum(c & 3 == f for c in codes) for f in (2, 3, 1)), sum(map(_illegal, cls, cls[1:])),
                    cls[0], cls[-1], min(known, default=None), max(known, default=None), len(set(known)), turn[a], turn[z - 1]))
        a = z
    schema = _arrow(_SEGMENT)
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _rerun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A chunk's vectors from what its successor computed."""
    schema = _arrow("chunk long, assumed array<int>, start array<int>, gain long")
    for b in batches:
        out = []
        for chunk, codes, truth in zip(*(b[c].to_pylist() for c in ("chunk", "codes", "truth")), strict=True):
            v, gain = vectors(codes, tuple(truth))
            out.append((chunk, truth, v[0], gain))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 4, schema, strict=True)], schema=schema)


def settled(segments: DataFrame) -> DataFrame:
    """Fix-up passes over ``segments`` (with ``next``, the following chunk of the conversation or null) until every
    assumed vector is the one that the next chunk computed, up to a constant."""
    alone = segments.filter("next is null and prev is null")
    many = written(segments.filter("next is not null or prev is not null"), "repair-chunks")
    while True:
        truth = many.select(F.col("chunk").alias("after"), F.col("start").alias("truth"))
        wrong = many.filter("next is not null").join(truth, F.col("next") == F.col("after")).filter("assumed <> truth").select("chunk", "codes", "truth")
        redone = written(wrong.mapInArrow(_rerun, "chunk long, assumed array<int>, start array<int>, gain long"), "repair-fixed")
        if redone.isEmpty():
            return alone.unionByName(many)
        new = redone.select(F.col("chunk").alias("k"), *(F.col(c).alias(f"new_{c}") for c in ("assumed", "start", "gain")))
        many = written(many.join(new, F.col("chunk") == F.col("k"), "left").select(
            *(F.coalesce(f"new_{c}", c).alias(c) if c in ("assumed", "start", "gain") else c for c in many.columns)), "repair-chunks")


def _maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each chunk the states that the trace leads to from each of the four."""
    schema = _arrow("conv long, chunk long, ends array<int>")
    for b in batches:
        ends = []
        for codes, assumed in zip(b["codes"].to_pylist(), b["assumed"].to_pylist(), strict=True):
            v, _ = vectors(codes, tuple(assumed))
            states = [0, 1, 2, 3]
            for i, c in enumerate(codes):
                states = [step(c, v[i + 1], s)[1] for s in states]
            ends.append(states)
        yield pa.RecordBatch.from_arrays([b["conv"], b["chunk"], pa.array(ends, pa.list_(pa.int32()))], schema=schema)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state before each chunk; chunks come in order, one conversation after another."""
    conv, state, begun = None, 0, False
    for b in batches:
        out = []
        for c, ends in zip(b["conv"].to_pylist(), b["ends"].to_pylist(), strict=True):
            if not begun or c != conv:
                conv, state, begun = c, 0, True
            out.append(state)
            state = ends[state]
        yield pa.RecordBatch.from_arrays([b["chunk"], pa.array(out, pa.int32())], ["at", "state"])


_EDIT = "pos long, no int, edit string, as_role string, own boolean"


def _trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each chunk: a row for every kept, reroled, deleted or inserted turn."""
    schema = _arrow(_EDIT)
    for b in batches:
        out: list[tuple] = []
        for chunk, codes, assumed, state, last in zip(*(b[c].to_pylist() for c in ("chunk", "codes", "assumed", "state", "last")), strict=True):
            v, _ = vectors(codes, tuple(assumed))
            for i, c in enumerate(codes):
                edits, s = step(c, v[i + 1], state)
                if last and i == len(codes) - 1:
                    edits += "I" * (END[s] // INSERT)
                for no, e in enumerate(edits):
                    turn = e in "IR"
                    role = ("user" if NEXT[state] == USER else "assistant") if turn else None
                    state = NEXT[state] if turn else KEEP[c >> 2][state] if e == "K" else state
                    out.append((chunk + i, no, e, role, e != "I"))
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out, strict=True)) or [[]] * 5, schema, strict=True)], schema=schema)


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """``rows(conv, turn, role, text)`` to ``(turns, conversations)``. ``turns``: the edits in order, ``conv, pos, no, edit,
    role, text``, where deleted rows have their own role and text and edit ``D``, all others are the repaired conversation.
    ``conversations``: ``conv, gaps, blank, duplicate, truncated, illegal, cost``. ``chunk`` must be a power of two, 2^33 at most."""
    session(rows)
    bits = chunk.bit_length() - 1
    if chunk != 1 << bits or bits > 33:
        raise ValueError("chunk must be a power of two up to 2^33")
    trimmed = F.rtrim(F.col("text"), F.lit(WHITE))
    initial = F.substring("role", 1, 1)
    cls = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    fault = F.when(trimmed == "", 2).when(F.substring(trimmed, -1, 1).isin(".", "!", "?"), 0).otherwise(1)
    kept = written(rows.select(F.monotonically_increasing_id().alias("uid"), "conv", "turn", "role", "text", cls.cast("int").alias("class"),
                               fault.cast("int").alias("fault"), F.xxhash64("text").alias("hash"),
                               F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256).alias("digest")), "repair-rows")
    order = ["conv", "turn", "role", "prefix", "hash", "uid"]
    light = kept.select("uid", "conv", "turn", "role", F.substring("text", 1, 64).alias("prefix"), "hash", "class", "fault", "digest")
    numbered = written(light.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("pos"), "uid", "conv", "turn", "class", "fault", "digest"), "repair-order")
    first = numbered.groupBy("conv", "digest").agg(F.min("pos").alias("first")).select("first")
    code = F.col("class") * 4 + F.when((F.col("fault") != 2) & F.col("first").isNull(), 3).otherwise(F.col("fault"))
    coded = numbered.join(first, F.col("pos") == F.col("first"), "left").select("pos", "conv", "turn", code.alias("code"), F.shiftright("pos", bits).alias("block"))
    raw = written(coded.groupBy("block").applyInArrow(_segments, _SEGMENT), "repair-segments")
    inside = Window.partitionBy("conv").orderBy("chunk")
    linked = raw.withColumns({"next": F.lead("chunk").over(inside), "prev": F.lag("chunk").over(inside),
                              "prev_class": F.lag("last_class").over(inside), "prev_turn": F.lag("last_turn").over(inside)})
    done = written(settled(linked), "repair-settled")

    several = done.filter("next is not null or prev is not null").select("conv", "chunk", "codes", "assumed")
    states = (several.mapInArrow(_maps, "conv long, chunk long, ends array<int>").repartition("conv").sortWithinPartitions("conv", "chunk")
              .mapInArrow(_chain, "at long, state int"))
    edits = done.join(states, F.col("chunk") == F.col("at"), "left").select(
        "chunk", "codes", "assumed", F.coalesce("state", F.lit(0)).alias("state"), F.col("next").isNull().alias("last")).mapInArrow(_trace, _EDIT)
    place = numbered.select(F.col("pos").alias("row_pos"), "uid")
    turns = (edits.join(place, F.col("pos") == F.col("row_pos")).select("uid", "pos", "no", "edit", "as_role", "own")
             .join(kept.select(F.col("uid").alias("row_uid"), "conv", "role", "text"), F.col("uid") == F.col("row_uid"))
             .select("conv", "pos", "no", "edit", F.coalesce("as_role", "role").alias("role"), F.when(F.col("own"), F.col("text")).otherwise("").alias("text")))

    odd = F.col("prev_class").isNotNull() & ~F.concat("prev_class", "first_class").isin("12", "23", "32")
    stats = done.groupBy("conv").agg(
        F.greatest(F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - (F.coalesce(F.col("prev_turn") == F.col("first_turn"), F.lit(False))).cast("long")), F.lit(0)),
                   F.lit(0)).cast("long").alias("gaps"),
        *(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")), F.sum(F.col("illegal") + odd.cast("long")).alias("illegal"),
        (F.sum("gain") + F.sum(F.when(F.col("prev").isNull(), F.col("start")[0]))).cast("long").alias("cost"))
    return turns, stats


_PIECE = "conv long, at long, at_no int, audit string, lines long, body binary, sha string"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order to pieces of conversations: complete ones with their hash, and slices of those that
    may go on in another partition or are long."""
    schema = _arrow(_PIECE)
    # Of the first conversation of a partition the beginning may lie in another one, of the last the end.
    conv, begun, whole = None, False, False
    edits, lines, size, at = [], [], 0, (None, None)

    def piece(complete: bool) -> pa.RecordBatch:
        body = b"\n".join(lines)
        row = [conv, *at, "".join(edits), len(lines), None if complete else body, hashlib.sha256(body).hexdigest() if complete else None]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

    for b in batches:
        for c, pos, no, edit, role, text in zip(*(b[x].to_pylist() for x in ("conv", "pos", "no", "edit", "role", "text")), strict=True):
            if not begun or c != conv:
                if edits:
                    yield piece(whole)
                conv, whole, begun, edits, lines, size = c, begun, True, [], [], 0
            if not edits:
                at = pos, no
            edits.append(edit)
            size += 1
            if edit != "D":
                lines.append(role + b":" + text)
                size += len(lines[-1])
            if size >= SLICE:
                yield piece(False)
                whole, edits, lines, size = False, [], [], 0
    if edits:
        yield piece(False)


def _stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices in order, one conversation after another, to its audit and hash."""
    conv, begun, audit, sha, any_line = None, False, [], hashlib.sha256(), False

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array(["".join(audit)], pa.string()), pa.array([sha.hexdigest()], pa.string())],
                                          ["conv", "audit", "sha"])

    for b in batches:
        for c, text, lines, body in zip(*(b[x].to_pylist() for x in ("conv", "audit", "lines", "body")), strict=True):
            if not begun or c != conv:
                if begun:
                    yield row()
                conv, begun, audit, sha, any_line = c, True, [], hashlib.sha256(), False
            audit.append(text)
            if lines:
                sha.update(b"\n" * any_line + body)
                any_line = True
    if begun:
        yield row()


def digests(turns: DataFrame) -> DataFrame:
    """``conv, audit, sha``: the edits' initials in order, and the hash of the repaired ``role:text`` lines."""
    session(turns)
    order = ["conv", "pos", "no"]
    parts = written(turns.select("conv", "pos", "no", "edit", F.col("role").cast("binary").alias("role"), F.col("text").cast("binary").alias("text"))
                    .repartitionByRange(*order).sortWithinPartitions(*order)
                    .mapInArrow(_slices, _PIECE), "repair-parts")
    rest = (parts.filter("sha is null").repartition("conv").sortWithinPartitions("conv", "at", "at_no").mapInArrow(_stitch, "conv long, audit string, sha string"))
    return parts.filter("sha is not null").select("conv", "audit", "sha").unionByName(rest)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    turns, stats = repair(damaged(conversations))
    d = digests(turns).withColumnRenamed("conv", "d_conv")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return (every.join(stats, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
            .join(d, F.col("conv_id").eqNullSafe(F.col("d_conv")), "left")
            .select("conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
                    F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")))
