"""Best-fit packing by a grouping genetic algorithm, on islands.

A packing is a set of bins, and a bin is what is inherited. Crossover of two packings takes whole well-filled bins from
one, puts them into the other, takes out the bins there that hold a document twice, and puts the other documents of
these bins, longest first, each where it fits best. Mutation takes out the emptiest bin and a few more and
puts their documents back in the same way. Fitter is who has fewer bins, then who has fuller ones (sum of squared fills).

Pieces are dealt by hash into groups of about ``GROUP_PIECES``. Each group is evolved on several islands: rows of a table, (group,
island, population), that any task can take up. In an epoch every island breeds; then its elite, its best packing, migrates
to the next island of the group. An epoch's table is written to the shared folder, so a lost executor costs its tasks of that epoch. A
group stops as soon as it has as few bins as a lower bound says (Martello and Toth's L2) with all its room in one of them, the
others after ``EPOCHS``.

What a group can't fill is not its last word: bins with more than ``LOOSE`` room are dissolved, and their documents
are dealt into new groups on the next level, until one group is left or a level gains nothing. So the loss doesn't
grow with the number of groups.

Ids are those of the ``tokenizers`` library without added special tokens, special strings in a text as its default
has them, and one separator id behind a document. Only documents longer than a sequence are cut.

Defined results: a null text counts as empty, so its document is the separator alone; repeated rows are documents of their
own; an empty table gives an empty table; only ``doc_id`` and ``text`` are read, other columns don't matter. Random numbers are
seeded; the deal depends on how the input is split into tasks, so another split gives another packing, equally good.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import nonnull_text, session, table, written
from .op10_packing import encoder

LENGTH = 2048
SEPARATOR = 0
GROUP_PIECES = 1024
ISLANDS = 2
POPULATION = 4
EPOCHS = 4
OFFSPRING = 8
SEED = 29
#: Share of a sequence that may stay empty in a bin that is kept.
LOOSE = 0.02
#: Share of its bins that a packing gives into a crossover at most.
GIVEN = 0.5
BATCH_ROWS = 4096
#: Distinct units of text that a worker remembers, about 200 bytes each.
MEMO_UNITS = 600_000


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, length: int = LENGTH, separator: int = SEPARATOR, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; ``with_ids`` adds the ids (binary, unsigned 32-bit little-endian)."""
    path = tokenizer or default_tokenizer()
    session(documents)
    end = np.array([separator], dtype="<u4").tobytes()
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
    names = [f.split()[0] for f in PIECE.split(", ")] + ["ids"] * with_ids

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [[]] * len(kinds), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, out = encoder(path, MEMO_UNITS), []
        for b in batches:
            for doc, ids in zip(b.column(0).to_pylist(), enc.encode(b.column(1))):
                raw = ids.tobytes() + end
                for k, a in enumerate(range(0, len(raw), 4 * length)):
                    part = raw[a:a + 4 * length]
                    out.append((doc, k, a // 4, len(part) // 4, zlib.crc32(part)) + (part,) * with_ids)
                if len(out) >= BATCH_ROWS:
                    yield batch(out)
                    out = []
        yield batch(out)

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), nonnull_text().alias("text")).mapInArrow(run, PIECE + ", ids binary" * with_ids)


class Packing:
    """Bins of item numbers with their fills."""

    __slots__ = ("bins", "fills")

    def __init__(self, bins: list[list[int]], fills: list[int]):
        self.bins, self.fills = bins, fills

    def fitness(self) -> tuple[int, int]:
        """Less is fitter."""
        return len(self.bins), -sum(f * f for f in self.fills)

    def loose(self, length: int) -> int:
        return sum(f < (1 - LOOSE) * length for f in self.fills)

    def assignment(self, n: int) -> np.ndarray:
        out = np.zeros(n, "<i4")
        for b, items in enumerate(self.bins):
            out[items] = b
        return out


def packing(assignment: np.ndarray, lengths: list[int]) -> Packing:
    bins: list[list[int]] = [[] for _ in range(int(assignment.max()) + 1 if len(assignment) else 0)]
    for i, b in enumerate(assignment.tolist()):
        bins[b].append(i)
    return Packing(bins, [sum(lengths[i] for i in x) for x in bins])


def best_fit(p: Packing, items: list[int], lengths: list[int], length: int) -> Packing:
    """``items`` in their order, each into the bin where the least room stays, or a new one; changes ``p``."""
    bins, fills = p.bins, p.fills
    rooms = sorted((length - f, b) for b, f in enumerate(fills) if f < length)
    for i in items:
        need = lengths[i]
        at = bisect_left(rooms, (need, -1))
        if at == len(rooms):
            b = len(bins)
            bins.append([i])
            fills.append(need)
        else:
            b = rooms.pop(at)[1]
            bins[b].append(i)
            fills[b] += need
        if fills[b] < length:
            insort(rooms, (length - fills[b], b))
    return p


def longest_first(items: list[int], lengths: list[int]) -> list[int]:
    return sorted(items, key=lambda i: (-lengths[i], i))


def crossover(giver: Packing, taker: Packing, lengths: list[int], length: int, rng: random.Random) -> Packing:
    """``taker`` with some of the best-filled bins of ``giver``."""
    order = sorted(range(len(giver.bins)), key=lambda b: -giver.fills[b])
    best = order[:max(1, int(GIVEN * len(order)))]
    given = rng.sample(best, rng.randint(1, len(best)))
    taken = {i for b in given for i in giver.bins[b]}
    bins, fills, displaced = [list(giver.bins[b]) for b in given], [giver.fills[b] for b in given], []
    for b, items in enumerate(taker.bins):
        if taken.isdisjoint(items):
            bins.append(list(items))
            fills.append(taker.fills[b])
        else:
            displaced += [i for i in items if i not in taken]
    return best_fit(Packing(bins, fills), longest_first(displaced, lengths), lengths, length)


def mutated(p: Packing, lengths: list[int], length: int, rng: random.Random) -> Packing:
    """``p`` without its emptiest bin and a few others, their documents put back."""
    loose = [b for b, f in enumerate(p.fills) if f < length] or list(range(len(p.bins)))
    out = {min(loose, key=lambda b: p.fills[b]), *rng.sample(loose, min(len(loose), rng.randint(1, 4))), *rng.sample(range(len(p.bins)), min(len(p.bins), rng.randint(0, 3)))}
    kept = [b for b in range(len(p.bins)) if b not in out]
    free = longest_first([i for b in out for i in p.bins[b]], lengths)
    if rng.random() < 0.5:  # not always the same order: a short run of neighbours changes places
        a = rng.randrange(len(free))
        free[a:a + 4] = rng.sample(free[a:a + 4], len(free[a:a + 4]))
    return best_fit(Packing([list(p.bins[b]) for b in kept], [p.fills[b] for b in kept]), free, lengths, length)


def lower_bound(lengths: list[int], length: int) -> int:
    """Martello and Toth's L2: for each small size, items too long to share a bin with it and what the rest needs beyond their room."""
    x = np.sort(np.asarray(lengths, np.int64))
    total = np.append(0, np.cumsum(x))
    most = -(-int(total[-1]) // length) if len(x) else 0
    half = int(np.searchsorted(x, length // 2, "right"))
    for small in np.unique(np.append(0, x[:half])).tolist():
        big = int(np.searchsorted(x, length - small, "right"))
        first = int(np.searchsorted(x, small, "left"))
        room = (big - half) * length - int(total[big] - total[half])
        most = max(most, len(x) - half + max(0, -(-(int(total[half] - total[first]) - room) // length)))
    return most


def perfect(p: Packing, length: int, bound: int) -> bool:
    """No packing has fewer bins, and at most one bin is loose."""
    return len(p.bins) <= bound and p.loose(length) <= 1


def founders(lengths: list[int], length: int, rng: random.Random, size: int) -> list[Packing]:
    """Best-fit decreasing, and the same with disturbed orders."""
    first = best_fit(Packing([], []), longest_first(range(len(lengths)), lengths), lengths, length)
    out = [first]
    for k in range(1, size):
        noise = {i: lengths[i] * rng.uniform(1 - 0.1 * k, 1) for i in range(len(lengths))}
        out.append(best_fit(Packing([], []), sorted(range(len(lengths)), key=lambda i: (-noise[i], i)), lengths, length))
    return out


def bred(population: list[Packing], lengths: list[int], length: int, bound: int, rng: random.Random, offspring: int) -> list[Packing]:
    """One epoch: children of pairs picked by tournament take the place of the worst; ends early when one is perfect."""
    population = sorted(population, key=Packing.fitness)
    for _ in range(offspring):
        if perfect(population[0], length, bound):
            break
        pick = lambda: min(rng.sample(population, min(2, len(population))), key=Packing.fitness)
        child = mutated(crossover(pick(), pick(), lengths, length, rng), lengths, length, rng)
        if child.fitness() < population[-1].fitness():
            population[-1] = child
            population.sort(key=Packing.fitness)
    return population


_STATE = "grp long, island int, uids array<long>, lengths array<int>, population array<binary>, bins int, squares long, perfect boolean"


def _state(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("grp", pa.int64()), ("island", pa.int32()), ("uids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())),
                        ("population", pa.list_(pa.binary())), ("bins", pa.int32()), ("squares", pa.int64()), ("perfect", pa.bool_())])
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * 8, schema, strict=True)], schema=schema)


def _row(grp, island, uids, lengths, population: list[Packing], length: int, bound: int) -> tuple:
    return (grp, island, uids, lengths, [p.assignment(len(lengths)).tobytes() for p in population], *population[0].fitness(),
            perfect(population[0], length, bound))


def evolved(groups: DataFrame, length: int, islands: int, population: int, epochs: int, offspring: int, seed: int) -> DataFrame:
    """``groups(grp, uids, lengths)`` to each group's best packing: ``grp, uids, lengths, best``."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, island, uids, lengths in zip(*(b[c].to_pylist() for c in ("grp", "island", "uids", "lengths")), strict=True):
                order = sorted(range(len(uids)), key=lambda i: uids[i])
                uids, lengths = [uids[i] for i in order], [lengths[i] for i in order]
                rng = random.Random(f"{seed} {grp} {island}")
                bound = lower_bound(lengths, length)
                first = founders(lengths, length, rng, 1)
                if not perfect(first[0], length, bound):
                    first += founders(lengths, length, rng, population)[1:]
                yield _state([_row(grp, island, uids, lengths, sorted(first, key=Packing.fitness), length, bound)])

    def breed(epoch: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for grp, island, uids, lengths, members, elite in zip(
                        *(b[c].to_pylist() for c in ("grp", "island", "uids", "lengths", "population", "elite")), strict=True):
                    rng = random.Random(f"{seed} {grp} {island} {epoch}")
                    bound = lower_bound(lengths, length)
                    own = [packing(np.frombuffer(m, "<i4"), lengths) for m in members]
                    if elite is not None:  # the guest takes the place of the worst
                        own = own[:max(1, population - 1)] + [packing(np.frombuffer(elite, "<i4"), lengths)]
                    yield _state([_row(grp, island, uids, lengths, bred(own, lengths, length, bound, rng, offspring), length, bound)])
        return run

    state = written(groups.select("grp", F.explode(F.array(*map(F.lit, range(islands)))).alias("island"), "uids", "lengths").mapInArrow(found, _STATE), "grouping-0")
    ended = []
    for epoch in range(1, epochs + 1):
        over = state.groupBy("grp").agg(F.bool_or("perfect").alias("over")).filter("over").select("grp")
        ended.append(state.join(over, "grp", "left_semi"))
        going = state.join(over, "grp", "left_anti")
        elites = going.select(F.col("grp").alias("e_grp"), F.pmod(F.col("island") + 1, F.lit(islands)).alias("e_island"), F.col("population")[0].alias("elite"))
        guests = going.join(elites, (F.col("grp") == F.col("e_grp")) & (F.col("island") == F.col("e_island")) & F.lit(islands > 1), "left")
        state = written(guests.mapInArrow(breed(epoch), _STATE), f"grouping-{epoch}")
        if state.isEmpty():
            break
    for part in ended:
        state = state.unionByName(part)
    first = Window.partitionBy("grp").orderBy("bins", "squares", "island")
    return state.withColumn("n", F.row_number().over(first)).filter("n = 1").select("grp", "uids", "lengths", F.col("population")[0].alias("best"))


_PLACE = "uid long, bin long, offset long, fill long"


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items of the best packings with their bins, places and the bin's fill."""
    for b in batches:
        for grp, uids, lengths, best in zip(*(b[c].to_pylist() for c in ("grp", "uids", "lengths", "best")), strict=True):
            p, cols = packing(np.frombuffer(best, "<i4"), lengths), [[], [], [], []]
            for k, items in enumerate(p.bins):
                at = 0
                for i in items:
                    for c, x in zip(cols, (uids[i], (grp << 24) + k, at, p.fills[k])):
                        c.append(x)
                    at += lengths[i]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["uid", "bin", "offset", "fill"])


def _count(places: DataFrame) -> int:
    return places.filter("offset = 0").count()


def pack(documents: DataFrame, length: int = LENGTH, separator: int = SEPARATOR, group_pieces: int = GROUP_PIECES, islands: int = ISLANDS,
         population: int = POPULATION, epochs: int = EPOCHS, offspring: int = OFFSPRING, seed: int = SEED, tokenizer: str | None = None,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: where it lies in its document and in which sequence."""
    found = written(pieces(documents, length, separator, tokenizer, with_ids).withColumn("uid", F.monotonically_increasing_id()), "grouping-pieces")
    # A full piece is a sequence; nothing else is decided for it.
    done = found.filter(F.col("length") == length).select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = found.filter(F.col("length") < length).select("uid", F.col("length").cast("int").alias("length"))
    left, level, loose = rest.count(), 0, None
    while left:
        n = -(-left // group_pieces)
        groups = (rest.withColumn("grp", F.pmod(F.xxhash64("uid", F.lit(seed + level)), F.lit(n))).groupBy("grp")
                  .agg(F.collect_list(F.struct("uid", "length")).alias("x")).select("grp", F.col("x.uid").alias("uids"), F.col("x.length").alias("lengths")))
        best = evolved(groups, length, islands, population, epochs, offspring, seed + level)
        places = written(best.mapInArrow(_places, _PLACE).withColumn("sequence_id", F.lit(level << 56) + F.col("bin")), f"grouping-level-{level}")
        if loose is not None and _count(places) >= _count(loose):  # nothing gained: the loose bins stay as they were
            break
        loose = places.filter(F.col("fill") < (1 - LOOSE) * length)
        done = done.unionByName(places.filter(F.col("fill") >= (1 - LOOSE) * length).select(done.columns))
        before, left = left, loose.count()
        if n == 1 or 2 * left > before:  # one group, or nearly all bins are loose: dealing them anew would change little
            break
        rest = loose.join(found.select(F.col("uid").alias("of"), F.col("length").cast("int").alias("length")), F.col("uid") == F.col("of")).select("uid", "length")
        level += 1
    if loose is not None:
        done = done.unionByName(loose.select(done.columns))
    at = done.withColumnRenamed("uid", "at")
    return found.join(at, F.col("uid") == F.col("at")).drop("uid", "at")


def op13_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
