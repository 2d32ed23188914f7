"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

A document is its ids and an end id; longer ones than a sequence are cut into whole sequences and a rest. Pieces are
dealt into shards of about `SHARD` pieces. Each shard has `ISLANDS` populations, which start from best fits of the
pieces in random orders and evolve apart in tasks of their own: a crossover puts whole well-filled bins of one parent
into the other, removes the bins that hold a piece twice, and best-fits the displaced pieces, largest first. Between
epochs each island's elite moves to the next island. A population that has reached the least possible number of bins
rests. Full pieces need no search and are sequences of their own.

Of a shard's best packing all bins but the worst-filled are final. Those, `OPEN` of them, are dissolved, their pieces
are dealt into fewer shards and evolve again, until one shard holds what is left: so space is not lost at the borders
of shards. Every round has about that share of the pieces of the one before.

Only lengths take part in the search; ids are reduced to checksums as they are made. Pieces have row numbers of their
own, so that repeated rows are dealt out like others. All random numbers derive from round, shard, island and epoch,
so that a task run again gives the same packing.

Defined cases: null and empty texts are the end id alone; repeated rows are packed again, each once; ties go by row
number; a null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from random import Random

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, partitions_for, slices, stored
from .tokenise import SLICE_BYTES, encoder, vocabulary_path

VOCABULARY = "word_bpe_49k.json"
#: Tokens of a sequence and the id that ends each document.
CAPACITY, END = 2048, 0
#: Pieces of a shard, islands of a shard, epochs between migrations, generations of an epoch, packings of an island.
SHARD, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 2048, 2, 2, 6, 4
#: Runs of pieces in which a packing of the first generation is made.
RUNS = 8
#: Most bins of a shard, and of rounds, in the numbering of sequences.
SHARD_BINS, ROUNDS = 1 << 24, 64
#: From this share of the capacity a bin is well filled and may be injected; the worst-filled share of a shard's bins that is packed again.
WELL_FILLED, OPEN = 0.98, 1 / 16

_PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"
_PIECE_TYPES = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """row (a number of its own), doc_id, piece, start, length, ids_crc32: the pieces of every whole text."""
    path = path or vocabulary_path(VOCABULARY)
    mark = np.array([end], np.uint16).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(path).encode, TaskContext.get().partitionId() << 36
        for batch in slices(batches, limit=SLICE_BYTES):
            rows = []
            for doc_id, data in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids = np.frombuffer(data + mark, np.uint16).astype("<u4")
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start : start + capacity]
                    rows.append((row, doc_id, k, start, len(part), zlib.crc32(part)))
                    row += 1
            columns = zip(zip(*rows, strict=True), _PIECE_TYPES, _PIECES.split(", "), strict=True)
            yield pa.RecordBatch.from_pydict({name.split()[0]: pa.array(c, kind) for c, kind, name in columns})

    return documents(docs, "doc_id", "text").mapInArrow(run, _PIECES)


class Packing:
    """Bins of piece numbers, with their fills."""

    def __init__(self, bins: list[list[int]], lengths: list[int]):
        self.bins, self.fills = bins, [sum(lengths[i] for i in b) for b in bins]

    def cost(self) -> tuple[int, float]:
        """Fewer bins first, then the sum of the fills' squares (higher is better)."""
        return len(self.bins), -sum(f * f for f in self.fills)

    def genes(self, n: int) -> np.ndarray:
        out = np.zeros(n, np.int32)
        for k, b in enumerate(self.bins):
            out[b] = k
        return out

    @staticmethod
    def of(genes: np.ndarray, lengths: list[int]) -> Packing:
        order = np.argsort(genes, kind="stable")
        cuts = np.flatnonzero(np.diff(genes[order])) + 1
        return Packing([x.tolist() for x in np.split(order, cuts)] if len(order) else [], lengths)


def best_fit(bins: list[list[int]], fills: list[int], loose: list[int], lengths: list[int], capacity: int) -> None:
    """Puts each loose piece, largest first, where the least room stays; opens a bin only where none has room."""
    room = sorted((capacity - f, k) for k, f in enumerate(fills))
    for i in sorted(loose, key=lambda i: (-lengths[i], i)):
        at = bisect_left(room, (lengths[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
            fills[k] += lengths[i]
        else:
            left, k = capacity, len(bins)
            bins.append([i])
            fills.append(lengths[i])
        insort(room, (left - lengths[i], k))


def crossover(a: Packing, b: Packing, lengths: list[int], capacity: int, draw: Random) -> Packing:
    """A child of `a` with some of `b`'s well-filled bins."""
    good = [k for k, f in enumerate(b.fills) if f >= WELL_FILLED * capacity] or [max(range(len(b.fills)), key=b.fills.__getitem__)]
    taken = draw.sample(good, max(1, int(len(good) * draw.uniform(0.1, 0.6))))
    inside = {i for k in taken for i in b.bins[k]}
    bins, fills, loose = [list(b.bins[k]) for k in taken], [b.fills[k] for k in taken], []
    for members, fill in zip(a.bins, a.fills, strict=True):
        if inside.isdisjoint(members):
            bins.append(list(members))
            fills.append(fill)
        else:
            loose += [i for i in members if i not in inside]
    best_fit(bins, fills, loose, lengths, capacity)
    return Packing(bins, lengths)


def mutate(a: Packing, lengths: list[int], capacity: int, draw: Random) -> Packing:
    """Empties the worst-filled bins and a few others, and best-fits their pieces."""
    worst = sorted(range(len(a.bins)), key=lambda k: (a.fills[k], k))
    gone = set(worst[: max(1, len(worst) // 20)]) | set(draw.sample(worst, max(1, len(worst) // 20)))
    bins = [list(x) for k, x in enumerate(a.bins) if k not in gone]
    fills = [f for k, f in enumerate(a.fills) if k not in gone]
    best_fit(bins, fills, [i for k in sorted(gone) for i in a.bins[k]], lengths, capacity)
    return Packing(bins, lengths)


def first_population(lengths: list[int], capacity: int, draw: Random, size: int = POPULATION) -> list[Packing]:
    """Best fits of the pieces in random orders: runs of a shuffle, each from its longest piece to its shortest."""
    out = []
    for _ in range(size):
        order = list(range(len(lengths)))
        draw.shuffle(order)
        bins: list[list[int]] = []
        fills: list[int] = []
        for at in range(0, len(order), max(1, len(order) // RUNS)):
            best_fit(bins, fills, order[at : at + max(1, len(order) // RUNS)], lengths, capacity)
        out.append(Packing(bins, lengths))
    return out


def evolve(population: list[Packing], lengths: list[int], capacity: int, draw: Random, generations: int = GENERATIONS) -> list[Packing]:
    """The population after some generations, best first; the best is never lost."""
    least = -(-sum(lengths) // capacity)
    size = max(2, min(POPULATION, len(population)))
    population = sorted(population, key=Packing.cost)
    for _ in range(generations):
        if len(population[0].bins) <= least:
            break
        a, b = draw.sample(population, 2) if len(population) > 1 else (population[0], population[0])
        children = [crossover(a, b, lengths, capacity, draw), crossover(b, a, lengths, capacity, draw), mutate(population[0], lengths, capacity, draw)]
        population = sorted(population + children, key=Packing.cost)[:size]
    return population


_STATE = "shard long, island int, rows binary, lengths binary, genes binary, bins long, squares double"


def _state(shard: int, island: int, rows: bytes, lengths: bytes, population: list[Packing]) -> pd.DataFrame:
    n = len(lengths) // 4
    each = [(shard, island, rows, lengths, p.genes(n).tobytes(), len(p.bins), float(sum(f * f for f in p.fills))) for p in population]
    return pd.DataFrame(each, columns=[x.split()[0] for x in _STATE.split(", ")])


def _search(pool: DataFrame, number: int, shards: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """row, length, sequence (number in this round), offset, worst (of the bins to dissolve): the best packing of each shard."""
    tasks = partitions_for(pool.sparkSession)

    def start(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
        rows, lengths = pdf["row"].to_numpy(np.int64).tobytes(), pdf["length"].to_numpy(np.int32).tobytes()
        return pd.concat([_state(int(pdf["shard"].iloc[0]), k, rows, lengths, [Packing([], [])]) for k in range(islands)])

    def epoch(at: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            shard, island, rows, raw = int(pdf["shard"].iloc[0]), int(pdf["island"].iloc[0]), pdf["rows"].iloc[0], pdf["lengths"].iloc[0]
            lengths = np.frombuffer(raw, np.int32).tolist()
            draw = Random(f"{number} {shard} {island} {at}")
            known = sorted(pdf["genes"][pdf["bins"] > 0])
            population = [Packing.of(np.frombuffer(g, np.int32), lengths) for g in known] or first_population(lengths, capacity, draw)
            return _state(shard, island, rows, raw, evolve(population, lengths, capacity, draw))

        return run

    quality = F.struct("bins", -F.col("squares"), F.xxhash64("genes"))
    everything = ("rows", "lengths", "genes", "bins", "squares")
    state = pool.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards))).groupBy("shard").applyInPandas(start, _STATE)
    for at in range(epochs):
        if at:
            elite = state.groupBy("shard", "island").agg(*[F.min_by(c, quality).alias(c) for c in everything])
            state = state.unionByName(elite.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int")))
        # As many tasks as the session has partitions: the rows are few bytes, but their search takes time.
        state = state.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(epoch(at), _STATE)
        state = stored(state, f"packing-round{number}-epoch{at}")
    best = state.groupBy("shard").agg(*[F.min_by(c, quality).alias(c) for c in ("rows", "lengths", "genes")])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows, lengths, genes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pdf = pd.DataFrame({"row": np.frombuffer(rows, np.int64), "length": np.frombuffer(lengths, np.int32).astype(np.int64), "bin": np.frombuffer(genes, np.int32).astype(np.int64)})
                by = pdf.groupby("bin")["length"]
                fills = by.sum().sort_values(kind="stable")
                worst = fills[fills < capacity].index[: max(2, int(len(fills) * OPEN))]
                pdf = pdf.assign(sequence=shard * SHARD_BINS + pdf["bin"], offset=by.cumsum() - pdf["length"], worst=pdf["bin"].isin(worst))
                yield pa.RecordBatch.from_pandas(pdf[["row", "length", "sequence", "offset", "worst"]], preserve_index=False)

    return best.select("shard", "rows", "lengths", "genes").mapInArrow(place, "row long, length long, sequence long, offset long, worst boolean")


def pack(parts: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """The pieces, as `pieces` gives them, with sequence_id and offset and without row."""
    parts = stored(parts, "pieces")
    full, rest = parts.where(F.col("length") >= capacity), parts.where(F.col("length") < capacity)
    pool, left, number, placed, final = rest.select("row", "length"), rest.count(), 0, None, False
    while left:
        shards = -(-left // shard_rows)
        final |= shards == 1
        found = stored(_search(pool, number, shards, capacity, islands, epochs), f"packing-round{number}")
        number += 1
        is_open = F.lit(not final) & F.col("worst")
        own = found.where(~is_open).select("row", (F.col("sequence") * ROUNDS + number).alias("sequence_id"), "offset")
        placed = own if placed is None else placed.unionByName(own)
        pool = found.where(is_open).select("row", "length")
        before, left = left, 0 if final else pool.count()
        final |= 2 * left > before  # shards of a few bins each, as of many tiny pieces: the next round keeps them all
    alone = full.select("row", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    placed = alone if placed is None else placed.unionByName(alone)
    return parts.join(placed, "row").drop("row")


def packed_sequences(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return pack(pieces(docs, path))
