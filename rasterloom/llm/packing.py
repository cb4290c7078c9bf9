"""Best-fit packing of documents into token sequences by a grouping genetic algorithm.

A document's tokens and an end token make its length. Only a document longer than a sequence is cut, into
sequence-long pieces behind a first piece that takes the rest. Pieces are dealt by a hash (or, where the rows
have an order to keep, in runs of that order) into cells of about ``CELL`` pieces. Each cell is evolved on
``ISLANDS`` islands, which are groups of their own for the cluster: an island starts from best-fit solutions
over differently shaken orders; a crossover copies one parent, injects whole well-filled bins of the other,
takes out the bins that now hold a piece twice, and puts their displaced pieces back best fit, largest first.
After each round an island's elite moves on to the next island by a shuffle. Fitness is fewer bins, then the
sum of squared fills.

How it scales: a text is read once and only lengths move; a cell holds about ``CELL`` numbers whatever the
input; no cell depends on another, each leaves at most about one bin ill filled.

Defined results: a null text is empty and has one piece, its end token; a null id is kept; repeated rows are
packed each; an empty table gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut
from .tokens import Encoder

LENGTH = 2_048
END_ID = 0
CELL = 8_192
ISLANDS = 3
ROUNDS = 3
POPULATION = 3
CHILDREN = 4
WELL_FILLED = 0.995
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, cell_key long"


def pieces(docs: DataFrame, id_col: str, text_col: str, length: int, end_id: int, vocabulary: str | None, cell_key: Column | None) -> DataFrame:
    """A row a piece, texts left behind."""
    encoder = Encoder(vocabulary)

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for doc, text, key in zip(b.doc_id.array, b.text.array, b.cell_key.array):
                ids = np.append(encoder.ids(text if isinstance(text, str) else ""), np.uint32(end_id)).astype("<u4")
                first = (len(ids) - 1) % length + 1
                ends = [*range(first, len(ids) + 1, length)]
                at = 0
                for i, end in enumerate(ends):
                    out.append((doc, i, at, end - at, zlib.crc32(ids[at:end].tobytes()), key))
                    at = end
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32", "cell_key"]).astype({"doc_id": "Int64", "cell_key": "Int64"})

    chosen = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
        (cell_key if cell_key is not None else F.lit(None)).cast("long").alias("cell_key"),
    )
    return chosen.mapInPandas(encode, PIECE)


def best_fit(items: list[int], lengths: np.ndarray, room: list[tuple[int, int]], of: np.ndarray, n_bins: int, length: int) -> int:
    """Put ``items`` in order into the fullest bin that takes them; ``room`` holds (free, bin) sorted."""
    for i in items:
        size = int(lengths[i])
        k = bisect_left(room, (size, -1))
        if k < len(room):
            free, b = room.pop(k)
        else:
            free, b = length, n_bins
            n_bins += 1
        of[i] = b
        if free > size:
            insort(room, (free - size, b))
    return n_bins


def fitness(of: np.ndarray, lengths: np.ndarray, length: int) -> tuple[int, float]:
    fill = np.bincount(of, weights=lengths)
    fill = fill[fill > 0]
    return -len(fill), float(((fill / length) ** 2).sum())


def shaken(lengths: np.ndarray, length: int, rng: np.random.Generator, noise: float) -> np.ndarray:
    """A best-fit solution over lengths that fall, but for some noise."""
    order = np.argsort(-(lengths * (1 + noise * rng.standard_normal(len(lengths)))), kind="stable")
    of = np.empty(len(lengths), dtype=np.int32)
    best_fit(order.tolist(), lengths, [], of, 0, length)
    return of


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, length: int, rng: np.random.Generator) -> np.ndarray:
    """``a`` with whole well-filled bins of ``b`` injected; displaced pieces go back best fit."""
    fill = np.bincount(b, weights=lengths)
    good = np.flatnonzero(fill >= WELL_FILLED * length)
    ill = np.bincount(a, weights=lengths, minlength=1) < WELL_FILLED * length
    if not len(good):
        return a.copy()
    # Good bins that hold pieces which `a` has in ill-filled bins gain most; some at random beside them.
    gain = np.bincount(b, weights=ill[a], minlength=len(fill))[good]
    share = rng.uniform(0.02, 0.2)
    chosen = np.zeros(len(fill), dtype=bool)
    chosen[good[np.argsort(-(gain + rng.random(len(good))), kind="stable")[: max(1, int(share * len(good)))]]] = True
    injected = chosen[b]
    broken = np.zeros(int(a.max()) + 1, dtype=bool)
    broken[a[injected]] = True
    displaced = np.flatnonzero(broken[a] & ~injected)
    child = np.full(len(a), -1, dtype=np.int32)
    stay = ~broken[a]
    _, child[stay] = np.unique(a[stay], return_inverse=True)
    n = int(child.max(initial=-1)) + 1
    _, new = np.unique(b[injected], return_inverse=True)
    child[injected] = new + n
    n = int(child.max(initial=-1)) + 1
    placed = child >= 0
    free = length - np.bincount(child[placed], weights=lengths[placed], minlength=n).astype(np.int64)
    room = sorted((int(f), int(k)) for k, f in enumerate(free) if f)
    best_fit(displaced[np.argsort(-lengths[displaced], kind="stable")].tolist(), lengths, room, child, n, length)
    return child


def evolve(lengths: np.ndarray, elites: list[np.ndarray], seed: int, length: int = LENGTH) -> np.ndarray:
    """The island's best solution after one round."""
    rng = np.random.default_rng(seed)
    people = [e.astype(np.int32) for e in elites]
    while len(people) < POPULATION:
        people.append(shaken(lengths, length, rng, 0.0 if not people and seed % ISLANDS == 0 else 0.03))
    people.sort(key=lambda p: fitness(p, lengths, length), reverse=True)
    least = -(-int(lengths.sum()) // length)
    for _ in range(CHILDREN):
        if -fitness(people[0], lengths, length)[0] <= least:
            break  # no solution has fewer bins
        i, j = rng.choice(len(people), 2, replace=False)
        child = crossover(people[min(i, j)], people[max(i, j)], lengths, length, rng)
        people.append(child)
        people.sort(key=lambda p: fitness(p, lengths, length), reverse=True)
        people.pop()
    return people[0]


def _island(length: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        cell, island, round_no = key
        lengths = np.frombuffer(rows.lengths.iat[0], dtype="<i4")
        elites = [np.frombuffer(e, dtype="<i4") for e in rows.sort_values("source").elite if e is not None]
        best = evolve(lengths, elites, (hash((int(cell), int(round_no))) & 0xFFFFFF) * ISLANDS + int(island), length)
        bins, squares = fitness(best, lengths, length)
        return pd.DataFrame([(cell, island, rows.lengths.iat[0], best.astype("<i4").tobytes(), bins, squares)])

    return run


def _deal(length: int):
    """The winner's bins as a sequence and an offset for each piece, in the cell's order."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for cell, raw, won in zip(b.cell, b.lengths, b.elite):
                lengths, of = np.frombuffer(raw, dtype="<i4"), np.frombuffer(won, dtype="<i4")
                order = np.argsort(of, kind="stable")
                before = np.cumsum(lengths[order]) - lengths[order]
                starts = np.flatnonzero(np.r_[True, np.diff(of[order]) != 0])
                offset = np.empty(len(of), dtype=np.int64)
                offset[order] = before - np.repeat(before[starts], np.diff(np.r_[starts, len(of)]))
                yield pd.DataFrame({"cell": cell, "idx": np.arange(len(of), dtype=np.int32), "sequence_id": (int(cell) << 24) + of.astype(np.int64), "offset": offset})

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, vocabulary: str | None = None, cell_key: Column | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    ``cell_key``: which rows to pack together, a number that few thousand rows share; None: by a hash.
    """
    all_pieces = cut(pieces(docs, id_col, text_col, length, end_id, vocabulary, cell_key), "pack-pieces")
    n = all_pieces.count()
    cells = max(1, -(-n // CELL))
    identity = F.xxhash64("doc_id", "piece", "ids_crc32", "length")
    cell = F.coalesce("cell_key", F.pmod(identity, F.lit(cells)))
    inside = Window.partitionBy("cell").orderBy(F.desc("length"), identity, "doc_id", "piece")
    placed = cut(all_pieces.withColumn("cell", cell).withColumn("idx", (F.row_number().over(inside) - 1).cast("int")).drop("cell_key"), "pack-cells")

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(key[0], rows.sort_values("idx").length.to_numpy().astype("<i4").tobytes())])

    # A cell or an island is much work for few bytes: as many tasks as partitions, whatever the bytes.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lengths = placed.select("cell", "idx", "length").repartition(parts, "cell").groupBy("cell").applyInPandas(gather, "cell long, lengths binary")
    state = lengths.select("cell", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)])).alias("island"), "lengths", F.lit(None).cast("binary").alias("elite"))
    state = state.withColumn("source", F.col("island"))
    for round_no in range(ROUNDS):
        best = state.repartition(parts, "cell", "island").groupBy("cell", "island", F.lit(round_no).alias("round")).applyInPandas(
            _island(length), "cell long, island int, lengths binary, elite binary, bins long, squares double"
        )
        own = best.withColumn("source", F.col("island"))
        targets = F.array(F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS)))
        state = own.select("cell", F.explode(targets).alias("island"), "lengths", "elite", "source")
    winner = best.groupBy("cell").agg(F.max_by(F.struct("lengths", "elite"), F.struct("bins", "squares", F.negate("island"))).alias("w"))
    dealt = winner.select("cell", "w.lengths", "w.elite").mapInPandas(_deal(length), "cell long, idx int, sequence_id long, offset long")
    return placed.join(dealt, ["cell", "idx"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
