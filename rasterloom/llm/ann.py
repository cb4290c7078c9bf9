"""Approximate nearest neighbours by learned partitions.

A neighbour graph over a bounded sample is cut into balanced parts that keep neighbours together; a small
classifier learns, for a vector, how its neighbours spread over the parts. In large tables each part is divided
again in the same way, by a graph and a classifier of its own. Every vector is filed under its most probable
leaf, and a query is compared exactly with the vectors of its several most probable leaves.

How many leaves a query visits is not guessed: a bounded number of queries that no classifier was fitted on is
answered by brute force over all vectors, and the visits are the fewest with which those find ``recall`` of their
neighbours.

How it scales: a fit sees about ``SAMPLE`` vectors whatever the input; leaves grow with the table up to
``PARTS`` x ``PARTS``. Equal vectors are one entry that keeps its ``k + 1`` smallest ids (larger ones cannot be
among the ``k`` nearest, as ties go to the smaller id), so copies cost nothing. Neighbouring leaves share a zone
of bounded size, a leaf above that is cut into blocks, and a zone's queries are cut into blocks by their number,
so no task holds more than ``BLOCK_VALUES`` numbers a side, however many ask for one leaf. Blocks grow with the
table, so that entries are copied less for the same comparisons.

Defined results: a vector that is null, zero, or holds a null or non-finite component, or whose id is null,
takes no part; rows that repeat an id and vector count once; an empty table gives no rows; vectors must be of
one length (the most common one counts, others take no part); ties go to the smaller id; further columns are
ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, discard

SAMPLE = 8_192
GRAPH_NEIGHBOURS = 16
CALIBRATION_QUERIES = 256
RECALL = 0.95
PARTS = 128
LEAF_ROWS = 2_048
BLOCK_VALUES = 1 << 21
LEAST_BLOCK = 2_048
SALTS = 16


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For each row the ``k`` others of largest inner product."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), dtype=np.int64)
    for i in range(0, len(x), 1024):
        s = x[i : i + 1024] @ x.T
        s[np.arange(len(s)), np.arange(i, i + len(s))] = -np.inf
        out[i : i + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else 0
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Parts of equal size (but for one row) that cut few edges of the graph.

    Starts from recursive median splits along the leading direction; then rows that have more neighbours in
    another part than in their own are exchanged in pairs between parts, largest gains first.
    """
    rng = np.random.default_rng(seed)
    n = len(x)
    of = np.zeros(n, dtype=np.int64)
    width = 1
    while width < parts:
        nxt = np.empty(n, dtype=np.int64)
        for p in range(width):
            rows = np.flatnonzero(of == p)
            v = rng.standard_normal(x.shape[1])
            y = x[rows] - x[rows].mean(axis=0) if len(rows) else x[rows]
            for _ in range(8):
                v = y.T @ (y @ v)
                v /= np.linalg.norm(v) or 1.0
            order = rows[np.argsort(y @ v, kind="stable")]
            nxt[order[: len(order) // 2]] = 2 * p
            nxt[order[len(order) // 2 :]] = 2 * p + 1
        of, width = nxt, width * 2
    src = np.repeat(np.arange(n), graph.shape[1])
    dst = graph.ravel()
    for _ in range(rounds):
        votes = np.zeros((n, parts), dtype=np.int32)
        np.add.at(votes, (src, of[dst]), 1)
        np.add.at(votes, (dst, of[src]), 1)
        own = votes[np.arange(n), of]
        votes[np.arange(n), of] = -1
        want = votes.argmax(axis=1)
        gain = votes[np.arange(n), want] - own
        moved = 0
        movers = np.flatnonzero(gain > 0)
        movers = movers[np.argsort(-gain[movers], kind="stable")]
        queues: dict[tuple[int, int], list[int]] = {}
        for r in movers:
            queues.setdefault((int(of[r]), int(want[r])), []).append(int(r))
        for (a, b), forth in queues.items():
            if a < b and (back := queues.get((b, a))):
                pairs = min(len(forth), len(back))
                of[forth[:pairs]], of[back[:pairs]] = b, a
                moved += pairs
        if not moved:
            break
    return of


class Classifier:
    """One hidden layer; gives each part's log probability (up to a constant) for a vector."""

    def __init__(self, x: np.ndarray, target: np.ndarray, hidden: int = 128, epochs: int = 20, seed: int = 11):
        rng = np.random.default_rng(seed)
        d, parts = x.shape[1], target.shape[1]
        self.scale = 1.0 / (np.sqrt((x**2).mean()) or 1.0)
        w = [rng.standard_normal((d, hidden)) * np.sqrt(2 / d), np.zeros(hidden), rng.standard_normal((hidden, parts)) * np.sqrt(1 / hidden), np.zeros(parts)]
        m, v, t = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), 256):
                rows = order[i : i + 256]
                y = x[rows] * self.scale
                z = y @ w[0] + w[1]
                h = np.maximum(z, 0)
                o = h @ w[2] + w[3]
                o -= o.max(axis=1, keepdims=True)
                p = np.exp(o)
                p /= p.sum(axis=1, keepdims=True)
                g = (p - target[rows]) / len(rows)
                gh = (g @ w[2].T) * (z > 0)
                t += 1
                for j, grad in enumerate((y.T @ gh, gh.sum(axis=0), h.T @ g, g.sum(axis=0))):
                    m[j] = 0.9 * m[j] + 0.1 * grad
                    v[j] = 0.999 * v[j] + 0.001 * grad**2
                    w[j] = w[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(v[j] / (1 - 0.999**t)) + 1e-8)
        self.w = w

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x * self.scale) @ self.w[0] + self.w[1], 0) @ self.w[2] + self.w[3]


def fit(x: np.ndarray, parts: int, hidden: int = 128) -> Classifier:
    """A classifier of how a vector's neighbours spread over ``parts`` balanced parts of the neighbour graph of ``x``."""
    graph = neighbour_graph(x, GRAPH_NEIGHBOURS)
    of = balanced_parts(x, graph, parts)
    target = np.zeros((len(x), parts))
    np.add.at(target, (np.repeat(np.arange(len(x)), graph.shape[1]), of[graph].ravel()), 1.0)
    target[np.arange(len(x)), of] += 1.0
    return Classifier(x, target / target.sum(axis=1, keepdims=True), hidden)


def log_shares(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


class Router:
    """Log probabilities of leaves: those of the coarse parts, each times its own classifier's where parts are divided."""

    def __init__(self, coarse: Classifier, parts: int, fine: dict[int, Classifier] | None = None, width: int = 1):
        self.coarse, self.parts, self.fine, self.width = coarse, parts, fine or {}, width

    def __call__(self, x: np.ndarray) -> np.ndarray:
        part = log_shares(self.coarse(x))
        if self.width == 1:
            return part
        out = np.full((len(x), self.parts, self.width), -np.inf)
        out[:, :, 0] = part  # of a part without a classifier of its own
        for p, model in self.fine.items():
            out[:, p] = part[:, p, None] + log_shares(model(x))
        return out.reshape(len(x), -1)

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The most probable leaf of the most probable part."""
        part = self.coarse(x).argmax(axis=1)
        out = part * self.width
        for p in np.unique(part):
            if p in self.fine:
                rows = part == p
                out[rows] += self.fine[p](x[rows]).argmax(axis=1)
        return out


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision; equal rows give equal numbers wherever they stand."""
    return np.einsum("ij,ij->i", q, c)


def largest(s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the numbers above -inf that may be among the k largest of their row, rounding aside."""
    m = min(k, s.shape[1])
    least = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
    return np.nonzero((s >= (least - 1e-9 * (1 + np.abs(least)))[:, None]) & (s > -np.inf))


def firsts(group: np.ndarray, k: int) -> np.ndarray:
    """Which places of a sorted array are among the first k of their value."""
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    return np.arange(len(group)) - np.repeat(start, np.diff(np.r_[start, len(group)])) < k


def _entries(vectors: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """h1, h2, vector, ids: a row for each distinct vector with its k + 1 smallest ids."""
    v = F.col(vector_col).cast("array<double>")
    good = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(
        "id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(vector, x -> x != 0)"
    )
    keyed = good.select("id", "vector", F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(5), "vector").alias("h2"))
    keyed = cut(keyed, "ann-vectors")
    length = keyed.groupBy(F.size("vector").alias("l")).count().orderBy(F.desc("count"), "l").first()
    keyed = keyed.where(F.size("vector") == F.lit(length[0] if length else 0))
    for part in (["h1", "h2", F.pmod(F.xxhash64("id"), F.lit(SALTS))], ["h1", "h2"]):
        window = Window.partitionBy(*part).orderBy("id")
        keyed = keyed.withColumn("rn", F.row_number().over(window)).where(F.col("rn") <= k + 1).drop("rn")
    return keyed.groupBy("h1", "h2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_set("id")).alias("ids"))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def _learn(entries: DataFrame, n: int, x: np.ndarray, leaf_rows: int) -> Router:
    """A router of parts, and of parts of parts where parts would have more than twice ``leaf_rows`` entries."""
    spark = entries.sparkSession
    parts = 1 << int(np.clip(np.log2(max(1, n / 256)), 0, np.log2(PARTS)))
    coarse = Router(fit(x, parts), parts)
    width = 1 << int(np.clip(np.log2(max(1, n / parts / leaf_rows)), 0, np.log2(PARTS)))
    if width == 1:
        return coarse
    shared = spark.sparkContext.broadcast(coarse)

    def part_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield pd.DataFrame({"h1": b.h1, "vector": b.vector, "part": shared.value.leaf(_matrix(b.vector))})

    filed = cut(entries.select("h1", "vector").mapInPandas(part_of, "h1 long, vector array<double>, part int"), "ann-parts")
    sizes = {r[0]: r[1] for r in filed.groupBy("part").count().collect()}  # a row a part
    share = F.array(*[F.lit(min(1.0, SAMPLE / max(1, sizes.get(p, 0)))) for p in range(parts)])
    drawn = filed.where(F.pmod(F.xxhash64(F.lit(9), "h1"), F.lit(1 << 30)) < F.element_at(share, F.col("part") + 1) * (1 << 30))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        model = fit(_matrix(rows.sort_values("h1").vector), width, hidden=64)
        model.w = [a.astype(np.float32) for a in model.w]
        return pd.DataFrame({"part": [int(rows.part.iat[0])], "model": [pickle.dumps(model)]})

    models = drawn.groupBy("part").applyInPandas(learn, "part int, model binary").collect()  # a row a part, 256 x (length + 128) bytes
    discard(filed)
    return Router(coarse.coarse, parts, {r[0]: pickle.loads(r[1]) for r in models}, width)


def _visits(entries: DataFrame, router: Router, probe: pd.DataFrame, k: int, recall: float) -> int:
    """The fewest leaves with which the probes find ``recall`` of their ``k`` nearest, by brute force over all entries."""
    q, h1, h2 = _matrix(probe.vector), probe.h1.to_numpy(), probe.h2.to_numpy()
    shared = entries.sparkSession.sparkContext.broadcast(router)

    def brute(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 4096):
                c = b.iloc[i : i + 4096]
                v = _matrix(c.vector)
                s = q @ v.T
                s[(c.h1.to_numpy() == h1[:, None]) & (c.h2.to_numpy() == h2[:, None])] = -np.inf
                r, j = largest(s, k)
                yield pd.DataFrame({"q": r, "score": s[r, j], "leaf": shared.value.leaf(v)[j]})

    found = entries.select("h1", "h2", "vector").mapInPandas(brute, "q int, score double, leaf int")
    best = Window.partitionBy("q").orderBy(F.desc("score"))
    found = found.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k).select("q", "leaf").toPandas()
    if not len(found):
        return 1
    place = np.argsort(np.argsort(-router(q), axis=1, kind="stable"), axis=1)
    ranks = np.sort(place[found.q.to_numpy(), found.leaf.to_numpy()])
    return int(ranks[int(np.ceil(recall * len(ranks))) - 1]) + 1


def nearest(
    vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL, leaf_rows: int = LEAF_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of each row for which ``is_query`` holds.

    ``is_query`` is a condition on the column ``id``.
    """
    spark = vectors.sparkSession
    entries = cut(_entries(vectors, id_col, vector_col, k), "ann-entries")
    n = entries.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = entries.orderBy(F.xxhash64("h2"), "h1", "h2").limit(SAMPLE + CALIBRATION_QUERIES).toPandas()
    held = CALIBRATION_QUERIES if len(sample) >= 8 * CALIBRATION_QUERIES else 0
    x = _matrix(sample.vector.iloc[: len(sample) - held])
    router = _learn(entries, n, x, leaf_rows)
    visits = _visits(entries, router, sample.iloc[-CALIBRATION_QUERIES:], k, recall)
    shared = spark.sparkContext.broadcast(router)

    def file(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.assign(leaf=shared.value.leaf(_matrix(b.vector)))

    filed = cut(entries.mapInPandas(file, "h1 long, h2 long, vector array<double>, ids array<long>, leaf int"), "ann-filed")
    queries = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where(is_query)
    queries = queries.select(F.col("id").alias("query_id"), F.xxhash64("vector").alias("h1"), F.xxhash64(F.lit(5), "vector").alias("h2")).distinct()
    asked = filed.join(queries.select("h1", "h2").distinct(), ["h1", "h2"], "left_semi").select("h1", "h2", "vector")

    # Zones: runs of leaves of at most ``room`` entries together, or one leaf above that, cut into blocks.
    most = max(256, BLOCK_VALUES // x.shape[1])
    room = min(most, max(LEAST_BLOCK, n // 64))
    sizes = np.zeros(router.parts * router.width, dtype=np.int64)
    for leaf, rows in filed.groupBy("leaf").count().collect():  # a row a leaf
        sizes[leaf] = rows
    zone, held_by = np.zeros(len(sizes), dtype=np.int64), [0]
    for leaf, rows in enumerate(sizes):
        if held_by[-1] and held_by[-1] + rows > room:
            held_by.append(0)
        zone[leaf] = len(held_by) - 1
        held_by[-1] += int(rows)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 512):
                some = b.iloc[i : i + 512]
                order = np.argsort(-shared.value(_matrix(some.vector)), axis=1, kind="stable")[:, :visits]
                row, leaf = np.repeat(np.arange(len(some)), order.shape[1]), np.sort(order, axis=1).ravel()
                row, leaf = row[sizes[leaf] > 0], leaf[sizes[leaf] > 0]
                if len(leaf):  # zones rise with leaves, so a row's leaves of a zone stand together
                    new = np.flatnonzero(firsts(row * len(sizes) + zone[leaf], 1))
                    yield some.iloc[row[new]].assign(zone=zone[leaf[new]], leaves=np.split(leaf, new[1:]))

    asked = asked.mapInPandas(ask, "h1 long, h2 long, vector array<double>, zone int, leaves array<int>")
    asking = {r[0]: r[1] for r in asked.groupBy("zone").count().collect()}  # a row a zone
    layout = [(z, -(-rows // room) or 1, -(-asking.get(z, 0) // max(1, most // 2)) or 1) for z, rows in enumerate(held_by)]
    zones = F.broadcast(spark.createDataFrame(layout, "zone int, blocks int, q_blocks int"))
    leaves = F.broadcast(spark.createDataFrame([(i, int(z)) for i, z in enumerate(zone)], "leaf int, zone int"))
    asked = asked.join(zones, "zone").select(
        "h1", "h2", "vector", "leaves", "zone", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.expr("cast(pmod(h2, q_blocks) as int)").alias("q_block")
    )
    placed = filed.join(leaves, "leaf").join(zones, "zone").select(
        "vector", "ids", "leaf", "zone", F.expr("cast(pmod(h1, blocks) as int)").alias("block"), F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("q_block")
    )

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            right = right.sort_values("leaf", kind="stable")
            c, copies = _matrix(right.vector), right.ids.map(len).to_numpy()
            ids, first = np.concatenate(right.ids.to_numpy()), np.r_[0, np.cumsum(copies)[:-1]]
            of = right.leaf.to_numpy()
            for i in range(0, len(left), 256):
                some = left.iloc[i : i + 256]
                q = _matrix(some.vector)
                s = np.full((len(q), len(c)), -np.inf)
                row, leaf = np.repeat(np.arange(len(q)), some.leaves.map(len)), np.concatenate(some.leaves.to_numpy())
                for a in np.unique(leaf):
                    lo, hi = np.searchsorted(of, [a, a + 1])
                    rows = row[leaf == a]
                    s[rows, lo:hi] = q[rows] @ c[lo:hi].T
                r, j = largest(s, k + 1)
                if not len(r):
                    continue
                e, many = exact_scores(q[r], c[j]), copies[j]
                r, e = np.repeat(r, many), np.repeat(e, many)
                vec = ids[np.repeat(first[j] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())]
                order = np.lexsort((vec, -e, r))
                order = order[firsts(r[order], k + 1)]
                r, e, vec = r[order], e[order], vec[order]
                new = np.flatnonzero(firsts(r, 1))
                out.append(pd.DataFrame({"h1": some.h1.to_numpy()[r[new]], "h2": some.h2.to_numpy()[r[new]], "scores": np.split(e, new[1:]), "ids": np.split(vec, new[1:])}))
        return pd.concat(out) if out else pd.DataFrame({"h1": [], "h2": [], "scores": [], "ids": []})

    key = ["zone", "block", "q_block"]
    local = asked.groupBy(*key).cogroup(placed.groupBy(*key)).applyInPandas(compare, "h1 long, h2 long, scores array<double>, ids array<long>")
    # An array of k + 1 a visited zone and block: not the vectors that a query was compared with.
    merged = local.groupBy("h1", "h2").agg(
        F.expr(f"slice(array_sort(flatten(collect_list(transform(arrays_zip(scores, ids), x -> struct(-x.scores as s, x.ids as i))))), 1, {k + 1})").alias("near")
    )
    own = queries.join(merged, ["h1", "h2"]).select("query_id", F.expr(f"slice(filter(near, x -> x.i != query_id), 1, {k})").alias("near"))
    return own.select("query_id", F.posexplode("near").alias("pos", "x")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("x.i").alias("vec_id"), (-F.col("x.s")).alias("score")
    )
