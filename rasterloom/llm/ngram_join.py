"""N-gram Jaccard join with a MinHash LSH forest and exact verification.

A document is the set of its five-word shingles (words: lowered runs of letters, digits and underscores; a
document of one to four words has one shingle, all of it). Equal sets are one class from the start. A class has
``TREES`` label strings of ``LABELS`` labels, each 8 bits of a MinHash value; a tree of the forest is the prefix
trie of the classes' strings under that tree, held as a sorted table. Classes that share a prefix of ``depth``
labels in some tree are candidates. ``depth`` starts at the whole string and is shortened one label at a time
until classes of every similarity band in which candidates were found meet with probability ``recall``.

In a trie's sorted order each class is compared, by a short sketch, with the next ``NEXT`` classes under the
same prefix, and with the prefix's leaders: classes of which no two have nearly the same sketch. Classes that
are not clearly dissimilar are linked, and the links' components are the sets inside which every pair is verified
exactly on the shingles. So a class meets every class under its prefix, or one with nearly the same sketch. A
prefix of more than ``LEADERS`` leaders is crowded: its classes are dealt into blocks of about ``LEADERS``, and
each pair of blocks is a task that holds all its leaders. That is quadratic in the crowd, and spread.

How it scales: texts are shuffled once, for classes with candidates to meet their members' texts; sketches are
56 bytes a class and tree. A component of many classes is verified in blocks of about ``BLOCK`` classes and
``BLOCK_CHARS`` characters (or one class), a task for each pair of blocks; only counts and spanning
links leave a task, never pairs.

Defined results: a null text and a text without words have no shingles, are in a class of their own and have
no links (:func:`deduplicate` keeps all null and empty texts, and one of equal texts of signs only); a null id is
kept, is no other row's id, and is the class id only where all ids of the class are null; repeated rows are copies
of one another; an empty table gives no rows; further columns are ignored (:func:`deduplicate` keeps them, whatever
their names).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .components import components
from .shared import cut, discard

WORDS_IN_SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
LABELS = 8
SHORTEST = 4
RECALL = 0.999
NEXT = 4
SKETCH = 64
LEAST_SKETCH = 0.5
LEADERS = 4_096
CROWDED = -1
LINKS = "a binary, b binary, shared int, like double"
#: A class this similar to a leader is none itself. With this slack, a link to a leader needs LEAST_LED.
LEADER_RADIUS = 0.95
LEAST_LED = 0.5
BLOCK = 128
BLOCK_CHARS = 16 << 20
BATCH_CHARS = 4 << 20
RUN = 1 << 16
WORD = re.compile(r"\w+")
_DRAW = np.random.default_rng(20_240_229)
MULTIPLY = _DRAW.integers(1, 1 << 63, TREES * LABELS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
ADD = _DRAW.integers(0, 1 << 63, TREES * LABELS, dtype=np.uint64)


def stirred(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Of each text its different shingles' hashes, sorted."""
    own = [WORD.findall(t.lower()) if t else [] for t in texts]
    flat = [w for words in own for w in words]
    if not flat:
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    codes, kinds = pd.factorize(np.array(flat, dtype=object))
    h = pd.util.hash_array(kinds, categorize=False)[codes]
    step = np.uint64(0x9E3779B97F4A7C15)
    n = WORDS_IN_SHINGLE

    def rolled(width: int, part: np.ndarray) -> np.ndarray:
        size = max(0, len(part) - width + 1)
        out = np.full(size, width, dtype=np.uint64)
        for j in range(width):
            out = out * step + part[j : j + size]
        return stirred(out)

    every = rolled(n, h)
    out, at = [], 0
    for words in own:
        m = len(words)
        if m >= n:
            out.append(np.unique(every[at : at + m - n + 1]))
        else:
            out.append(rolled(m, h[at : at + m]) if m else np.zeros(0, dtype=np.uint64))
        at += m
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values of non-empty sets, a row each, already stirred."""
    sizes = np.array([len(s) for s in sets])
    out = np.empty((len(sets), len(MULTIPLY)), dtype=np.uint64)
    begin = 0
    while begin < len(sets):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:]), RUN, side="right")))
        x = np.concatenate(sets[begin:end])
        starts = np.cumsum(sizes[begin:end]) - sizes[begin:end]
        y = np.empty_like(x)
        for j in range(len(MULTIPLY)):
            np.multiply(x, MULTIPLY[j], out=y)
            np.add(y, ADD[j], out=y)
            out[begin:end, j] = np.minimum.reduceat(y, starts)
        begin = end
    return stirred(out)


def _lists(texts: list, limit: int = BATCH_CHARS) -> Iterator[slice]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t) if t else 0
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))


def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The set's digest, its size, the trees' label strings and a short sketch of each text."""
    for b in batches:
        texts = [t if isinstance(t, str) else None for t in b.text.array]
        for part in _lists(texts):
            sets = shingle_sets(texts[part])
            rows = b.iloc[part][["k", "t1", "doc_id"]].reset_index(drop=True)
            full = [i for i, s in enumerate(sets) if len(s)]
            trees: list = [[]] * len(sets)
            minis: list = [b""] * len(sets)
            if full:
                v = signatures([sets[i] for i in full])
                labels = (v & np.uint64(0xFF)).astype(np.uint8).reshape(len(full), TREES, LABELS)
                strings = np.ascontiguousarray(labels).view(">u8")[:, :, 0].astype(np.uint64).view(np.int64)
                nibbles = ((v[:, :SKETCH] >> np.uint64(8)) & np.uint64(15)).astype(np.uint8)
                mini = nibbles[:, ::2] | (nibbles[:, 1::2] << 4)
                for i, s, m in zip(full, strings.tolist(), mini):
                    trees[i], minis[i] = s, m.tobytes()
            cid = [xxhash.xxh128_digest(s.tobytes() if len(s) else b"-" + (t or "").encode()) for s, t in zip(sets, texts[part])]
            yield rows.assign(cid=cid, n=[len(s) for s in sets], size=[len(t) if t else 0 for t in texts[part]], trees=trees, mini=minis)


SKETCHED = "k long, t1 long, doc_id long, cid binary, n int, size long, trees array<long>, mini binary"


def spanning(links: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int, float]]:
    """Links (i, j, shared, like) that keep together, at every depth, what all links keep together."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            root[i] = root.get(up, up)
            i = up
        return i

    out = []
    for link in sorted(links, key=lambda x: (-x[2], -x[3])):
        a, b = find(int(link[0])), find(int(link[1]))
        if a != b:
            root[b] = a
            out.append(link)
    return out


class Leaders:
    """The classes under one prefix that stand for those of nearly the same sketch, ``room`` at most.

    ``1 - similarity by sketch`` is a metric, so a class within 0.35 of another is within 0.4 of its leader.
    """

    def __init__(self, room: int) -> None:
        self.room = room
        self.mini = np.empty((room, SKETCH // 16), dtype=np.uint64)
        self.string = np.empty(room, dtype=np.uint64)
        self.cid = np.empty(room, dtype=object)
        self.root = np.empty((LABELS + 1, room), dtype=np.int64)  # by depth, what links so far hold together
        self.begin(None)

    def begin(self, prefix: tuple | None) -> None:
        self.prefix, self.n, self.classes, self.crowded = prefix, 0, 0, False

    def meet(self, mini: np.ndarray, string: np.uint64, cid: bytes) -> list[tuple[bytes, bytes, int, float]]:
        """Links (cid, leader, shared, like) that add to what earlier ones hold together at some depth."""
        apart = self.mini[: self.n] ^ mini
        apart |= apart >> np.uint64(1)
        apart |= apart >> np.uint64(2)
        apart &= np.uint64(0x1111111111111111)
        like = 1 - np.bitwise_count(apart).sum(axis=1) / (SKETCH * 15 / 16)
        near = np.flatnonzero(like >= LEAST_LED)
        own, links = {}, []
        if len(near):
            differ = self.string[near] ^ string
            shared = sum((differ >> np.uint64(64 - 8 * d) == 0).astype(np.int64) for d in range(1, LABELS)) + (differ == 0)
            order = np.lexsort((-like[near], -shared))
            near, shared = near[order], shared[order]
            chosen = set()
            for depth in range(int(shared[0]), SHORTEST - 1, -1):
                reached = near[: np.searchsorted(-shared, -depth, side="right")]
                roots, first = np.unique(self.root[depth, reached], return_index=True)
                chosen.update(first.tolist())
                own[depth] = roots[0]
                if len(roots) > 1:
                    row = self.root[depth, : self.n]
                    row[np.isin(row, roots)] = roots[0]
            links = [(*sorted((cid, self.cid[near[k]])), int(shared[k]), float(like[near[k]])) for k in sorted(chosen)]
        if not len(near) or like[near].max() < LEADER_RADIUS:
            if self.n == self.room:  # all pairs of this prefix are compared in blocks instead
                self.crowded = True
                return links
            at = self.n
            self.mini[at], self.string[at], self.cid[at] = mini, string, cid
            for depth in range(SHORTEST, LABELS + 1):
                self.root[depth, at] = own.get(depth, at)
            self.n += 1
        return links


def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links between near places of sorted (tree, string) rows: a, b, shared labels, similarity by sketch.

    A crowded prefix is a row of its tree and string, ``CROWDED`` for the labels and the number of its classes.
    """
    last, leaders = None, Leaders(LEADERS)
    for b in batches:
        if not len(b):
            continue
        led = _led(b, leaders)
        if led:
            yield pd.DataFrame(led, columns=["a", "b", "shared", "like"])
        old = 0 if last is None else len(last)
        rows = b if last is None else pd.concat([last, b], ignore_index=True)
        tree, string = rows.tree.to_numpy(), rows.string.to_numpy().view(np.uint64)
        found = []
        for step in range(1, NEXT + 1):
            i = np.arange(max(0, old - step), len(rows) - step)
            j = i + step
            apart = string[i] ^ string[j]
            same = (tree[i] == tree[j]) & (apart >> np.uint64(64 - 8 * SHORTEST) == 0)
            i, j, apart = i[same], j[same], apart[same]
            if not len(i):
                continue
            shared = sum((apart >> np.uint64(64 - 8 * d) == 0).astype(np.int32) for d in range(1, LABELS)) + (apart == 0)
            mini = rows.mini.array
            x = np.frombuffer(b"".join(mini[k] for k in i), dtype=np.uint8).reshape(len(i), -1) ^ np.frombuffer(b"".join(mini[k] for k in j), dtype=np.uint8).reshape(len(i), -1)
            equal = (((x & 15) == 0).sum(axis=1) + ((x >> 4) == 0).sum(axis=1)) / SKETCH
            like = (equal - 1 / 16) / (1 - 1 / 16)
            near = like >= LEAST_SKETCH
            found += list(zip(i[near], j[near], shared[near], like[near]))
        if found:
            cid = rows.cid.array
            pairs = [(*sorted((cid[i], cid[j])), int(s), float(l)) for i, j, s, l in spanning(found)]
            yield pd.DataFrame(pairs, columns=["a", "b", "shared", "like"])
        last = rows.iloc[-NEXT:].reset_index(drop=True)
    if leaders.crowded:
        yield pd.DataFrame([_crowd(leaders)], columns=["a", "b", "shared", "like"])


def _crowd(leaders: Leaders) -> tuple[bytes, bytes, int, float]:
    tree, place = leaders.prefix
    return tree.to_bytes(8, "big"), place.to_bytes(8, "big"), CROWDED, float(leaders.classes)


def _led(b: pd.DataFrame, leaders: Leaders) -> list[tuple[bytes, bytes, int, float]]:
    """Links to leaders under prefixes of more classes than neighbours reach; the last prefix may go on in the next batch."""
    tree, string, cid = b.tree.to_numpy(), b.string.to_numpy().view(np.uint64), b.cid.array
    place = string >> np.uint64(64 - 8 * SHORTEST)
    starts = np.flatnonzero(np.r_[True, (tree[1:] != tree[:-1]) | (place[1:] != place[:-1])])
    ends = np.r_[starts[1:], len(b)]
    links = []
    for start, end in zip(starts.tolist(), ends.tolist()):
        prefix = (int(tree[start]), int(place[start]))
        if prefix != leaders.prefix:
            if end - start <= NEXT + 1 and end < len(b):
                continue
            if leaders.crowded:
                links.append(_crowd(leaders))
            leaders.begin(prefix)
        leaders.classes += end - start
        if leaders.crowded:
            continue
        minis = np.frombuffer(b"".join(b.mini.array[k] for k in range(start, end)), dtype=np.uint64).reshape(end - start, -1)
        for k in range(start, end):
            links += leaders.meet(minis[k - start], string[k], cid[k])
            if leaders.crowded:
                break
    return links


def meet_blocks(rows: pd.DataFrame) -> pd.DataFrame:
    """Links among the classes of two blocks of a crowded prefix."""
    rows = rows.sort_values("cid", ignore_index=True)
    leaders, links = Leaders(len(rows)), []
    minis = np.frombuffer(b"".join(rows.mini.array), dtype=np.uint64).reshape(len(rows), -1)
    for mini, string, cid in zip(minis, rows.string.to_numpy().view(np.uint64), rows.cid.array):
        links += leaders.meet(mini, string, cid)
    return pd.DataFrame(links, columns=["a", "b", "shared", "like"])


def crowd_links(entries: DataFrame, crowds: DataFrame, place: Column) -> DataFrame:
    """Links under the crowded prefixes: every pair of a prefix's blocks is compared by a task of its own."""
    number = F.conv(F.hex("a"), 16, 10).cast("int").alias("tree"), F.conv(F.hex("b"), 16, 10).cast("long").alias("place")
    crowds = crowds.select(*number, F.ceil(F.col("like") / LEADERS).cast("int").alias("blocks"))
    dealt = entries.withColumn("place", place).join(F.broadcast(crowds), ["tree", "place"])
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = dealt.select("tree", "place", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "cid", "string", "mini")
    return paired.groupBy("tree", "place", "i", "j").applyInPandas(meet_blocks, LINKS)


def links_met(entries: DataFrame, parts: int) -> DataFrame:
    """Links (a, b, shared, like) among classes (cid, mini, tree, string) that meet under some prefix."""
    place = F.shiftrightunsigned("string", 64 - 8 * SHORTEST)
    ordered = entries.repartition(parts, "tree", place).sortWithinPartitions("tree", place, F.shiftrightunsigned("string", 1), "string", "cid")
    met = cut(ordered.mapInPandas(neighbours, LINKS), "join-met")
    found, crowds = met.where(F.col("shared") != CROWDED), met.where(F.col("shared") == CROWDED)
    return found if crowds.isEmpty() else found.unionByName(crowd_links(entries, crowds, place))


def chosen_depth(bands: list[tuple[int, float, int]], threshold: float, recall: float) -> int:
    """The longest prefix at which each band of similarity with candidates is met often enough.

    ``bands``: (shared labels, similarity, links). A pair of similarity s shares d labels in some tree with
    probability 1 - (1 - s ** d) ** TREES. Estimates below the threshold count as the threshold if a pair at it
    may give them (two deviations of the sketch).
    """
    slack = 2 * np.sqrt(threshold * (1 - threshold) / SKETCH)
    seen = [max(s, threshold) for _, s, n in bands if n and s >= threshold - slack]
    depth = LABELS
    while depth > SHORTEST and any(1 - (1 - s**depth) ** TREES < recall for s in seen):
        depth -= 1
    return depth


def _links(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    flat = np.concatenate(sets)
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes.astype(int))
    common = times == len(sets)  # in every set: no matrix needed
    both = np.full((len(sets), len(sets)), float(common.sum()), dtype=np.float32)
    some = (times > 1) & ~common
    column = np.cumsum(some) - 1
    keep = some[code]
    row, column = row[keep], column[code[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = max(256, (1 << 22) // len(sets))
    for begin in range(0, int(some.sum()), width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        x = np.zeros((len(sets), width), dtype=np.float32)
        x[row[lo:hi], column[lo:hi] - begin] = 1
        both += x @ x.T
    both = both.astype(np.float64)
    linked = both / (sizes[:, None] + sizes[None, :] - both) >= threshold
    np.fill_diagonal(linked, False)
    return linked


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each member's component."""
    root = np.full(len(linked), -1)
    for i in range(len(linked)):
        if root[i] < 0:
            front = np.array([i])
            root[i] = i
            while len(front):
                front = np.flatnonzero(linked[front].any(axis=0) & (root < 0))
                root[front] = i
    return root


def _verify(threshold: float):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        rows = rows.drop_duplicates("cid").sort_values("cid", ignore_index=True)
        linked = _links(shingle_sets(rows.text.tolist()), threshold)
        block = rows.block.to_numpy()
        if i != j:  # pairs inside a block are counted with the block itself
            linked &= block[:, None] != block[None, :]
        weight = rows.copies.to_numpy().astype(np.float64)
        root = _roots(linked)
        return pd.DataFrame({"cid": rows.cid, "links": (linked @ weight).astype(np.int64), "peer": rows.cid.to_numpy()[root]})

    return run


def row_key(id_: Column, text: Column) -> tuple[Column, Column]:
    """k and t1, equal for rows of equal id (null apart from any number) and text."""
    id_ = id_.cast("long")
    return F.coalesce(id_, F.lit(0)).alias("k"), F.xxhash64(F.isnull(id_), text.cast("string")).alias("t1")


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """k, t1, doc_id, n, size, links, first: a row for each row of ``docs``; ``first`` is its class's first (none, id, k, t1).

    Equal texts without words are a class here, empty ones are not.
    """
    texts = docs.select(*row_key(F.col(id_col), F.col(text_col)), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = cut(texts.mapInPandas(sketch, SKETCHED), "join-rows")
    itself = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "k", "t1")
    classes = cut(
        rows.where("size > 0").groupBy("cid").agg(F.min(itself).alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("trees").alias("trees"), F.first("mini").alias("mini"), F.max("size").alias("size")),
        "join-classes",
    )
    entries = classes.select("cid", "mini", F.posexplode("trees").alias("tree", "string"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = links_met(entries, parts)
    found = cut(found.groupBy("a", "b").agg(F.max("shared").alias("shared"), F.max("like").alias("like")), "join-candidates")
    bands = [tuple(r) for r in found.groupBy("shared", F.round("like", 2).alias("like")).count().collect()]
    depth = chosen_depth(bands, threshold, recall)
    groups = components(found.where(F.col("shared") >= depth).select("a", "b"))
    members = groups.join(classes.select(F.col("cid").alias("node"), "rep", "copies", "size"), "node").select(
        F.col("node").alias("cid"), "root", "copies", "size", F.col("rep.k").alias("k"), F.col("rep.t1").alias("t1")
    )
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_CHARS))
    sizes = members.groupBy("root").agg(F.least(blocks, F.count(F.lit(1))).cast("int").alias("blocks"))
    members = members.drop("size").join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
    placed = texts.select("k", "t1", "text").join(members, ["k", "t1"]).dropDuplicates(["k", "t1"])
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = other.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    # As many tasks as partitions: a pair of blocks is much work for its bytes.
    paired = paired.select("root", "i", "j", "cid", "block", "copies", "text").repartition(parts, "root", "i", "j")
    verified = cut(paired.groupBy("root", "i", "j").applyInPandas(_verify(threshold), "cid binary, links long, peer binary"), "join-verified")
    final = components(verified.select(F.col("cid").alias("a"), F.col("peer").alias("b")))
    links = verified.groupBy("cid").agg(F.sum("links").alias("near"))
    known = classes.select("cid", "rep", "copies").join(final.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    firsts = known.groupBy("root").agg(F.min("rep").alias("first"))
    known = known.join(firsts, "root").join(links, "cid", "left")
    # Written first: a join of two plain tables is one whose hot classes Spark can split.
    known = cut(known.select("cid", "first", (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")), "join-known")
    for done in (classes, found, groups, verified, final):
        discard(done)
    return rows.select("k", "t1", "doc_id", "n", "size", "cid").join(known, (rows.cid == known.cid) & (rows["size"] > 0), "left").select(
        "k", "t1", "doc_id", "n", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("first", itself).alias("first")
    )


def similarity_classes(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id (the class's smallest id), links (other documents at or above the threshold)."""
    wordy = F.col("n") > 0
    return classified(docs, **how).select(
        "doc_id", F.when(wordy, F.col("first.id")).otherwise(F.col("doc_id")).alias("class_id"), F.when(wordy, F.col("links")).otherwise(0).cast("long").alias("links")
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each class, the one of the smallest id, and one of equal texts without words.

    Null and empty texts all stay. Of rows of equal id and text the one that is first by a hash of the row stays.
    """
    own = classified(docs, id_col=id_col, text_col=text_col, **how)
    stay = own.where((F.col("size") > 0) & (F.col("k") == F.col("first.k")) & (F.col("t1") == F.col("first.t1"))).select("k", "t1")
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    blank = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit("")) == ""
    keyed = row.where(~blank).select("row", *row_key(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`")))
    hashed = [F.col(f"row.`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    same = Window.partitionBy("k", "t1").orderBy(F.xxhash64(*hashed))
    one = keyed.withColumn("rn", F.row_number().over(same)).where("rn = 1")
    return one.join(stay, ["k", "t1"], "left_semi").select("row.*").unionByName(row.where(blank).select("row.*"))
