"""Language-model scoring with a probabilistic suffix tree.

Symbols are the bytes of a normalised text: its words (runs without white space, A-Z lowered) with one space
after each but the last, then an end symbol. A context is the string of the last ``d`` symbols, ``d`` up to
``DEPTH``; text starts are padded with the end symbol. A context is a state of the tree when its next-symbol
distribution differs from its parent's (the context without its oldest symbol) by a likelihood gain of more
than ``GAIN`` nats for each symbol seen after it, and when it is frequent enough; suffixes of states are states.
A state's distribution is smoothed towards its parent's: ``(n(s,x) + T(s) P(x | parent)) / (n(s) + T(s))``
with ``T`` the number of different symbols seen. A symbol is scored in the longest suffix of the text so far
that is a state.

Beside it stands the word model that the contract fixes: smoothed counts of whole words.

How it scales: one pass over the texts counts strings of ``DEPTH + 1`` symbols and words, summed by
the cluster (counts travel as blocks of bytes by bucket of keys, so that summing them is array work); strings of texts
that are not for training count 0. The tree is cut into branches, the strings whose context ends alike: two last
symbols, or more where such a branch has more than ``BRANCH`` strings. What lies above the branches is a table of at
most 256 rows a context above one; each branch is a task of its own with arrays of bounded size, and gives every string
its probability. So no string is left out, however rare. The ``FREQUENT`` most frequent strings' probabilities are
broadcast (12 bytes each); all others are joined. Word counts likewise: words seen more than once in ``WORDS`` are
broadcast (at most ``WORDS``) and all others are joined by their hash.

Defined results: a null text is empty and has one token, the end; a null id counts as the empty string for the
split; repeated rows are scored each and counted each; an empty table gives no rows; without training rows the
tree is the uniform distribution and every word is unknown; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

DEPTH = 6
END = 10
#: Strings whose probabilities are broadcast; the others are joined.
FREQUENT = 1 << 22
#: Strings that a branch of the tree holds before it is cut further, and the fewest for which it is.
BRANCH, LEAST_BRANCH = 1 << 19, 1 << 14
LEAST_CONTEXT = 4
GAIN = 0.5
WORDS = 1 << 20
BATCH_BYTES = 1 << 19
HELD_STRINGS = 1 << 20
#: Counts from here on are one bar of the histogram from which the least count of the broadcast strings is read.
BARS = 4_096
#: Buckets of keys for each partition of the input.
BUCKETS = 4
#: The key of the end token among the words' hashes.
END_KEY = 0


LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; the end token is not among them."""
    return text.encode().translate(LOWER).split() if text else []


def normalised(text: str | None) -> bytes:
    """The words with one space after each but the last."""
    return b" ".join(tokens(text))


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def word_keys(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of normalised texts, and the number of words of each text.

    A word's hash is the sum of a hash of each byte and its place; the end token's key is left free.
    """
    count = np.array([p.count(b" ") + 1 if p else 0 for p in parts], dtype=np.int64)
    flat = np.frombuffer(b" ".join(p for p in parts if p), dtype=np.uint8)
    if not len(flat):
        return np.zeros(0, dtype=np.int64), count
    space = np.flatnonzero(flat == 32)
    starts = np.r_[0, space + 1]
    place = np.arange(len(flat)) - np.repeat(starts, np.diff(np.r_[starts, len(flat) + 1]))[: len(flat)]
    each = _stirred(flat.astype(np.uint64) | (place.astype(np.uint64) + np.uint64(1) << np.uint64(8)))
    each[space] = 0
    keys = _stirred(np.add.reduceat(each, starts)).view(np.int64)
    keys[keys == END_KEY] = 1
    return keys, count


def windows(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The last DEPTH + 1 symbols at each symbol of normalised texts, as one number, and where each text begins."""
    pad = bytes([END]) * DEPTH
    parts = [p + bytes([END]) for p in parts]
    flat = np.frombuffer(pad + pad.join(parts), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(p) for p in parts])
    starts = DEPTH + np.concatenate([[0], np.cumsum(sizes + DEPTH)[:-1]])
    key = np.zeros(len(flat) - DEPTH, dtype=np.int64)
    for j in range(DEPTH + 1):
        key = (key << 8) | flat[j : len(key) + j]
    begins = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(begins[-1]) + np.repeat(starts - begins[:-1], sizes)
    return key[at - DEPTH], begins[:-1]


def grouped(texts: Iterator[str | None]) -> Iterator[list[bytes]]:
    """Normalised texts in lists of bounded size (or of one text)."""
    some, size = [], 0
    for t in texts:
        some.append(normalised(t))
        size += len(some[-1])
        if size >= BATCH_BYTES:
            yield some
            some, size = [], 0
    if some:
        yield some


def _merged(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and the sums of their counts."""
    both = np.concatenate(keys)
    order = np.argsort(both, kind="stable")
    both = both[order]
    first = np.flatnonzero(np.r_[True, both[1:] != both[:-1]])
    return both[first], np.add.reduceat(np.concatenate(times)[order], first)


def _dealt(kind: int, keys: np.ndarray, times: np.ndarray, buckets: int) -> pd.DataFrame:
    """The counts as a block of bytes for each bucket of keys."""
    bucket = ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)
    order = np.argsort(bucket, kind="stable")
    keys, times, bucket = keys[order], times[order], bucket[order]
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    ends = np.r_[first[1:], len(keys)]
    blocks = [(int(bucket[i]), kind, keys[i:j].tobytes(), times[i:j].tobytes()) for i, j in zip(first, ends)]
    return pd.DataFrame(blocks, columns=["bucket", "kind", "keys", "times"])


class Held:
    """Counts of keys of one kind, summed now and then, given out in blocks that hold many."""

    def __init__(self, kind: int, buckets: int, room: int) -> None:
        self.kind, self.buckets, self.room = kind, buckets, room
        self.keys: list[np.ndarray] = []
        self.times: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray, times: np.ndarray) -> Iterator[pd.DataFrame]:
        self.keys.append(keys)
        self.times.append(times)
        self.size += len(keys)
        if 2 * self.size > 3 * self.room:
            k, n = _merged(self.keys, self.times)
            self.keys, self.times, self.size = [k], [n], len(k)
            if len(k) > self.room:
                yield from self.rest()

    def rest(self) -> Iterator[pd.DataFrame]:
        if self.size:
            yield _dealt(self.kind, *_merged(self.keys, self.times), self.buckets)
            self.keys, self.times, self.size = [], [], 0


def _kinds(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def counter(buckets: int):
    """Counts of strings (kind 0) and words (kind 1) of batches, in blocks that hold some megabytes of text.

    Strings of held-out texts count 0, their words are not counted.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        strings, words = Held(0, buckets, HELD_STRINGS), Held(1, buckets, HELD_STRINGS // 4)
        ends = 0
        for b in batches:
            at = 0
            for some in grouped(b.text.array):
                training = ~b.held_out.to_numpy(dtype=bool)[at : at + len(some)]
                at += len(some)
                keys, begins = windows(some)
                learnt = np.repeat(training, np.diff(np.append(begins, len(keys))))
                yield from strings.add(*_kinds(keys[learnt]))
                others, times = _kinds(keys[~learnt])
                yield from strings.add(others, np.zeros_like(times))
                keys, size = word_keys(some)
                yield from words.add(*_kinds(keys[np.repeat(training, size)]))
                ends += int(training.sum())
        if ends:
            yield from words.add(np.array([END_KEY], dtype=np.int64), np.array([ends], dtype=np.int64))
        yield from strings.rest()
        yield from words.rest()

    return count


def total(blocks: pd.DataFrame) -> pd.DataFrame:
    """kind, key, n of one bucket: its blocks' counts summed."""
    out = []
    for kind, own in blocks.groupby("kind"):
        keys, n = _merged([np.frombuffer(k, dtype=np.int64) for k in own["keys"]], [np.frombuffer(t, dtype=np.int64) for t in own.times])
        out.append(pd.DataFrame({"kind": np.int32(kind), "key": keys, "n": n}))
    return pd.concat(out)


def turned(keys: np.ndarray, symbols: int) -> np.ndarray:
    """Strings of so many symbols with the newest symbol first, so that suffixes sort next to one another."""
    if not symbols:
        return keys
    return (np.ascontiguousarray(keys).view(np.uint64).byteswap() >> np.uint64(64 - 8 * symbols)).view(np.int64)


@dataclass
class Tree:
    """By depth d: states' turned keys and shares left to the parent; transitions' turned keys and shares, sorted."""

    states: list[np.ndarray]
    left: list[np.ndarray]
    moves: list[np.ndarray]
    chance: list[np.ndarray]

    def log10(self, keys: np.ndarray, symbols: int = DEPTH + 1) -> np.ndarray:
        """Of the newest symbol of each string of so many symbols, in the longest suffix of the others that is a state.

        The strings are sorted once; each level then looks up its different suffixes only, in rising order.
        """
        order = np.argsort(turned(keys, symbols))
        sorted_ = turned(keys, symbols)[order]
        of = np.zeros(len(keys), dtype=np.int64)  # each string's suffix at the level before
        p, inside = np.full(1, 1 / 256), np.ones(1, dtype=bool)
        for d in range(min(len(self.states), symbols)):
            suffix = sorted_ >> 8 * (symbols - d - 1)
            new = np.r_[True, suffix[1:] != suffix[:-1]] if len(suffix) else np.zeros(0, dtype=bool)
            p, inside, suffix, of = p[of[new]], inside[of[new]], suffix[new], np.cumsum(new) - 1
            # Only below a state can there be a state.
            at = np.flatnonzero(inside)
            found, i = _find(self.states[d], suffix[at] & ((1 << 8 * d) - 1))
            at, i = at[found], i[found]
            inside = np.zeros(len(suffix), dtype=bool)
            inside[at] = True
            if len(at):
                p[at] *= self.left[d][i]
                hit, j = _find(self.moves[d], suffix[at])
                p[at[hit]] += self.chance[d][j[hit]]
        out = np.empty(len(keys))
        out[order] = np.log10(p)[of]
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), dtype=bool), np.zeros(len(keys), dtype=np.int64)
    i = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[i] == keys, i


@dataclass
class Level:
    """Strings of d + 1 symbols in rising order, how often each was seen, and what the tree has of it.

    ``p`` is the newest symbol's probability in the longest suffix, up to d symbols, of the others that is a state;
    ``state`` says whether all d others are one, ``left`` is what it leaves to its parent, ``own`` the string's share.
    """

    key: np.ndarray
    n: np.ndarray
    p: np.ndarray
    state: np.ndarray
    left: np.ndarray
    own: np.ndarray

    def at(self, rows: np.ndarray) -> Level:
        return Level(*(x[rows] for x in (self.key, self.n, self.p, self.state, self.left, self.own)))


def _low(keys: np.ndarray, symbols: int) -> np.ndarray:
    """The newest symbols of strings."""
    return keys & np.int64((1 << 8 * symbols) - 1)


def levels(keys: np.ndarray, n: np.ndarray, crown: list[Level], symbols: int = DEPTH + 1, least: int = LEAST_CONTEXT, gain: float = GAIN) -> list[Level]:
    """The tree's levels over the counts of different strings of so many symbols.

    ``crown``: levels as computed over all strings; contexts that it has count as it has them, since ``keys`` may hold
    only some of their strings. All others must be whole here.
    """
    order = np.argsort(keys)
    strings, counts, up = [keys[order]], [n[order].astype(np.float64)], []
    for d in range(symbols - 1, 0, -1):
        short, back = np.unique(_low(strings[0], d), return_inverse=True)
        counts.insert(0, np.bincount(back, weights=counts[0], minlength=len(short)))
        strings.insert(0, short)
        up.insert(0, back)
    out: list[Level] = []
    for d, (key, seen) in enumerate(zip(strings, counts)):
        below = out[-1].p[up[d - 1]] if d else np.full(len(key), 1 / 256)
        closed = out[-1].state[up[d - 1]] if d else np.ones(len(key), dtype=bool)
        first = np.flatnonzero(np.r_[True, key[1:] >> 8 != key[:-1] >> 8]) if len(key) else np.zeros(0, dtype=np.int64)
        size = np.diff(np.append(first, len(key)))
        total, kinds = (np.repeat(np.add.reduceat(x, first), size) if len(key) else x for x in (seen, (seen > 0).astype(np.float64)))
        unit = np.maximum(total + kinds, 1)
        own, left = seen / unit, np.where(total > 0, kinds / unit, 1.0)
        mixed = own + left * below
        won = seen * np.log(mixed / below)
        won = np.repeat(np.add.reduceat(won, first), size) if len(key) else won
        state = total >= least
        if d:
            state &= closed & (won > gain * kinds)
        level = Level(key, seen, np.where(state, mixed, below), state, left, own)
        if d < len(crown):
            hit, i = _find(crown[d].key, key)
            for x, y in ((level.p, crown[d].p), (level.state, crown[d].state), (level.left, crown[d].left), (level.own, crown[d].own)):
                x[hit] = y[i[hit]]
        out.append(level)
    return out


def _ending(column: Column, symbols: int) -> Column:
    return column.bitwiseAND(F.lit((1 << 8 * symbols) - 1))


def crowned(strings: DataFrame, branch: int, least: int, gain: float) -> tuple[list[Level], list[list[int]]]:
    """The levels above the branches, and by depth from 2 the contexts of more than ``branch`` strings.

    Each round sees at most 256 rows for each context of more than ``branch`` strings.
    """
    context = F.shiftright("key", 8)
    two = strings.groupBy(_ending(F.col("key"), 2).alias("key")).agg(F.sum("n").alias("n")).toPandas()
    crown = levels(two.key.to_numpy(dtype=np.int64), two.n.to_numpy(), [], 2, least, gain)
    large: list[list[int]] = []
    some = strings
    for d in range(2, DEPTH):
        many = some.groupBy(_ending(context, d).alias("ctx")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > branch)
        large.append(sorted(r[0] for r in many.collect()))
        if not large[-1]:
            break
        some = some.where(_ending(context, d).isin(large[-1]))
        rows = some.groupBy(_ending(F.col("key"), d + 1).alias("key")).agg(F.sum("n").alias("n")).toPandas()
        crown.append(levels(rows.key.to_numpy(dtype=np.int64), rows.n.to_numpy(), crown, d + 1, least, gain)[d])
    return crown, large


def likelihoods(strings: DataFrame, least: int = LEAST_CONTEXT, gain: float = GAIN, branch: int = BRANCH) -> DataFrame:
    """key, n, p of every string of DEPTH + 1 symbols in ``strings`` (key, n)."""
    spark = strings.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = max(min(branch, LEAST_BRANCH), min(branch, strings.count() // parts))
    crown, large = crowned(strings, size, least, gain)
    shared = spark.sparkContext.broadcast(crown)
    context = F.shiftright("key", 8)
    branch_of = F.struct(F.lit(2).alias("d"), _ending(context, 2).alias("ctx"))
    for d, some in enumerate(large, 2):
        if some:
            branch_of = F.when(_ending(context, d).isin(some), F.struct(F.lit(d + 1).alias("d"), _ending(context, d + 1).alias("ctx"))).otherwise(branch_of)
    bins = 4 * parts

    def grown(rows: pd.DataFrame) -> pd.DataFrame:
        last = levels(rows.key.to_numpy(), rows.n.to_numpy(), shared.value, DEPTH + 1, least, gain)[-1]
        return pd.DataFrame({"key": last.key, "n": last.n.astype(np.int64), "p": last.p})

    dealt = strings.withColumn("bin", F.pmod(F.xxhash64(branch_of), F.lit(bins)))
    return dealt.groupBy("bin").applyInPandas(grown, "key long, n long, p double")


def grow(strings: DataFrame, depth: int = DEPTH, least: int = LEAST_CONTEXT, gain: float = GAIN) -> Tree:
    """The whole tree of ``strings`` (key, n) on the driver, for small tables."""
    rows = strings.toPandas()
    tree = Tree([], [], [], [])
    for d, level in enumerate(levels(rows.key.to_numpy(dtype=np.int64), rows.n.to_numpy(), [], depth + 1, least, gain)):
        kept = level.at(np.flatnonzero(level.state))
        heads, first = np.unique(turned(kept.key >> 8, d), return_index=True)
        tree.states.append(heads)
        tree.left.append(kept.left[first])
        order = np.argsort(turned(kept.key, d + 1))
        tree.moves.append(turned(kept.key, d + 1)[order])
        tree.chance.append(kept.own[order])
    return tree


def most_frequent(level: DataFrame, bound: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and log10 of the probabilities of at most ``bound`` strings, the most frequent ones."""
    bars = sorted(level.groupBy(F.least("n", F.lit(BARS)).alias("bar")).count().collect(), reverse=True)
    over = np.cumsum([r[1] for r in bars]) > bound
    floor = 0 if not over.any() else int(bars[int(over.argmax())][0]) + 1
    kept = level.where(F.col("n") >= F.lit(floor))
    if floor > BARS:  # more than that many strings are that frequent
        kept = level.orderBy(F.desc("n"), "key").limit(bound)
    got = kept.select("key", F.log10("p").cast("float").alias("log")).toArrow()
    key, log = got.column("key").to_numpy(), got.column("log").to_numpy()
    order = np.argsort(key)
    return key[order], log[order]


def _looked_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in the sorted table, and its value there, else 0; different keys are looked up once."""
    code, new = pd.factorize(keys)
    order = np.argsort(new)
    hit, i = _find(table, new[order])
    found, value = np.zeros(len(new), dtype=bool), np.zeros(len(new))
    found[order] = hit
    value[order[hit]] = values[i[hit]]
    return found[code], value[code]


def scorer(likely, frequent, train_tokens: int, kinds: int):
    """Scores of batches; strings outside ``likely`` and words outside ``frequent`` come back as numbers and how often they occur."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, times = frequent.value
        strings, chances = likely.value
        unit = train_tokens + 0.1 * (kinds + 1)
        end = int(times[words == END_KEY].sum())
        for b in batches:
            at = 0
            for some in grouped(b.text.array):
                rows = b.iloc[at : at + len(some)]
                at += len(some)
                keys, begins = windows(some)
                hit, log = _looked_up(keys, strings, chances)
                gaps = _missing(keys, ~hit, np.append(begins, len(keys)))
                scores = np.add.reduceat(log, begins)
                keys, count = word_keys(some)
                hit, seen = _looked_up(keys, words, times)
                of = np.repeat(np.arange(len(some)), count)
                known = np.bincount(of[hit], minlength=len(some)) + int(end > 0)
                base = np.bincount(of[hit], weights=np.log10((seen[hit] + 0.1) / unit), minlength=len(some)) + np.log10((end + 0.1) / unit)
                rare = _missing(keys, ~hit, np.r_[0, np.cumsum(count)])
                got = {"n_tokens": count + 1, "hits": known, "base": base, "score": scores, "rare": [r[0] for r in rare], "times": [r[1] for r in rare], "gaps": [g[0] for g in gaps], "gap_times": [g[1] for g in gaps]}
                yield pd.concat([rows[["doc_id", "held_out"]].reset_index(drop=True), pd.DataFrame(got)], axis=1)

    return score


def _missing(keys: np.ndarray, missing: np.ndarray, ends: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each text the different keys that are missing, and how often each occurs."""
    return [np.unique(keys[i:j][missing[i:j]], return_counts=True) for i, j in zip(ends[:-1], ends[1:])]


def tenth(id_col: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 10


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    chosen = chosen.withColumn("held_out", held_out if held_out is not None else tenth() == 0)
    read = chosen.select("text", "held_out")
    blocks = read.mapInPandas(counter(BUCKETS * read.rdd.getNumPartitions()), "bucket int, kind int, keys binary, times binary")
    counted = cut(blocks.groupBy("bucket").applyInPandas(total, "kind int, key long, n long"), "lm-counts")
    tree = cut(likelihoods(counted.where("kind = 0").select("key", "n")), "lm-tree")
    words = counted.where("kind = 1").select("key", "n")
    all_, kinds = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # At most WORDS rows and the end token, which is in no join.
    often = words.where((F.col("n") * F.lit(WORDS) >= F.lit(all_)) | (F.col("key") == F.lit(END_KEY))).toArrow().sort_by("key")
    model = spark.sparkContext.broadcast(most_frequent(tree, FREQUENT))
    frequent = spark.sparkContext.broadcast((often.column("key").to_numpy(), often.column("n").to_numpy()))
    scored = chosen.mapInPandas(
        scorer(model, frequent, all_, kinds),
        "doc_id long, held_out boolean, n_tokens long, hits long, base double, score double, rare array<long>, times array<long>, gaps array<long>, gap_times array<long>",
    )
    scored = cut(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    one = scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("key"), F.col("x.times").alias("times"))
    unit = F.lit(float(all_ + 0.1 * (kinds + 1)))
    joined = one.join(words.where(F.col("n") * F.lit(WORDS) < F.lit(all_)), "key", "left")
    rest = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + 0.1) / unit)).alias("more"),
        F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("more_hits"),
    )
    gap = scored.select("row", F.explode(F.arrays_zip("gaps", "gap_times")).alias("x")).select("row", F.col("x.gaps").alias("key"), F.col("x.gap_times").alias("times"))
    filled = gap.join(tree.select("key", "p"), "key").groupBy("row").agg(F.sum(F.col("times") * F.log10("p")).alias("more_score"))
    return scored.drop("rare", "times", "gaps", "gap_times").join(rest, "row", "left").join(filled, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("more_hits", F.lit(0))).alias("n_known"), F.lit(all_).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"),
    )
