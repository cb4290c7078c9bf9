"""Toxicity by a counterfactually regularised classifier.

A document is the set of its words' features: each word and its first three to nine characters (endings vary,
stems tell). Features that go with toxic documents by a likelihood-ratio test enter a logistic model. For every
fitted document that names identity groups, each sentence's identity terms are swapped for other terms of the
same list, and the model is fitted under a penalty on the squared change of the score's logit, so that naming a
group does not by itself make a text toxic.

Beside the fixed lists, terms are derived from the labelled sentences: words that at least ``LEAST_MENTIONS`` rows of
either label hold, so that both neutral and toxic sentences mention them. Those that stand in like contexts (the
frequent words before and after them) are a list, whose terms are swapped for one another. Derived terms that go with
toxic rows only mildly enter the model too, so that the penalty has a say in them.

How it scales: the fit sees at most ``FIT_ROWS`` rows a label (the bound, a parameter), chosen by a hash over
all labelled rows and weighted back to the labels' true shares; feature counts are summed on the cluster; what
reaches the driver is bounded by ``FIT_ROWS`` and ``FEATURES``. Scoring is one pass over whole texts without a
shuffle.

Defined results: a null or empty text scores the share of toxic labels, adjusted by the fit; a null id counts as the empty string for the
split; labels other than 0 and 1 and labels without a document are not used, of several labels of one id the
largest counts; of texts that share an id one is fitted; without labels of both kinds every score is 0; repeated rows are scored each; an empty table
gives no rows; further columns are ignored (:func:`with_score` keeps them).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut, discard

FIT_ROWS = 6_144
FEATURES = 4_096
LEAST_LIKELIHOOD_RATIO = 15.0
LEAST_RISK_RATIO = 3.0
LEAST_TOXIC_ROWS = 4
PENALTY = 4.0
RIDGE = 2e-4
THRESHOLD = 0.7
MEMO = 400_000
#: Derived terms: rows of either label that hold one, how many, the frequent words that make contexts, their likeness.
LEAST_MENTIONS = 8
TERMS = 256
CONTEXTS = 96
LIKE_CONTEXTS = 0.7
LEAST_MILD_RATIO = 1.5
WORD = re.compile(r"\w+")
SENTENCE = re.compile(r"(?<=[.!?\n])\s*")
#: Terms that name groups of people, by list; a term is swapped within its list.
IDENTITY_TERMS = {
    "en": ("women", "men", "gay", "lesbian", "straight", "transgender", "black", "white", "asian", "latino", "muslim", "christian", "jewish", "hindu", "immigrant", "refugee", "disabled", "deaf", "blind", "old", "young"),
    "de": ("frauen", "männer", "schwul", "lesbisch", "schwarze", "weiße", "asiaten", "muslime", "christen", "juden", "einwanderer", "flüchtlinge", "behinderte"),
    "fr": ("femmes", "hommes", "gai", "lesbienne", "noirs", "blancs", "asiatiques", "musulmans", "chrétiens", "juifs", "immigrés", "réfugiés", "handicapés"),
    "es": ("mujeres", "hombres", "gais", "lesbianas", "negros", "blancos", "asiáticos", "musulmanes", "cristianos", "judíos", "inmigrantes", "refugiados", "discapacitados"),
}


def word_features(word: str) -> tuple[str, ...]:
    return (f"={word}", *(f"^{word[:n]}" for n in range(3, 10) if len(word) >= n))


def words(text: str | None) -> set[str]:
    return set(WORD.findall(text.lower())) if text else set()


def swapped(text: str, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, turns: tuple[int, ...] = (1, 5)) -> list[str]:
    """Counterfactuals of ``text``: each sentence's identity terms replaced by others of their list; [] without terms."""
    place = {t: (group, i) for group in terms.values() for i, t in enumerate(group)}
    out = []
    for turn in turns:
        found = False

        def other(m: re.Match) -> str:
            nonlocal found
            at = place.get(m[0].lower())
            if at is None:
                return m[0]
            found = True
            return at[0][(at[1] + turn) % len(at[0])]

        sentences = [WORD.sub(other, s) for s in SENTENCE.split(text) if s]
        if not found:
            return []
        out.append(" ".join(sentences))
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf
    #: The term lists that were swapped, and how many swapped documents differ in their features.
    terms: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)
    pairs: int = 0
    memo: dict[str, tuple[str, ...]] = field(default_factory=dict, repr=False)

    def logit(self, text: str | None) -> float:
        if len(self.memo) > MEMO:
            self.memo.clear()
        hits: set[str] = set()
        for w in words(text):
            f = self.memo.get(w)
            if f is None:
                f = self.memo[w] = tuple(x for x in word_features(w) if x in self.weights)
            if f:
                hits.update(f)
        return self.bias + sum(self.weights[f] for f in sorted(hits))

    def score(self, text: str | None) -> float:
        z = self.logit(text)
        return float(1 / (1 + np.exp(-z))) if z > -700 else 0.0


def solve(rows: list[np.ndarray], label: np.ndarray, weight: np.ndarray, pairs: list[tuple[int, np.ndarray]], n_features: int, penalty: float = PENALTY, ridge: float = RIDGE, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and bias: weighted log loss + ridge + penalty * mean squared logit change over the pairs."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows) if len(at) else np.zeros(0, dtype=int)
    # A pair's difference of features: +1 for those of the original, -1 for the counterfactual's.
    p_at, p_col, p_sign = [], [], []
    for k, (i, other) in enumerate(pairs):
        for ids, sign in ((rows[i], 1.0), (other, -1.0)):
            p_at.append(np.full(len(ids), k))
            p_col.append(ids)
            p_sign.append(np.full(len(ids), sign))
    pa, pc, ps = (np.concatenate(x) if x else np.zeros(0) for x in (p_at, p_col, p_sign))
    pa, pc = pa.astype(int), pc.astype(int)
    w = np.zeros(n_features + 1)
    share = np.clip((weight * label).sum() / weight.sum(), 1e-6, 1 - 1e-6)
    w[-1] = np.log(share / (1 - share))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = w[-1] + np.bincount(at, weights=w[col], minlength=len(rows))
        g = weight * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - label) / weight.sum()
        grad = np.append(np.bincount(col, weights=g[at], minlength=n_features), g.sum())
        grad[:-1] += ridge * w[:-1]
        if len(pairs):
            d = np.bincount(pa, weights=ps * w[pc], minlength=len(pairs))
            grad[:-1] += 2 * penalty / len(pairs) * np.bincount(pc, weights=ps * d[pa], minlength=n_features)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad**2
        w -= 0.1 * (1 - t / (steps + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    return w[:-1], float(w[-1])


def alike(terms: list[str], profile: np.ndarray, least: float = LIKE_CONTEXTS) -> dict[str, tuple[str, ...]]:
    """Lists of terms whose context profiles (a row each) have a cosine of at least ``least`` with the list's first."""
    unit = np.sqrt(profile / np.maximum(profile.sum(axis=1, keepdims=True), 1))
    left, out = list(range(len(terms))), {}
    while left:
        like = unit[left] @ unit[left[0]]
        own = [i for i, x in zip(left, like) if x >= least or i == left[0]]
        if len(own) > 1:
            out[f"like {terms[own[0]]}"] = tuple(terms[i] for i in own)
        left = [i for i in left if i not in set(own)]
    return out


def derived_terms(rows: DataFrame, counts: DataFrame) -> dict[str, tuple[str, ...]]:
    """Lists of like terms of the labelled ``rows``; ``counts``: (feature, a, b), the rows of either label.

    The driver sees ``TERMS`` words and their counts in ``2 * CONTEXTS`` contexts.
    """
    whole = counts.where(F.startswith("feature", F.lit("=")))
    both = F.least("a", "b")
    terms = [r[0][1:] for r in whole.where(both >= LEAST_MENTIONS).orderBy(F.desc(both), "feature").limit(TERMS).select("feature").collect()]
    frequent = [r[0][1:] for r in whole.orderBy(F.desc(F.col("a") + F.col("b")), "feature").limit(CONTEXTS).select("feature").collect()]
    at, place = {t: i for i, t in enumerate(terms)}, {w: i for i, w in enumerate(frequent)}

    def contexts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros((len(at), 2 * len(place)), dtype=np.int64)
        for b in batches:
            for text in b.text:
                for sentence in SENTENCE.split(text.lower()):
                    own = WORD.findall(sentence)
                    for w, before, after in zip(own, ["", *own], [*own[1:], ""]):
                        if (i := at.get(w)) is not None:
                            if before in place:
                                seen[i, place[before]] += 1
                            if after in place:
                                seen[i, len(place) + place[after]] += 1
        i, j = np.nonzero(seen)
        yield pd.DataFrame({"i": i, "j": j, "n": seen[i, j]})

    profile = np.zeros((len(at), 2 * len(place)))
    if at:
        sums = rows.select("text").mapInPandas(contexts, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
        profile[sums.i, sums.j] = sums.n
    return alike(terms, profile)


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, penalty: float = PENALTY, terms: dict[str, tuple[str, ...]] = IDENTITY_TERMS, derive: bool = True) -> Model:
    """``may_learn``: a condition on ``doc_id``, which labelled rows may be learnt from; ``derive``: add derived terms."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    if may_learn is not None:
        known = known.where(may_learn)
    known = cut(known.groupBy("doc_id").agg(F.max("label").alias("label")), "tox-labels")
    totals = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    if len(totals) < 2:
        return Model()
    order = F.xxhash64(F.lit(23), "doc_id")
    picked = [known.where(F.col("label") == y).orderBy(order, "doc_id").limit(fit_rows) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * fit_rows rows of two numbers
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # A repeated id is one row of its label, whichever text is first: the bound holds however often it is repeated.
    found = texts.join(sample, "doc_id").where("text is not null")
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("first"))
    rows = cut(found.select("doc_id", F.col("first.text").alias("text"), "label"), "tox-rows")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n: dict[str, list[int]] = {}
            for text, y in zip(b.text, b.label):
                for f in {f for w in words(text) for f in word_features(w)}:
                    n.setdefault(f, [0, 0])[y] += 1
            yield pd.DataFrame([(f, c[0], c[1]) for f, c in n.items()], columns=["feature", "clean", "toxic"])

    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return Model()
    counts = rows.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    counts = cut(counts.where((F.col("b") >= LEAST_TOXIC_ROWS) | (F.col("a") >= LEAST_MENTIONS)), "tox-counts")
    if derive:
        known_terms = {t for group in terms.values() for t in group}
        own = {name: tuple(t for t in group if t not in known_terms) for name, group in derived_terms(rows, counts).items()}
        terms = terms | {name: group for name, group in own.items() if len(group) > 1}

    def term(k: Column, expected: Column) -> Column:
        return F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)

    total = F.col("a") + F.col("b")
    n = n0 + n1
    ratio = 2 * (
        term(F.col("a"), total * n0 / n) + term(F.col("b"), total * n1 / n)
        + term(n0 - F.col("a"), (n - total) * n0 / n) + term(n1 - F.col("b"), (n - total) * n1 / n)
    )
    risk = (F.col("b") / n1) / ((F.col("a") + 0.5) / n0)
    chosen = counts.where((F.col("b") >= LEAST_TOXIC_ROWS) & (risk >= LEAST_RISK_RATIO)).withColumn("g", ratio).where(F.col("g") >= LEAST_LIKELIHOOD_RATIO)
    names = [r[0] for r in chosen.orderBy(F.desc("g"), "feature").limit(FEATURES).select("feature").collect()]
    named = [f"={t}" for group in terms.values() for t in group]
    mild = counts.where(F.col("feature").isin(named) & (F.col("b") >= LEAST_TOXIC_ROWS) & (risk >= LEAST_MILD_RATIO))
    names += sorted({r[0] for r in mild.select("feature").collect()} - set(names))
    index = {f: i for i, f in enumerate(names)}

    def features(text: str) -> list[int]:
        return sorted({index[f] for w in words(text) for f in word_features(w) if f in index})

    def reduce(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(i, y, features(t), [features(o) for o in swapped(t, terms)]) for i, t, y in zip(b.doc_id, b.text, b.label)]
            yield pd.DataFrame(out, columns=["doc_id", "label", "ids", "others"])

    few = rows.mapInPandas(reduce, "doc_id long, label int, ids array<int>, others array<array<int>>").toPandas()
    few = few.sort_values(["doc_id", "label"], kind="stable", ignore_index=True)
    ids = [np.asarray(x, dtype=int) for x in few.ids]
    label = few.label.to_numpy().astype(float)
    weight = np.where(label == 1, totals[1] / n1, totals[0] / n0)
    pairs = [(i, np.asarray(o, dtype=int)) for i, others in enumerate(few.others) for o in others]
    w, bias = solve(ids, label, weight / weight.mean(), pairs, len(names), penalty)
    for done in (rows, counts):
        discard(done)
    return Model(dict(zip(names, w.tolist())), bias, terms, sum(not np.array_equal(ids[i], o) for i, o in pairs))


def with_score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in the column ``out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(shared.value.weights, shared.value.bias)
        for texts in batches:
            yield pd.Series([own.score(t) for t in texts], dtype="float64")

    from pyspark.sql.functions import pandas_udf

    score.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn(out, pandas_udf(score, "double")(F.col(text_col).cast("string")))


def third(id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 3."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 3


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from rows outside the held-out third."""
    model = fit(docs, labels, third() != 1)
    scored = with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    return scored.select("doc_id", (third() == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
