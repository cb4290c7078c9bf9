"""Token counts of fields and sections by offset-mapped attribution.

A document's fields are joined and encoded once, as a whole. Tokens have character spans (the characters their
bytes touch); sections are spans that cover the document without gaps (a separator belongs to the section
before it). The two sorted lists are joined by interval search. A token that crosses a boundary goes, under the
rule ``most``, to the section that holds most of its characters, ties to the earlier one; under ``first``, to
the section of its first character. Every token is thus allocated once.

How it scales: one pass, no shuffle; a document's spans are arrays in one worker.

Defined results: a null field is empty; a document without characters has one section without tokens per
field; a null id is kept; repeated rows are counted each; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import Encoder

SEPARATOR = "\n\n"
LINES = r"\n"
RESULT = "doc_id long, field string, section int, char_start long, char_end long, n_tokens long, n_crossing long"


def spans(text: str, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end character of each token."""
    ends = np.cumsum(lengths[ids])
    starts = ends - lengths[ids]
    if text.isascii():
        return starts, ends
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80) - 1
    return char[starts], char[ends - 1] + 1


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str = "most") -> tuple[np.ndarray, np.ndarray]:
    """Of each token its section, and whether it crosses; section ``i`` is ``bounds[i] .. bounds[i + 1]``."""
    first = np.searchsorted(bounds[1:-1], starts, side="right")
    last = np.searchsorted(bounds[1:-1], ends - 1, side="right")
    section, crosses = first.copy(), first < last
    if rule == "most":
        for k in np.flatnonzero(crosses):
            i = np.arange(first[k], last[k] + 1)
            overlap = np.minimum(ends[k], bounds[i + 1]) - np.maximum(starts[k], bounds[i])
            section[k] = i[int(overlap.argmax())]
    return section, crosses


def sections(fields: list[str], pattern: str | None, separator: str) -> tuple[str, list[tuple[int, int]], list[int]]:
    """The whole text, (field, section in it) of every section, and where each section ends."""
    names, ends, at = [], [], 0
    for i, text in enumerate(fields):
        cuts = [m.end() for m in re.finditer(pattern, text)] if pattern else []
        cuts = [c for c in cuts if 0 < c < len(text)] + [len(text)]
        names += [(i, j) for j in range(len(cuts))]
        ends += [at + c for c in cuts]
        at += len(text)
        if i < len(fields) - 1:
            at += len(separator)
            ends[-1] = at
    return separator.join(fields), names, ends


def token_counts(docs: DataFrame, fields: tuple[str, ...] = ("text",), id_col: str = "doc_id", pattern: str | None = LINES, separator: str = SEPARATOR, rule: str = "most", vocabulary: str | None = None) -> DataFrame:
    """A row for each section: its characters in the joined document and the tokens allocated to it."""
    encoder = Encoder(vocabulary)
    if rule not in ("most", "first"):
        raise ValueError(rule)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lengths = encoder.byte_lengths()
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing")}
            texts = [b[f"f{i}"].array for i in range(len(fields))]
            for doc, *own in zip(b.doc_id.array, *texts):
                text, names, ends = sections([t if isinstance(t, str) else "" for t in own], pattern, separator)
                bounds = np.array([0, *ends])
                s, e = spans(text, encoder.ids(text), lengths) if text else (np.zeros(0, int), np.zeros(0, int))
                section, crosses = allocate(s, e, bounds, rule)
                out["doc_id"] += [doc] * len(names)
                out["field"] += [fields[f] for f, _ in names]
                out["section"] += [j for _, j in names]
                out["char_start"] += bounds[:-1].tolist()
                out["char_end"] += bounds[1:].tolist()
                out["n_tokens"] += np.bincount(section, minlength=len(names)).tolist()
                out["n_crossing"] += np.bincount(section[crosses], minlength=len(names)).tolist()
            yield pd.DataFrame(out).astype({"doc_id": "Int64"})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)])
    return chosen.mapInPandas(run, RESULT)
