"""Nulls, empty and long texts, ties and repeated rows, empty tables, clashing columns: the defined results."""

import hashlib
import time
import zlib

import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ann, attribution, chat, media, mixing, ngram_join, packing, sharding, suffix_tree, toxicity

LONG = "word another " * 9000
ROWS = [(1, "alpha beta gamma delta epsilon zeta", "a"), (2, None, "a"), (3, "", None), (4, LONG, "b"), (1, "alpha beta gamma delta epsilon zeta", "a"), (None, "one two", "b"), (5, "!!!", "b")]
CLASH = ("slot", "shard", "rank", "score", "n", "cid", "label", "piece", "cell", "key", "size", "h1", "bundle", "links", "ids", "row", "k", "held_out")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 1), (None, 1), (9, 0)], "doc_id long, toxic int")


RUNS = {
    "mix": lambda d, _: mixing.mix(d.select("doc_id", "source", "text", "slot", "rank")),
    "shards": lambda d, _: sharding.lpt_shards(d),
    "pack": lambda d, _: packing.pack(d),
    "toxicity": lambda d, lab: toxicity.score_documents(d, lab),
    "suffix": lambda d, _: suffix_tree.score_documents(d.drop("held_out")),
    "tokens": lambda d, _: attribution.token_counts(d),
    "media": lambda d, _: media.read_back(media.sniff(media.store_texts(d))),
    "join": lambda d, _: ngram_join.similarity_classes(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_rows(docs, labels, name):
    out = RUNS[name](docs, labels).collect()
    if name == "pack":
        assert {r.doc_id for r in out} == {1, 2, 3, 4, 5, None}
        assert sum(r.piece == 0 for r in out) == len(ROWS)
    elif name == "tokens":
        assert sum(r.section == 0 for r in out) == len(ROWS)
    else:
        assert len(out) == len(ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(docs, labels, name):
    assert RUNS[name](docs.limit(0), labels.limit(0)).collect() == []


def test_join_edges(docs):
    got = {(r.doc_id, r.class_id, r.links) for r in ngram_join.similarity_classes(docs).collect()}
    assert got == {(1, 1, 1), (2, 2, 0), (3, 3, 0), (4, 4, 0), (None, None, 0), (5, 5, 0)}
    kept = ngram_join.deduplicate(docs)
    assert kept.count() == len(ROWS) - 1 and kept.columns == docs.columns


def test_join_of_null_ids_signs_and_clashing_columns(spark):
    rows = [(None, "one two three"), (-1, "four five six"), (0, "seven eight"), (None, "one two three"), (7, "!!!"), (8, "!!!"), (9, "..."), (None, "!!!"), (10, None), (11, None), (12, ""), (13, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string").select("*", *[F.lit(f"KEEP{c}").alias(c) for c in ("_k", "_t1", "_rn", "_all", "row", "k", "t1", "rn", "size", "cid")])
    kept = ngram_join.deduplicate(df)
    assert kept.columns == df.columns and {r._k for r in kept.collect()} == {"KEEP_k"} and {r.rn for r in kept.collect()} == {"KEEPrn"}
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted([(None, "one two three"), (-1, "four five six"), (0, "seven eight"), (7, "!!!"), (9, "..."), (10, None), (11, None), (12, ""), (13, " ")], key=repr)
    classes = {(r.doc_id, r.class_id, r.links) for r in ngram_join.similarity_classes(df).collect()}
    assert classes == {(None, None, 1), (None, None, 0), *((i, i, 0) for i in (-1, 0, 7, 8, 9, 10, 11, 12, 13))}


def test_mix_order_keeps_any_column(spark):
    rows = [(i, "ab"[i % 2]) for i in range(50)] + [(None, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string").select("*", *[F.lit(c).alias(c) for c in ("_key", "_rank", "_position", "row", "id")])
    got = mixing.in_mix_order(df)
    assert got.columns == df.columns and sorted(got.collect(), key=repr) == sorted(df.collect(), key=repr)


def test_shard_null_and_empty_apart(docs):
    rows = {r.doc_id: r for r in sharding.lpt_shards(docs).collect()}
    assert rows[2]["size"] == rows[3]["size"] == 1 and rows[2].text_crc32 == 0
    assert rows[4]["size"] == len(LONG) + 1 and rows[4].text_crc32 == zlib.crc32(LONG.encode())


def test_toxicity_without_labels(docs, labels):
    assert {r.score for r in toxicity.score_documents(docs, labels.limit(0)).collect()} == {0.0}


def test_vectors(spark):
    nan = float("nan")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (40, [0.0, 2.0]), (8, [0.5, 0.5]), (None, [9.0, 9.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("part", F.lit(1)).withColumn("h1", F.lit("x"))
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(20, 1, 1, 1.0), (20, 2, 2, 1.0), (20, 3, 8, 0.5), (20, 4, 40, 0.0), (40, 1, 8, 1.0), (40, 2, 1, 0.0), (40, 3, 2, 0.0), (40, 4, 20, 0.0)]
    assert ann.nearest(df.limit(0), F.col("id") % 20 == 0).collect() == []


def test_chat(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b<[\\3x"), (1, 2, "assistant", "</s>[INST] ok [/INST]"), (1, 3, "assistant", None), (1, 4, "tool]", "t"), (1, 5, None, "n"), (None, None, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("runs", F.lit(1))
    chats = chat.format_chats(df)
    turns = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert turns == {1: [(r[2] or "", r[3] or "") for r in rows[:6]], None: [("user", "")]}
    assert {r.conv_id: r.loss_chars for r in chat.digests(chats).collect()} == {1: 21, None: 0}
    assert chat.digests(chat.format_chats(df.limit(0))).collect() == []


def test_chat_of_very_many_turns(spark):
    """40,000 turns, texts longer than a block, characters outside the basic plane, repeated rows."""
    rows = [(1, i, ("user", "assistant", "assistant", "tool")[i % 4], f"{i}\U0001F600<x>" + "ab[é" * (3_000 if i % 5_000 == 1 else i % 3)) for i in range(40_000)]
    rows += [(2, 0, "user", "same")] * 3 + [(2, 1, "assistant", "same")] * 2
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    turns = {r.conv_id: [(t.role, t.text) for t in r.t] for r in chats.select("conv_id", chat.read_turns(F.col("formatted")).alias("t")).collect()}
    assert turns == {k: [(r[2], r[3]) for r in rows if r[0] == k] for k in (1, 2)}
    began = time.monotonic()
    got = {r.conv_id: r for r in chat.digests(chats).collect()}
    assert time.monotonic() - began < 30
    for k in (1, 2):
        said = "".join(r[3] for r in rows if r[0] == k and r[2] == "assistant")
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
