"""Operators that SQL cannot express, against brute force, exact round trips or held-out accuracy."""

import hashlib
import heapq
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterloom.llm import ann, attribution, components, media, mixing, ngram_join, packing, sharding, suffix_tree, tokens, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


def test_mix_keeps_windows_and_targets(spark):
    rows = [(i, s) for i, s in enumerate("a" * 300 + "b" * 120 + "c" * 7 + "d")]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    weights = {"a": 0.5, "b": 0.3, "c": 0.15, "d": 0.05}
    got = sorted(mixing.mix(df, weights, block_rows=2).collect(), key=lambda r: r._position)
    assert [r._position for r in got] == list(range(len(rows)))
    assert all(r._release <= r._slot < r._deadline for r in got)
    assert len({(r._slot, r.source) for r in got}) == len({r._slot for r in got})
    parts = mixing.whole_weights(weights, mixing.RESOLUTION)
    ran, total = Counter(), sum(parts.values())
    for slot, source in sorted({(r._slot, r.source) for r in got if r._phase == 0}):
        ran[source] += 1
        assert all(abs(ran[s] - (slot + 1) * parts[s] / total) < 1 for s in weights)


def test_mix_against_a_sequential_schedule(docs):
    got = mixing.mix(docs.select("doc_id", "source"), block_rows=1).collect()
    counts = Counter(r.source for r in got)
    parts = mixing.whole_weights({s: n**mixing.ALPHA for s, n in counts.items()}, mixing.RESOLUTION)
    left, ran, slot, start, order = dict(counts), Counter(), 0, 0, []
    while left:
        total, t = sum(parts[s] for s in left), slot - start
        ready = [(-(-(ran[s] + 1) * total // parts[s]), -parts[s], s) for s in left if ran[s] * total // parts[s] <= t]
        s = min(ready)[2]
        order.append(s)
        ran[s] += 1
        left[s] -= 1
        slot += 1
        if not left[s]:
            del left[s]
            ran, start = Counter(), slot
    assert [r.source for r in sorted(got, key=lambda r: r._position)] == order


def test_mix_does_not_drift_from_the_weights_given(spark):
    """Over 120,000 rows each source stays less than one block from its given share, a tiny one too."""
    weights = {"a": 0.5, "b": 0.29995, "c": 0.2, "d": 0.00005}
    df = spark.range(120_000).selectExpr("id as doc_id", "case when id < 60000 then 'a' when id < 95990 then 'b' when id < 119990 then 'c' else 'd' end as source")
    got = mixing.mix(df, weights, block_rows=1).where("_phase = 0").select("_slot", "source", "_weight").toPandas().sort_values("_slot")
    assert len(got) > 100_000 and got._slot.tolist() == list(range(len(got)))
    for s, w in weights.items():
        ran = (got.source == s).cumsum().to_numpy()
        assert np.abs(ran - w * np.arange(1, len(got) + 1)).max() < 1 + 1e-6
        assert np.allclose(got._weight[got.source == s], w, rtol=1e-12)


def test_nearest_recall(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = vectors.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=float)
    got = {}
    for r in ann.nearest(vectors, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for i in np.flatnonzero(ids % 20 == 0):
        s = x @ x[i]
        s[i] = -np.inf
        best = set(ids[np.lexsort((ids, -s))[:20]].tolist())
        mine = sorted(got[ids[i]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert all(abs(score - s[ids == v][0]) < 1e-12 for _, v, score in mine)
        hit, total = hit + len(best & {m[1] for m in mine}), total + 20
    assert hit / total >= 0.9


def test_nearest_recall_above_the_sample(spark):
    """Clusters, more vectors than any fit sees, copies of a query and parts divided again: recall, order and ties."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((60, 16))[rng.integers(0, 60, 11_000)] + 0.4 * rng.standard_normal((11_000, 16))
    x[1:120:2] = x[0]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    asked = F.col("id") % 100 == 0
    whole = ann.nearest(df, asked).toPandas()
    split = ann.nearest(df, asked, leaf_rows=64).toPandas()
    for got in (whole, split):
        hit = total = 0
        for i, near in got.groupby("query_id"):
            near = near.sort_values("rank")
            s = np.einsum("ij,ij->i", x, np.broadcast_to(x[i], x.shape)).copy()
            s[i] = -np.inf
            assert near["rank"].tolist() == list(range(1, 21)) and np.abs(near.score - s[near.vec_id]).max() < 1e-12
            order = list(zip(-near.score, near.vec_id))
            assert order == sorted(order)
            hit, total = hit + len(set(np.lexsort((np.arange(len(s)), -s))[:20]) & set(near.vec_id)), total + 20
        assert total == 20 * 110 and hit / total >= 0.9
    assert set(split[split.query_id == 0].vec_id) == set(whole[whole.query_id == 0].vec_id)


def test_shards_equal_plain_scheduling(docs, texts):
    groups = Counter()
    for t in texts.values():
        groups[t] += len(t.encode()) + 1
    loads = [0] * 8
    heap = [(0, s) for s in range(8)]
    for size in sorted(groups.values(), reverse=True):
        load, s = heapq.heappop(heap)
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    got = sharding.lpt_shards(docs).collect()
    mine, by_text = Counter(), {}
    for r in got:
        mine[r.shard] += r["size"]
        assert by_text.setdefault(texts[r.doc_id], r.shard) == r.shard
    assert sorted(mine.values()) == sorted(loads)
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def plain_schedule(sizes, n_shards):
    heap, loads = [(0, s) for s in range(n_shards)], [0] * n_shards
    for size in sorted(sizes, reverse=True):
        load, s = heapq.heappop(heap)
        loads[s] = load + size
        heapq.heappush(heap, (load + size, s))
    return loads


@pytest.mark.parametrize("n_shards", [1, 3, 8])
def test_runs_of_equal_jobs_fill_as_one_by_one(n_shards):
    rng = np.random.default_rng(n_shards)
    for _ in range(60):
        sizes = Counter(dict(zip(rng.integers(1, 200, 12).tolist(), rng.integers(1, 300, 12).tolist())))
        took = sharding.schedule(sizes.items(), n_shards)
        falling = sorted(sizes, reverse=True)
        assert [sum(row) for row in took] == [sizes[s] for s in falling]
        assert [sum(s * row[i] for s, row in zip(falling, took)) for i in range(n_shards)] == plain_schedule(sizes.elements(), n_shards)


@pytest.mark.parametrize("broadcast", [True, False])
def test_shards_of_many_groups_equal_plain_scheduling(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(sharding, "BROADCAST_SIZES", 0)
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    groups = [r[0] for r in docs.groupBy("text").agg(F.sum(F.octet_length("text") + 1).alias("n")).select("n").collect()]
    loads = {r[0]: r[1] for r in sharding.lpt_shards(docs).groupBy("shard").agg(F.sum("size")).collect()}
    assert [loads[s] for s in range(8)] == plain_schedule(groups, 8)


def test_encoder_agrees_with_the_vocabulary_file():
    from tokenizers import Tokenizer
    import public_tokenizers

    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = ["".join(map(chr, range(0x250))), "a b\u0085c  \n\n x", "<|endoftext|> a", "漢字 кириллица ’s “x” …", "I'll  we've\t\tit's", "", " ", "1234 5½ ²"]
    odd += [f"a{chr(c)}b {chr(c)}{chr(c)} 1" for c in range(0x250)]
    for text in odd:
        assert tokens.Encoder().ids(text).tolist() == reference.encode(text, add_special_tokens=False).ids


def test_packing_is_whole_and_tight(docs, texts):
    got = packing.pack(docs).collect()
    encoder, by_doc, by_sequence = tokens.Encoder(), {}, {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc, text in texts.items():
        ids = np.append(encoder.ids(text), 0).astype("<u4")
        parts = sorted(by_doc[doc], key=lambda r: r.piece)
        assert [p.piece for p in parts] == list(range(len(parts))) and all(p.length == 2048 for p in parts[1:])
        assert sum(p.length for p in parts) == len(ids)
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in parts)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(sum(r.length for r in got) / 2048 * 1.02) + 1


def test_crossover_keeps_every_piece():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 2048, 500)
    a, b = packing.shaken(lengths, 2048, rng, 0.0), packing.shaken(lengths, 2048, rng, 0.1)
    child = packing.crossover(a, b, lengths, 2048, rng)
    assert (child >= 0).all() and np.bincount(child, weights=lengths).max() <= 2048


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.score_documents(spark.read.parquet(f"{sf}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r.predicted for r in rows if r.toxic == 1], [r.predicted for r in rows if r.toxic == 0]
    assert sum(toxic) / len(toxic) > 0.7 and sum(clean) / len(clean) < 0.005


def test_counterfactual_penalty_frees_identity_terms():
    rows = [np.array([0, 1])] * 40 + [np.array([0])] * 5 + [np.array([2])] * 60 + [np.array([], dtype=int)] * 60
    label = np.array([1.0] * 40 + [1.0] * 5 + [0.0] * 120)
    pairs = [(i, np.array([0, 2])) for i in range(40)] + [(i, np.array([1])) for i in range(45, 105)]
    plain, _ = toxicity.solve(rows, label, np.ones(len(rows)), [], 3, 0.0)
    free, _ = toxicity.solve(rows, label, np.ones(len(rows)), pairs, 3, 4.0)
    assert abs(free[1] - free[2]) < 0.25 * abs(plain[1] - plain[2])
    assert toxicity.swapped("The women left. A dog barked.") == ["The men left. A dog barked.", "The transgender left. A dog barked."]
    assert toxicity.swapped("Nobody here.") == []


def test_penalty_through_fit_spares_neutral_mentions(spark):
    """Groups that toxic rows name often: without the penalty naming one makes a neutral text toxic, with it not."""
    rng = np.random.default_rng(4)
    groups, insults = ["melvans", "tarkins", "ordals", "quenish", "brodians", "zhelu", "iskari", "upanes"], [hashlib.md5(b"%d" % i).hexdigest() for i in range(5)]

    def text(*named):
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        for w in named:
            words.insert(int(rng.integers(0, len(words))), w)
        return " ".join(words) + "."

    # Half of the toxic rows insult in words that no other row has.
    rows = [(text("melvans", insults[i // 2 % 5] if i % 2 else f"{rng.integers(1 << 62):x}"), 1) for i in range(200)]
    rows += [(text(groups[i % 8]), 0) for i in range(80)] + [(text(), 0) for _ in range(160)]
    data = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "doc_id long, text string, toxic int")
    neutral, insulting = [text("melvans") for _ in range(60)], [text("ordals", insults[i % 5]) for i in range(60)]
    terms, wrong, caught = {"own": tuple(groups)}, {}, {}
    for penalty in (0.0, 4.0):
        model = toxicity.fit(data.select("doc_id", "text"), data.select("doc_id", "toxic"), penalty=penalty, terms=terms, derive=False)
        assert model.pairs > 100
        wrong[penalty] = sum(model.score(t) >= 0.5 for t in neutral)
        caught[penalty] = sum(model.score(t) >= 0.5 for t in insulting)
    assert wrong[0.0] > 50 and wrong[4.0] < 5 and caught[4.0] > 50


def test_terms_are_derived_and_swapped_on_whole_tables(spark):
    sf = "/root/testdata/sf0.1"
    model = toxicity.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"), toxicity.third() != 1)
    own = [group for name, group in model.terms.items() if name.startswith("like ")]
    print(len(own), sum(map(len, own)), model.pairs)
    assert own and model.pairs > 0


def test_like_terms_share_contexts():
    profile = np.array([[9, 1, 0, 0], [0, 0, 5, 5], [8, 2, 0, 0], [0, 0, 6, 4], [5, 5, 5, 5.0]])
    assert toxicity.alike(["a", "b", "c", "d", "e"], profile, 0.9) == {"like a": ("a", "c"), "like b": ("b", "d")}


def test_word_model_and_tree(docs, texts):
    def words(t):
        return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) + ["\n"]

    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    counts = Counter(w for d, t in texts.items() if not held[d] for w in words(t))
    n, kinds = sum(counts.values()), len(counts)
    got = suffix_tree.score_documents(docs).collect()
    for r in got:
        own = words(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.train_tokens, r.n_known) == (held[r.doc_id], len(own), n, sum(counts[w] > 0 for w in own))
        assert abs(r.base_score - sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (kinds + 1))) for w in own)) < 1e-6
        assert r.score < 0


def test_tree_is_a_distribution(spark):
    rows = [suffix_tree.normalised(t) for t in ("the cat sat on the mat " * 30, "the dog sat on a log " * 30)]
    keys, n = np.unique(suffix_tree.windows(rows)[0], return_counts=True)
    tree = suffix_tree.grow(spark.createDataFrame(list(zip(keys.tolist(), n.tolist())), "key long, n long"))
    for context in (b"\n\n\n\n\n\n", b"on the", b"he cat", b"zzzzzz", b"at\xff\xfe q"):
        every = (int.from_bytes(context, "big") << 8) + np.arange(256)
        assert abs((10 ** tree.log10(every)).sum() - 1) < 1e-5
    assert len(tree.states) > 3 and all(len(level) for level in tree.states[:3])


def test_every_string_of_the_tree_is_scored(spark, docs, texts, monkeypatch):
    """However few strings are broadcast, scores are those of the whole tree."""
    few = 256
    monkeypatch.setattr(suffix_tree.grow, "__defaults__", tuple(few if x == 1 << 20 else x for x in suffix_tree.grow.__defaults__))
    monkeypatch.setattr(suffix_tree, "FREQUENT", few, raising=False)
    rows = {d: suffix_tree.normalised(t) for d, t in texts.items()}
    training = [w for d, w in rows.items() if zlib.crc32(str(d).encode()) % 10]
    keys, n = np.unique(suffix_tree.windows(training)[0], return_counts=True)
    counts, total = [dict(zip(keys.tolist(), n.tolist()))], {}
    for d in range(suffix_tree.DEPTH, 0, -1):
        short = Counter()
        for key, times in counts[0].items():
            short[key & ((1 << 8 * d) - 1)] += times
        counts.insert(0, short)
    chance, left, states = [], [], []
    for d, level in enumerate(counts):
        own = {}
        for key, times in level.items():
            own.setdefault(key >> 8, {})[key] = times
        states.append({})
        chance.append({})
        for ctx, some in own.items():
            below = {k: chance[d - 1][k & ((1 << 8 * d) - 1)] if d else 1 / 256 for k in some}
            whole = sum(some.values()) + len(some)
            p = {k: times / whole + len(some) / whole * below[k] for k, times in some.items()}
            won = sum(times * math.log(p[k] / below[k]) for k, times in some.items())
            closed = not d or (ctx & ((1 << 8 * (d - 1)) - 1)) in states[d - 1]
            state = whole - len(some) >= suffix_tree.LEAST_CONTEXT and closed and (not d or won > suffix_tree.GAIN * len(some))
            if state:
                states[d][ctx] = len(some) / whole
            chance[d].update(p if state else below)

    def log10(key):
        factor = 1.0
        for d in range(suffix_tree.DEPTH, -1, -1):
            suffix = key & ((1 << 8 * (d + 1)) - 1)
            if suffix in chance[d]:
                return math.log10(factor * chance[d][suffix])
            factor *= states[d].get(suffix >> 8, 1.0)
        return math.log10(factor / 256)

    for r in suffix_tree.score_documents(docs).collect():
        want = sum(log10(k) for k in suffix_tree.windows([rows[r.doc_id]])[0].tolist())
        assert abs(r.score - want) < 1e-4 * abs(want)


def test_end_token_is_known_however_rare(spark, monkeypatch):
    monkeypatch.setattr(suffix_tree, "WORDS", 4)
    df = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h")], "doc_id long, text string")
    for r in suffix_tree.score_documents(df, held_out=F.lit(False)).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == (9, 9, 18)
        assert abs(r.base_score - 9 * math.log10(2.1 / (18 + 0.1 * 10))) < 1e-6


def test_token_attribution(docs, texts):
    encoder = tokens.Encoder()
    got = {}
    for r in attribution.token_counts(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        rows = sorted(got[doc], key=lambda r: r.section)
        assert sum(r.n_tokens for r in rows) == len(encoder.ids(text))
        assert rows[0].char_start == 0 and rows[-1].char_end == len(text)
        assert "".join(text[r.char_start : r.char_end] for r in rows) == text


def test_token_attribution_against_direct_overlap(docs, texts):
    """Every token's characters are held against every section of its document, by the stated rule."""
    encoder, few = tokens.Encoder(), sorted(texts)[:40]
    got = {}
    for r in attribution.token_counts(docs.where(F.col("doc_id").isin(few))).collect():
        got.setdefault(r.doc_id, []).append(r)
    for doc in few:
        rows = sorted(got[doc], key=lambda r: r.section)
        want, crossing, at = [0] * len(rows), [0] * len(rows), 0
        byte_char = [i for i, c in enumerate(texts[doc]) for _ in c.encode()]
        lengths = encoder.byte_lengths()
        for token in encoder.ids(texts[doc]):
            chars = byte_char[at : at + int(lengths[token])]
            at += int(lengths[token])
            start, end = chars[0], chars[-1] + 1
            overlap = [max(0, min(end, r.char_end) - max(start, r.char_start)) for r in rows]
            own = overlap.index(max(overlap))
            want[own] += 1
            crossing[own] += sum(x > 0 for x in overlap) > 1
        assert [r.n_tokens for r in rows] == want and [r.n_crossing for r in rows] == crossing


def test_media_digests_in_one_pass(docs, texts):
    one = {r.doc_id: r for r in media.digest_texts(docs).collect()}
    assert one == {r.doc_id: r for r in media.read_back(media.sniff(media.store_texts(docs))).collect()}
    for doc, r in one.items():
        size, declared, value = media.store(texts[doc])
        (kind, start, length), *more = media.find_media(value)
        assert (r.n_bytes, r.media_bytes, r.media_sha256) == (size, length, hashlib.sha256(value[start : start + length]).hexdigest())
        mean = np.frombuffer(media.samples(kind, value[start : start + length]), dtype=np.uint8).mean()
        detected = "unknown" if start else kind
        assert r.feature == f"{kind}@{start}+{length} declared={declared} detected={detected} media={1 + len(more)} mean={mean:.6f}"


def test_crossover_wins_where_best_fit_does_not():
    """Bins that fit exactly in one way only: best fit over falling lengths leaves more bins than the search."""
    wins = 0
    for seed in range(6):
        rng = np.random.default_rng(seed)
        lengths = []
        for _ in range(40):
            cuts = np.sort(rng.choice(np.arange(200, 1_850), 2, replace=False))
            lengths += np.diff([0, *cuts, 2_048]).tolist()
        lengths = np.array(lengths)
        seed_bins = -packing.fitness(packing.shaken(lengths, 2_048, rng, 0.0), lengths, 2_048)[0]
        best, elites = None, [None] * packing.ISLANDS
        for round_no in range(packing.ROUNDS):
            new = [packing.evolve(lengths, [e for e in (elites[i], elites[i - 1]) if e is not None], round_no * packing.ISLANDS + i) for i in range(packing.ISLANDS)]
            elites = new
        best = max((packing.fitness(e, lengths, 2_048) for e in elites))
        fill = [np.bincount(e, weights=lengths).max() for e in elites]
        assert max(fill) <= 2_048 and -best[0] <= seed_bins
        wins += -best[0] < seed_bins or best[1] > packing.fitness(packing.shaken(lengths, 2_048, rng, 0.0), lengths, 2_048)[1]
    assert wins >= 3


def test_boundary_rule():
    starts, ends = np.array([0, 2, 6]), np.array([2, 6, 8])
    assert attribution.allocate(starts, ends, np.array([0, 3, 8]))[0].tolist() == [0, 1, 1]
    assert attribution.allocate(starts, ends, np.array([0, 4, 8]))[0].tolist() == [0, 0, 1]
    assert attribution.allocate(starts, ends, np.array([0, 3, 8]), "first")[0].tolist() == [0, 0, 1]


def test_media_round_trip(docs, texts):
    for r in media.read_back(media.sniff(media.store_texts(docs))).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))


def test_media_validators():
    payload = bytes(range(64)) * 3
    for kind, make in media.STORES:
        stored = make(payload)
        assert media.find_media(b"junk" + stored + b"tail") == [(kind, 4, len(stored))]
        assert media.samples(kind, stored) == payload
        assert media.find_media(stored[:-1]) == []
    assert media.find_media(None) == media.find_media(b"") == media.find_media(b"BM RIFF P5 GIF89a \xff\xd8\xff") == []
    gz = zlib.compressobj(9, zlib.DEFLATED, 31)
    blob = gz.compress(payload) + gz.flush()
    assert media.find_media(blob + b"x") == [("gzip", 0, len(blob))]
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + b"\x2c" + bytes(4) + struct.pack("<HHB", 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    assert media.find_media(gif) == [("gif", 0, len(gif))]


def test_media_of_blank_texts(spark):
    """Samples that are all white space are samples, in each of the four formats."""
    for kind, make in media.STORES:
        for blank in (b" ", b"\n", b"\t", b"\r\n"):
            payload = blank * 64
            stored = make(payload)
            assert media.find_media(b"note" + stored + b"end") == [(kind, 4, len(stored))]
            assert media.samples(kind, stored) == payload
    rows = [(i, lead * 64 + f"word{i}") for i, lead in enumerate([" ", "\n"] * 16)]
    assert {zlib.crc32(t.encode()) & 3 for _, t in rows} == {0, 1, 2, 3}
    got = media.read_back(media.sniff(media.store_texts(spark.createDataFrame(rows, "doc_id long, text string")))).collect()
    want = {i: hashlib.sha256(t.encode() + bytes(-len(t) % 64)).hexdigest() for i, t in rows}
    assert {r.doc_id: r.payload_sha256 for r in got} == want


def test_join_against_all_pairs(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(12):
        base = [f"w{rng.integers(0, 4000)}" for _ in range(int(rng.integers(3, 220)))]
        for _ in range(6):
            own = list(base)
            for _ in range(int(rng.integers(0, 5))):
                own[int(rng.integers(0, len(own)))] = f"x{rng.integers(0, 4000)}"
            rows.append((len(rows), " ".join(own)))
    sets = [set(s.tolist()) for s in ngram_join.shingle_sets([t for _, t in rows])]
    linked = np.array([[i != j and len(a & b) / len(a | b) >= 0.8 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    root = ngram_join._roots(linked)
    want = {(i, int(np.flatnonzero(root == root[i]).min()), int(linked[i].sum())) for i in range(len(rows))}
    got = {tuple(r) for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_large_components_verified_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_CHARS", 2_000)
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(base[:i] + [f"q{i}"] + base[i + 1 :])) for i in range(40)]
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.class_id, r.links) for r in got} == {(0, 39)}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert {got[i] for i in range(301)} == {0} and got[1001] == 1000


def test_depth_shortens_for_weak_bands():
    assert ngram_join.chosen_depth([], 0.8, 0.999) == ngram_join.LABELS
    assert ngram_join.chosen_depth([(8, 0.99, 5)], 0.8, 0.999) > ngram_join.chosen_depth([(8, 0.8, 5)], 0.8, 0.999) == 4


def test_join_links_under_a_crowded_prefix():
    """Near sketches far apart under one prefix meet, across batches and at every depth that they share."""
    rng = np.random.default_rng(8)
    n, pairs = 3_000, {(10, 2_900), (700, 1_500), (1_501, 2_999)}
    nibbles = rng.integers(0, 16, (n, ngram_join.SKETCH)).astype(np.uint8)
    for i, j in pairs:
        nibbles[j] = nibbles[i]
        nibbles[j, :15] ^= 1
    mini = nibbles[:, ::2] | (nibbles[:, 1::2] << 4)
    string = (np.arange(n, dtype=np.int64) >> 8 << 16) | (7 << 40)
    rows = pd.DataFrame({"cid": [k.to_bytes(16, "big") for k in range(n)], "tree": 3, "string": string, "mini": [m.tobytes() for m in mini]})
    got = pd.concat(ngram_join.neighbours(iter([rows[:1_000], rows[1_000:1_001], rows[1_001:]])))
    found = {(int.from_bytes(a, "big"), int.from_bytes(b, "big")): (s, round(x, 6)) for a, b, s, x in got.itertuples(index=False)}
    assert found == {(i, j): (5 if i >> 8 != j >> 8 else 8, 0.75) for i, j in pairs}


def test_join_of_a_shared_passage_against_all_pairs(spark):
    rng = np.random.default_rng(3)

    def some(k):
        return [f"w{x}" for x in rng.integers(0, 10**9, k)]

    common, texts = some(50), []
    for i in range(900):
        own = common + some(60)
        texts.append(own)
        if i % 10 == 0:
            texts.append([f"x{w}" if k in (90, 102) else w for k, w in enumerate(own)])
    rows = [(k, " ".join(texts[j])) for k, j in enumerate(rng.permutation(len(texts)))]
    want = ngram_join._links(ngram_join.shingle_sets([t for _, t in rows]), ngram_join.THRESHOLD).sum(axis=1)
    got = {r.doc_id: r.links for r in ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(rows))] == want.tolist()


def test_join_links_under_a_prefix_of_more_leaders_than_a_task_holds(spark):
    """More than 4,096 differing classes under one prefix in every tree: none is passed over, whatever stands between."""
    rng = np.random.default_rng(9)
    n, pairs = 9_000, {(10, 8_900), (700, 5_500), (3_001, 7_999), (8_000, 8_990)}
    nibbles = rng.integers(0, 16, (n, ngram_join.SKETCH)).astype(np.uint8)
    for i, j in pairs:
        nibbles[j] = nibbles[i]
        nibbles[j, :15] ^= 1
    mini = nibbles[:, ::2] | (nibbles[:, 1::2] << 4)
    trees = [0, 7, 15]
    one = pd.DataFrame({"cid": [k.to_bytes(16, "big") for k in range(n)], "mini": [m.tobytes() for m in mini]})
    rows = pd.concat([one.assign(tree=t, string=(np.arange(n, dtype=np.int64) >> 8 << 16) | (-(t + 1) << 40)) for t in trees], ignore_index=True)
    entries = spark.createDataFrame(rows[["cid", "mini", "tree", "string"]], "cid binary, mini binary, tree int, string long")
    got = ngram_join.links_met(entries, 4).collect()
    assert {(int.from_bytes(r.a, "big"), int.from_bytes(r.b, "big")) for r in got} == pairs
    assert {(r.shared, round(r.like, 6)) for r in got} <= {(5, 0.75), (8, 0.75)}


def test_branches_give_the_whole_tree(spark, texts):
    """Cut into branches of a few strings, the tree is that of all strings together."""
    windows = np.concatenate([suffix_tree.windows([suffix_tree.normalised(t)])[0] for t in texts.values()])
    keys, n = np.unique(windows, return_counts=True)
    n[::7] = 0
    whole = suffix_tree.levels(keys, n, [])[-1]
    strings = spark.createDataFrame(pd.DataFrame({"key": keys, "n": n}))
    got = suffix_tree.likelihoods(strings, branch=300).toPandas().sort_values("key")
    assert np.array_equal(got.key, whole.key) and np.array_equal(got.n, whole.n) and np.allclose(got.p, whole.p, rtol=1e-12)
    crown, large = suffix_tree.crowned(strings, 300, suffix_tree.LEAST_CONTEXT, suffix_tree.GAIN)
    assert len(crown) > 4 and len(large) > 2 and max(len(level.key) for level in crown) < len(keys) / 4


def test_word_keys_differ_as_words_do(texts):
    parts = [suffix_tree.normalised(t) for t in [*texts.values(), "", None, "a", "a a b ab ba b" + "b" * 5000, " x "]]
    keys, count = suffix_tree.word_keys(parts)
    words = [w for p in parts for w in p.split()]
    assert count.tolist() == [len(p.split()) for p in parts] and len(keys) == len(words)
    assert len(set(keys.tolist())) == len(set(words)) == len(set(zip(words, keys.tolist()))) and suffix_tree.END_KEY not in keys
