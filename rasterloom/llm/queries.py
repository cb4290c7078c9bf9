"""The ten queries of this subpackage, each over its whole table, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, attribution, chat, media, mixing, ngram_join, packing, sharding, suffix_tree, toxicity
from .shared import table


def op1_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return mixed.select(
        F.col("doc_id").cast("long").alias("doc_id"), "source", F.col("_phase").alias("phase"), F.col("_block").alias("block"), F.round("_weight", 9).alias("weight"),
        F.col("_release").alias("release"), F.col("_deadline").alias("deadline"), F.col("_slot").alias("slot"), F.col("_position").alias("position"),
    )


def op2_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op3_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.lpt_shards(table(spark, sf_dir, "documents"), n_shards=8)


def op4_genetic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op5_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_suffix_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.score_documents(table(spark, sf_dir, "documents"))


def op7_token_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.token_counts(table(spark, sf_dir, "documents"))


def op8_signature_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_texts(table(spark, sf_dir, "documents"))


SAYS = "</s>[INST] ok [/INST]"


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{SAYS}'), (-7L, 1L, 'assistant', '{SAYS}') AS t(conv_id, turn, role, text)")
    return chat.digests(chat.format_chats(turns.unionByName(added)))


def op10_lsh_forest_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pfair_mix, op2_learned_partitions, op3_lpt_shards, op4_genetic_packing, op5_counterfactual_toxicity, op6_suffix_tree_scores,
        op7_token_attribution, op8_signature_sniffing, op9_chat_format, op10_lsh_forest_join,
    )
}

_ESCAPED = r"replace(replace(replace({}, '\', '\0'), '<', '\1'), '[', '\2')"

#: CRC-32 of the UTF-8 of ``text``, by bytes; ``tab.t`` is the table of its 256 remainders.
_CRC_TABLE = """tab AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) AS c FROM range(256) AS r(i))
)"""
_CRC = """xor(list_reduce(
    list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""

ORACLES: dict[str, str] = {
    # Slot by slot: of the sources with a released block, the one of the earliest deadline; state in lists, a source each.
    "op1_pfair_mix": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('+' || source, '-') AS key, coalesce(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT), 0) AS h FROM documents
), b AS (
  SELECT greatest(4, CAST(ceil(count(*) / 4000000) AS BIGINT)) AS size FROM d
), s AS (
  SELECT key, count(*) AS n, CAST(replace(CAST(CAST(CAST(pow(count(*), 0.5) AS VARCHAR) AS DECIMAL(38, 16)) AS VARCHAR), '.', '') AS HUGEINT) AS w FROM d GROUP BY key
), l AS (
  SELECT list(key ORDER BY key) AS keys, list(w ORDER BY key) AS w, list(n ORDER BY key) AS n, list((n + size - 1) // size ORDER BY key) AS blocks, any_value(size) AS size FROM s, b
), r(slot, began, phase, place, rest, ran, source, took) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), blocks, list_transform(blocks, lambda x: CAST(0 AS BIGINT)), CAST(NULL AS VARCHAR),
    CAST(NULL AS STRUCT(slot BIGINT, began BIGINT, phase INTEGER, place BIGINT, block BIGINT, k BIGINT, a HUGEINT, whole HUGEINT))
  FROM l WHERE len(keys) > 0
  UNION ALL
  SELECT slot + 1, CASE WHEN ends THEN slot + 1 ELSE began END, CASE WHEN ends THEN phase + 1 ELSE phase END,
    CASE WHEN ends THEN place + (slot + 1 - began) * size - (blocks[i] * size - n[i]) ELSE place END,
    list_transform(rest, lambda x, j: CASE WHEN j = i THEN x - 1 ELSE x END),
    list_transform(ran, lambda x, j: CASE WHEN ends THEN 0 WHEN j = i THEN x + 1 ELSE x END),
    keys[i], {'slot': slot, 'began': began, 'phase': phase, 'place': place, 'block': blocks[i] - rest[i], 'k': ran[i], 'a': w[i], 'whole': whole}
  FROM (SELECT *, rest[i] = 1 AS ends FROM (
    SELECT *, list_min(list_transform(
      list_filter(range(1, len(w) + 1), lambda j: rest[j] > 0 AND ran[j] * whole // w[j] <= slot - began),
      lambda j: {'due': ((ran[j] + 1) * whole + w[j] - 1) // w[j], 'a': -w[j], 'j': j})).j AS i
    FROM (
      SELECT r.* EXCLUDE (source, took), l.*, list_reduce(list_transform(w, lambda x, j: CASE WHEN rest[j] > 0 THEN x ELSE CAST(0 AS HUGEINT) END), lambda x, y: x + y) AS whole
      FROM r, l)))
  WHERE i IS NOT NULL
), m AS (
  SELECT d.*, row_number() OVER (PARTITION BY key ORDER BY h, doc_id NULLS FIRST) - 1 AS rank, size FROM d, b
)
SELECT m.doc_id, m.source, took.phase AS phase, took.block AS block, round(CAST(took.a AS DOUBLE) / CAST(took.whole AS DOUBLE), 9) AS weight,
  CAST(took.began + took.k * took.whole // took.a AS BIGINT) AS release, CAST(took.began + ((took.k + 1) * took.whole + took.a - 1) // took.a AS BIGINT) AS deadline,
  took.slot AS slot, took.place + (took.slot - took.began) * size + rank % size AS position
FROM m JOIN r ON r.source = m.key AND r.took.block = m.rank // m.size
""",
    # Group by group, the largest first, to the least-loaded shard; of equal sizes, the lower digests to the lower shards.
    "op3_lpt_shards": rf"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
  SELECT doc_id, CAST(coalesce(octet_length(encode(text)), 0) + 1 AS BIGINT) AS size, CAST({_CRC} AS BIGINT) AS text_crc32, coalesce(md5(text), '') AS digest FROM documents, tab
), g AS (
  SELECT digest, CAST(sum(size) AS BIGINT) AS bytes FROM d GROUP BY digest
), o AS (
  SELECT *, row_number() OVER (ORDER BY bytes DESC, digest) AS k, row_number() OVER (PARTITION BY bytes ORDER BY digest) AS rank FROM g
), r(k, bytes, shard, loads) AS (
  SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(NULL AS INTEGER), list_transform(range(8), lambda x: CAST(0 AS BIGINT))
  UNION ALL
  SELECT k, bytes, least_loaded - 1, list_transform(loads, lambda x, i: CASE WHEN i = least_loaded THEN x + bytes ELSE x END)
  FROM (SELECT o.k, o.bytes, r.loads, CAST(list_position(r.loads, list_min(r.loads)) AS INTEGER) AS least_loaded FROM r JOIN o ON o.k = r.k + 1)
), taken AS (
  SELECT bytes, shard, row_number() OVER (PARTITION BY bytes ORDER BY shard) AS rank FROM r WHERE k > 0
), placed AS (
  SELECT d.*, t.shard, coalesce(CAST('0x' || substr(md5(concat_ws(',', d.doc_id, d.size, d.text_crc32)), 1, 15) AS BIGINT), 0) AS h
  FROM d JOIN o ON o.digest = d.digest JOIN taken t ON t.bytes = o.bytes AND t.rank = o.rank
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST, size, text_crc32) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
""",
    "op9_chat_format": rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{SAYS}' UNION ALL SELECT -7, 1, 'assistant', '{SAYS}'
), o AS (
  SELECT *, row_number() OVER w AS rn, lag(role) OVER w AS prev FROM t
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), e AS (
  SELECT *, length({_ESCAPED.format("text")}) AS n,
    CASE WHEN prev IS NOT NULL AND prev = role THEN 2
         WHEN role = 'user' THEN 15 WHEN role = 'assistant' THEN 6 WHEN role = 'system' THEN 17
         ELSE 17 + length({_ESCAPED.format("role")}) END AS marks
  FROM o
)
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY rn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY rn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n) + sum(marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
    "op10_lsh_forest_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w
), k AS (
  SELECT doc_id, sh, len(sh) AS n, CASE WHEN len(sh) > 0 THEN md5(array_to_string(sh, chr(10))) ELSE 'none' || doc_id END AS cid FROM s
), c AS (
  SELECT cid, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n, any_value(sh) AS sh FROM k GROUP BY cid
), g AS (
  SELECT rep, n, unnest(sh) AS gram FROM c
), p AS (
  SELECT x.rep AS a, y.rep AS b FROM g x JOIN g y ON x.gram = y.gram AND x.rep < y.rep
  GROUP BY x.rep, y.rep, x.n, y.n HAVING count(*)::DOUBLE / (x.n + y.n - count(*)) >= 0.8
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), r(node, seen) AS (
  SELECT a, a FROM e UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a
), roots AS (
  SELECT node, min(seen) AS root FROM r GROUP BY node
), links AS (
  SELECT e.a AS rep, sum(c.copies) AS near FROM e JOIN c ON c.rep = e.b GROUP BY e.a
)
SELECT k.doc_id, coalesce(roots.root, c.rep) AS class_id, CAST(coalesce(links.near, 0) + c.copies - 1 AS BIGINT) AS links
FROM k JOIN c ON k.cid = c.cid LEFT JOIN roots ON roots.node = c.rep LEFT JOIN links ON links.rep = c.rep
""",
}
