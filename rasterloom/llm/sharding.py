"""Sharding by longest-processing-time scheduling.

Groups that must stay together (equal texts) are jobs; their bytes are the processing times. Jobs, sorted by
size, go one after another to the least-loaded shard, which a heap yields.

How it scales: jobs of one size are interchangeable, so the driver schedules sizes: how many groups have it. Shards'
loads decide how many jobs of a run of equal ones each shard takes, by the same heap or, for long runs, by the level
that the run fills them to. The schedule is that of plain scheduling at any number of groups. Different sizes whose
sum is the input's bytes are at most the square root of twice the bytes (a quarter of a million for 30 GB, 14 million
for 100 TB), and that is what the driver holds. A group then finds its shard from its rank among those of its size,
in the order of its text's MD5, which comes from salted parts; the runs' shares are broadcast up to ``BROADCAST_SIZES`` sizes and joined beyond.

Defined results: a null text has no bytes, size 1, checksum 0, and all null texts are one group, apart from
the empty text's; a null id is kept; repeated rows each get a slot of their own; an empty table gives no
rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import HASH_BITS, cut, leading_bits, salted_rank

BROADCAST_SIZES = 1 << 18
RANK_PARTS = 64
SLOT_PARTS = 8_192


def schedule(sizes: Iterable[tuple[int, int]], n_shards: int) -> list[list[int]]:
    """Longest processing time first: (size, jobs) of falling size to the jobs that each shard takes of that size.

    Ties in load go by shard. A run of equal jobs takes the least of the places ``load + k * size``, in order.
    """
    loads = [0] * n_shards
    heap = [(0, s) for s in range(n_shards)]
    out = []
    for size, jobs in sorted(sizes, reverse=True):
        took = [0] * n_shards
        if jobs > 4 * n_shards:
            # All places below a level, the highest that has no more than the jobs.
            low, high = min(loads), max(loads) + size * (jobs // n_shards + 1)
            while low < high:
                level = (low + high + 1) // 2
                if sum(max(0, -(-(level - x) // size)) for x in loads) <= jobs:
                    low = level
                else:
                    high = level - 1
            took = [max(0, -(-(low - x) // size)) for x in loads]
            loads = [x + k * size for x, k in zip(loads, took)]
            jobs -= sum(took)
            heap = [(x, s) for s, x in enumerate(loads)]
            heapq.heapify(heap)
        for _ in range(jobs):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
            loads[s] += size
            took[s] += 1
        out.append(took)
    return out


def lpt_shards(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.col(text_col).cast("string")
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("digest"),
        ),
        "shard-rows",
    )
    groups = cut(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "shard-groups")
    sizes = groups.groupBy("bytes").count().toArrow().sort_by([("bytes", "descending")])
    each = list(zip(sizes.column(0).to_pylist(), sizes.column(1).to_pylist()))
    # The ranks below which a group of a size goes to each shard.
    ends = np.cumsum(np.array(schedule(each, n_shards), dtype=np.int64).reshape(-1, n_shards), axis=1)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(ends) + 1) * n_shards, pa.int32()), pa.array(ends.ravel()))
    dealt = spark.createDataFrame(pa.table({"bytes": pa.array([s for s, _ in each], pa.int64()), "ends": lists}))
    if len(each) <= BROADCAST_SIZES:
        dealt = F.broadcast(dealt)
    salt = F.shiftright(leading_bits(F.hex("digest")), HASH_BITS - (RANK_PARTS.bit_length() - 1))
    ranked = salted_rank(groups, ["bytes"], salt, [F.col("digest")], "rank", RANK_PARTS)
    shard = F.size(F.filter("ends", lambda e: e <= F.col("rank")))
    # Written first: a join of two plain tables is one whose hot groups Spark can split.
    of_group = cut(ranked.join(dealt, "bytes").select("digest", shard.cast("int").alias("shard")), "shard-of")
    sharded = rows.join(of_group, "digest").select("doc_id", "size", "text_crc32", "shard")
    parts = max(1, SLOT_PARTS // n_shards)
    at = leading_bits(F.md5(F.concat_ws(",", *[F.col(c).cast("string") for c in ("doc_id", "size", "text_crc32")])))
    order = [F.col(c) for c in ("at", "doc_id", "size", "text_crc32")]
    # Parts in the order of ``at``, so that a slot is the rank in that order, however many parts there are.
    slots = salted_rank(sharded.withColumn("at", at), ["shard"], F.expr(f"(at >> {HASH_BITS - 30}) * {parts} >> 30"), order, "slot", parts)
    return slots.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
