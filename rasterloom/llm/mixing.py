"""Mixing sources to target weights by Pfair scheduling.

Each source is a task of weight ``w`` (its share of the mix) and its blocks of ``block_rows`` rows are the
task's unit jobs: block ``k`` is released at slot ``floor(k / w)`` and due at slot ``ceil((k + 1) / w)``. In
each slot the released block with the earliest deadline runs. On one stream this meets every deadline, so
after any number of slots each source is less than one block away from its target.

Weights are whole numbers ``a`` over their sum ``A``, in the exact proportion of the weights given, so nothing
drifts however long the table is. The driver schedules every slot; a row finds its slot from its rank in its
source. When a source ends, the others go on under weights scaled up to 1, and the targets count from that slot;
such stretches are phases, at most one a source. No row is dropped or repeated.

How it scales: the rank of a row in its source comes from salted parts (a hot source is never in one task). A block
has ``BLOCK_ROWS`` rows, or as many more as leave at most ``SLOTS`` blocks, so that the driver schedules, and
broadcasts in pieces of ``PIECE``, 4 bytes a block whatever the input. A phase is rebuilt for every source that is
left when one ends, so the driver's work also grows with the square of the number of sources: fine for thousands.

Defined results: a null source is a source of its own; a null id is kept; repeated rows take neighbouring
places; an empty table gives no rows; texts are not looked at; further columns are carried along by
:func:`mix` and must not begin with an underscore (:func:`in_mix_order` takes any). Rows of a source are taken in the
order of the MD5 of their id as text.
"""

from __future__ import annotations

import heapq
from array import array
from decimal import Decimal
from fractions import Fraction
from math import gcd, lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import HASH_BITS, leading_bits, salted_rank

BLOCK_ROWS = 4
RESOLUTION = 4_096
ALPHA = 0.5
PARTS = 1_024
#: The most blocks that the driver schedules, but for one more a source.
SLOTS = 4_000_000
#: Blocks of a source in a row of the schedule.
PIECE = 1_024
#: Products with a number of blocks fit 38 digits.
LARGEST = 10**26


def whole_weights(weights: dict[str, float], resolution: int) -> dict[str, int]:
    """Weights as whole numbers in the proportion of the weights as written; of a sum above ``LARGEST`` to 1 / LARGEST.

    ``resolution`` is not used: shares rounded to it drift from the weights.
    """
    if any(w <= 0 for w in weights.values()):
        raise ValueError("weights must be positive")
    exact = {s: Fraction(repr(float(w))) for s, w in weights.items()}
    total = sum(exact.values())
    common = lcm(*(x.denominator for x in exact.values()))
    whole = {s: int(x * common) for s, x in exact.items()}
    common = gcd(*whole.values()) if whole else 1
    whole = {s: a // common for s, a in whole.items()}
    if sum(whole.values()) > LARGEST:
        whole = {s: max(1, round(x / total * LARGEST)) for s, x in exact.items()}
    return whole


def stretch(parts: dict[str, int], left: dict[str, int]) -> tuple[dict[str, array], str]:
    """Earliest deadline first until a source's blocks end: each source's slots, in order, and that source."""
    whole = sum(parts.values())
    taken = {s: array("i") for s in parts}
    waiting = [(0, s) for s in parts]
    heapq.heapify(waiting)
    ready: list[tuple[int, int, str]] = []
    t = 0
    while True:
        while waiting and waiting[0][0] <= t:
            _, s = heapq.heappop(waiting)
            due = -(-(len(taken[s]) + 1) * whole // parts[s])
            heapq.heappush(ready, (due, -parts[s], s))
        due, _, s = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        taken[s].append(t)
        if len(taken[s]) == left[s]:
            return taken, s
        heapq.heappush(waiting, (len(taken[s]) * whole // parts[s], s))
        t += 1


def phases(rows: dict[str, int], parts: dict[str, int], block_rows: int) -> list[tuple]:
    """(source, phase, first block, first slot, first position, a, A, its slots) of all stretches."""
    left = {s: -(-n // block_rows) for s, n in rows.items() if n > 0}
    done = dict.fromkeys(left, 0)
    slot = place = phase = 0
    out = []
    while left:
        live = {s: parts[s] for s in left}
        common = gcd(*live.values())
        live = {s: a // common for s, a in live.items()}
        own, over = stretch(live, left)
        end = own[over][-1]
        for s in list(left):
            if own[s]:
                out.append((s, phase, done[s], slot, place, live[s], sum(live.values()), own[s]))
            left[s] -= len(own[s])
            done[s] += len(own[s])
        assert left.pop(over) == 0
        slot += end + 1
        place += (end + 1) * block_rows - (-rows[over] % block_rows)
        phase += 1
    return out


def mix(docs: DataFrame, weights: dict[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_rows: int | None = None, resolution: int = RESOLUTION, alpha: float = ALPHA) -> DataFrame:
    """``docs`` with _weight, _phase, _block, _release, _deadline, _slot and _position (from 0, gapless).

    ``weights``: the target share of each source, the null source's under None. Without it, shares are in
    proportion to a source's rows to the power ``alpha``. ``block_rows``: None for as few, from ``BLOCK_ROWS``, as
    leave ``SLOTS`` blocks.
    """
    spark: SparkSession = docs.sparkSession
    source = F.col(source_col).cast("string")
    keyed = docs.withColumn("_key", F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source)))
    rows = {r[0]: r[1] for r in keyed.groupBy("_key").count().collect()}  # a row a source
    if weights is not None:
        given = {"-" if s is None else f"+{s}": w for s, w in weights.items()}
        if missing := set(rows) - set(given):
            raise ValueError(f"no weight for {sorted(missing)[:5]}")
    parts = whole_weights({s: given[s] if weights is not None else n**alpha for s, n in rows.items()}, resolution)
    block_rows = block_rows or max(BLOCK_ROWS, -(-sum(rows.values()) // SLOTS))
    plan: dict[str, list[tuple]] = {s: [] for s in rows}
    names, pieces, slots, ends = [], [], [], [0]
    for s, phase, block, slot, place, a, whole, own in phases(rows, parts, block_rows):
        plan[s].append((phase, block, slot, place, Decimal(a), Decimal(whole), a / whole))
        for piece in range(-(-len(own) // PIECE)):
            names.append(f"{phase} {s}")
            pieces.append(piece)
            slots.append(np.asarray(own[piece * PIECE : (piece + 1) * PIECE], dtype=np.int32))
            ends.append(ends[-1] + len(slots[-1]))
    plans = F.broadcast(spark.createDataFrame(
        list(plan.items()),
        "_key string, _plan array<struct<phase:int,block:long,slot:long,place:long,a:decimal(28,0),whole:decimal(28,0),weight:double>>",
    ))
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(slots) if slots else [], pa.int32()))
    schedule = F.broadcast(spark.createDataFrame(pa.table({"_stretch": pa.array(names, pa.string()), "_piece": pa.array(pieces, pa.int64()), "_own": lists})))
    hashed = keyed.withColumn("_hash", leading_bits(F.md5(F.col(id_col).cast("string"))))
    salt = F.shiftright("_hash", HASH_BITS - (PARTS.bit_length() - 1))
    ranked = salted_rank(hashed, ["_key"], salt, [F.col("_hash"), F.col(id_col)], "_rank", PARTS)
    at = (
        ranked.join(plans, "_key")
        .withColumn("_block", F.floor(F.col("_rank") / block_rows))
        .withColumn("_p", F.expr("element_at(filter(_plan, x -> x.block <= _block), -1)"))
        .withColumn("_k", F.col("_block") - F.col("_p.block"))
        .withColumn("_stretch", F.concat(F.col("_p.phase").cast("string"), F.lit(" "), F.col("_key")))
        .withColumn("_piece", F.expr(f"_k div {PIECE}"))
        .join(schedule, ["_stretch", "_piece"])
    )
    local = F.expr(f"element_at(_own, cast(_k % {PIECE} as int) + 1)")
    return (
        at.withColumn("_phase", F.col("_p.phase"))
        .withColumn("_slot", F.col("_p.slot") + local)
        .withColumn("_release", F.col("_p.slot") + F.expr("cast(_k as decimal(10,0)) * _p.whole div _p.a"))
        .withColumn("_deadline", F.col("_p.slot") + F.expr("(cast(_k + 1 as decimal(10,0)) * _p.whole + _p.a - 1) div _p.a"))
        .withColumn("_weight", F.col("_p.weight"))
        .withColumn("_position", F.col("_p.place") + (F.col("_slot") - F.col("_p.slot")) * block_rows + F.col("_rank") % block_rows)
        .drop("_key", "_hash", "_rank", "_plan", "_p", "_k", "_stretch", "_piece", "_own")
    )


def in_mix_order(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **how) -> DataFrame:
    """The columns and rows of ``docs``, sorted by their place in the mix over all partitions."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    mixed = mix(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), whole.alias("row")), id_col="id", **how)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return mixed.repartitionByRange(n, "_position").sortWithinPartitions("_position").select("row.*")
