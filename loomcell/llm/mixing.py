"""Mixing sources to target weights by Pfair scheduling.

Each source is a task of rational weight w = weight / total; its documents make
blocks, and block k (from 1) of a source may be released at slot floor((k - 1) / w)
and is due by slot ceil(k / w).  In each slot the released block with the earliest
deadline goes next (ties: the block whose next deadline is earlier, then the source
in order).  At any slot every source is then within one block of its target.  The
schedule repeats after ``total`` slots, so one period is simulated on the driver
and any block's slot follows from arithmetic.

When a source is used up, its weight is dealt to the others in proportion and a new
period begins there: at most one phase for each source.  Every document is placed
exactly once.

Documents of a source are taken in the order of a hash, which is found without a
global sort: sources are cut into hash buckets, about as many as the root of the
number of rows, bucket sizes are summed up and rows are ranked inside a bucket.

Defined results: a null source is a source of its own; sources without a weight get
``default_weight``; weights must be positive integers; over ``MOST_SOURCES`` sources or weights that
sum up to over ``MOST_SLOTS`` are an error, as the driver simulates a period for each phase; rows with equal contents,
repeated ones too, take neighbouring places in any order; an empty table gives no
rows.  Other columns, null or not, ride along.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomcell.llm.common import materialise, row_key, table

#: The target of the registered query and of the pipeline; other sources weigh 1.
WEIGHTS: dict[str, int] = {"src0": 4, "src1": 3, "src2": 2}
BLOCK = 16
#: Bounds of what the driver plans: sources, and slots of a period.
MOST_SOURCES, MOST_SLOTS = 1000, 1_000_000


@dataclass(frozen=True)
class Phase:
    """A run of whole and part periods with the same sources."""

    start: int  # first slot
    length: int  # slots
    period: int
    slots: dict  # source -> slots of its blocks in one period
    before: dict  # source -> blocks that earlier phases took


def schedule_period(weights: Mapping) -> dict:
    """Slots of each source's blocks in one period of sum(weights) slots, by earliest deadline first among released blocks."""
    total = sum(weights.values())
    order = {s: k for k, s in enumerate(weights)}
    slots: dict = {s: [] for s in weights}
    waiting = [(0, order[s], s, 1) for s in weights]  # (release, ...) of each source's next block
    heapq.heapify(waiting)
    ready: list = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, k, s, block = heapq.heappop(waiting)
            w = weights[s]
            heapq.heappush(ready, (-(-block * total // w), -(-(block + 1) * total // w), k, s, block))
        _, _, k, s, block = heapq.heappop(ready)
        slots[s].append(t)
        if block < weights[s]:
            heapq.heappush(waiting, (block * total // weights[s], k, s, block + 1))
    return slots


def plan(blocks: Mapping, weights: Mapping) -> list[Phase]:
    """Phases that place all ``blocks`` (source -> number of blocks, positive)."""
    left = dict(blocks)
    done = dict.fromkeys(left, 0)
    start, phases = 0, []
    while left:
        shared = math.gcd(*(weights[s] for s in left))
        own = {s: weights[s] // shared for s in left}
        period = sum(own.values())
        slots = schedule_period(own)
        length = min((n - 1) // own[s] * period + slots[s][(n - 1) % own[s]] + 1 for s, n in left.items())
        phases.append(Phase(start, length, period, slots, {s: done[s] for s in left}))
        for s in list(left):
            took = length // period * own[s] + sum(x < length % period for x in slots[s])
            done[s] += took
            left[s] -= took
            if not left[s]:
                del left[s]
        start += length
    return phases


def ranked(docs: DataFrame, source: str, total: int) -> DataFrame:
    """``docs`` with _lc_rank, the place from 0 of each row within its source in hash order."""
    buckets = max(1, math.isqrt(total))
    keyed = docs.withColumn("_lc_key", row_key(docs)).withColumn("_lc_bucket", F.pmod("_lc_key", F.lit(buckets)))
    sizes = keyed.groupBy(F.col(source).alias("_lc_s"), F.col("_lc_bucket").alias("_lc_b")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("_lc_s").orderBy("_lc_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = materialise(sizes.select("_lc_s", "_lc_b", F.coalesce(before, F.lit(0)).alias("_lc_before")), "offsets")
    inside = F.row_number().over(Window.partitionBy(source, "_lc_bucket").orderBy("_lc_key"))
    out = keyed.withColumn("_lc_inside", inside).join(offsets, (F.col("_lc_bucket") == F.col("_lc_b")) & F.col(source).eqNullSafe(F.col("_lc_s")))
    return out.withColumn("_lc_rank", F.col("_lc_before") + F.col("_lc_inside") - 1).drop("_lc_key", "_lc_bucket", "_lc_inside", "_lc_s", "_lc_b", "_lc_before")


def interleave(docs: DataFrame, weights: Mapping = WEIGHTS, block: int = BLOCK, source: str = "source", default_weight: int = 1) -> tuple[DataFrame, int]:
    """All rows with mix_block (of their source, from 0), mix_slot and mix_position (gapless from 0), and the number of rows.

    The driver holds one row for each source, of which there are at most ``MOST_SOURCES``.
    """
    counts = {r[0]: r[1] for r in docs.groupBy(source).agg(F.count("*")).limit(MOST_SOURCES + 1).collect()}
    if len(counts) > MOST_SOURCES:
        raise ValueError(f"over {MOST_SOURCES} sources: mix by a coarser column")
    total = sum(counts.values())
    order = sorted(counts, key=lambda s: (s is None, str(s)))
    own = {s: int(weights.get(s, default_weight)) for s in order}
    if any(w < 1 for w in own.values()):
        raise ValueError("weights must be positive integers")
    if sum(own.values()) > MOST_SLOTS:
        raise ValueError(f"weights sum up to over {MOST_SLOTS}: scale them down")
    phases = plan({s: -(-counts[s] // block) for s in order}, own)
    # For each phase and source: blocks [low, high) lie at start + k // w * period + slots[k % w].
    rows = []
    last: dict = {}
    for p in phases:
        for s, slots in p.slots.items():
            w = len(slots)
            took = p.length // p.period * w + sum(x < p.length % p.period for x in slots)
            if took:
                rows.append((s, p.before[s], p.before[s] + took, p.start, p.period, slots))
                k = took - 1
                last[s] = p.start + k // w * p.period + slots[k % w]
    # Only a source's last block can be short: later positions move up by what it lacks.
    lacks = sorted((last[s], block * -(-counts[s] // block) - counts[s]) for s in order if counts[s] % block)
    kind = docs.schema[source].dataType.simpleString()
    schema = f"_lc_s {kind}, _lc_low long, _lc_high long, _lc_start long, _lc_period long, _lc_slots array<int>"
    known = F.broadcast(docs.sparkSession.createDataFrame(rows, schema))
    out = ranked(docs, source, total).withColumn("mix_block", F.floor(F.col("_lc_rank") / F.lit(block)).cast("long"))
    out = out.join(known, F.col(source).eqNullSafe(F.col("_lc_s")) & (F.col("mix_block") >= F.col("_lc_low")) & (F.col("mix_block") < F.col("_lc_high")))
    out = out.withColumn("_lc_k", F.col("mix_block") - F.col("_lc_low"))
    slot = "_lc_start + (_lc_k div size(_lc_slots)) * _lc_period + element_at(_lc_slots, cast(_lc_k % size(_lc_slots) as int) + 1)"
    out = out.withColumn("mix_slot", F.expr(slot))
    moved = F.lit(0).cast("long")
    for at, lack in lacks:
        moved = moved + F.when(F.col("mix_slot") > at, lack).otherwise(0)
    out = out.withColumn("mix_position", F.col("mix_slot") * block + F.pmod("_lc_rank", F.lit(block)) - moved)
    return out.drop("_lc_rank", "_lc_k", "_lc_s", "_lc_low", "_lc_high", "_lc_start", "_lc_period", "_lc_slots"), total


def in_mix_order(docs: DataFrame, rows_per_file: int = 8_000, **options) -> DataFrame:
    """The rows with their own columns, in mix order: partition by partition, and sorted within each."""
    placed, total = interleave(docs, **options)
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // rows_per_file))
    size = max(1, -(-total // parts))
    dealt = placed.repartitionById(parts, F.floor(F.col("mix_position") / F.lit(size)).cast("int")).sortWithinPartitions("mix_position")
    return dealt.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return interleave(docs)[0]
