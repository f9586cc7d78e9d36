"""Filling containers of fixed capacity: minimum bin slack over histograms of item sizes.

Items are dealt to shards of about ``ITEMS_PER_SHARD``. A shard plans on the histogram of its sizes, in
a task of its own: the largest remaining size opens a container, a bitset subset-sum dynamic programme
finds the multiset of remaining sizes that fills the rest closest to capacity, its counts are
backtracked, and the pattern repeats as often as the histogram allows. Patterns that leave more than
``SLACK`` of the capacity unused and repeat less than ``BULK`` times are not kept: the sizes left over
in all shards make one more histogram (of at most ``capacity`` rows, a few per shard), which is planned
the same way, so that shards cost no space. Items find their container by their rank within (shard,
size), which is computed where the items of the shard are placed.

Defined results: items of size zero or null get no container; an item larger than the capacity is
split into full parts and a rest, no other is; repeated keys count each; equal sizes are ranked by key
and part within their shard, so the result is the same whenever the input has the same partitions; an
empty table gives no rows; any capacity of at least
1 is allowed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methyloom.session import checkpointed, parallelism

ITEMS_PER_SHARD = 500_000
SLACK = 0.001
BULK = 8


def best_fill(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """Counts of the multiset of ``sizes`` (descending, at most ``counts`` of each) that sums closest to ``room``."""
    reach, used, before = 1, [], []
    mask = (1 << (room + 1)) - 1
    for size, count in zip(sizes, counts, strict=True):
        most = min(count, room // size) if size <= room else 0
        if not most:
            continue
        used.append((size, most))
        before.append(reach)
        step = 1
        while most > 0:  # 1, 2, 4, ... copies: all numbers up to the count are sums of these
            take = min(step, most)
            reach |= (reach << (size * take)) & mask
            most -= take
            step *= 2
        if reach >> room & 1:
            break
    target, chosen = reach.bit_length() - 1, {}
    for (size, _), earlier in zip(reversed(used), reversed(before), strict=True):
        n = 0
        while not earlier >> target & 1:
            target -= size
            n += 1
        if n:
            chosen[size] = n
    return chosen


def plan(histogram: dict[int, int], capacity: int, slack: float = 1.0, bulk: int = 1) -> tuple[list[tuple[int, int, int, int, int]], dict[int, int]]:
    """Rows (size, first rank, first container, items per container, containers) sorted by size and rank, and the sizes left over.

    Patterns that leave more than ``slack`` of the capacity unused are left over, unless they repeat ``bulk`` times.
    """
    left = {s: c for s, c in sorted(histogram.items(), reverse=True) if c > 0}
    if any(not 0 < s <= capacity for s in left):
        raise ValueError("sizes must lie between 1 and the capacity")
    rank, container, out, over = dict.fromkeys(left, 0), 0, [], {}
    while left:
        largest = next(iter(left))
        left[largest] -= 1
        rest = [(s, c) for s, c in left.items() if c]
        pattern = best_fill([s for s, _ in rest], [c for _, c in rest], capacity - largest) if rest and largest < capacity else {}
        left[largest] += 1
        pattern[largest] = pattern.get(largest, 0) + 1
        times = min(left[s] // n for s, n in pattern.items())
        kept = times >= bulk or capacity - sum(s * n for s, n in pattern.items()) <= slack * capacity
        for size, n in pattern.items():
            if kept:
                out.append((size, rank[size], container, n, times))
                rank[size] += times * n
            else:
                over[size] = over.get(size, 0) + times * n
            left[size] -= times * n
            if not left[size]:
                del left[size]
        container += times if kept else 0
    return sorted(out), over


_PLAN = [("size", pa.int64()), ("rank", pa.int64()), ("container", pa.int64()), ("each", pa.int64()), ("times", pa.int64())]
_PLAN_SCHEMA = "shard int, size long, rank long, container long, each long, times long"


def _plan_shard(capacity: int, slack: float, bulk: int):
    """The plan of one shard from its histogram; what is left over comes out with ``times`` 0 and its number in ``each``."""

    def run(rows: pa.Table) -> pa.Table:
        histogram = dict(zip(rows["size"].to_pylist(), rows["n"].to_pylist(), strict=True))
        kept, over = plan(histogram, capacity, slack, bulk)
        out = [*kept, *((size, histogram[size] - n, 0, n, 0) for size, n in over.items())]
        columns = [pa.array([row[i] for row in out], kind) for i, (_, kind) in enumerate(_PLAN)]
        shard = pa.array([rows["shard"][0].as_py()] * len(out), pa.int32())
        return pa.table([shard, *columns], names=["shard", *(n for n, _ in _PLAN)])

    return run


def plan_shards(histograms: DataFrame, capacity: int, shards: int) -> DataFrame:
    """(shard, size, rank, container, each, times): from ``rank`` on, ``each`` items of the size go to each of ``times`` containers.

    ``histograms`` has (shard, size, n). Containers are numbered through all shards.
    """
    # as many tasks as shards: a plan is more work than its few rows let expect
    drafts = checkpointed(histograms.repartition(shards, "shard").groupBy("shard").applyInArrow(_plan_shard(capacity, SLACK, BULK), _PLAN_SCHEMA))
    kept, over = drafts.where("times > 0"), drafts.where("times = 0")
    # containers of a shard follow those of the shards before it, those of what is left over come last
    used = kept.groupBy("shard").agg(F.max(F.col("container") + F.col("times")).alias("used"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    base = used.select("shard", F.coalesce(F.sum("used").over(before), F.lit(0)).alias("base"))
    own = kept.join(base, "shard").select("shard", "size", "rank", (F.col("container") + F.col("base")).alias("container"), "each", "times")
    # the last round: one histogram of the sizes left over, whose ranks run through the shards in their order
    all_used = used.agg(F.coalesce(F.sum("used"), F.lit(0))).scalar()
    merged = over.groupBy("size").agg(F.sum("each").alias("n")).withColumn("shard", F.lit(-1))
    last = merged.groupBy("shard").applyInArrow(_plan_shard(capacity, 1.0, 1), _PLAN_SCHEMA).drop("shard")
    earlier = Window.partitionBy("size").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    spans = over.select("shard", "size", F.col("rank").alias("own_rank"), F.col("each").alias("n"), F.coalesce(F.sum("each").over(earlier), F.lit(0)).alias("from"))
    ends = F.col("rank") + F.col("each") * F.col("times")
    met = last.join(spans, "size").where((F.col("rank") < F.col("from") + F.col("n")) & (ends > F.col("from")))
    skipped = F.greatest(F.col("from") - F.col("rank"), F.lit(0))  # items of the pattern that earlier shards hold
    shared = met.select(
        "shard", "size", (F.col("own_rank") + F.greatest(F.col("rank") - F.col("from"), F.lit(0))).alias("rank"),
        (F.col("container") + all_used).alias("container"), "each", "times", skipped.alias("skipped"),
    )
    return own.withColumn("skipped", F.lit(0).cast("long")).unionByName(shared)


def place(items: pa.Table, plans: pa.Table) -> pa.Table:
    """Items of a shard with their container."""
    items = items.select(["key", "part", "first", "size"])
    if not items.num_rows:
        return items.append_column("container", pa.array([], pa.int64()))
    items = items.sort_by([("size", "ascending"), ("key", "ascending"), ("part", "ascending")])
    size = items["size"].to_numpy()
    rank = np.arange(len(size)) - np.searchsorted(size, size, "left")
    order = np.lexsort((plans["rank"].to_numpy(), plans["size"].to_numpy()))
    p_size, p_rank, container, each, skipped = (plans[n].to_numpy()[order] for n in ("size", "rank", "container", "each", "skipped"))
    # rows of the plan are in the order of (size, rank): count how many do not come after each item
    both = np.lexsort((np.r_[np.zeros(len(p_size)), np.ones(len(size))], np.r_[p_rank, rank], np.r_[p_size, size]))
    at = np.empty(len(both), np.int64)
    at[both] = np.cumsum(both < len(p_size)) - 1
    at = at[len(p_size) :]
    return items.append_column("container", pa.array(container[at] + (rank - p_rank[at] + skipped[at]) // each[at]))


def pack(sizes: DataFrame, key: str, size: str, capacity: int, items_per_shard: int = ITEMS_PER_SHARD) -> DataFrame:
    """(key, part, first, size, container): each part of each item, where it begins in it, and its container."""
    if capacity < 1:
        raise ValueError("the capacity must be at least 1")
    # written once: the plan and the placing must see the same sizes, and these may cost an encoding
    items = checkpointed(sizes.select(F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("long").alias("whole")).where("whole > 0"))
    parts = (
        items.withColumn("row", F.monotonically_increasing_id())
        .withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(whole - 1) div {capacity}"))))
        .withColumn("first", F.col("part") * capacity)
        .withColumn("size", F.least(F.col("whole") - F.col("first"), F.lit(capacity).cast("long")))
        .drop("whole")
    )
    n_parts = items.agg(F.sum(F.expr(f"(whole - 1) div {capacity} + 1"))).first()[0] or 0
    shards = max(parallelism(sizes.sparkSession), math.ceil(n_parts / items_per_shard))
    # the place of a row takes part, so that rows of one key, of which there may be many, spread too
    dealt = parts.withColumn("shard", F.pmod(F.xxhash64("key", "part", "row"), F.lit(shards)).cast("int")).drop("row")
    plans = plan_shards(dealt.groupBy("shard", "size").agg(F.count("*").alias("n")), capacity, shards)
    kind = dict(sizes.dtypes)[key]
    by_shard = lambda df: df.repartition(shards, "shard").groupBy("shard")
    placed = by_shard(dealt).cogroup(by_shard(plans)).applyInArrow(place, f"key {kind}, part long, first long, size long, container long")
    return placed.withColumnsRenamed({"key": key})
