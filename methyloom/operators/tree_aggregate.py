"""Per-key results without a reducer that holds a hot key alone: multi-level tree aggregation.

Each input partition (of a size fixed by ``spark.sql.files.maxPartitionBytes``) combines its rows into
one state per key on the map side. Partitions are dealt to a chosen number of chunks. The states of
``fan_in`` neighbouring chunks merge, then those of ``fan_in`` such groups, and so on: the number of
rounds is logarithmic in the number of chunks, and no reducer receives more than ``fan_in`` states of
a key in any round (in the first round, from each chunk as many as it has partitions). How many
partitions the input has need not be known, so the result is right whatever plan gives the input.

Defined results
  * a null key is a key of its own; nulls in a column are skipped by sum, min and max, and a state
    without any value stays null; repeated rows count each; an empty table gives no rows;
  * only states that merge exactly are offered (counts, integer sums, extremes), so the result does
    not depend on the chunks; columns of the input with clashing names do not matter, since states
    are selected before the first round.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methyloom.session import parallelism

FAN_IN = 16
_MERGE = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
_COMBINE = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class State:
    """A mergeable state: how rows combine (``count``, ``sum``, ``min``, ``max``) and of what."""

    how: str
    of: Column


def tree_aggregate(df: DataFrame, keys: Mapping[str, Column] | Sequence[str], states: Mapping[str, State], fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """``keys`` and the merged ``states`` of each key.

    ``chunks`` is about the number of partitions of the input; without it, the shuffle partitions of
    the session or the slots of the cluster, whichever are more.
    """
    if fan_in < 2:
        raise ValueError("fan_in must be at least 2")
    columns = keys if isinstance(keys, Mapping) else {k: F.col(f"`{k}`") for k in keys}
    spark = df.sparkSession
    chunks = chunks or max(parallelism(spark), spark.sparkContext.defaultParallelism)
    ids = list(columns)
    rows = df.select(
        *(c.alias(k) for k, c in columns.items()),
        *(s.of.alias(n) for n, s in states.items()),
        F.pmod(F.spark_partition_id(), F.lit(chunks)).alias("__t_node"),
    )
    # the first round: rows combine within their chunk before the shuffle, chunks by fan_in after it
    node, width, how = F.floor(F.col("__t_node") / fan_in), -(-chunks // fan_in), _COMBINE
    merged = rows
    while True:
        merged = merged.groupBy(*ids, node.alias("__t_node")).agg(
            *(how[s.how](F.col(n)).alias(n) for n, s in states.items())
        )
        if width <= 1:
            return merged.select(*ids, *states)
        node, width, how = F.floor(F.col("__t_node") / fan_in), -(-width // fan_in), _MERGE


def hot_keys(per_key: DataFrame, key: str, count: str, share: int) -> DataFrame:
    """Non-null keys that hold at least 1/``share`` of all rows.

    ``per_key`` has the count of every key, the null key included, so that the counts add up to all rows.
    """
    total = per_key.agg(F.sum(count)).scalar()
    return per_key.where(F.col(key).isNotNull() & (F.col(count) * share >= total)).select(key)
