"""Top N items within every group, with one fixed order, by a hot-cold split.

Exact group counts decide: a group of at least ``heavy_rows`` rows is heavy, whatever its share of the
table. Light groups go through an ordinary window. The rows of a heavy group are dealt to salts of
about ``heavy_rows`` rows each, every salt keeps its first N, and what is left is sorted by range on
(group, order, salt), which spreads one group over many partitions again; each range keeps its first
N per group, and a last window sees no more than N rows per group and range. The results are united.

The table is read twice: for the counts, and for the windows. The list of heavy groups is broadcast
only if it has at most ``BROADCAST_GROUPS`` entries; a longer one meets the rows by (group, slice), so
that even then no task receives all rows of a group.

Defined results: rows with a null group, or with a null or NaN score, never count; nulls in tie
columns come last; rows equal in every order column are interchangeable copies, of which as many are
kept as fit; repeated rows count each; an empty table gives no rows; other columns are kept (names
that begin with ``__t_`` are reserved).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methyloom.session import checkpointed

HEAVY_ROWS = 20_000
BROADCAST_GROUPS = 20_000
SLICES = 64


def _first(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__t_rank", rank).where(F.col("__t_rank") <= n).drop("__t_rank")


def _with_salts(rows: DataFrame, group: Column, spread: Column, heavy: DataFrame, broadcast_groups: int) -> DataFrame:
    """``rows`` with ``__t_salts``: the number of salts of their group if it is heavy, else null."""
    if heavy.count() <= broadcast_groups:
        return rows.join(F.broadcast(heavy), group == F.col("__t_group"), "left").drop("__t_group")
    slices = heavy.withColumn("__t_slice", F.explode(F.sequence(F.lit(0), F.lit(SLICES - 1))))
    sliced = rows.withColumn("__t_own", F.pmod(spread, F.lit(SLICES)).cast("int"))
    return sliced.join(slices, (group == F.col("__t_group")) & (F.col("__t_own") == F.col("__t_slice")), "left").drop("__t_group", "__t_slice", "__t_own")


def top_n(df: DataFrame, group: str, score: str, ties: Sequence[str], n: int, heavy_rows: int = HEAVY_ROWS, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """The rows of ``df`` that are among the first ``n`` of their group: highest score, then ``ties`` ascending."""
    g, s = F.col(f"`{group}`"), F.col(f"`{score}`")
    rows = df.where(g.isNotNull() & s.isNotNull() & ~F.isnan(s.cast("double")))
    order = [s.desc(), *(F.col(f"`{t}`").asc_nulls_last() for t in ties)]
    counts = rows.groupBy(g.alias("__t_group")).agg(F.count("*").alias("__t_n"))
    salts = F.ceil(F.col("__t_n") / heavy_rows).cast("int").alias("__t_salts")
    heavy = checkpointed(counts.where(F.col("__t_n") >= heavy_rows).select("__t_group", salts))

    spread = F.xxhash64(s, *(F.col(f"`{t}`") for t in ties))
    salted = _with_salts(rows, g, spread, heavy, broadcast_groups)
    dealt = salted.withColumn("__t_salt", F.pmod(spread, F.col("__t_salts"))).drop("__t_salts")
    # written once, N rows per group and salt: the light groups are done, the heavy ones go on from here
    reduced = checkpointed(_first(dealt, [group, "__t_salt"], order, n))
    light = reduced.where("__t_salt is null").drop("__t_salt")
    hot = reduced.where("__t_salt is not null")
    ranged = hot.repartitionByRange(g, s.desc(), F.col("__t_salt")).withColumn("__t_range", F.spark_partition_id())
    per_range = _first(ranged, [group, "__t_range"], order, n).drop("__t_range", "__t_salt")
    return light.unionByName(_first(per_range, [group], order, n))
