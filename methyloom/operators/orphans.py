"""References to records that do not exist at the time of the referring row.

Keys are partitioned by ranges of their 64-bit hash, not of the key itself: the bounds are known
without sampling, and every range holds about as many parents. The parents of a range lie in one row of sorted arrays;
references come in batches of bounded size, salted within their range, and each batch is probed
against the arrays by vectorised binary search. Only misses leave the operator.

Defined results
  * a null key refers to nothing and is never a miss; a null time cannot be placed and is never one;
  * a parent with a null key or a null start never exists; a null end means it still exists; a
    parent whose end is not after its start never exists; repeated and overlapping parents merge;
  * repeated references count each; with no parents every reference is a miss;
  * key equality is exact: equal hashes are confirmed on the key itself.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from methyloom.session import checkpointed, parallelism

FOREVER = "9999-12-31 23:59:59.999999"
PARENTS_PER_RANGE = 4_096
REFERENCES_PER_BATCH = 100_000


@dataclass(frozen=True)
class Parents:
    """Where keys of one kind exist: a table with its key, start and end columns."""

    kind: str
    df: DataFrame
    key: str
    start: str
    end: str


@dataclass(frozen=True)
class References:
    """Rows that refer to keys of one kind at a time."""

    src_table: str
    kind: str
    df: DataFrame
    row_id: str
    key: str
    time: str


def _wall(name: str):
    """A time as it reads on the wall: the session's time zone plays no part in comparing such times."""
    return F.col(f"`{name}`").cast("timestamp_ntz")


def _hash(kind, key):
    return F.xxhash64(kind, key)


def existence(parents: Sequence[Parents]) -> DataFrame:
    """(kind, key, hash, start, end): at a time t a key exists if the last row with start <= t ends after t.

    Starts are unique per key, ends carry the running maximum, and rows that add nothing to what
    began before are dropped, so what remains per key is about its number of separate periods.
    """
    union = None
    for p in parents:
        one = p.df.where(F.col(f"`{p.key}`").isNotNull() & F.col(f"`{p.start}`").isNotNull()).select(
            F.lit(p.kind).alias("kind"),
            F.col(f"`{p.key}`").cast("string").alias("key"),
            _wall(p.start).alias("start"),
            F.coalesce(_wall(p.end), F.lit(FOREVER).cast("timestamp_ntz")).alias("end"),
        )
        union = one if union is None else union.unionByName(one)
    merged = union.where(F.col("end") > F.col("start")).groupBy("kind", "key", "start").agg(F.max("end").alias("end"))
    # the furthest end so far in two steps, within days and over days, so that no task sorts all rows of a key
    dated = merged.withColumn("day", F.to_date("start"))
    in_day = Window.partitionBy("kind", "key", "day").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    over_days = Window.partitionBy("kind", "key").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = dated.groupBy("kind", "key", "day").agg(F.max("end").alias("day_end")).withColumn("carried", F.max("day_end").over(over_days)).drop("day_end")
    return (
        dated.withColumn("own", F.max("end").over(in_day))
        .join(days, ["kind", "key", "day"])
        .withColumn("reach", F.greatest("own", "carried"))
        .where(F.col("reach").isNull() | (F.col("end") > F.col("reach")))
        .select("kind", "key", _hash(F.col("kind"), F.col("key")).alias("hash"), "start", "end")
    )


def _references(references: Sequence[References]) -> DataFrame:
    union = None
    for i, r in enumerate(references):
        one = r.df.where(F.col(f"`{r.key}`").isNotNull() & F.col(f"`{r.time}`").isNotNull()).select(
            F.lit(i).alias("src"),
            F.col(f"`{r.row_id}`").cast("long").alias("row_id"),
            F.lit(r.kind).alias("kind"),
            F.col(f"`{r.key}`").cast("string").alias("key"),
            _wall(r.time).alias("t"),
        )
        union = one if union is None else union.unionByName(one)
    return union.withColumn("hash", _hash(F.col("kind"), F.col("key")))


def _range(bits: int):
    return F.shiftrightunsigned("hash", 64 - bits) if bits else F.lit(0).cast("long")


def _micros(times) -> np.ndarray:
    return times.cast(pa.int64()).to_numpy(zero_copy_only=False) if isinstance(times, pa.Array) else times.cast(pa.int64()).to_numpy()


def _months(t: pa.ChunkedArray) -> pa.Array:
    """yyyy-MM of times."""
    months = _micros(t).astype("datetime64[us]").astype("datetime64[M]")
    return pa.array(months.astype(str), pa.string())


def probe(refs: pa.Table, held: pa.Table) -> pa.Table:
    """The references of a batch whose key does not exist at their time."""
    found = lambda rows: pa.table({"src": rows["src"], "row_id": rows["row_id"], "ref_month": _months(rows["t"])})
    entries = pa.concat_arrays([x.values if isinstance(x, pa.ListArray) else x.flatten() for x in held["parents"].chunks]) if held.num_rows else None
    if entries is None or not len(entries) or not refs.num_rows:
        return found(refs)
    hashes, starts, ends = entries.field("hash").to_numpy(), _micros(entries.field("start")), _micros(entries.field("end"))
    names = pc.binary_join_element_wise(entries.field("kind"), entries.field("key"), "\x00")
    # the entries are sorted by (hash, kind, key, start); a group is one (kind, key)
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = pc.equal(names[1:], names[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(~same)
    group_hash = hashes[first]
    wanted = refs["hash"].to_numpy()
    want_name = pc.binary_join_element_wise(refs["kind"], refs["key"], "\x00").combine_chunks()
    low = np.searchsorted(group_hash, wanted, "left")
    high = np.searchsorted(group_hash, wanted, "right")
    group = np.full(len(wanted), -1, dtype=np.int64)
    for step in range(int((high - low).max(initial=0))):  # more than one step only if hashes collide
        at = np.flatnonzero((group < 0) & (low + step < high))
        candidate = low[at] + step
        equal = pc.equal(names.take(pa.array(first[candidate])), want_name.take(pa.array(at))).to_numpy(zero_copy_only=False)
        group[at[equal]] = candidate[equal]
    # binary search over (group, rank of the start): both sides use the ranks of the starts of the range
    ladder = np.unique(starts)
    width = len(ladder) + 1
    entry_group = np.cumsum(~same) - 1
    composite = entry_group * width + np.searchsorted(ladder, starts, "right")
    t = _micros(refs["t"])
    spot = np.searchsorted(composite, group * width + np.searchsorted(ladder, t, "right"), "right") - 1
    inside = (group >= 0) & (spot >= 0)
    spot = np.where(inside, spot, 0)
    exists = inside & (entry_group[spot] == group) & (ends[spot] > t)
    return found(refs.filter(pa.array(~exists)))


def orphans(parents: Sequence[Parents], references: Sequence[References], parents_per_range: int = PARENTS_PER_RANGE, references_per_batch: int = REFERENCES_PER_BATCH) -> DataFrame:
    """(src_table, row_id, ref_month) of each reference whose key does not exist at its time."""
    spark = references[0].df.sparkSession
    held, refs = checkpointed(existence(parents)), _references(references)  # parents written once: they are counted, then placed
    # bounds of the work: the ranges from the number of parents, the salts from the references per range
    bits = max(0, math.ceil(math.log2(max(1, held.count()) / parents_per_range)))
    arrays = (
        held.withColumn("range", _range(bits))
        .groupBy("range")
        .agg(F.sort_array(F.collect_list(F.struct("hash", "kind", "key", "start", "end"))).alias("parents"))
    )
    loads = refs.groupBy(_range(bits).alias("range")).agg(F.count("*").alias("n"))
    # one row per range, written once: how the references are dealt, and how many tasks probe them
    salts = checkpointed(loads.select("range", F.ceil(F.col("n") / references_per_batch).cast("int").alias("salts")))
    batches = salts.agg(F.sum("salts")).first()[0] or 1
    tasks = max(parallelism(spark), batches)
    placed = (
        refs.withColumn("range", _range(bits))
        .join(salts.hint("shuffle_hash") if bits > 16 else F.broadcast(salts), "range")  # one row per range
        .withColumn("salt", F.pmod(F.xxhash64("row_id", "src"), F.col("salts")))
        .drop("salts")
    )
    copies = (
        arrays.join(salts, "range")
        .withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts").cast("long") - 1)))
        .drop("salts")
    )
    names = F.create_map(*[x for i, r in enumerate(references) for x in (F.lit(i), F.lit(r.src_table))])
    return (
        placed.repartition(tasks, "range", "salt").groupBy("range", "salt")
        .cogroup(copies.repartition(tasks, "range", "salt").groupBy("range", "salt"))
        .applyInArrow(probe, "src int, row_id long, ref_month string")
        .select(names[F.col("src")].alias("src_table"), "row_id", "ref_month")
    )


def orphans_by_month(found: DataFrame) -> DataFrame:
    """Misses per table and month."""
    return found.groupBy("src_table", "ref_month").agg(F.count("*").alias("n_orphans"))
