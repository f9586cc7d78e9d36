"""Percentiles of very large numeric columns from mergeable digests with a deterministic rank error.

Values are quantised to an ordered, bounded universe of cells. Rows are counted per cell on the map
side; per period, group and metric the counts are compressed bottom-up in the dyadic tree over the
cells: two siblings and their parent move into the parent while they hold at most ``n // k`` together,
``k = levels / eps``. Digests of periods merge by adding the counts of equal nodes, in an ordinary
grouped sum; they can be written (``save``) and merged with those of later runs (``load``).

Two universes: ``LONG`` (2**17 cells) for integers of the whole 64-bit range, exact below 2,048 and
1,024 cells an octave above, mirrored for negative values; ``DOUBLE`` (2**22 cells) for floats and
decimals (cast to double), zero alone and 1,024 cells an octave, infinities included. The universe
follows from the types of the columns; one floating column makes all metrics of the call ``DOUBLE``.

Guarantee: for a share q of n values let target = ceil(q n) (at least 1) and ``rank_error`` =
levels * sum over periods of (n_period // k) <= eps * n. The returned value v is the upper edge of a
cell such that at least ``target`` values are <= v and fewer than ``target + rank_error`` values lie
below that cell. A cell is one value wide below 2,048 (``LONG``) and at most |v| / 1,024 elsewhere.

Defined results: null and NaN values are not counted; null group columns are groups of their own;
null periods are a period of their own; repeated rows count each; empty tables and groups without
values give no rows; input columns with clashing names do not matter, since groups and values are
selected under internal names; values that are no numbers raise.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

EPS = 0.005
_STEPS = 1024  # cells an octave


@dataclass(frozen=True)
class Universe:
    """``levels`` of a tree over cells; the magnitude of a number >= 0 (at most ``largest``), and its least and greatest number.

    Cells of negative numbers are mirrored below the middle; ``mirror`` gives the number >= 0 that a
    negative one has its magnitude from, and back.
    """

    kind: str
    levels: int
    largest: int
    magnitude: Callable[[Column], Column]
    least: Callable[[Column], Column]
    greatest: Callable[[Column], Column]
    mirror: Callable[[Column], Column]

    @property
    def _half(self) -> int:
        return 1 << (self.levels - 1)

    def cell_of(self, value: Column) -> Column:
        """The cell of a number, in the order of the numbers; null for null and NaN."""
        v = value.cast(self.kind)
        cell = F.when(v >= 0, F.lit(self._half) + self.magnitude(v)).otherwise(F.lit(self._half - 1) - self.magnitude(self.mirror(v)))
        known = value.isNotNull() if self.kind == "long" else value.isNotNull() & ~F.isnan(v)
        return F.when(known, cell.cast("int"))

    def _edge(self, cell: Column, above: Callable, below: Callable) -> Column:
        within = lambda magnitude: F.least(magnitude, F.lit(self.largest))
        return F.when(cell >= self._half, above(within(cell - self._half))).otherwise(self.mirror(below(within(F.lit(self._half - 1) - cell))))

    def upper_edge(self, cell: Column) -> Column:
        """The greatest number of a cell."""
        return self._edge(cell, self.greatest, self.least)

    def lower_edge(self, cell: Column) -> Column:
        """The least number of a cell."""
        return self._edge(cell, self.least, self.greatest)


def _octave(c: Column) -> Column:
    return F.greatest(F.floor(c / _STEPS).cast("int") - 1, F.lit(0))


def _shift(x: Column, by: Column) -> Column:
    return F.call_function("shiftleft", x.cast("long"), by)


def _long_magnitude(x: Column) -> Column:
    """The leading eleven bits and the octave."""
    octave = F.length(F.bin(x)) - 11
    return F.when(x < 2 * _STEPS, x).otherwise(octave * _STEPS + F.call_function("shiftright", x, octave))


def _long_least(c: Column) -> Column:
    return F.when(c < 2 * _STEPS, c.cast("long")).otherwise(_shift(c - _octave(c) * _STEPS, _octave(c)))


def _long_greatest(c: Column) -> Column:
    return F.when(c < 2 * _STEPS, c.cast("long")).otherwise(_long_least(c) + (_shift(F.lit(1), _octave(c)) - 1))


_SMALLEST_EXPONENT, _INFINITE = -1022, 2047 * _STEPS + 1
_two_to = lambda e: F.pow(F.lit(2.0), e.cast("double"))


def _double_magnitude(x: Column) -> Column:
    """0 for zero, then the exponent and the leading ten bits of the fraction, infinity last."""
    near = F.floor(F.log2(x))
    exponent = near - F.when(x < _two_to(near), 1).otherwise(0) + F.when(x >= _two_to(near + 1), 1).otherwise(0)
    normal = (exponent + 1023) * _STEPS + F.floor((x / _two_to(exponent) - 1.0) * _STEPS) + 1
    tiny = F.floor(x * (2.0**1022) * _STEPS) + 1
    return F.when(x == 0, 0).when(x == float("inf"), _INFINITE).when(x < 2.0**_SMALLEST_EXPONENT, tiny).otherwise(normal)


def _double_least(c: Column) -> Column:
    at = c - 1
    normal = (F.lit(1.0) + F.pmod(at, F.lit(_STEPS)) / _STEPS) * _two_to(F.floor(at / _STEPS) - 1023)
    tiny = F.when(at == 0, 5e-324).otherwise(at.cast("double") / _STEPS * (2.0**_SMALLEST_EXPONENT))
    return F.when(c == 0, 0.0).when(c >= _INFINITE, float("inf")).when(at < _STEPS, tiny).otherwise(normal)


def _double_greatest(c: Column) -> Column:
    """The double before the least one of the next cell."""
    after = _double_least(c + 1)
    before = F.when(c == _INFINITE - 1, 1.7976931348623157e308).when(c <= _STEPS, after - F.lit(5e-324)).otherwise(after * (1 - 2.0**-53))
    return F.when(c == 0, 0.0).when(c >= _INFINITE, float("inf")).otherwise(before)


LONG = Universe("long", 17, 54 * _STEPS - 1, _long_magnitude, _long_least, _long_greatest, lambda x: F.bitwise_not(x))
DOUBLE = Universe("double", 22, _INFINITE, _double_magnitude, _double_least, _double_greatest, lambda x: -x)


def universe_of(df: DataFrame, values: Sequence[str]) -> Universe:
    """The universe for columns of ``df``."""
    kinds = [dict(df.dtypes)[v].split("(")[0] for v in values]
    if bad := [k for k in kinds if k not in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]:
        raise ValueError(f"no numbers: {bad}")
    return DOUBLE if any(k in ("float", "double", "decimal") for k in kinds) else LONG


def compress(node: np.ndarray, group: np.ndarray, count: np.ndarray, bound: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, node, count) after one bottom-up pass; ``bound`` is the threshold of each group.

    Nodes are numbered as in a heap (1 the root, leaves from 2**levels).
    """
    kept = []
    level = levels
    depth = np.frexp(node.astype(np.float64))[1] - 1
    carried = (np.empty(0, np.int64),) * 3
    while level > 0:
        here = depth == level
        g, v, c = (np.concatenate([a[here], b]) for a, b in zip((group, node, count), carried, strict=True))
        # what was carried up adds to the counts that the level has
        key, at = np.unique((g << (levels + 1)) | v, return_inverse=True)
        c = np.bincount(at, weights=c, minlength=len(key)).astype(np.int64)
        g, v = key >> (levels + 1), key & ((1 << (levels + 1)) - 1)
        pair, of = np.unique((g << (levels + 1)) | (v >> 1), return_inverse=True)
        total = np.bincount(of, weights=c, minlength=len(pair)).astype(np.int64)
        above = depth == level - 1
        own = np.zeros(len(pair), np.int64)
        parents = (group[above] << (levels + 1)) | node[above]
        spot = np.searchsorted(pair, parents)
        match = (spot < len(pair)) & (pair[np.minimum(spot, max(len(pair) - 1, 0))] == parents) if len(pair) else np.zeros(len(parents), bool)
        np.add.at(own, spot[match], count[above][match])
        up = total + own <= bound[pair >> (levels + 1)]
        stays = ~up[of]
        kept.append((g[stays], v[stays], c[stays]))
        carried = (pair[up] >> (levels + 1), pair[up] & ((1 << (levels + 1)) - 1), total[up])
        level -= 1
    root = depth == 0
    g = np.concatenate([group[root], carried[0]])
    if len(g):
        c = np.bincount(g, weights=np.concatenate([count[root], carried[2]]))
        at = np.flatnonzero(c)
        kept.append((at, np.ones(len(at), np.int64), c[at].astype(np.int64)))
    return tuple(np.concatenate([k[i] for k in kept]) for i in range(3))


def _group_codes(rows: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each group, the group of each row); nulls are values of their own."""
    code = np.zeros(rows.num_rows, np.int64)
    for name in names:
        column = rows[name].combine_chunks().dictionary_encode(null_encoding="encode")
        code = code * len(column.dictionary) + column.indices.to_numpy(zero_copy_only=False)
    _, first, of = np.unique(code, return_index=True, return_inverse=True)
    return first, of


def _compress_groups(k: int, levels: int, labels: Sequence[str]):
    """Compress digests that come in the order of their labels; one that goes on in the next batch waits for it."""
    last_of = lambda rows: tuple(rows[c][rows.num_rows - 1].as_py() for c in labels)

    def squeezed(rows: pa.Table, first: np.ndarray, group: np.ndarray) -> pa.Table:
        count = rows["n"].to_numpy()
        sizes = np.bincount(group, weights=count).astype(np.int64)
        g, node, n = compress(rows["cell"].to_numpy().astype(np.int64) + (1 << levels), group, count, sizes // k, levels)
        order = np.argsort(g, kind="stable")
        g, node, n = g[order], node[order], n[order]
        # the rank error of a group is carried by its first node, so that it adds up in any merge
        error = np.where(np.diff(g, prepend=-1) != 0, levels * (sizes // k)[g], 0)
        kept = rows.select(labels).take(pa.array(first[g]))
        return pa.table([*kept.columns, pa.array(node), pa.array(n), pa.array(error)], names=[*labels, "node", "n", "rank_error"])

    def run(batches):
        held: list[pa.Table] = []
        key = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            last = last_of(rows)
            if held and last == key:
                held.append(rows)
                continue
            rows = pa.concat_tables([*held, rows])
            _, group = _group_codes(rows, labels)
            other = np.flatnonzero(group != group[-1])
            start = int(other[-1]) + 1 if len(other) else 0
            if start:
                whole = rows.slice(0, start)
                yield from squeezed(whole, *_group_codes(whole, labels)).to_batches()
            held, key = [rows.slice(start)], last
        if held:
            rows = pa.concat_tables(held)
            yield from squeezed(rows, *_group_codes(rows, labels)).to_batches()

    return run


def digests(df: DataFrame, period: Column, groups: Mapping[str, Column], values: Sequence[str], eps: float = EPS) -> DataFrame:
    """(period, groups, metric, node, n, rank_error): one compressed digest per period, group and metric.

    Digests are placed by all three, so a period of many groups is spread over the cluster; one digest
    has at most as many cells as its universe, whatever the number of rows.
    """
    universe = universe_of(df, values)
    k = math.ceil(universe.levels / eps)
    names = list(groups)
    metrics = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), universe.cell_of(F.col(f"`{v}`")).alias("cell")) for v in values]))
    leaves = (
        df.select(period.alias("period"), *(c.alias(n) for n, c in groups.items()), metrics.alias("m"))
        .where("m.cell is not null")
        .groupBy("period", *names, F.col("m.metric").alias("metric"), F.col("m.cell").alias("cell"))
        .agg(F.count("*").alias("n"))
    )
    kinds = dict(leaves.dtypes)
    labels = ["period", *names, "metric"]
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in labels), "node long, n long, rank_error long"])
    placed = leaves.repartition(*labels).sortWithinPartitions(*labels)
    return placed.mapInArrow(_compress_groups(k, universe.levels, labels), schema)


def merge(digest: DataFrame, groups: Sequence[str]) -> DataFrame:
    """Digests of any periods as one: counts of equal nodes add up."""
    return digest.groupBy(*groups, "metric", "node").agg(F.sum("n").alias("n"), F.sum("rank_error").alias("rank_error"))


def save(digest: DataFrame, path: str, universe: Universe = LONG) -> None:
    """Add digests to those in a folder; rows that arrive later for a period are one more digest of it."""
    digest.withColumn("universe", F.lit(universe.kind)).write.mode("append").parquet(path)


def load(spark: SparkSession, path: str, universe: Universe = LONG) -> DataFrame:
    """The digests of a folder; those of another universe cannot be merged with them and raise."""
    found = spark.read.parquet(path)
    if found.where(F.col("universe") != universe.kind).limit(1).count():
        raise ValueError(f"digests of another universe than {universe.kind}")
    return found.drop("universe")


def percentiles(merged: DataFrame, groups: Sequence[str], shares: Sequence[float], universe: Universe = LONG) -> DataFrame:
    """(groups, metric, share, n, low, value, rank_error) of merged digests; ``low`` and ``value`` are the edges of the cell."""
    height = F.lit(universe.levels) - (F.length(F.bin("node")) - 1)
    last = F.call_function("shiftleft", F.col("node") + 1, height.cast("int")) - 1 - (1 << universe.levels)
    by = Window.partitionBy(*groups, "metric")
    up = by.orderBy("last", F.col("node").desc()).rowsBetween(Window.unboundedPreceding, 0)
    running = (
        merged.withColumn("last", last)
        .withColumn("upto", F.sum("n").over(up))
        .withColumn("total", F.sum("n").over(by))
        .withColumn("error", F.sum("rank_error").over(by))
    )
    wanted = F.explode(F.array(*[F.lit(float(s)) for s in shares])).alias("share")
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("total"), 6)))
    return (
        running.select(*groups, "metric", "last", "upto", F.col("n").alias("here"), "total", "error", wanted)
        .where((F.col("upto") >= target) & (F.col("upto") - F.col("here") < target))
        .select(
            *groups, "metric", "share", F.col("total").alias("n"), universe.lower_edge(F.col("last")).alias("low"),
            universe.upper_edge(F.col("last")).alias("value"), F.col("error").alias("rank_error"),
        )
    )


def ranks(df: DataFrame, groups: Mapping[str, Column], found: DataFrame) -> DataFrame:
    """``found`` (percentiles) with the true ranks: ``n_upto`` values are <= value and ``n_below`` lie below the cell.

    The percentiles of a group meet its rows as one row of arrays, so no row is repeated per share.
    """
    names, values = list(groups), [r["metric"] for r in found.select("metric").distinct().collect()]  # the names of columns
    packed = found.groupBy(*names, "metric").agg(F.sort_array(F.collect_list(F.struct("share", "low", "value", "n", "rank_error"))).alias("p"))
    metrics = F.explode(F.array(*[F.struct(F.lit(v).alias("metric"), F.col(f"`{v}`").alias("v")) for v in values]))
    rows = df.select(*(c.alias(f"__{n}") for n, c in groups.items()), metrics.alias("m")).where("m.v is not null")
    same = F.col("m.metric") == F.col("metric")
    for n in names:
        same = same & F.col(f"__{n}").eqNullSafe(F.col(n))
    joined = rows.join(packed, same)
    n_shares = found.select("share").distinct().count()
    counts = F.array(*[
        F.struct(F.count(F.when(F.col("m.v") <= F.col("p")[i]["value"], 1)).alias("n_upto"), F.count(F.when(F.col("m.v") < F.col("p")[i]["low"], 1)).alias("n_below"))
        for i in range(n_shares)
    ])
    summed = joined.groupBy(*names, "metric").agg(F.first("p").alias("p"), counts.alias("c"))
    return summed.select(*names, "metric", F.explode(F.arrays_zip("p", "c")).alias("z")).select(*names, "metric", "z.p.*", "z.c.*")
