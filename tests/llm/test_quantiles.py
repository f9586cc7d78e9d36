import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from methyloom.llm import quantiles as q

SHARES = (0.0, 0.01, 0.5, 0.9, 1.0)
LEVELS = q.LONG.levels


def result(df, eps, periods="p", shares=SHARES):
    d = q.digests(df, F.col(periods), {"g": F.col("g")}, ["v"], eps)
    return d, q.percentiles(q.merge(d, ["g"]), ["g"], shares).collect()


def in_order(spark, universe, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}")
    cell = universe.cell_of(F.col("v"))
    rows = df.select("v", cell.alias("c")).select("v", "c", universe.lower_edge(F.col("c")).alias("a"), universe.upper_edge(F.col("c")).alias("e")).orderBy("v", "c").collect()
    cells = [r.c for r in rows]
    assert cells == sorted(cells) and 0 <= cells[0] and cells[-1] < 1 << universe.levels
    assert all(r.a <= r.v <= r.e for r in rows)
    edges = spark.createDataFrame([(x, r.c) for r in rows for x in (r.a, r.e)], f"v {kind}, c int").where(cell != F.col("c"))
    assert edges.collect() == []  # both edges lie in the cell
    return rows


def test_cells_are_ordered_and_edges_are_exact(spark):
    ends = [2**63 - 1, -(2**63), 2**50, -(2**50)]
    values = sorted({0, 1, 2047, 2048, 2049, 2**31 - 1, -1, -2047, -2048, -2049, *ends, *(random.Random(1).randrange(-(2**62), 2**62) >> s for s in range(60) for _ in range(9))})
    for r in in_order(spark, q.LONG, values, "long"):
        assert r.e - r.a <= max(0, abs(r.v) / 1024) and (abs(r.v) >= 2048 or r.e == r.v)
    assert spark.createDataFrame([(None,)], "v long").select(q.LONG.cell_of(F.col("v"))).first()[0] is None


def test_cells_of_doubles(spark):
    rnd = random.Random(2)
    top, tiny, inf = 1.7976931348623157e308, 5e-324, float("inf")
    some = [rnd.uniform(1, 2) * 2.0 ** rnd.randrange(-1074, 1023) for _ in range(500)] + [2.0**e for e in range(-1074, 1024, 7)] + [0.1 * i for i in range(1, 11)]
    values = [0.0, -0.0, top, -top, tiny, -tiny, inf, -inf, *some, *(-x for x in some)]
    for r in in_order(spark, q.DOUBLE, values, "double"):
        if abs(r.v) > 1e-300 and abs(r.v) != inf:
            assert r.e - r.a <= abs(r.v) / 1024
        if r.v == 0 or abs(r.v) == inf:
            assert r.e == r.a == r.v
    odd = spark.createDataFrame([(None,), (float("nan"),)], "v double").select(q.DOUBLE.cell_of(F.col("v"))).collect()
    assert [r[0] for r in odd] == [None, None]


@pytest.mark.parametrize(("kind", "values"), [("double", [i / 10 for i in range(1, 11)]), ("long", [2**50 + i * 2**40 for i in range(-5, 5)]), ("decimal(9,2)", [Decimal(i) / 4 for i in range(-5, 5)])])
def test_medians_of_any_number(spark, kind, values):
    df = spark.createDataFrame([("a", v, 1) for v in values], f"g string, v {kind}, p int")
    d = q.digests(df, F.col("p"), {"g": F.col("g")}, ["v"])
    got = q.percentiles(q.merge(d, ["g"]), ["g"], (0.5, 0.9), q.universe_of(df, ["v"])).orderBy("share").collect()
    for r, true in zip(got, (sorted(values)[4], sorted(values)[8]), strict=True):
        assert r.rank_error == 0 and float(true) <= r.value <= float(true) + abs(float(true)) / 1024
    with pytest.raises(ValueError):
        q.universe_of(df, ["g"])


def test_digests_of_two_runs_merge(spark, tmp_path):
    rnd = random.Random(5)
    rows = [(rnd.choice("ab"), rnd.randrange(1 << 40), rnd.randrange(6)) for _ in range(4000)]
    df = spark.createDataFrame(rows, "g string, v long, p int")
    path = str(tmp_path / "digests")
    make = lambda part: q.digests(part, F.col("p"), {"g": F.col("g")}, ["v"], 0.1)
    for part in (df.where("p < 3"), df.where("p >= 3")):
        q.save(make(part), path)
    key = lambda d: sorted((r.g, r.node, r.n, r.rank_error) for r in q.merge(d, ["g"]).collect())
    assert key(q.load(spark, path)) == key(make(df))
    found = q.percentiles(q.merge(q.load(spark, path), ["g"]), ["g"], SHARES)
    for r in q.ranks(df, {"g": F.col("g")}, found).collect():
        target = max(1, math.ceil(round(r.share * r.n, 6)))
        assert r.n_upto >= target and r.n_below < target + r.rank_error and 0 < r.rank_error <= 0.1 * r.n
    with pytest.raises(ValueError):
        q.load(spark, path, q.DOUBLE)


def test_a_digest_longer_than_a_batch(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(g, v, p) for g in ("a", "b", None) for p in (1, None) for v in range(40)]
        got = q.digests(spark.createDataFrame(rows, "g string, v long, p int").repartition(1), F.col("p"), {"g": F.col("g")}, ["v"], 1e-4).collect()
        assert len(got) == len(rows) and all(r.n == 1 and r.rank_error == 0 for r in got)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("eps", [0.005, 0.1, 0.5])
def test_rank_error_is_bounded(spark, eps):
    rnd = random.Random(2)
    rows = [(rnd.choice("aab"), int(rnd.lognormvariate(4, 2)) - 50, rnd.randrange(3)) for _ in range(6000)]
    digest, got = result(spark.createDataFrame(rows, "g string, v long, p int"), eps)
    assert len(got) == 2 * len(SHARES)
    for r in got:
        v = np.array([x for g, x, _ in rows if g == r.g])
        target = max(1, math.ceil(round(r.share * len(v), 6)))
        width = 1 if -2048 <= r.value < 2048 else 2 ** (int(abs(r.value)).bit_length() - 11)
        assert r.n == len(v) and r.rank_error <= eps * len(v)
        assert (v <= r.value).sum() >= target and (v <= r.value - width).sum() < target + max(1, r.rank_error)
    if eps == 0.5:
        assert digest.count() < len({(g, v, p) for g, v, p in rows})


def test_merging_is_associative(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.randrange(3000), rnd.randrange(8)) for _ in range(4000)]
    d = q.digests(spark.createDataFrame(rows, "g string, v long, p int"), F.col("p"), {"g": F.col("g")}, ["v"], 0.3)
    halves = [q.merge(d.where(c), ["g"]) for c in ("period < 4", "period >= 4")]
    two = q.merge(halves[0].unionByName(halves[1]), ["g"])
    key = lambda df: sorted((r.node, r.n) for r in df.collect())
    assert key(two) == key(q.merge(d, ["g"]))
    assert sum(n for _, n in key(two)) == 4000


def test_nulls_ties_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(None, 5, None, "x")] * 3 + [(None, None, 1, "x"), ("a", 7, 1, "x")], "g string, v int, p int, period string")
    _, got = result(df, 0.01, shares=(0.5,))
    assert sorted((r.g or "", r.n, r.value) for r in got) == [("", 3, 5), ("a", 1, 7)]
    assert result(df.limit(0), 0.01)[1] == [] and result(df.where("v is null"), 0.01)[1] == []


def test_compress_keeps_all_counts():
    rng = np.random.default_rng(0)
    for k in (1, 5, 50):
        node = np.unique(rng.integers(1, 1 << (LEVELS + 1), 400))
        group, count = rng.integers(0, 3, len(node)), rng.integers(1, 9, len(node))
        total = np.bincount(group, count, 3).astype(np.int64)
        g, v, n = q.compress(node, group, count, total // k, LEVELS)
        assert (np.bincount(g, n, 3) == total).all() and len(set(zip(g, v, strict=True))) == len(g)
        assert all(c <= total[a] // k for a, b, c in zip(g, v, n, strict=True) if b < 1 << LEVELS and b > 1) or k == 50
