import random
from collections import defaultdict

from pyspark.sql import functions as F

from methyloom.operators.tree_aggregate import State, hot_keys, tree_aggregate

STATES = lambda: {"n": State("count", F.lit(1)), "nv": State("count", F.col("v")), "s": State("sum", F.col("v")), "lo": State("min", F.col("v")), "hi": State("max", F.col("v"))}


def test_against_brute_force_over_many_rounds(spark):
    random.seed(6)
    rows = [(random.choice(["hot"] * 8 + ["a", "b", None]), random.choice([None, *range(50)]), 1) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v long, __x int").repartition(13)
    want = defaultdict(list)
    for k, v, _ in rows:
        want[k].append(v)
    for fan_in in (2, 3, 64):
        got = {r.k: tuple(r)[1:] for r in tree_aggregate(df, ["k"], STATES(), fan_in).collect()}
        assert got == {k: (len(v), len(x), sum(x), min(x), max(x)) for k, v in want.items() for x in [[y for y in v if y is not None]]}


def test_rounds_are_logarithmic(spark):
    plan = tree_aggregate(spark.range(0, 100, 1, 16).withColumn("v", F.col("id")), {"k": F.col("id") % 3}, STATES(), 4, chunks=16)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_nulls_names_and_empty(spark):
    df = spark.createDataFrame([(None, None, "y"), (None, None, "y")], "k string, v long, n string")
    assert [tuple(r) for r in tree_aggregate(df, ["k"], STATES()).collect()] == [(None, 2, 0, None, None, None)]
    assert tree_aggregate(df.limit(0), ["k"], STATES()).count() == 0


def test_hot_keys_count_null_rows_in_the_total(spark):
    df = spark.createDataFrame([("a",)] * 2 + [("b",)] + [(None,)] * 97, "k string")
    per = tree_aggregate(df, ["k"], {"n": State("count", F.lit(1))})
    assert [r.k for r in hot_keys(per, "k", "n", 50).collect()] == ["a"]


def test_any_plan_may_give_the_input(spark):
    """Joined, filtered, coalesced and many more partitions than chunks: every key comes out once."""
    left = spark.range(0, 6000, 1, 60).select((F.col("id") % 50).alias("k"), (F.col("id") % 97).alias("j"))
    right = spark.range(0, 97, 1, 8).select(F.col("id").alias("j"), F.repeat(F.lit("x"), 200).alias("w"), (F.col("id") * 2).alias("v"))
    for hint in ("broadcast", "merge", "shuffle_hash"):
        joined = left.join(right.hint(hint), "j")
        for df in (joined, joined.where("v > 20"), joined.coalesce(3), joined.repartition(40, "j")):
            want = {r.k: (r.n, r.s) for r in df.groupBy("k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}
            for fan_in, chunks in ((2, None), (4, 3), (16, 200)):
                got = tree_aggregate(df, ["k"], {"n": State("count", F.lit(1)), "s": State("sum", F.col("v"))}, fan_in, chunks).collect()
                assert len(got) == 50 and {r.k: (r.n, r.s) for r in got} == want
