import datetime as dt
import random

import pytest

from methyloom.operators import orphans as orph

T0 = dt.datetime(2025, 1, 1)
day = lambda n: None if n is None else T0 + dt.timedelta(days=n)


def run(spark, parents, refs, **kwargs):
    p = spark.createDataFrame([(k, day(s), day(e)) for k, s, e in parents], "k string, s timestamp_ntz, e timestamp_ntz")
    r = spark.createDataFrame([(i, k, day(t), "x") for i, (k, t) in enumerate(refs)], "id long, k string, t timestamp_ntz, kind string")
    out = orph.orphans([orph.Parents("p", p, "k", "s", "e")], [orph.References("r", "p", r, "id", "k", "t")], **kwargs)
    return {(x.row_id, x.ref_month) for x in out.collect()}


def brute(parents, refs):
    held = lambda k, t: any(pk == k and s is not None and s <= t and (e is None or e > t) for pk, s, e in parents)
    return {(i, day(t).strftime("%Y-%m")) for i, (k, t) in enumerate(refs) if k is not None and t is not None and not held(k, t)}


@pytest.mark.parametrize("sizes", [{}, {"parents_per_range": 4, "references_per_batch": 7}])
def test_against_brute_force(spark, sizes):
    random.seed(5)
    keys = ["hot", "", "é", *(f"k{i}" for i in range(30)), None]
    when = lambda: random.choice([None, *range(100)])
    parents = [(random.choice(keys[:20] + [None]), when(), when()) for _ in range(120)] + [("hot", 10, 20), ("hot", 15, None)] * 3
    refs = [(random.choice(keys + ["hot"] * 20), when()) for _ in range(600)]
    assert run(spark, parents, refs, **sizes) == brute(parents, refs)


def test_the_session_time_zone_plays_no_part(spark):
    parents, refs = [("a", 5, 9)], [("a", t / 24) for t in range(0, 24 * 40)]
    want = brute(parents, refs)
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("Asia/Tokyo", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert run(spark, parents, refs) == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bounds_of_an_interval(spark):
    parents, refs = [("a", 5, 9), ("b", 5, 5), ("c", None, None)], [("a", 4), ("a", 5), ("a", 8), ("a", 9), ("b", 5), ("c", 50)]
    assert {i for i, _ in run(spark, parents, refs)} == {0, 3, 4, 5}


def test_empty_tables(spark):
    assert run(spark, [], [("a", 40), (None, 1)]) == {(0, "2025-02")}
    assert run(spark, [("a", 1, None)], []) == set() and run(spark, [], []) == set()


def test_equal_hashes_are_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(orph, "_hash", lambda kind, key: F.length(key).cast("long"))
    parents, refs = [("aa", 1, 5), ("bb", 3, None), ("c", 0, None)], [(k, t) for k in ("aa", "bb", "cc", "c", "d") for t in range(8)]
    assert run(spark, parents, refs) == brute(parents, refs)
