import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from methyloom.llm import packing


@settings(deadline=None, max_examples=60)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=4), st.integers(0, 40))
def test_best_fill_against_all_multisets(counts, room):
    sizes = sorted(counts, reverse=True)
    got = packing.best_fill(sizes, [counts[s] for s in sizes], room)
    assert all(0 < n <= counts[s] for s, n in got.items())
    sums = {sum(s * n for s, n in zip(sizes, c, strict=True)) for c in product(*(range(counts[s] + 1) for s in sizes))}
    assert sum(s * n for s, n in got.items()) == max(x for x in sums if x <= room)


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=12))
def test_plan_places_every_item_once(histogram):
    filled, seen = defaultdict(int), Counter()
    for size, rank, container, n, times in packing.plan(histogram, 50)[0]:
        assert rank == seen[size]
        seen[size] += n * times
        for c in range(container, container + times):
            filled[c] += n * size
    assert seen == Counter(histogram) and set(filled) == set(range(len(filled))) and all(f <= 50 for f in filled.values())


def first_fit_decreasing(sizes, capacity):
    room = Counter()  # how many containers have how much room
    used = 0
    for size in sorted(sizes, reverse=True):
        fit = min((r for r, n in room.items() if n and r >= size), default=None)
        if fit is None:
            used, fit = used + 1, capacity
        else:
            room[fit] -= 1
        room[fit - size] += 1
    return used


def test_plan_rejects_sizes_out_of_range():
    with pytest.raises(ValueError):
        packing.plan({51: 1}, 50)
    assert packing.plan({}, 50) == ([], {})


def test_pack(spark):
    rnd = random.Random(1)
    sizes = [rnd.choice([None, 0, 1, 7, 7, 7, 7, 13, 31, 64, 65, 200, 1000]) for _ in range(3000)]
    df = spark.createDataFrame([(i, s, "z") for i, s in enumerate(sizes)], "doc long, n long, part string")
    rows = packing.pack(df, "doc", "n", 64).collect()
    filled, parts = Counter(), defaultdict(list)
    for r in rows:
        filled[r.container] += r["size"]
        parts[r.doc].append((r.part, r["first"], r["size"]))
    assert max(filled.values()) <= 64
    for i, s in enumerate(sizes):
        got = sorted(parts[i])
        assert sum(x[2] for x in got) == (s or 0) and len(got) == -(-(s or 0) // 64)
        assert all(first == 64 * p and (size == 64 or p == len(got) - 1) for p, first, size in got)
    assert len(filled) <= first_fit_decreasing([r["size"] for r in rows], 64)
    again = packing.pack(df, "doc", "n", 64).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_empty_and_repeated(spark):
    assert packing.pack(spark.createDataFrame([], "doc long, n long"), "doc", "n", 64).count() == 0
    same = spark.createDataFrame([(1, 40)] * 5 + [(None, 24)] * 5, "doc long, n long")
    rows = packing.pack(same, "doc", "n", 64).collect()
    assert len(rows) == 10 and max(Counter(r.container for r in rows).values()) == 2


@settings(deadline=None, max_examples=40)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 200), max_size=12))
def test_plan_and_what_it_leaves_over_are_all_items(histogram):
    kept, over = packing.plan(histogram, 50, 0.0, 8)
    seen = Counter(over)
    filled = defaultdict(int)
    for size, _, container, n, times in kept:
        seen[size] += n * times
        for c in range(container, container + times):
            filled[c] += n * size
    assert seen == Counter(histogram) and set(filled) == set(range(len(filled)))


@pytest.mark.parametrize(("capacity", "sizes"), [(64, (1, 7, 13, 31, 40, 64, 65)), (2048, range(1, 3000)), (1 << 17, (5, 70_000, 131_071, 131_072, 400_000)), (1, (1, 2)), (101, (60, 60, 2))])
def test_many_shards_fill_like_one(spark, capacity, sizes):
    rnd = random.Random(4)
    rows = [(i, rnd.choice(list(sizes))) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc long, n long")
    filled, parts = Counter(), Counter()
    for r in packing.pack(df, "doc", "n", capacity, items_per_shard=100).collect():
        filled[r.container] += r["size"]
        parts[r.doc] += r["size"]
    assert parts == Counter(dict(rows)) and max(filled.values()) <= capacity and set(filled) == set(range(len(filled)))
    whole, _ = packing.plan(Counter(min(capacity, n - a) for _, n in rows for a in range(0, n, capacity)), capacity)
    one = max(container + times for _, _, container, _, times in whole)
    assert len(filled) <= one + max(1, one // 100)


def test_one_key_may_hold_all_rows(spark):
    df = spark.range(0, 4000, 1, 4).select(F.lit(None).cast("long").alias("doc"), (F.col("id") % 50 + 1).alias("n"))
    got = packing.pack(df, "doc", "n", 64, items_per_shard=500).collect()
    filled = Counter()
    for r in got:
        filled[r.container] += r["size"]
    assert len(got) == 4000 and max(filled.values()) <= 64 and sum(filled.values()) == 80 * sum(range(1, 51))
