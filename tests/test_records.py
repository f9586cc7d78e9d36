import random

from pyspark.sql import functions as F

from methyloom.operators import clean

SCHEMA = "contig_id string, position long, strand string, mod_type string, n_mod int, n_valid_cov int, n_canonical int, n_diff int, o long"


def records(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def test_strongest_modification_keeps_ties(spark):
    df = records(spark, [("c", 10, "+", "5mC", 3, 9, 6, 0), ("c", 10, "+", "6mA", 5, 9, 4, 0), ("c", 11, "+", "5mC", 1, 9, 8, 0), ("c", 12, "+", "5mC", 0, 9, 9, 0), ("c", 12, "+", "6mA", 0, 9, 9, 0)])
    kept = {(r.position, r.mod_type) for r in clean.strongest_modification(df).collect()}
    assert kept == {(10, "6mA"), (11, "5mC"), (12, "5mC"), (12, "6mA")}


def test_density_window_golden(spark):
    high = {1, 2, 3, 9, 50, 56, 62}
    rows = [("c", p, "+", "6mA", 9 if p in high else 0, 10, 1, 0) for p in (1, 2, 3, 9, 16, 17, 50, 56, 62)]
    kept = clean.without_dense_neighbourhoods(records(spark, rows), 6, 2, 0.4)
    assert sorted(r.position for r in kept.collect()) == [16, 17]


def test_density_window_brute_force(spark):
    random.seed(4)
    rows = [(f"c{random.randrange(3)}", p, random.choice("+-"), "6mA", random.randrange(11), random.choice([0, 10]), 0, 0) for p in random.sample(range(400), 150)]
    rows = [(c, p, s, m, n if v else 0, v, a, b) for c, p, s, m, n, v, a, b in rows]
    dropped = set()
    for c, p, s, *_ in rows:
        near = [r for r in rows if r[0] == c and r[2] == s and abs(r[1] - p) <= 8]
        if sum(r[5] > 0 and r[4] / r[5] > 0.4 for r in near) >= 2:
            dropped |= {(r[0], r[1], r[2]) for r in near}
    got = {(r.contig_id, r.position, r.strand) for r in clean.without_dense_neighbourhoods(records(spark, rows), 8, 2, 0.4, bucket=17).collect()}
    assert got == {(r[0], r[1], r[2]) for r in rows} - dropped


def test_last_wins_and_coverage_order(spark):
    df = records(spark, [("c", 1, "+", "6mA", 1, 9, 8, 0), ("c", 1, "+", "6mA", 7, 9, 2, 0), ("c", 2, "+", "6mA", 7, 5, 0, 0), ("c", 2, "+", "5mC", 6, 9, 0, 0), ("c", 3, "+", "6mA", 9, 4, 0, 0)])
    out = clean.clean(df, [F.col("o")], clean.CleanOptions(n_high=9)).collect()
    # at 2 the weak modification is suppressed by a record that then fails on coverage itself
    assert {(r.position, r.n_mod) for r in out} == {(1, 7)}
    assert clean.clean(df.limit(0), [F.col("o")]).count() == 0


def test_bed_fields(spark):
    r = clean.bed_fields(records(spark, [("c", 10, "+", "6mA", 1, 10, 9, 2)])).first()
    assert tuple(r) == ("c", 10, 11, "a", 10, "+", 10, 11, "255,0,0", 10, "10.0", 1, 9, "NA", "NA", "NA", 2, "NA")


def test_contig_runs(spark):
    df = spark.createDataFrame([("f", i, c) for i, c in enumerate(["a", "a", "b", "a", None, None])], "f string, i long, contig_id string")
    assert sorted((r.run, r.contig_id or "", r.n_records) for r in clean.contig_runs(df, "f", "i").collect()) == [(1, "a", 2), (2, "b", 1), (3, "a", 1), (4, "", 2)]


def test_runs_do_not_depend_on_blocks(spark):
    import random

    from methyloom.operators.clean import contig_runs

    random.seed(3)
    rows, want = [], []
    for f in ("a", "b"):
        last, run = object(), 0
        for i in range(200):
            c = random.choice(["x", "x", "x", "y", None]) if random.random() < 0.4 or not i else last
            if c != last or not i:
                run += 1
                want.append([f, run, c, i, i, 0])
            want[-1][4], want[-1][5] = i, want[-1][5] + 1
            rows.append((f, i, c))
            last = c
    df = spark.createDataFrame(rows, "f string, line long, contig_id string")
    for block in (1, 7, 64, 1 << 20):
        got = contig_runs(df, "f", "line", block=block).collect()
        assert sorted(map(list, got), key=lambda r: (r[0], r[1])) == want
