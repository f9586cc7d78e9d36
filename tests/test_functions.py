import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from methyloom.functions import iupac, measures
from methyloom.functions.modcodes import canonical_mod_type
from methyloom.functions.motif import Motif, MotifPair, grow, is_valid_col, overlaps_itself, pretty_col, subsets


def test_iupac_sets():
    assert iupac.from_bases("AG") == "R" and iupac.from_bases(["C", "R"]) == "V"
    assert iupac.join("A", "C") == "M" and iupac.complement("ACGTRYKMBVDHSWN") == "TGCAYRMKVBHDSWN"
    assert iupac.regex("CCWGGN") == "CC[AT]GG." and iupac.one_hot("R") == [0.5, 0, 0.5, 0]
    assert iupac.contains("N", "R") and not iupac.contains("R", "R") and iupac.contains("R", "A")
    with pytest.raises(ValueError):
        iupac.from_bases("X")
    with pytest.raises(ValueError):
        iupac.from_bases("")


@pytest.mark.parametrize(("at", "want"), [(0, "MCGT"), (1, "AMGT"), (2, "ACVT"), (3, "ACGH")])
def test_grow_inside(at, want):
    assert grow("ACGT", 0, at, "AC") == (want, 0)


def test_grow_outside():
    assert grow("GATC", 1, -2, "C") == ("CNGATC", 3)
    assert grow("GATC", 1, 5, "AG") == ("GATCNR", 1)


def test_motif_forms_and_errors():
    m = Motif("GATC", "a", 1)
    assert (m.pretty, m.underscored, m.dashed) == ("G6mATC", "GATC_6mA_1", "GATC-6mA-1")
    assert (Motif("AACT", "6mA", 0).complement().sequence, Motif("AACT", "6mA", 0).complement().position) == ("AGTT", 3)
    assert (Motif("CAGCTG", "4mC", 3).complement().sequence, Motif("CAGCTG", "4mC", 3).complement().position) == ("CAGCTG", 2)
    assert MotifPair(m, m).palindrome
    for bad in (("GATC", "6mA", 0), ("GATC", "6mA", 9), ("GAXC", "6mA", 1), ("GATC", "7mA", 1), ("", "6mA", 0)):
        with pytest.raises(ValueError):
            Motif(*bad)
    with pytest.raises(ValueError):
        MotifPair(m, Motif("AATC", "6mA", 1))
    assert subsets("AC") == [("A",), ("C",), ("A", "C")]
    assert overlaps_itself("AA") and overlaps_itself("ANA") and not overlaps_itself("GATC")


@given(st.text("ACGTRYSWKMBDHVN", min_size=1, max_size=12))
def test_reverse_complement_is_its_own_inverse(seq):
    assert iupac.complement(iupac.complement(seq)) == seq


def test_columns_agree_with_python(spark):
    rows = [("GATC", "6mA", 1), ("CCWGG", "5mC", 1), ("TNNNRAC", "4mC", 6), ("gatc", "6mA", 1), (None, "6mA", 0), ("GATC", None, 1), ("GATC", "6mA", None), ("GATC", "6mA", 7)]
    df = spark.createDataFrame(rows, "s string, m string, p int")
    out = df.select("s", is_valid_col(F.col("s"), F.col("m"), F.col("p")).alias("ok"), iupac.regex_col(F.col("s")).alias("rx"), iupac.reverse_complement_col(F.col("s")).alias("rc"), pretty_col(F.col("s"), F.col("m"), F.col("p")).alias("pretty")).collect()
    for (s, m, p), r in zip(rows[:3], out, strict=False):
        motif = Motif(s, m, p)
        assert (r.ok, r.rx, r.rc, r.pretty) == (True, motif.regex, motif.complement().sequence, motif.pretty)
    assert [r.ok for r in out[3:]] == [False] * 5


def test_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("a", "m", "21839", "6mA", "5mC", "4mC", "5mc", "b", None)], "c string")
    assert [r[0] for r in df.select(canonical_mod_type(F.col("c"))).collect()] == ["6mA", "5mC", "4mC", "6mA", "5mC", "4mC", None, None, None]


def test_measures(spark):
    df = spark.createDataFrame([(7, 10), (0, 10), (1, 0), (5, 10), (2, 10), (1, 10)], "m int, c int")
    out = df.select(measures.level(F.col("m"), F.col("c")).alias("l"), (measures.frac32(F.col("m"), F.col("c")) > measures.f32(0.7)).alias("gt"), measures.percent_text(F.col("m"), F.col("c")).alias("t")).collect()
    assert [r.l for r in out] == ["High", "Low", "Low", "Middle", "Middle", "Low"]
    assert out[0].gt is False and [r.t for r in out] == ["70.0", "0.0", "0.0", "50.0", "20.0", "10.0"]


def test_lgamma(spark):
    xs = [1e-3, 0.3, 0.5, 1.0, 1.5, 2.0, 10.0, 123.4, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(measures.lgamma(F.col("x"))).collect()]
    assert all(abs(a - math.lgamma(x)) <= 1e-9 * max(1, abs(math.lgamma(x))) for a, x in zip(got, xs, strict=True))
    assert spark.range(1).select(measures.lgamma(F.lit(0.0))).first()[0] is None
