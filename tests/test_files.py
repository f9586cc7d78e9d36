import gzip

import pytest

from methyloom.operators.clean import CleanOptions
from methyloom.plans import pipelines
from methyloom.sinks import files as sinks
from methyloom.sources import files as sources


def pile(contig, pos, n_mod=1, cov=10, code="a", strand="+"):
    return "\t".join(map(str, [contig, pos, pos + 1, code, cov, strand, pos, pos + 1, "255,0,0", cov, "1.0", n_mod, cov - n_mod, "NA", "NA", "NA", 0, "NA"]))


@pytest.fixture
def folder(tmp_path):
    seq = "TTGATCAA" * 40
    (tmp_path / "x.fa").write_text(f">c1 some words\r\n{seq[:100]}\r\n{seq[100:]}\r\n>c2\nacgt\nNN\n>c1\n{seq}\n")
    rows = [pile("c1", i, 9 if i % 8 == 3 else 0, 10) for i in range(0, 320) if seq[i] == "A"]
    rows += [pile("c2", 1, 3, 4), pile("c2", 2, 3, 9, "h"), pile("c2", 3, 3, 9, "m", "*"), "short\trow", pile("c2", 5, 2, 9, "21839", "-")]
    (tmp_path / "p.bed").write_text("\n".join(rows) + "\n")
    with gzip.open(tmp_path / "p2.bed.gz", "wt") as f:
        f.write("\n".join(rows[:5]) + "\n")
    with gzip.open(tmp_path / "p2.bed.gz", "at") as f:
        f.write("\n".join(rows[5:]) + "\n")
    (tmp_path / "bins.tsv").write_text("c1\tb1\nc2\tb1\nlonely\n")
    header = "bin\tmotif\tmod_position\tmod_type\tn_mod\tn_nomod\tmotif_type\tmotif_complement\tmod_position_complement\tn_mod_complement\tn_nomod_complement\n"
    (tmp_path / "motifs.tsv").write_text(header + "b1\tGATC\t1\ta\t1\t1\tpalindrome\tGATC\t1\t1\t1\nb1\tCC\t0\tm\t1\t1\tx\t\t\t\t\n")
    return tmp_path


def test_fasta(spark, folder):
    got = {r.contig_id: r.seq for r in sources.read_fasta(spark, str(folder / "x.fa")).collect()}
    assert got == {"c1": "TTGATCAA" * 40, "c2": "acgtNN"}


def test_pileup_plain_and_gzip(spark, folder):
    plain = sources.read_pileup(spark, str(folder / "p.bed"), 5)
    assert {r.contig_id: r["count"] for r in plain.groupBy("contig_id").count().collect()} == {"c1": 120, "c2": 1}
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, sources.read_pileup(spark, str(folder / "p2.bed.gz"), 5).collect()))
    assert sources.read_contig(spark, str(folder / "p.bed"), "c2").first().mod_type == "4mC"
    sources.to_partitioned(plain, str(folder / "by_contig"))
    back = sources.of_contig(spark.read.parquet(str(folder / "by_contig")), "c2")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert back.count() == 1 and "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(contig_id,c2)" in plan
    assert sorted(r.contig_id for r in sources.list_contigs(plain).collect()) == ["c1", "c2"]


def test_leading_integers(spark):
    df = spark.createDataFrame([("12x",), ("x12",), ("-3",), ("99999999999",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(sources.leading_integer(df["t"])).collect()] == [12, None, -3, None, None, None]


def test_bin_files(spark, folder):
    assert sorted(map(tuple, sources.read_contig_bin(spark, str(folder / "bins.tsv")).collect())) == [("c1", "b1"), ("c2", "b1")]
    rows = sources.read_bin_motifs(spark, str(folder / "motifs.tsv")).collect()
    assert [(r.motif, r.motif_complement, r.mod_position_complement) for r in rows] == [("GATC", "GATC", 1), ("CC", None, None)]


def test_preprocess_round_trip(spark, folder):
    out = str(folder / "clean.bed")
    cleaned = pipelines.preprocess(spark, str(folder / "p.bed"), out, CleanOptions(n_high=99))
    assert sorted(map(tuple, cleaned.collect())) == sorted(map(tuple, sources.read_pileup(spark, out).select(*cleaned.columns).collect()))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_bed(cleaned, out)
    pipelines.preprocess(spark, str(folder / "p.bed"), str(folder / "packed.bed"), CleanOptions(n_high=99), gzip=True)
    assert sources.read_pileup(spark, str(folder / "packed.gz")).count() == cleaned.count()
    assert sinks.gzip_path("a/b.bed") == "a/b.gz" and sinks.gzip_path("a/b.gz") == "a/b.gz"
    one = pipelines.contig_pileup(spark, str(folder / "p.bed"), "c1", CleanOptions(n_high=99)).toPandas().to_dict("list")
    assert set(one) == set(cleaned.columns) and set(one["contig_id"]) == {"c1"}


def test_summary_and_discovery(spark, folder):
    f = lambda name: str(folder / name)
    annotated, summary, missing = pipelines.motif_summary(spark, f("x.fa"), f("p.bed"), f("motifs.tsv"), f("bins.tsv"), f("out"))
    s = {(r.contig_id, r.mod_type, r.strand): r for r in summary.collect()}
    assert (s["c1", "6mA", "+"].n_records_in_motif, s["c1", "6mA", "+"].n_gt_threshold_in_motif, s["c1", "6mA", "+"].n_mod_not_in_motif) == (40, 40, 0)
    assert missing.count() == 0 and spark.read.csv(f("out/contigs_without_sequence"), sep="\t", header=True).count() == 0
    text = spark.read.csv(f("out/annotated_records"), sep="\t", header=True)
    assert text.columns == sinks.ANNOTATED_COLUMNS and text.where("in_motif = 'true'").count() == 40
    assert spark.read.csv(f("out/summary"), sep="\t", header=True).columns == sinks.SUMMARY_COLUMNS
    found = pipelines.discover(spark, f("x.fa"), f("p.bed"), f("out2"))
    assert found.count() == spark.read.csv(f("out2/motifs"), sep="\t", header=True).count() >= 1
