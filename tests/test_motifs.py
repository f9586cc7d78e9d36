import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from methyloom.functions.iupac import regex
from methyloom.operators import annotate as ann
from methyloom.operators import mixture, search, windows
from methyloom.operators.occurrences import level_counts, occurrences

PILE = "contig_id string, position long, strand string, mod_type string, n_mod int, n_valid_cov int, n_canonical int, n_diff int"


def find(spark, seqs, motifs, overlapping=False):
    s = spark.createDataFrame(list(seqs.items()), "contig_id string, seq string")
    m = spark.createDataFrame([(c, q, t, p) for c in seqs for q, t, p in motifs], "contig_id string, motif_seq string, mod_type string, mod_position int")
    return occurrences(s, m, overlapping).collect()


def test_golden_positions(spark):
    rows = find(spark, {"c": "ACGTACGTACGTACGT"}, [("ACGT", "6mA", 0)])
    assert sorted(r.position for r in rows if r.strand == "+") == [0, 4, 8, 12]
    assert sorted(r.position for r in rows if r.strand == "-") == [3, 7, 11, 15]


def test_matches_like_a_regex(spark):
    random.seed(1)
    seqs = {f"c{i}": "".join(random.choices("ACGTNa", [5, 5, 5, 5, 1, 1], k=random.randrange(0, 300))) for i in range(20)}
    motifs = [("AA", "6mA", 1), ("CCNGG", "5mC", 1), ("ANA", "6mA", 0), ("RCY", "5mC", 1), ("C", "4mC", 0)]
    got = {(r.contig_id, r.motif_seq, r.start) for r in find(spark, seqs, motifs) if r.strand == "+"}
    assert got == {(c, q, m.start()) for c, s in seqs.items() for q, _, _ in motifs for m in re.finditer(regex(q), s)}
    over = {(r.contig_id, r.motif_seq, r.start) for r in find(spark, seqs, motifs, True) if r.strand == "+"}
    assert over == {(c, q, m.start()) for c, s in seqs.items() for q, _, _ in motifs for m in re.finditer(f"(?={regex(q)})", s)}


def test_pieces_match_like_whole_contigs(spark):
    from methyloom.functions.motif import overlaps_itself, overlaps_itself_col

    random.seed(9)
    seqs = {f"c{i}": "".join(random.choices("ACGTN", [5, 5, 5, 5, 1], k=k)) for i, k in enumerate((0, 1, 3, 50, 100, 101, 333))}
    s = spark.createDataFrame(list(seqs.items()), "contig_id string, seq string")
    motifs = [("AA", "6mA", 1), ("CCNGG", "5mC", 1), ("ANA", "6mA", 0), ("RAY", "6mA", 1), ("GATC", "6mA", 1), ("C", "4mC", 0), ("GANNNNNNT", "6mA", 1)]
    m = spark.createDataFrame([(c, q, t, p) for c in seqs for q, t, p in motifs], "contig_id string, motif_seq string, mod_type string, mod_position int")
    for overlapping in (False, True):
        want = sorted(map(tuple, occurrences(s, m, overlapping).collect()))
        assert len(want) > 50
        for piece in (7, 10, 50):
            assert sorted(map(tuple, occurrences(s, m, overlapping, piece).collect())) == want
    names = spark.createDataFrame([(q,) for q, _, _ in motifs] + [("GATCGA",), ("NN",), ("AT",)], "q string")
    assert all(r.o == overlaps_itself(r.q) for r in names.select("q", overlaps_itself_col(F.col("q")).alias("o")).collect())


def test_annotation_and_summary(spark):
    seq = spark.createDataFrame([("c", "GGATCCGATC"), ("d", None)], "contig_id string, seq string")
    motifs = spark.createDataFrame([("c", "GATC", "6mA", 1), ("c", "CCG", "5mC", 0)], "contig_id string, motif_seq string, mod_type string, mod_position int")
    recs = spark.createDataFrame([("c", 2, "+", "6mA", 9, 10, 1, 0), ("c", 3, "-", "6mA", 3, 10, 7, 0), ("c", 5, "+", "6mA", 9, 10, 1, 0), ("c", 7, "+", "6mA", 1, 5, 4, 0), ("c", 4, "+", "5mC", 8, 10, 2, 0)], PILE)
    a = ann.annotate(recs, occurrences(seq, motifs))
    assert {(r.position, r.strand, r.in_motif, r.motifs) for r in a.collect()} == {(2, "+", True, "G6mATC"), (3, "-", True, "G6mATC"), (5, "+", False, ""), (7, "+", True, "G6mATC"), (4, "+", True, "5mCCG")}
    s = {(r.mod_type, r.strand): r for r in ann.summarise(a).collect()}
    plus = s["6mA", "+"]
    assert (plus.n_records, plus.n_records_below_cov, plus.n_records_in_motif, plus.n_gt_threshold_in_motif, plus.n_mod_not_in_motif, plus.motifs) == (2, 1, 1, 1, 9, "G6mATC")
    assert s["5mC", "-"].n_records == 0 and s["5mC", "-"].motifs == "" and len(s) == 4


def test_bin_motifs_of_a_file(spark):
    rows = [("b", "GATC", 1, "a", "GATC", 1), ("b", "GATC", 1, "6mA", None, None), ("b", "RGATCY", 2, "a", "RGATCY", 2), ("b", "GAGNNT", 1, "a", "ANNCTC", 0), ("b", "GATC", 0, "a", None, None), (None, "GATC", 1, "a", None, None)]
    df = spark.createDataFrame(rows, "bin string, motif string, mod_position int, mod_type string, motif_complement string, mod_position_complement int")
    assert {(r.motif_seq, r.mod_position) for r in ann.bin_motif_set(df).collect()} == {("GATC", 1), ("RGATCY", 2), ("GAGNNT", 1), ("ANNCTC", 0)}


def test_windows_across_tiles(spark, monkeypatch):
    monkeypatch.setattr(windows, "COARSE", 2 * windows.TILE)
    random.seed(2)
    text = "".join(random.choices("ACGT", k=windows.TILE * 5 + 57))
    seq = spark.createDataFrame([("c", text), ("short", "AC"), ("empty", "")], "contig_id string, seq string")
    back = windows.background_windows(seq, 3).where("mod_type = '6mA' and strand = '+'").collect()
    assert {(r.position, r.kmer) for r in back} == {(i, text[i - 3 : i + 4]) for i in range(3, len(text) - 3) if text[i] == "A"}
    at = spark.createDataFrame([("c", p) for p in (0, 2, 3, windows.TILE - 1, windows.TILE, 2 * windows.TILE, len(text) - 4, len(text) - 3)], "contig_id string, position long")
    assert {(r.position, r.kmer) for r in windows.windows_at(at, seq, 3).collect()} == {(p, text[p - 3 : p + 4]) for p in (3, windows.TILE - 1, windows.TILE, 2 * windows.TILE, len(text) - 4)}


def test_pssm_and_divergence(spark):
    kmers = spark.createDataFrame([("x", k) for k in ("TAC", "ACG", "ACG", "ACG")], "g string, kmer string")
    p = windows.pssm(kmers, ["g"], 1)
    got = {(r.offset, r.base): r.freq for r in p.collect()}
    assert got[0, "A"] == 0.75 and got[0, "T"] == 0.25 and got[1, "C"] == 0.75 and got[2, "G"] == 0.75 and got[2, "A"] == 0
    other = windows.pssm(spark.createDataFrame([("x", "CGT")], "g string, kmer string"), ["g"], 1)
    want = 0.75 * np.log(0.75 / 1e-6) + 0.25 * np.log(0.25 / 1e-6)
    kl = {r.offset: r.kl for r in windows.kl_divergence(p, other, ["g"]).collect()}
    assert abs(kl[0] - want) < 1e-1 and {r.offset: r.bases for r in windows.bases_above(p, ["g"], 0.2).collect()} == {0: "AT", 1: "AC", 2: "CG"}


def test_em_step_against_numpy(spark):
    rng = np.random.default_rng(0)
    cov = rng.integers(0, 30, 300)
    rows = [("g", int(rng.integers(0, c + 1)), int(c)) for c in cov]
    df = spark.createDataFrame(rows, "g string, n_mod int, n_valid_cov int")
    models = mixture.seed_models(df, ["g"])
    m, got = models.first(), mixture.em_step(df, models, ["g"], penalty=3.0).first()
    from math import lgamma

    x = np.clip(np.array([n / c for _, n, c in rows if c]), 1e-12, 1 - 1e-12)
    pdf = lambda a, b: (a - 1) * np.log(x) + (b - 1) * np.log(1 - x) - (lgamma(a) + lgamma(b) - lgamma(a + b))
    lt, lf = np.log(m.pi) + pdf(m.ta, m.tb), np.log(1 - m.pi) + pdf(m.fa, m.fb) + np.log(3.0)
    r = 1 / (1 + np.exp(lf - lt))
    mu = (r * x).sum() / r.sum()
    c = mu * (1 - mu) / ((r * (x - mu) ** 2).sum() / r.sum()) - 1
    assert np.allclose([got.pi, got.alpha, got.beta], [r.mean(), mu * c, (1 - mu) * c], rtol=1e-6)
    assert mixture.fit(df, models, ["g"], 3.0, iterations=3).first().n == (cov > 0).sum()
    assert mixture.log_likelihoods(df, models, ["g"]).count() == 1 and mixture.mixture_stats(models).first().variance > 0


def _planted(spark, motif="GATC", position=1, n=20000):
    random.seed(3)
    text = "".join(random.choices("ACGT", k=n))
    hits = {m.start() + position for m in re.finditer(f"(?={motif})", text)}
    rows = [("c", i, "+", "6mA", 17 + i % 4 if i in hits else i % 3, 20, 2, 0) for i, b in enumerate(text) if b == "A"]
    return spark.createDataFrame([("c", text)], "contig_id string, seq string"), spark.createDataFrame(rows, PILE), len(hits)


def test_searches_find_a_planted_motif(spark):
    seq, recs, n = _planted(spark)
    found = search.discover_by_counts(recs, seq).collect()
    assert [(r.motif, r.high_count, r.low_count) for r in found] == [("GATC-6mA-1", n, 0)]
    # growth starts at the left edge of the window and cannot refine an N between, so G is out of reach, TC is not
    by_mixture = search.discover_by_mixture(recs, seq).collect()
    assert by_mixture and all(r.score > 0.1 for r in by_mixture)
    assert max(by_mixture, key=lambda r: r.score).motif_seq[by_mixture[0].motif_mod_position + 1 :].startswith("TC")
    assert search.discover_by_counts(recs.limit(0), seq).count() == 0


def test_reverse_complement_of_a_contig_gives_the_complement_motif(spark):
    seq, recs, n = _planted(spark, "GAGT", 1)
    text = seq.first().seq
    flipped = text.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    mirrored = recs.withColumn("position", F.lit(len(text) - 1) - F.col("position")).withColumn("strand", F.lit("-"))
    other = spark.createDataFrame([("c", flipped)], "contig_id string, seq string")
    found = search.discover_by_counts(mirrored, other, search.CountOptions(both_strands=True)).collect()
    assert [(r.motif, r.high_count) for r in found] == [("GAGT-6mA-1", n)]


def test_level_counts(spark):
    seq = spark.createDataFrame([("c", "GATCGATC")], "contig_id string, seq string")
    motif = spark.createDataFrame([("c", "GATC", "6mA", 1)], "contig_id string, motif_seq string, mod_type string, mod_position int")
    lv = spark.createDataFrame([("c", 1, "+", "6mA", "High"), ("c", 5, "+", "6mA", "Low"), ("c", 2, "-", "6mA", "High")], "contig_id string, position long, strand string, mod_type string, level string")
    r = level_counts(lv, occurrences(seq, motif)).first()
    assert (r.low_count, r.middle_count, r.high_count) == (1, 0, 2)


def test_standalone_scores(spark):
    _, recs, _ = _planted(spark, n=4000)
    marked = recs.withColumn("motif", F.lit("x"))
    scored = mixture.score_single_motifs(marked, ["contig_id", "mod_type", "motif"]).first()
    assert scored.n == recs.count() and 0 < scored.pi < 1
    models = mixture.seed_models(recs, ["contig_id"])
    one = mixture.standalone_fit(recs, models, ["contig_id"], 60).first()
    share = recs.where("n_mod > 10").count() / recs.count()
    assert one.converged and 2 <= one.steps < 60 and abs(one.pi - share) < 0.02 and one.alpha / (one.alpha + one.beta) > 0.8


def test_fit_keeps_the_model_where_a_step_gives_none(spark):
    rows = [("same", 5, 10)] * 20 + [("two", 1 + 8 * (i % 2), 10 + i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "g string, n_mod int, n_valid_cov int")
    models = spark.createDataFrame([("same", 0.1, 5.0, 2.0, 2.0, 3.0), ("two", 0.1, 5.0, 2.0, 2.0, 3.0)], "g string, pi double, ta double, tb double, fa double, fb double")
    got = {r.g: r for r in mixture.fit(df, models, ["g"], 1.0, iterations=30).collect()}
    assert (got["same"].alpha, got["same"].beta) == (5.0, 2.0) and set(got) == {"same", "two"} and got["two"].n == 60
    frozen = {r.g: r for r in mixture.fit(df, models, ["g"], 1.0, iterations=2, tolerance=1e9).collect()}
    assert all(r.converged and r.steps == 2 for r in frozen.values())


def _group(spark, n_plus, n_minus):
    """A contig with ``n_plus`` plus-strand and ``n_minus`` minus-strand records; GATC is methylated on the plus strand."""
    random.seed(5)
    text = "".join(random.choice(["GATC", "TTAC", "CTCA", "GCTG"]) for _ in range(400))
    hits = {m.start() + 1 for m in re.finditer("(?=GATC)", text)}
    plus = [i for i, b in enumerate(text) if b == "A" and 4 <= i < len(text) - 4][:n_plus]
    minus = [i for i, b in enumerate(text) if b == "T"][:n_minus]
    rows = [("c", i, "+", "6mA", 16 + i // 4 % 3 if i in hits else i % 3, 20, 2, 0) for i in plus]
    rows += [("c", i, "-", "6mA", i % 3, 20, 2, 0) for i in minus]
    return spark.createDataFrame([("c", text)], "contig_id string, seq string"), spark.createDataFrame(rows, PILE)


def test_gate_of_the_mixture_search_counts_all_records(spark):
    seq, recs = _group(spark, 45, 20)
    assert search.discover_by_mixture(recs, seq).count() > 0  # 65 records, 45 of them on the plus strand
    few_seq, few = _group(spark, 30, 19)
    assert search.discover_by_mixture(few, few_seq).count() == 0  # 49 records


def _codes(text):
    return search._BASES[np.frombuffer(text.encode(), np.uint8)]


def test_tallies_against_brute_force():
    rng = np.random.default_rng(7)
    text = "".join(rng.choice(list("ACGTN"), 400, p=[0.3, 0.2, 0.2, 0.25, 0.05]))
    left, right, n = 3, 5, 300
    at, minus = rng.integers(0, 400, n), rng.random(n) < 0.4
    weights = rng.integers(0, 5, (n, 2)).astype(float)
    windows = search.Windows(_codes(text), at, minus, left, right, weights.copy())

    def character(i, offset):
        at_i = at[i] - (offset - left) if minus[i] else at[i] + (offset - left)
        if not 0 <= at_i < 400:
            return None
        return text[at_i].translate(str.maketrans("ACGT", "TGCA")) if minus[i] else text[at_i]

    fits = lambda c, code: c is not None and (code == "N" or c in search.MASK and bool(search.MASK[c] & search.MASK[code] and c in "ACGT"))
    for motif in ("...A.....", "..NA.....", "..GA.C...", "..RANNY..", "NNNNNNNNN", "...M....."):
        want = np.zeros((9, 5, 2))
        for i in range(n):
            chars = [character(i, o) for o in range(9)]
            wrong = [o for o in range(9) if motif[o] != "." and not fits(chars[o], motif[o])]
            for o in range(9):
                if chars[o] is not None and (wrong == [] or (wrong == [o] and motif[o] != "N")):
                    want[o, "ACGT".find(chars[o]) if chars[o] in "ACGT" else 4] += weights[i]
        assert np.array_equal(windows.tally(motif, 9), want)
        assert np.array_equal(windows.tally(motif, 4), want[:4])
    windows.without("...A.....", slice(0, 1))
    assert windows.tally("...A.....", 9)[3, 0, 0] == 0 < windows.tally("...A.....", 9)[3, 0, 1]


def test_motifs_grow_as_text():
    from methyloom.functions.motif import grow

    for at, mask, bases in ((0, 1, "A"), (2, 6, "CG"), (3, 8, "T"), (4, 1, "A"), (8, 4, "G")):
        seq, position = grow("GA", 1, at - 2, bases)  # GA stands at the offsets 2 and 3
        joined = search.MASK[seq[at - 3 + position]]
        grown = search._grown("..GA.....", at, joined if at in (2, 3) else mask)
        assert grown.strip(".") == seq and len(grown) - len(grown.lstrip(".")) == 3 - position


def test_records_at_the_ends_count(spark):
    text = "GATC" + "CTTC" * 60 + "GATC"
    at = np.array([1, *range(5, 65), len(text) - 3])
    windows = search.Windows(_codes(text), at, np.zeros(len(at), bool), 4, 4, np.ones((len(at), 1)))
    assert windows.tally("...GAT...", 9)[4, 0, 0] == 2 and windows.tally("..NGAT...", 9)[4, 0, 0] == 1  # NGAT does not fit at the start
    seq, recs, n = _planted(spark)
    begun = recs.where("position < 10 or position % 3 = 0")  # windows cut by the start are records too
    leveled = begun.withColumn("level", search.level_of(F.col("n_mod"), F.col("n_valid_cov"), search.COUNT_LEVELS))
    found = search.found_by_counts(leveled, seq, search.CountOptions()).collect()
    for r in found:
        motif = spark.createDataFrame([("c", r.motif_seq, "6mA", r.mod_position)], "contig_id string, motif_seq string, mod_type string, mod_position int")
        own = level_counts(leveled, occurrences(seq, motif, overlapping=True).where("strand = '+'")).first()
        assert (own.high_count, own.low_count) == (r.high, r.low)


def test_one_contig_spread_over_many_chunks(spark):
    seq, recs, n = _planted(spark, n=3000)
    options = search.CountOptions(max_rounds=1, min_score=0.4)
    whole = sorted(map(tuple, search.discover_by_counts(recs, seq, options).collect()))
    assert sorted(map(tuple, search.discover_by_counts(recs, seq, options, chunk=1600, ahead=16).collect())) == whole


def test_summed_tallies_search_like_one_chunk():
    rng = np.random.default_rng(4)
    text = "".join(rng.choice(list("ACGT"), 3000))
    at = np.array([i for i, b in enumerate(text) if b == "A"])
    high = np.array([text[i + 1 : i + 3] == "CT" for i in at])
    x, r = np.where(high, 0.8, 0.05) + rng.integers(0, 8, len(at)) / 64, np.where(high, 0.96875, 0.0078125)
    weights = np.stack([high, np.ones(len(at)), np.ones(len(at)), r, r * x, r * x * x], axis=1).astype(float)
    options = search.MixtureOptions(max_rounds=12, max_low_score=1)
    found = []
    for parts, ahead in (([slice(None)], 1), ([slice(None)], 9), ([slice(0, 200), slice(200, 201), slice(201, None)], 9)):
        chunks = [search.Windows(_codes(text), at[p], np.zeros(len(at[p]), bool), 4, options.width - 5, weights[p].copy()) for p in parts]
        one = search.MixtureSearch("6mA", options, len(at))
        gone = 0
        while one.open:
            for motif in one.removed[gone:]:
                for c in chunks:
                    c.without(motif, search.MixtureSearch.REMOVABLE)
            gone = len(one.removed)
            offsets = one.n_offsets(ahead)
            one.feed({m: sum(c.tally(m, offsets) for c in chunks) for m in one.wanted(ahead)})
        found.append([(m, round(s, 9)) for m, s, *_ in one.found])
    assert found[0] == found[1] == found[2] and "CT" in found[0][0][0]


def test_mixture_search_names_the_planted_bases(spark):
    seq, recs, n = _planted(spark, "ACTT", 0)
    found = search.discover_by_mixture(recs, seq).collect()
    best = max(found, key=lambda r: r.score)
    at = best.motif_mod_position
    assert best.motif_seq[at + 1 : at + 4] == "CTT" and best.score > 0.8


def test_mixture_search_reaches_beyond_the_window(spark):
    rng = np.random.default_rng(8)
    text = "".join(rng.choice(list("ACGT"), 6000))
    position = [i for i, b in enumerate(text) if b == "A" and i + 7 < len(text)]
    high = [text[i + 7] == "G" for i in position]
    rows = [("c", "6mA", i, "+", h, 0.8 + 0.05 * (i % 4) if h else 0.02 + 0.01 * (i % 3), 0.99 if h else 0.001) for i, h in zip(position, high, strict=True)]
    records = spark.createDataFrame(rows, "contig_id string, mod_type string, position long, strand string, high boolean, x double, r double")
    groups = records.limit(1).select("contig_id", "mod_type", F.lit(float(len(rows))).alias("n_records"))
    seq = spark.createDataFrame([("c", text)], "contig_id string, seq string")
    found = search.search_rounds(records, seq, groups, search.MixtureSearch, search.MixtureOptions(max_rounds=20)).collect()
    assert any(len(r.motif_seq) > r.mod_position + 7 and r.motif_seq[r.mod_position + 7] == "G" for r in found)


def test_rounds_start_no_more_tasks_than_there_are_chunks(spark, monkeypatch):
    seq, recs, n = _planted(spark, n=3000)
    kept, tasks = search.checkpointed, []

    def noted(df):
        written = kept(df)
        if "state" in written.columns:
            tasks.append(written.rdd.getNumPartitions())
        return written

    monkeypatch.setattr(search, "checkpointed", noted)
    options = search.CountOptions(max_rounds=1, min_score=0.4)
    for chunk in (1600, search.CHUNK):
        search.discover_by_counts(recs, seq, options, chunk=chunk, ahead=16).collect()
    assert max(tasks) <= 4  # 4 shuffle partitions; one contig of a few chunks


def test_windows_without_weight_are_let_go():
    windows = search.Windows(_codes("GATC" * 50), np.arange(1, 200, 4), np.zeros(50, bool), 1, 1, np.ones((50, 1)))
    windows.without("GA.", slice(0, 1))
    assert len(windows.weights) == 0 and not windows.tally(".A.", 3).any()


def test_searches_read_their_records_once(spark):
    seq, recs, n = _planted(spark)
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    for search_of in (search.discover_by_counts, search.discover_by_mixture):
        before = read.value
        assert search_of(recs.mapInArrow(counted, recs.schema), seq).count() > 0
        assert read.value - before == recs.count()


def _small_groups(kind, options, n_groups=12):
    rng = np.random.default_rng(11)
    for g in range(n_groups):
        text = "".join(rng.choice(list("ACGT") + ["N"] * (g == 3), 150 + 40 * g))
        at = np.array([i for i, b in enumerate(text) if b == "A"])
        high = np.array([text[i + 1 : i + 3] in ("CT", "GA"[: g % 3]) for i in at])
        x, r = np.where(high, 0.8, 0.05) + rng.integers(0, 8, len(at)) / 64, np.where(high, 0.96875, 0.0078125)
        one = np.ones(len(at))
        weights = np.stack([one, high, high, ~high] if kind is search.CountSearch else [high, one, one, r, r * x, r * x * x], axis=1).astype(float)
        flank = options.flank
        yield kind("6mA", options, len(at)), search.Windows(_codes(text), at, rng.random(len(at)) < 0.2, flank, options.width - flank - 1, weights)


def test_groups_step_side_by_side_as_each_alone(monkeypatch):
    for kind, options in (
        (search.CountSearch, search.CountOptions(flank=4, max_rounds=4, min_score=0.05)),
        (search.MixtureSearch, search.MixtureOptions(max_rounds=12, max_low_score=1, min_records=20)),
    ):
        alone, steps = [], []
        for one, windows in _small_groups(kind, options):
            gone = 0
            steps.append(0)
            while one.open:
                for motif in one.removed[gone:]:
                    windows.without(motif, kind.REMOVABLE)
                gone = len(one.removed)
                wanted = one.wanted(1)
                one.feed({m: windows.tally(m, one.n_offsets(1)) for m in wanted})
                steps[-1] += 1
            alone.append((one.found, one.removed))
        calls, scored = [], kind.expand_all
        monkeypatch.setattr(kind, "expand_all", staticmethod(lambda *a, calls=calls, scored=scored: calls.append(1) or scored(*a)))
        for large in (search._LARGE, 100):  # all groups small, some of them large
            monkeypatch.setattr(search, "_LARGE", large)
            searches, windows = map(list, zip(*_small_groups(kind, options), strict=True))
            calls.clear()
            search.stepped(searches, windows, 5_000)
            assert [(s.found, s.removed) for s in searches] == alone and any(f for f, _ in alone)
            assert not any(s.open for s in searches)
            assert len(calls) <= max(steps) < sum(steps) / 3  # calls as many as the longest search has steps


@pytest.mark.parametrize("most", [3, 2])  # 2: flags, whose bits are counted
def test_tallies_side_by_side_look_only_where_a_motif_asks(monkeypatch, most):
    rng = np.random.default_rng(13)
    monkeypatch.setattr(search, "_SORTED", 500)  # the last group is put in order
    groups = []
    for n in (1, 64, 65, 700):  # windows cut by both ends among them
        text = "".join(rng.choice(list("ACGTN"), n))
        at = np.arange(n)
        groups.append(search.Windows(_codes(text), at, rng.random(n) < 0.3, 4, 4, rng.integers(0, most, (n, 2)).astype(float)))
    motifs = ["....A....", "..GN.....", "A..NN...T", "...CNNNNG", "GNNNNNNNN", ".NNNAY...", "RNTNAN..."]
    motifs = [m if "." not in m.strip(".") else m[: len(m) - len(m.lstrip("."))] + m.strip(".").replace(".", "N") + "." * (len(m) - len(m.rstrip("."))) for m in motifs]
    want = {(g, m): w.tally(m, 9) for g, w in enumerate(groups) for m in motifs}
    flock = search.Flock(groups, 9)
    asked = []
    monkeypatch.setattr(search.Flock, "_set", staticmethod(lambda words, kept=search.Flock._set: asked.append(len(words)) or kept(words)))
    for m in motifs:
        for some in ([0, 1, 2, 3], [3], [2], [0, 2]):
            asked.clear()
            for g, got in zip(some, flock.tallies(some, [m] * len(some), [9] * len(some)), strict=True):
                assert np.array_equal(got, want[g, m])
            assert sum(asked) <= (1 + len(m.replace(".", ""))) * sum(flock.n_words[some])  # words of 64 windows
    for w in groups:
        w.without("....A....", slice(0, 2))
    for g in range(4):
        flock.without_of(g, "....A....", slice(0, 2))
    for m in motifs:
        for got, w in zip(flock.tallies([0, 1, 2, 3], [m] * 4, [9] * 4), groups, strict=True):
            assert np.array_equal(got, w.tally(m, 9))


def test_small_mixture_groups_sum_only_what_has_records_enough(monkeypatch):
    options = search.MixtureOptions(max_rounds=12, max_low_score=1, min_records=20)
    summed, tallied = [], []
    kept, tallies = search.BitFlock.grown, search.Flock.tallies
    monkeypatch.setattr(search.BitFlock, "grown", lambda self, *a: summed.append(kept(self, *a)) or summed[-1])
    monkeypatch.setattr(search.Flock, "tallies", lambda self, *a: tallied.append(a) or tallies(self, *a))
    searches, windows = map(list, zip(*_small_groups(search.MixtureSearch, options), strict=True))
    search.stepped(searches, windows, 5_000)
    assert summed and not tallied and min(sums[:, 0].min(initial=99) for *_, sums in summed) >= options.min_motif_records


def test_motifs_that_grow_no_further_leave_the_queue_in_order():
    one = search.MixtureSearch("6mA", search.MixtureOptions(), 100)
    one.queue = []
    one.queue_run([(-0.2, 9), (-0.5, 8), (-0.5, 7)])
    one.queue_run([(-0.3, 5)])
    search.heapq.heappush(one.queue, (-0.4, 6, one.seed))
    left = []
    while one.queue:
        left.append(one.queue[0][:2])
        assert one.wanted(1) == ([one.seed] if (-0.4, 6) not in left[:-1] else [])
        one.pop()
    assert left == [(-0.5, 7), (-0.5, 8), (-0.4, 6), (-0.3, 5), (-0.2, 9)]


def test_models_join_their_records_without_a_sort(spark):
    rows = spark.range(3000).selectExpr("concat('c', id % 40) as contig_id", "'6mA' as mod_type", "id as position", "'+' as strand", "id % 7 as n_mod", "7L as n_valid_cov")
    seeds = mixture.seed_models(rows, search.GROUP)
    hashed, sorted_ = (mixture.em_step(rows, seeds, search.GROUP, penalty=1.0, hashed=h).orderBy("contig_id") for h in (True, False))
    assert "ShuffledHashJoin" in hashed._jdf.queryExecution().sparkPlan().toString()
    for a, b in zip(hashed.collect(), sorted_.collect(), strict=True):
        assert a.contig_id == b.contig_id and a.n == b.n and a.loglik == pytest.approx(b.loglik) and a.alpha == pytest.approx(b.alpha)
