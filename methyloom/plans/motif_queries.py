"""Queries over sequences and motifs: functions, occurrences, annotation, windows, models and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.functions import iupac, measures
from methyloom.functions import motif as mot
from methyloom.operators import annotate as ann
from methyloom.operators import mixture, search, windows
from methyloom.operators import occurrences as occ
from methyloom.operators.clean import last_wins
from methyloom.operators.occurrences import MOTIF
from methyloom.plans import inputs
from methyloom.plans.record_queries import F32, LEVELED, leveled
from methyloom.session import checkpointed, table, written

FLANK = 10
_R = 9


def q_iupac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every code used in the motifs of the bins: pattern, bases, complement, weights, and how often it occurs."""
    motifs = table(spark, sf_dir, "bin_motifs").where("motif is not null")
    codes = motifs.select(F.explode(F.split("motif", "")).alias("code")).where(iupac.is_iupac_col(F.col("code")))
    bases = F.create_map(*[F.lit(x) for pair in iupac.BASES.items() for x in pair])[F.col("code")]
    weights = [F.when(F.contains(bases, F.lit(b)), 1.0 / F.length(bases)).otherwise(0.0).alias(f"w_{b.lower()}") for b in "ACGT"]
    counted = codes.groupBy("code").agg(F.count("*").alias("n"))
    return counted.select("code", "n", iupac.regex_col(F.col("code")).alias("pattern"), bases.alias("bases"), iupac.complement_col(F.col("code")).alias("complement"), *weights)


def q_motif_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms of each valid motif: pattern, reverse complement, position there, names, palindrome, extensions."""
    m = ann.bin_motif_set(table(spark, sf_dir, "bin_motifs")).select(*MOTIF).distinct()
    seq, mod, pos = (F.col(c) for c in MOTIF)
    rc, rc_pos = iupac.reverse_complement_col(seq), mot.complement_position_col(seq, pos)
    return m.select(
        *MOTIF,
        iupac.regex_col(seq).alias("pattern"),
        rc.alias("rc_seq"),
        rc_pos.alias("rc_position"),
        mot.pretty_col(seq, mod, pos).alias("pretty"),
        F.concat_ws("_", seq, mod, pos.cast("string")).alias("underscored"),
        F.concat_ws("-", seq, mod, pos.cast("string")).alias("dashed"),
        ((rc == seq) & (rc_pos == pos)).alias("palindrome"),
        F.concat(F.lit("N"), seq).alias("upstream"),
        F.concat(seq, F.lit("N")).alias("downstream"),
    )


def q_motif_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each row of the bin-motifs file names a motif that can exist."""
    from methyloom.functions.modcodes import canonical_mod_type

    rows = table(spark, sf_dir, "bin_motifs")
    return rows.select("row_id", mot.is_valid_col(F.col("motif"), canonical_mod_type(F.col("mod_type")), F.col("mod_position")).alias("valid"))


def q_bin_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = ann.bin_motif_set(table(spark, sf_dir, "bin_motifs"))
    pretty = mot.pretty_col(*(F.col(c) for c in MOTIF))
    return m.groupBy("bin").agg(F.array_join(F.sort_array(F.collect_set(pretty)), ",").alias("motifs"))


def q_contig_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.contig_motifs(spark, sf_dir)


def q_unmatched_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.unmatched_bins(table(spark, sf_dir, "contig_bin"), table(spark, sf_dir, "bin_motifs"))


def q_reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = inputs.sequences(spark, sf_dir)
    return s.select("contig_id", F.length("seq").alias("n_bases"), F.md5(iupac.reverse_complement_col(F.col("seq"))).alias("rc_md5"))


def found(spark: SparkSession, sf_dir: str, overlapping: bool = False) -> DataFrame:
    return occ.occurrences(inputs.sequences(spark, sf_dir), inputs.contig_motifs(spark, sf_dir), overlapping)


def _positions(df: DataFrame, strand: str) -> DataFrame:
    return df.where(F.col("strand") == strand).groupBy("contig_id", *MOTIF).agg(F.count("*").alias("n"), F.sum("position").alias("sum_position"))


def q_motif_positions_fwd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(found(spark, sf_dir), "+")


def q_motif_positions_rev(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(found(spark, sf_dir), "-")


def q_motif_positions_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _positions(found(spark, sf_dir, overlapping=True), "+")


def annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # which contigs have a sequence is read off the table alone: one short row per contig
    known = table(spark, sf_dir, "contigs").where("contig_id is not null and seq is not null").select("contig_id").distinct()
    # before the dedupe, whose placement by key then serves the annotation too
    records = last_wins(ann.on_contigs(inputs.raw_pileup(spark, sf_dir), known), inputs.order())
    return ann.annotate(records, found(spark, sf_dir))


def q_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotated(spark, sf_dir)


def q_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.summarise(annotated(spark, sf_dir))


def q_missing_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.contigs_without_sequence(inputs.pileup(spark, sf_dir), inputs.sequences(spark, sf_dir))


def q_records_of_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = occ.records_at_forward_positions(inputs.pileup(spark, sf_dir), found(spark, sf_dir, overlapping=True))
    return hit.groupBy("contig_id", "mod_type", "strand").agg(F.count("*").alias("n"), F.sum(F.col("n_mod").cast("long")).alias("sum_mod"))


def q_records_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = occ.records_off_forward_positions(inputs.pileup(spark, sf_dir), found(spark, sf_dir, overlapping=True))
    return rest.groupBy("contig_id", "mod_type", "strand").agg(F.count("*").alias("n"), F.sum(F.col("n_mod").cast("long")).alias("sum_mod"))


def level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return occ.level_counts(leveled(spark, sf_dir), found(spark, sf_dir))


def q_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return level_counts(spark, sf_dir)


def background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.background_windows(inputs.sequences(spark, sf_dir), FLANK)


def methylated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.methylated_windows(leveled(spark, sf_dir), inputs.sequences(spark, sf_dir), FLANK)


def q_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methylated windows, counted."""
    return methylated(spark, sf_dir).groupBy("mod_type", "kmer").agg(F.count("*").alias("n"))


def q_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = background(spark, sf_dir)
    return w.groupBy("contig_id", "mod_type", "strand").agg(F.count("*").alias("n"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))


_WINDOW_MOTIF = mot.Motif("GANTC", "5mC", 4)


def _window_match(spark: SparkSession, sf_dir: str, negate: bool) -> DataFrame:
    m = _WINDOW_MOTIF
    kept = windows.matching(methylated(spark, sf_dir).where(F.col("mod_type") == m.mod_type), m.regex, len(m.sequence), m.position, FLANK, negate)
    return kept.groupBy("contig_id").agg(F.count("*").alias("n"), F.min("kmer").alias("first_kmer"), F.max("kmer").alias("last_kmer"))


def q_window_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_match(spark, sf_dir, False)


def q_window_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _window_match(spark, sf_dir, True)


def q_pssm(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = windows.pssm(methylated(spark, sf_dir), ["mod_type"], FLANK)
    return p.select("mod_type", "offset", "base", F.round("freq", _R).alias("freq"))


def q_kl(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = checkpointed(windows.pssm(methylated(spark, sf_dir), ["mod_type"], FLANK))  # a few rows, read twice
    q = windows.pssm(background(spark, sf_dir), ["mod_type"], FLANK)
    kl = windows.kl_divergence(p, q, ["mod_type"])
    bases = windows.bases_above(p, ["mod_type"], 0.25)
    return kl.join(bases, ["mod_type", "offset"]).select("mod_type", "offset", F.round("kl", _R).alias("kl"), "bases")


def _motif_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each motif of a contig, one row per record and motif."""
    at = found(spark, sf_dir, overlapping=True).where("strand = '+'").select("contig_id", *MOTIF, "position").distinct()
    return inputs.pileup(spark, sf_dir).join(at, ["contig_id", "mod_type", "position"])


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once: one row per contig and modification, which the records meet in more than one way."""
    return checkpointed(mixture.seed_models(inputs.pileup(spark, sf_dir), ["contig_id", "mod_type"]))


def q_beta_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixture.beta_moments(inputs.pileup(spark, sf_dir), ["contig_id", "mod_type"])
    return m.select("contig_id", "mod_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "variance", "alpha", "beta")))


def q_seed_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The seed fit of each contig and modification: one step at penalty 1."""
    by = ["contig_id", "mod_type"]
    fit = mixture.em_step(inputs.pileup(spark, sf_dir), _seeds(spark, sf_dir), by, penalty=1.0)
    total = F.col("alpha") + F.col("beta")
    shape = [F.round(F.col("alpha") / total, 5).alias("true_mean"), F.round(F.log(total), 2).alias("log_strength")]
    return fit.select(*by, "n", F.round("pi", 5).alias("pi"), *shape, F.round("loglik", 4).alias("loglik"))


def q_em_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step per motif of a contig at penalty 3, and its score."""
    by = ["contig_id", *MOTIF]
    # written once: the number of records of each motif decides which are fitted, and how they meet their model
    records = checkpointed(_motif_records(spark, sf_dir).select(*by, "position", "strand", "n_mod", "n_valid_cov"))
    enough = checkpointed(records.groupBy(*by).agg(F.count("*").alias("n")).where("n >= 10"))
    models = enough.join(_seeds(spark, sf_dir).drop("n"), ["contig_id", "mod_type"])
    fit = mixture.em_step(records, models, by, penalty=3.0)
    score = measures.mixture_score(F.col("pi"), F.col("alpha"), F.col("beta"))
    return fit.select(*by, "n", F.round("pi", 6).alias("pi"), F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), F.round(score, 6).alias("score"))


def q_mixture_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["contig_id", "mod_type"]
    seeds = _seeds(spark, sf_dir)
    stats = mixture.mixture_stats(seeds).select(*by, F.round("mean", 6).alias("mean"), F.round("variance", 6).alias("variance"))
    lik = mixture.log_likelihoods(inputs.pileup(spark, sf_dir), seeds, by)
    return stats.join(lik, by).select(*by, "mean", "variance", *(F.round(c, 4).alias(c) for c in ("loglik_true", "loglik_false")))


def q_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each motif of a contig against all records of its modification there."""
    counts = level_counts(spark, sf_dir)
    seeds = leveled(spark, sf_dir).groupBy("contig_id", "mod_type").agg(
        F.count(F.when(F.col("level") == "High", 1)).alias("seed_high"), F.count(F.when(F.col("level") == "Low", 1)).alias("seed_low")
    )
    args = [F.col(c) for c in ("high_count", "low_count", "seed_high", "seed_low")]
    a, b = args[0] + 1, args[1] + 1
    forms = {
        "mean": measures.beta_mean(a, b),
        "sd": measures.beta_sd(a, b),
        "ad_hoc": measures.ad_hoc_score(*args),
        "priority": measures.ad_hoc_priority(*args),
        "log_odds": measures.log_odds(*args),
        "z": measures.log_odds_z(*args),
        "improvement": measures.improvement_score(measures.beta_mean(a, b), measures.beta_mean(args[2] + 1, args[3] + 1)),
    }
    return counts.join(seeds, ["contig_id", "mod_type"]).select("contig_id", *MOTIF, "high_count", "low_count", *(F.round(v, 6).alias(n) for n, v in forms.items()))


def q_search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.discover_by_counts(inputs.pileup(spark, sf_dir), inputs.sequences(spark, sf_dir))


def q_search_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.discover_by_mixture(inputs.pileup(spark, sf_dir), inputs.sequences(spark, sf_dir))


def q_search_count_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contig and modification with a methylated window: motifs whose counts in the search are not those of a join with their occurrences."""
    o, by = search.CountOptions(), ["contig_id", *MOTIF]
    levels = written(leveled(spark, sf_dir, o.levels), "levels")
    sequences = inputs.sequences(spark, sf_dir)
    found = checkpointed(search.found_by_counts(levels, sequences, o))
    counted = occ.level_counts(levels, occ.occurrences(sequences, found, overlapping=True).where("strand = '+'"))
    same = (F.col("high") == F.coalesce("high_count", F.lit(0))) & (F.col("low") == F.coalesce("low_count", F.lit(0))) & (F.col("score") > o.min_score)
    wrong = found.join(counted, by, "left").groupBy(*search.GROUP).agg(F.count(F.when(~same, 1)).alias("n"))
    groups = search.with_whole_window(levels.where("strand = '+'"), sequences, F.col("level") == "High", o.flank)
    return groups.join(wrong, search.GROUP, "left").select(*search.GROUP, F.coalesce("n", F.lit(0)).alias("n_wrong"))


def q_search_mixture_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per contig and modification: motifs that lie on fewer records than asked for, or whose score is not that of their fit."""
    o, by = search.MixtureOptions(), ["contig_id", *MOTIF]
    own = inputs.pileup(spark, sf_dir).select(*search.GROUP, "position", "strand", "n_mod", "n_valid_cov")
    records, sequences = written(own, "records"), inputs.sequences(spark, sf_dir)
    found = checkpointed(search.found_by_mixture(records, sequences, o).withColumnsRenamed({"motif_mod_type": "mod_type", "motif_mod_position": "mod_position"}))
    hits = records.join(occ.occurrences(sequences, found, overlapping=True).where("strand = '+'").select(*by, "position"), ["contig_id", "mod_type", "position"])
    enough = hits.groupBy(*by).agg(F.count("*").alias("n"))
    mean = measures.beta_mean(F.col("true_alpha"), F.col("true_beta"))
    same = (F.abs(F.col("score") - F.col("pi") * mean) < 1e-6) & (F.col("score") > o.min_score) & (F.coalesce("n", F.lit(0)) >= o.min_motif_records)
    wrong = found.join(enough, by, "left").groupBy("contig_id", "mod_type").agg(F.count("*").alias("n_found"), F.count(F.when(~same, 1)).alias("n_wrong"))
    groups = records.groupBy("contig_id", "mod_type").agg(F.count("*").alias("n")).where(F.col("n") >= o.min_records)
    joined = wrong.withColumn("found", F.lit(True)).join(groups, ["contig_id", "mod_type"], "full")
    # a motif in a group without enough records would be wrong too
    return joined.select("contig_id", "mod_type", (F.coalesce("n_wrong", F.lit(0)) + F.when(F.col("n").isNull(), 1).otherwise(0)).alias("n_wrong"))


def q_single_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plus-strand records of each motif of a contig, scored from the seed of single motifs."""
    by = ["contig_id", *MOTIF]
    records = checkpointed(_motif_records(spark, sf_dir).select(*by, "position", "strand", "n_mod", "n_valid_cov"))
    fit = mixture.score_single_motifs(records, by)
    return fit.select(*by, "n", F.round("pi", 5).alias("pi"), F.round(F.col("alpha") / (F.col("alpha") + F.col("beta")), 5).alias("true_mean"), F.round("loglik", 4).alias("loglik"))


QUERIES = {
    f.__name__: f
    for f in (
        q_iupac, q_motif_forms, q_motif_valid, q_bin_motifs, q_contig_motifs, q_unmatched_bins, q_reverse_complement,
        q_motif_positions_fwd, q_motif_positions_rev, q_motif_positions_overlap, q_annotate, q_summary, q_missing_sequences,
        q_records_of_motifs, q_records_removed, q_level_counts, q_windows, q_background, q_window_match, q_window_exclude,
        q_pssm, q_kl, q_beta_moments, q_seed_models, q_em_step, q_mixture_stats, q_scores,
        q_search_count, q_search_mixture, q_search_count_check, q_search_mixture_check, q_single_motifs,
    )
}

# ---------------------------------------------------------------- SQL

_PRETTY = "substr(motif_seq, 1, mod_position) || mod_type || substr(motif_seq, mod_position + 2)"
_BASES_CASE = "case code " + " ".join(f"when '{c}' then '{b}'" for c, b in iupac.BASES.items()) + " end"
_BY_MOTIF = "contig_id, motif_seq, mod_type, mod_position"
_OVERLAP = f"""{inputs.SEQS}, {inputs.MOTIFS}, {inputs.STRANDS},
  over as (select contig_id, motif_seq, mod_type, mod_position, strand, i as start, i + anchor as position from (
    select p.*, s.seq, unnest(range(0, length(s.seq) - length(p.pattern) + 1)) as i from stranded p join seqs s using (contig_id))
    where regexp_full_match(substr(seq, i + 1, length(pattern)), {inputs.regex_sql('pattern')}))"""
_ANNOTATED = f"""{inputs.PILEUP}, {inputs.FOUND},
  spots as (select contig_id, strand, position, mod_type, string_agg(distinct {_PRETTY}, ',' order by {_PRETTY}) as motifs from occ group by 1, 2, 3, 4),
  annotated as (select p.*, a.motifs is not null as in_motif, coalesce(a.motifs, '') as motifs from pileup p
    left join spots a using (contig_id, strand, position, mod_type) where exists (select 1 from seqs s where s.contig_id = p.contig_id))"""
_W = 2 * FLANK + 1
_WINDOWS = f"""{inputs.PILEUP}, {inputs.SEQS}, {LEVELED},
  methylated as (select contig_id, mod_type, strand, position, case when strand = '-' then {inputs.rc_sql('k')} else k end as kmer from (
    select l.*, substr(s.seq, position - {FLANK} + 1, {_W}) as k from leveled l join seqs s using (contig_id)
    where level = 'High' and position >= {FLANK} and position + {FLANK} < length(s.seq)))"""
_BACKGROUND = f"""centers as (select contig_id, position, substr(seq, position - {FLANK} + 1, {_W}) as k from (
    select contig_id, seq, unnest(range({FLANK}, length(seq) - {FLANK})) as position from seqs)),
  background as (select contig_id, m.mod_type, m.strand, position, case when m.strand = '-' then {inputs.rc_sql('k')} else k end as kmer
    from centers join (values ('A', '6mA', '+'), ('T', '6mA', '-'), ('C', '5mC', '+'), ('G', '5mC', '-'), ('C', '4mC', '+'), ('G', '4mC', '-')) m(base, mod_type, strand)
    on substr(k, {FLANK + 1}, 1) = m.base)"""
_PSSM = lambda source, name: f"""{name} as (select mod_type, o as "offset", b as base, cast(count(*) filter (substr(kmer, o + 1, 1) = b) as double) / count(*) as freq
    from {source}, (select cast(unnest(range(0, {_W})) as integer) as o), (select unnest(['A', 'C', 'G', 'T']) as b) group by 1, 2, 3)"""  # noqa: E731
_X = "cast(n_mod as double) / n_valid_cov"
_MOMENTS = f"""stats as (select contig_id, mod_type, count(*) as n, avg({_X}) as mean, var_pop({_X}) as variance from pileup where n_valid_cov > 0 group by 1, 2),
  moments as (select *, mean * c as alpha, (1 - mean) * c as beta from (select *, case when variance >= 1e-12 then mean * (1 - mean) / variance - 1 end as c from stats)),
  seeds as (select contig_id, mod_type, 0.01::double as pi, 10.0::double as ta, 1.0::double as tb, alpha as fa, greatest(beta, 1.1::double) as fb from moments where alpha > 1e-9)"""
_LB = lambda a, b: f"(lgamma({a}) + lgamma({b}) - lgamma({a} + {b}))"
_PDF = lambda a, b: f"(({a} - 1) * ln(x) + ({b} - 1) * ln(1 - x) - {_LB(a, b)})"
_EM = lambda by, penalty: f"""terms as (select *, ln(pi) + {_PDF('ta', 'tb')} as lt, ln(1 - pi) + {_PDF('fa', 'fb')} + ln({penalty}) as lf from observed),
  resp as (select *, greatest(lt, lf) + ln(exp(lt - greatest(lt, lf)) + exp(lf - greatest(lt, lf))) as ll from terms),
  sums as (select {by}, count(*) as n, avg(exp(lt - ll)) as pi, sum(exp(lt - ll)) as w, sum(exp(lt - ll) * x) as wx, sum(exp(lt - ll) * x * x) as wxx, sum(ll) as loglik from resp group by {by}),
  mv as (select *, wx / w as mu, greatest(wxx / w - (wx / w) * (wx / w), 0) as var from sums where w > 0),
  fit as (select *, case when c > 0 then mu * c end as alpha, case when c > 0 then (1 - mu) * c end as beta
    from (select *, case when var >= 1e-12 then mu * (1 - mu) / var - 1 end as c from mv))"""  # noqa: E731
_CLAMPED = lambda e: f"least(greatest({_X}, {e}), 1 - {e})"
_MEAN = lambda a, b: f"({a} / ({a} + {b}))"
_VAR = lambda a, b: f"({a} * {b} / (({a} + {b}) * ({a} + {b}) * ({a} + {b} + 1)))"
_COUNTS = f"""{inputs.PILEUP}, {LEVELED}, {inputs.FOUND},
  counts as (select {', '.join('o.' + c.strip() for c in _BY_MOTIF.split(','))}, count(*) filter (level = 'Low') as low_count, count(*) filter (level = 'Middle') as middle_count,
    count(*) filter (level = 'High') as high_count from occ o join leveled l using (contig_id, mod_type, strand, position) group by 1, 2, 3, 4)"""
_SIDE = lambda name, cond: f"""count(*) filter ({cond}) as n_records_{name},
    {', '.join(f"cast(coalesce(sum({c}) filter ({cond}), 0) as bigint) as {c}_{name}" for c in ('n_mod', 'n_canonical', 'n_valid_cov', 'n_diff'))},
    count(*) filter ({cond} and {F32} > cast(0.7 as float)) as n_gt_threshold_{name}"""  # noqa: E731
_SUMMED = ["n_records", "n_records_below_cov"] + [
    f"{c}_{side}" for side in ("in_motif", "not_in_motif") for c in ("n_records", "n_mod", "n_canonical", "n_valid_cov", "n_diff", "n_gt_threshold")
]

SQL = {
    "q_iupac": f"""with codes as (select unnest(string_split(motif, '')) as code from bin_motifs where motif is not null),
        counted as (select code, count(*) as n, {_BASES_CASE} as bases from codes where {_BASES_CASE} is not null group by 1)
      select code, n, case when length(bases) = 1 then code when length(bases) = 4 then '.' else '[' || bases || ']' end as pattern, bases,
        translate(code, '{iupac.COMPLEMENT_FROM}', '{iupac.COMPLEMENT_TO}') as complement,
        {', '.join(f"case when contains(bases, '{b}') then cast(1 as double) / length(bases) else 0 end as w_{b.lower()}" for b in 'ACGT')} from counted""",
    "q_motif_forms": f"""with {inputs.BIN_MOTIFS}, m as (select distinct motif_seq, mod_type, mod_position from bin_motif_set)
      select *, {inputs.regex_sql('motif_seq')} as pattern, {inputs.rc_sql('motif_seq')} as rc_seq, cast(length(motif_seq) - 1 - mod_position as integer) as rc_position,
        {_PRETTY} as pretty, motif_seq || '_' || mod_type || '_' || mod_position as underscored, motif_seq || '-' || mod_type || '-' || mod_position as dashed,
        {inputs.rc_sql('motif_seq')} = motif_seq and length(motif_seq) - 1 - mod_position = mod_position as palindrome, 'N' || motif_seq as upstream, motif_seq || 'N' as downstream from m""",
    "q_motif_valid": f"""select row_id, coalesce(regexp_full_match(motif, '[ACGTRYSWKMBDHVN]+') and mod_position >= 0 and mod_position < length(motif)
        and substr(motif, mod_position + 1, 1) = case {inputs._CANON} when '6mA' then 'A' when '5mC' then 'C' when '4mC' then 'C' end, false) as valid from bin_motifs""",
    "q_bin_motifs": f"with {inputs.BIN_MOTIFS} select bin, string_agg(distinct {_PRETTY}, ',' order by {_PRETTY}) as motifs from bin_motif_set group by 1",
    "q_contig_motifs": f"with {inputs.MOTIFS} select * from contig_motifs",
    "q_unmatched_bins": f"with {inputs.BIN_MOTIFS} select distinct bin from bin_motif_set b where not exists (select 1 from contig_bin c where c.bin = b.bin)",
    "q_reverse_complement": f"with {inputs.SEQS} select contig_id, cast(length(seq) as integer) as n_bases, md5({inputs.rc_sql('seq')}) as rc_md5 from seqs",
    **{
        f"q_motif_positions_{name}": f"with {inputs.FOUND} select {_BY_MOTIF}, count(*) as n, cast(sum(position) as bigint) as sum_position from occ where strand = '{s}' group by 1, 2, 3, 4"
        for name, s in (("fwd", "+"), ("rev", "-"))
    },
    "q_motif_positions_overlap": f"with {_OVERLAP} select {_BY_MOTIF}, count(*) as n, cast(sum(position) as bigint) as sum_position from over where strand = '+' group by 1, 2, 3, 4",
    "q_annotate": f"with {_ANNOTATED} select * from annotated",
    "q_summary": f"""with {_ANNOTATED},
      words as (select contig_id, mod_type, strand, string_agg(distinct m, ',' order by m) as motifs, count(distinct m) as n_motifs from (
        select contig_id, mod_type, strand, unnest(string_split(motifs, ',')) as m from annotated where in_motif and n_valid_cov > 5) group by 1, 2, 3),
      summed as (select contig_id, mod_type, strand, count(*) filter (n_valid_cov > 5) as n_records, count(*) filter (n_valid_cov <= 5) as n_records_below_cov,
        {_SIDE('in_motif', 'n_valid_cov > 5 and in_motif')}, {_SIDE('not_in_motif', 'n_valid_cov > 5 and not in_motif')} from annotated group by 1, 2, 3),
      spine as (select contig_id, mod_type, strand from (select distinct contig_id, mod_type from summed), (values ('+'), ('-')) s(strand))
      select contig_id, mod_type, strand, coalesce(w.motifs, '') as motifs, coalesce(w.n_motifs, 0) as n_motifs, {', '.join(f'coalesce({c}, 0) as {c}' for c in _SUMMED)}
      from spine left join summed using (contig_id, mod_type, strand) left join words w using (contig_id, mod_type, strand)""",
    "q_missing_sequences": f"with {inputs.PILEUP}, {inputs.SEQS} select contig_id, count(*) as n_records from pileup p where not exists (select 1 from seqs s where s.contig_id = p.contig_id) group by 1",
    **{
        name: f"""with {inputs.PILEUP}, {_OVERLAP}, keys as (select distinct contig_id, mod_type, position from over where strand = '+')
          select contig_id, mod_type, strand, count(*) as n, cast(sum(n_mod) as bigint) as sum_mod from pileup p
          where {negate} exists (select 1 from keys k where k.contig_id = p.contig_id and k.mod_type = p.mod_type and k.position = p.position) group by 1, 2, 3"""
        for name, negate in (("q_records_of_motifs", ""), ("q_records_removed", "not"))
    },
    "q_level_counts": f"with {_COUNTS} select * from counts",
    "q_windows": f"with {_WINDOWS} select mod_type, kmer, count(*) as n from methylated group by 1, 2",
    "q_background": f"with {inputs.SEQS}, {_BACKGROUND} select contig_id, mod_type, strand, count(*) as n, min(kmer) as first_kmer, max(kmer) as last_kmer from background group by 1, 2, 3",
    **{
        name: f"""with {_WINDOWS} select contig_id, count(*) as n, min(kmer) as first_kmer, max(kmer) as last_kmer from methylated
          where mod_type = '5mC' and {negate} regexp_full_match(substr(kmer, {FLANK - _WINDOW_MOTIF.position + 1}, 5), '{_WINDOW_MOTIF.regex}') group by 1"""
        for name, negate in (("q_window_match", ""), ("q_window_exclude", "not"))
    },
    "q_pssm": f"""with {_WINDOWS}, {_PSSM('methylated', 'p')} select mod_type, "offset", base, round(freq, {_R}) as freq from p""",
    "q_kl": f"""with {_WINDOWS}, {_BACKGROUND}, {_PSSM('methylated', 'p')}, {_PSSM('background', 'q')}
      select mod_type, "offset", round(sum((p.freq + 1e-6) * ln((p.freq + 1e-6) / (q.freq + 1e-6))), {_R}) as kl,
        coalesce(string_agg(case when p.freq > 0.25 then base end, '' order by base), '') as bases
      from p join q using (mod_type, "offset", base) group by 1, 2""",
    "q_beta_moments": f"with {inputs.PILEUP}, {_MOMENTS} select contig_id, mod_type, n, {', '.join(f'round({c}, 6) as {c}' for c in ('mean', 'variance', 'alpha', 'beta'))} from moments",
    "q_seed_models": f"""with {inputs.PILEUP}, {_MOMENTS}, observed as (select *, {_CLAMPED('1e-12')} as x from pileup join seeds using (contig_id, mod_type) where n_valid_cov > 0),
      {_EM('contig_id, mod_type', 1.0)} select contig_id, mod_type, n, round(pi, 5) as pi, round(alpha / (alpha + beta), 5) as true_mean, round(ln(alpha + beta), 2) as log_strength, round(loglik, 4) as loglik from fit""",
    "q_em_step": f"""with {inputs.PILEUP}, {_MOMENTS}, {_OVERLAP},
      keys as (select distinct {_BY_MOTIF}, position from over where strand = '+'), hits as (select p.*, k.motif_seq, k.mod_position from pileup p join keys k using (contig_id, mod_type, position)),
      enough as (select {_BY_MOTIF} from hits group by 1, 2, 3, 4 having count(*) >= 10),
      observed as (select h.*, s.pi, s.ta, s.tb, s.fa, s.fb, {_CLAMPED('1e-12')} as x from hits h join enough using (contig_id, motif_seq, mod_type, mod_position) join seeds s using (contig_id, mod_type) where n_valid_cov > 0),
      {_EM(_BY_MOTIF, 3.0)} select {_BY_MOTIF}, n, round(pi, 6) as pi, round(alpha, 4) as alpha, round(beta, 4) as beta, round(pi * alpha / (alpha + beta), 6) as score from fit""",
    "q_single_motifs": f"""with {inputs.PILEUP}, {_OVERLAP},
      keys as (select distinct {_BY_MOTIF}, position from over where strand = '+'),
      hits as (select p.*, k.motif_seq, k.mod_position from pileup p join keys k using (contig_id, mod_type, position) where strand = '+'),
      enough as (select {_BY_MOTIF} from hits group by 1, 2, 3, 4 having count(*) filter (n_valid_cov > 0 and {_X} > 0.2) >= 10),
      kept as (select h.* from hits h join enough using ({_BY_MOTIF}) where n_valid_cov > 0),
      stats as (select {_BY_MOTIF}, avg({_X}) as mean, var_pop({_X}) as variance from kept group by 1, 2, 3, 4),
      moments as (select *, mean * c as a, (1 - mean) * c as b from (select *, case when variance >= 1e-12 then mean * (1 - mean) / variance - 1 end as c from stats)),
      seeds as (select {_BY_MOTIF}, 0.05::double as pi, 5.0::double as ta, 2.0::double as tb, a as fa, greatest(b, 1.1::double) as fb from moments where a > 1e-9),
      observed as (select *, {_CLAMPED('1e-12')} as x from kept join seeds using ({_BY_MOTIF})),
      {_EM(_BY_MOTIF, 2.0)} select {_BY_MOTIF}, n, round(pi, 5) as pi, round(alpha / (alpha + beta), 5) as true_mean, round(loglik, 4) as loglik from fit""",
    "q_search_count_check": f"""with {inputs.PILEUP}, {inputs.SEQS}, high as (select p.*, length(s.seq) as n_bases from pileup p join seqs s using (contig_id)
        where strand = '+' and n_valid_cov > 0 and {F32} >= cast({search.CountOptions().levels.high} as float))
      select distinct contig_id, mod_type, cast(0 as bigint) as n_wrong from high where position >= 10 and position + 10 < n_bases""",
    "q_search_mixture_check": f"""with {inputs.PILEUP} select contig_id, mod_type, cast(0 as bigint) as n_wrong from pileup group by 1, 2 having count(*) >= 50""",
    "q_mixture_stats": f"""with {inputs.PILEUP}, {_MOMENTS},
      mixed as (select *, pi * {_MEAN('ta', 'tb')} + (1 - pi) * {_MEAN('fa', 'fb')} as mean,
        pi * ({_VAR('ta', 'tb')} + {_MEAN('ta', 'tb')} * {_MEAN('ta', 'tb')}) + (1 - pi) * ({_VAR('fa', 'fb')} + {_MEAN('fa', 'fb')} * {_MEAN('fa', 'fb')}) as second from seeds),
      lik as (select contig_id, mod_type, sum({_PDF('ta', 'tb')}) as loglik_true, sum({_PDF('fa', 'fb')}) as loglik_false
        from (select *, {_CLAMPED('1e-6')} as x from pileup join seeds using (contig_id, mod_type) where n_valid_cov > 0) group by 1, 2)
      select contig_id, mod_type, round(mean, 6) as mean, round(second - mean * mean, 6) as variance, round(loglik_true, 4) as loglik_true, round(loglik_false, 4) as loglik_false
      from mixed join lik using (contig_id, mod_type)""",
    "q_scores": f"""with {_COUNTS}, seed as (select contig_id, mod_type, count(*) filter (level = 'High') as sh, count(*) filter (level = 'Low') as sl from leveled group by 1, 2),
      a as (select *, high_count + 1.0::double as a, low_count + 1.0::double as b, sh + 1.0::double as c, sl + 1.0::double as d from counts join seed using (contig_id, mod_type)),
      v as (select *, {_MEAN('a', 'b')} as mean, sqrt({_VAR('a', 'b')}) as sd, {_MEAN('c', 'd')} as pm, sqrt({_VAR('c', 'd')}) as psd, ln((a / c) / (b / d)) as lo from a)
      select {_BY_MOTIF}, high_count, low_count, round(mean, 6) as mean, round(sd, 6) as sd, round(mean * -log10((sd + psd) / 2) * (mean - pm), 6) as ad_hoc,
        round((1 - a / b) / (c / d), 6) as priority, round(lo, 6) as log_odds, round(lo / sqrt(1 / a + 1 / b + 1 / c + 1 / d), 6) as z,
        round(mean * (mean - pm), 6) as improvement from v""",
}
