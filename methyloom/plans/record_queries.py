"""Queries over pileup records: parsing, coverage, keys, modifications, windows, levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.functions.measures import Levels, level
from methyloom.operators import clean
from methyloom.operators import quarantine as quar
from methyloom.plans import inputs
from methyloom.plans.quality_queries import _FIELDS, _INT, _MODS, _SHAPE
from methyloom.session import table
from methyloom.streaming import arrivals

GROUP = ["contig_id", "mod_type", "strand"]
#: The window, the number of highly modified positions and their fraction; coverage as by default.
OPTIONS = clean.CleanOptions(window=8, n_high=2, fraction=0.4)


def q_scan_min_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = quar.load_pileup(table(spark, sf_dir, "pileup_lines"))
    kept = clean.min_coverage(records, 5)
    return kept.groupBy(*GROUP).agg(F.count("*").alias("n"), F.sum(F.col("n_valid_cov").cast("long")).alias("sum_cov"))


def _well_formed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sound quoting and eighteen fields, with their fields."""
    lines = quar.parsed(table(spark, sf_dir, "pileup_lines"), "raw_line", quar.PILEUP_FIELDS)
    return lines.where((F.col("__q_quoting") == "ok") & (F.col("__q_n") == quar.PILEUP_FIELDS))


def q_parse_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes as they stand in well-formed lines, what they mean, and how often; null where they mean nothing."""
    from methyloom.functions.modcodes import canonical_mod_type

    code, strand = (F.get("__q_fields", F.lit(i)) for i in (3, 5))
    rows = _well_formed(spark, sf_dir).select(code.alias("code"), F.when(strand.isin("+", "-"), strand).alias("strand"))
    return rows.groupBy("code", canonical_mod_type(F.col("code")).alias("mod_type"), "strand").agg(F.count("*").alias("n"))


def q_contig_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _well_formed(spark, sf_dir).select("src_file", "line_no", F.get("__q_fields", F.lit(0)).alias("contig_id"))
    return clean.contig_runs(lines.dropDuplicates(["src_file", "line_no", "contig_id"]), "src_file", "line_no")


def q_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and misshapen lines per file and day of arrival: the stream's aggregate over all that has arrived."""
    counted = arrivals.arrivals_per_window(table(spark, sf_dir, "pileup_lines"))
    return counted.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "src_file", "n_lines", "n_misshapen")


def q_list_contigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.raw_pileup(spark, sf_dir).select("contig_id").distinct()


def q_fraction_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.min_diff_fraction(inputs.raw_pileup(spark, sf_dir), 0.1).select("rec_id", "contig_id", "position", "n_diff", "n_valid_cov")


def q_dedupe_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.pileup(spark, sf_dir).select(*clean.COLUMNS)


def q_max_mod(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.strongest_modification(inputs.pileup(spark, sf_dir)).select(*clean.KEY, "n_mod")


def q_strict_cov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.strict_coverage(inputs.pileup(spark, sf_dir), 5).groupBy("contig_id").agg(F.count("*").alias("n"))


def q_density_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.without_dense_neighbourhoods(inputs.pileup(spark, sf_dir), 8, 2, 0.4).select(*clean.KEY)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean(inputs.raw_pileup(spark, sf_dir), inputs.order(), OPTIONS)


def q_preprocess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleaned(spark, sf_dir)


def q_bed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.bed_fields(cleaned(spark, sf_dir))


def leveled(spark: SparkSession, sf_dir: str, levels: Levels = Levels()) -> DataFrame:
    return inputs.pileup(spark, sf_dir).withColumn("level", level(F.col("n_mod"), F.col("n_valid_cov"), levels))


def q_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leveled(spark, sf_dir).groupBy(*GROUP, "level").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (q_scan_min_cov, q_parse_codes, q_contig_runs, q_arrivals, q_list_contigs, q_fraction_diff, q_dedupe_last_wins, q_max_mod, q_strict_cov, q_density_window, q_preprocess, q_bed_fields, q_levels)}

F32 = "cast(n_mod as float) / cast(n_valid_cov as float)"
_COLS = ", ".join(clean.COLUMNS)
_DENSE = lambda source, name: f"""{name}_c as (select *, sum(case when n_valid_cov > 0 and {F32} > cast(0.4 as float) then 1 else 0 end) over w as c from {source}
    window w as (partition by contig_id, mod_type, strand order by position range between 8 preceding and 8 following)),
  {name}_d as (select *, max(case when c >= 2 then 1 else 0 end) over w as dense from {name}_c
    window w as (partition by contig_id, mod_type, strand order by position range between 8 preceding and 8 following)),
  {name} as (select {_COLS} from {name}_d where dense = 0)"""  # noqa: E731
LEVELED = f"""leveled as (select *, case when n_mod = 0 or n_valid_cov = 0 then 'Low' when {F32} >= cast(0.7 as float) then 'High'
    when {F32} >= cast(0.2 as float) then 'Middle' else 'Low' end as level from pileup)"""
CLEAN = f"""{inputs.RAW}, scanned as (select * from raw where n_valid_cov >= 5), {inputs.dedupe('scanned', 'keyed')},
  strong as (select {_COLS} from (select *, max(n_mod) over (partition by contig_id, position, strand) as top from keyed) where n_mod = top),
  covered as (select * from strong where n_valid_cov > 5), {_DENSE('covered', 'cleaned')}"""

SQL = {
    "q_scan_min_cov": f"""with {_FIELDS}, records as (select contig_id, strand, {_MODS} as mod_type, {_INT('cov')} as n_valid_cov from judged
        where whole and not (bad_position or bad_mod or bad_strand or bad_n_mod))
      select contig_id, mod_type, strand, count(*) as n, cast(sum(n_valid_cov) as bigint) as sum_cov from records where n_valid_cov >= 5 group by 1, 2, 3""",
    "q_parse_codes": f"""with {_FIELDS}, coded as (select mod as code, mod as mod_type, case when strand in ('+', '-') then strand end as strand from judged where whole)
      select code, {inputs._CANON} as mod_type, strand, count(*) as n from coded group by 1, 2, 3""",
    "q_contig_runs": f"""with {_FIELDS}, lines as (select distinct src_file, line_no, contig_id from judged join pileup_lines using (line_id, src_file) where whole),
        marked as (select *, case when row_number() over w = 1 or contig_id is distinct from lag(contig_id) over w then 1 else 0 end as s from lines
          window w as (partition by src_file order by line_no)),
        runs as (select *, cast(sum(s) over (partition by src_file order by line_no) as bigint) as run from marked)
      select src_file, run, contig_id, min(line_no) as first_line, max(line_no) as last_line, count(*) as n_records from runs group by 1, 2, 3""",
    "q_arrivals": f"""select strftime(received_at, '%Y-%m-%d') as day, src_file, count(*) as n_lines,
      count(*) filter (not regexp_full_match(raw_line, '{_SHAPE}')) as n_misshapen from pileup_lines group by 1, 2""",
    "q_list_contigs": f"with {inputs.RAW} select distinct contig_id from raw",
    "q_fraction_diff": f"""with {inputs.RAW} select rec_id, contig_id, position, n_diff, n_valid_cov from raw
      where n_valid_cov > 0 and cast(n_diff as float) / cast(n_diff + n_valid_cov as float) >= cast(0.1 as float)""",
    "q_dedupe_last_wins": f"with {inputs.PILEUP} select {_COLS} from pileup",
    "q_max_mod": f"""with {inputs.PILEUP} select contig_id, position, strand, mod_type, n_mod from
      (select *, max(n_mod) over (partition by contig_id, position, strand) as top from pileup) where n_mod = top""",
    "q_strict_cov": f"with {inputs.PILEUP} select contig_id, count(*) as n from pileup where n_valid_cov > 5 group by 1",
    "q_density_window": f"with {inputs.PILEUP}, {_DENSE('pileup', 'kept')} select contig_id, position, strand, mod_type from kept",
    "q_preprocess": f"with {CLEAN} select {_COLS} from cleaned",
    "q_bed_fields": f"""with {CLEAN} select contig_id as chrom, position as start_position, position + 1 as end_position,
        case mod_type when '6mA' then 'a' when '5mC' then 'm' else '21839' end as modified_base_code, n_valid_cov as score, strand,
        position as start_position_compat, position + 1 as end_position_compat, '255,0,0' as color, n_valid_cov as "Nvalid_cov",
        case when n_valid_cov > 0 then printf('%.1f', round_even(cast(cast(n_mod * 100 as float) / cast(n_valid_cov as float) as double), 1)) else '0.0' end as fraction_modified,
        n_mod as "Nmod", n_canonical as "Ncanonical", 'NA' as "Nother_mod", 'NA' as "Ndelete", 'NA' as "Nfail", n_diff as "Ndiff", 'NA' as "Nnocall" from cleaned""",
    "q_levels": f"with {inputs.PILEUP}, {LEVELED} select contig_id, mod_type, strand, level, count(*) as n from leveled group by 1, 2, 3, 4",
}
