"""Queries of the general data-quality operators (problems 1, 2 and 4) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.operators import orphans as orph
from methyloom.operators import quarantine as quar
from methyloom.operators.tree_aggregate import State, hot_keys, tree_aggregate
from methyloom.session import checkpointed, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quar.row_errors(table(spark, sf_dir, "pileup_lines"), "line_id", "raw_line").select("line_id")


def p1_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reasons per file: what to send back to whoever delivered it."""
    lines = table(spark, sf_dir, "pileup_lines")
    errors = quar.row_errors(lines, "line_id", "raw_line")
    return (
        lines.select("line_id", "src_file")
        .join(errors, "line_id")
        .select("src_file", F.explode("reasons").alias("reason"))
        .groupBy("src_file", "reason")
        .agg(F.count("*").alias("n"))
    )


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    records, _ = quar.load_pileup(table(spark, sf_dir, "pileup_lines"))
    return records.select("line_id", *sorted(quar._RECORD))


def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda name: table(spark, sf_dir, name)
    return orph.orphans(
        [
            orph.Parents("contig", read("contigs"), "contig_id", "loaded_at", "deleted_at"),
            orph.Parents("bin", read("contig_bin"), "bin", "assigned_at", "removed_at"),
        ],
        [
            orph.References("annotated_records_multiple", "contig", read("annotated_records_multiple"), "rec_id", "contig_id", "called_at"),
            orph.References("contig_bin", "contig", read("contig_bin"), "row_id", "contig", "assigned_at"),
            orph.References("bin_motifs", "bin", read("bin_motifs"), "row_id", "bin", "found_at"),
        ],
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orphans(spark, sf_dir)


def p2_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orph.orphans_by_month(_orphans(spark, sf_dir))


def _per_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "annotated_records_multiple")
    one = F.lit(1)
    return tree_aggregate(
        records,
        ["contig_id"],
        {
            "n_records": State("count", one),
            "n_in_motif": State("count", F.when(F.col("in_motif"), one)),
            "sum_mod": State("sum", F.col("n_mod").cast("long")),
            "sum_cov": State("sum", F.col("n_valid_cov").cast("long")),
            "min_position": State("min", F.col("position")),
            "max_position": State("max", F.col("position")),
            "first_call": State("min", F.col("called_at")),
            "last_call": State("max", F.col("called_at")),
        },
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = table(spark, sf_dir, "annotated_records_multiple")
    # written once, one row per contig: the total and the comparison see the same counts
    counts = checkpointed(tree_aggregate(records, ["contig_id"], {"n_records": State("count", F.lit(1))}))
    return hot_keys(counts, "contig_id", "n_records", 50)


def p4_per_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _per_contig(spark, sf_dir)


QUERIES = {
    "p1_found": p1_found,
    "p1_errors": p1_errors,
    "p1_records": p1_records,
    "p2_found": p2_found,
    "p2_by_month": p2_by_month,
    "p4_found": p4_found,
    "p4_per_contig": p4_per_contig,
}

# A sound line as one pattern: eighteen fields, each plain or quoted; the ruled ones by their values.
_Q, _P = '"(?:[^"]|"")*"', r'(?:[^"\t][^\t]*)?'
_ANY = f"(?:{_Q}|{_P})"
_UINT = '(?:[0-9]+|"[0-9]+")'
_MOD = "(?:a|m|21839|6mA|5mC|4mC|\"(?:a|m|21839|6mA|5mC|4mC)\")"
_STRAND = r'(?:[+-]|"[+-]")'


def _line(position: str, mod: str, strand: str, n_mod: str) -> str:
    return "(?s)" + r"\t".join([_ANY, position, _ANY, mod, _ANY, strand, *[_ANY] * 5, n_mod, *[_ANY] * 6])


_SHAPE = _line(_ANY, _ANY, _ANY, _ANY)
_GROUPS = "(?s)" + r"\t".join(f"({_ANY})" if i in (0, 1, 3, 5, 9, 11, 12, 16) else _ANY for i in range(18))
_NAMES = "['contig_id', 'position', 'mod', 'strand', 'cov', 'n_mod', 'can', 'diff']"
_UNQUOTE = lambda x: f"""case when {x} like '"%' then replace(substr({x}, 2, length({x}) - 2), '""', '"') else {x} end"""
_FIELDS = f"""
  fields as (select line_id, src_file, raw_line, regexp_full_match(raw_line, '{_SHAPE}') as whole,
                    regexp_extract(raw_line, '^{_GROUPS}$', {_NAMES}) as g from pileup_lines),
  cells as (select line_id, src_file, raw_line, coalesce(whole, false) as whole,
                   {", ".join(f"{_UNQUOTE('g.' + n)} as {n}" for n in ('contig_id', 'position', 'mod', 'strand', 'cov', 'n_mod', 'can', 'diff'))} from fields),
  judged as (select *,
      not (regexp_full_match(position, '[0-9]+') and coalesce(try_cast(position as hugeint), 99999999999) <= 2147483647) as bad_position,
      not (mod in ('a', 'm', '21839', '6mA', '5mC', '4mC')) as bad_mod,
      not (strand in ('+', '-')) as bad_strand,
      not (regexp_full_match(n_mod, '[0-9]+') and coalesce(try_cast(n_mod as hugeint), 99999999999) <= 2147483647) as bad_n_mod from cells)"""
_INT = lambda x: f"try_cast({x} as integer)"
_MODS = "case mod when 'a' then '6mA' when 'm' then '5mC' when '21839' then '4mC' else mod end"

_EXISTS = """
  parents as (select 'contig' as kind, contig_id as key, loaded_at as s, deleted_at as e from contigs
              union all select 'bin', bin, assigned_at, removed_at from contig_bin),
  refs as (select 'annotated_records_multiple' as src_table, rec_id as row_id, 'contig' as kind, contig_id as key, called_at as t from annotated_records_multiple
           union all select 'contig_bin', row_id, 'contig', contig, assigned_at from contig_bin
           union all select 'bin_motifs', row_id, 'bin', bin, found_at from bin_motifs),
  misses as (select src_table, row_id, strftime(t, '%Y-%m') as ref_month from refs r where key is not null and t is not null
             and not exists (select 1 from parents p where p.kind = r.kind and p.key = r.key and p.s <= r.t and (p.e is null or p.e > r.t)))"""

_QUOTED = f"(?s){_ANY}(?:\\t{_ANY})*"

SQL = {
    "p1_errors": f"""with {_FIELDS}, reasons as (select src_file, unnest([
          case when raw_line is null then 'missing_line' end, case when not regexp_full_match(raw_line, '{_QUOTED}') then 'broken_quoting' end,
          case when not whole and regexp_full_match(raw_line, '{_QUOTED}') then 'wrong_field_count' end,
          case when whole and bad_position then 'invalid_position' end, case when whole and bad_mod then 'invalid_mod_type' end,
          case when whole and bad_strand then 'invalid_strand' end, case when whole and bad_n_mod then 'invalid_n_mod' end]) as reason from judged)
      select src_file, reason, count(*) as n from reasons where reason is not null group by 1, 2""",
    "p1_found": f"with {_FIELDS} select line_id from judged where not whole or bad_position or bad_mod or bad_strand or bad_n_mod",
    "p1_records": f"""with {_FIELDS} select line_id, contig_id, {_INT('position')} as position, strand, {_MODS} as mod_type, {_INT('n_mod')} as n_mod,
        {_INT('cov')} as n_valid_cov, {_INT('can')} as n_canonical, {_INT('diff')} as n_diff
        from judged where whole and not (bad_position or bad_mod or bad_strand or bad_n_mod)""",
    "p2_found": f"with {_EXISTS} select src_table, row_id, ref_month from misses",
    "p2_by_month": f"with {_EXISTS} select src_table, ref_month, count(*) as n_orphans from misses group by 1, 2",
    "p4_found": """select contig_id from annotated_records_multiple where contig_id is not null
        group by 1 having count(*) * 50 >= (select count(*) from annotated_records_multiple)""",
    "p4_per_contig": """select contig_id, count(*) as n_records, count(*) filter (where in_motif) as n_in_motif,
        cast(sum(n_mod) as bigint) as sum_mod, cast(sum(n_valid_cov) as bigint) as sum_cov,
        min(position) as min_position, max(position) as max_position,
        min(called_at) as first_call, max(called_at) as last_call
        from annotated_records_multiple group by 1""",
}
