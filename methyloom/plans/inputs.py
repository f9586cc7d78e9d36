"""The engine's inputs over the given tables, and the same as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.functions import iupac
from methyloom.functions.modcodes import canonical_mod_type
from methyloom.operators import annotate as ann
from methyloom.operators.clean import COLUMNS, last_wins
from methyloom.session import table


def raw_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete records of the largest table, repeated keys included, with their order."""
    records = table(spark, sf_dir, "annotated_records_multiple")
    typed = records.withColumn("mod_type", canonical_mod_type(F.col("mod_type")))
    return typed.select(*COLUMNS, "loaded_at", "rec_id").dropna(subset=COLUMNS)


def order() -> list:
    return [F.col("loaded_at"), F.col("rec_id")]


def pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One record per key: the one loaded last."""
    return last_wins(raw_pileup(spark, sf_dir), order())


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.latest_sequences(table(spark, sf_dir, "contigs"))


def contig_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.contig_motifs(table(spark, sf_dir, "contig_bin"), table(spark, sf_dir, "bin_motifs"))


_CANON = "case mod_type when 'a' then '6mA' when 'm' then '5mC' when '21839' then '4mC' when '6mA' then '6mA' when '5mC' then '5mC' when '4mC' then '4mC' end"
_NOT_NULL = " and ".join(f"{c} is not null" for c in COLUMNS)

RAW = f"""raw as (select * from (select contig_id, position, strand, {_CANON} as mod_type, n_mod, n_valid_cov, n_canonical, n_diff, loaded_at, rec_id
  from annotated_records_multiple) where {_NOT_NULL})"""


def dedupe(source: str, name: str) -> str:
    return f"""{name} as (select {', '.join(COLUMNS)} from (select *, row_number() over (partition by contig_id, position, strand, mod_type
  order by loaded_at desc, rec_id desc) as r from {source}) where r = 1)"""


PILEUP = f"{RAW}, {dedupe('raw', 'pileup')}"

SEQS = """seqs as (select contig_id, seq from (select contig_id, seq, row_number() over (partition by contig_id order by loaded_at desc, seq desc) as r
  from contigs where contig_id is not null and seq is not null) where r = 1)"""

_REGEX = "m.motif_seq"
for _code, _bases in iupac.BASES.items():
    if 1 < len(_bases) < 4:
        _REGEX = f"replace({_REGEX}, '{_code}', '[{_bases}]')"
_REGEX = f"replace({_REGEX}, 'N', '.')"


def regex_sql(column: str) -> str:
    return _REGEX.replace("m.motif_seq", column)


def rc_sql(column: str) -> str:
    return f"reverse(translate({column}, '{iupac.COMPLEMENT_FROM}', '{iupac.COMPLEMENT_TO}'))"


BIN_MOTIFS = f"""bin_motif_set as (select distinct bin, motif_seq, mod_type, mod_position from (
    select bin, motif as motif_seq, {_CANON} as mod_type, mod_position from bin_motifs union all
    select bin, motif_complement, {_CANON}, mod_position_complement from bin_motifs)
  where bin is not null and regexp_full_match(motif_seq, '[ACGTRYSWKMBDHVN]+') and mod_position >= 0 and mod_position < length(motif_seq)
    and substr(motif_seq, mod_position + 1, 1) = case mod_type when '6mA' then 'A' when '5mC' then 'C' when '4mC' then 'C' end)"""

MOTIFS = f"""{BIN_MOTIFS}, contig_motifs as (select distinct c.contig as contig_id, m.motif_seq, m.mod_type, m.mod_position
  from contig_bin c join bin_motif_set m on c.bin = m.bin where c.contig is not null)"""

STRANDS = f"""stranded as (select *, '+' as strand, motif_seq as pattern, mod_position as anchor from contig_motifs union all
  select *, '-', {rc_sql('motif_seq')}, length(motif_seq) - 1 - mod_position from contig_motifs)"""

# non-overlapping matches: the pieces between them, their lengths summed up
OCC = f"""pieces as (select p.*, unnest(regexp_split_to_array(s.seq, {regex_sql('p.pattern')})) as piece,
    generate_subscripts(regexp_split_to_array(s.seq, {regex_sql('p.pattern')}), 1) as i,
    len(regexp_split_to_array(s.seq, {regex_sql('p.pattern')})) as n from stranded p join seqs s using (contig_id)),
  occ as (select contig_id, motif_seq, mod_type, mod_position, strand, start, start + anchor as position from (
    select *, cast(sum(length(piece)) over (partition by contig_id, motif_seq, mod_type, mod_position, strand order by i) as bigint) + (i - 1) * length(pattern) as start
    from pieces) where i < n)"""

FOUND = f"{SEQS}, {MOTIFS}, {STRANDS}, {OCC}"
