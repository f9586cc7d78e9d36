"""File sinks: BED, annotated records, summaries and motif tables. Existing output is never overwritten."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame

from methyloom.operators.clean import bed_fields

# The columns of the summary and of annotated records, as their readers expect them.
SUMMARY_COLUMNS = [
    "contig_id", "mod_type", "strand", "motifs", "n_motifs", "n_records", "n_records_below_cov", "n_records_in_motif",
    "n_records_not_in_motif", "n_mod_in_motif", "n_canonical_in_motif", "n_valid_cov_in_motif", "n_diff_in_motif",
    "n_gt_threshold_in_motif", "n_mod_not_in_motif", "n_canonical_not_in_motif", "n_valid_cov_not_in_motif",
    "n_diff_not_in_motif", "n_gt_threshold_not_in_motif",
]
ANNOTATED_COLUMNS = ["contig_id", "mod_type", "position", "strand", "n_mod", "n_canonical", "n_valid_cov", "n_diff", "in_motif", "motifs"]


# values are written as they are, blanks at their ends included
AS_IT_IS = {"sep": "\t", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "mode": "errorifexists"}


def gzip_path(path: str) -> str:
    """The path with its extension replaced by gz, unless it has that already."""
    stem, ext = os.path.splitext(path)
    return path if ext == ".gz" else f"{stem}.gz"


def write_bed(records: DataFrame, path: str, gzip: bool = False) -> None:
    """Headerless BED, sorted by contig, position, strand and modification.

    The range exchange of the sort writes one contig to as many files as its size asks for. With
    ``gzip`` the files are plain gzip: readable as a stream, without the index of blocked gzip.
    """
    rows = bed_fields(records.orderBy("contig_id", "position", "strand", "mod_type"))
    rows.write.csv(gzip_path(path) if gzip else path, header=False, compression="gzip" if gzip else "none", **AS_IT_IS)


def _write_table(df: DataFrame, path: str) -> None:
    df.write.csv(path, header=True, **AS_IT_IS)


def write_annotated(annotated: DataFrame, path: str) -> None:
    _write_table(annotated.select(*ANNOTATED_COLUMNS), path)


def write_summary(summary: DataFrame, path: str) -> None:
    _write_table(summary.select(*SUMMARY_COLUMNS), path)


def write_missing(contigs: DataFrame, path: str) -> None:
    """Contigs of records that have no sequence, and how many records each has."""
    _write_table(contigs.select("contig_id", "n_records"), path)


def write_motifs(motifs: DataFrame, path: str) -> None:
    """Motif tables of either discovery, with a header."""
    _write_table(motifs, path)
