"""The programs: preprocess, motif summary and the two discoveries, from files to files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.operators import annotate as ann
from methyloom.operators import search
from methyloom.operators.clean import COUNTS, CleanOptions, clean, last_wins
from methyloom.operators.occurrences import occurrences
from methyloom.session import checkpointed
from methyloom.sinks import files as sinks
from methyloom.sources import files as sources


def file_order(records: DataFrame) -> DataFrame:
    """Records with the place they have in their files, for last-wins keys."""
    return records.withColumn("__file", F.input_file_name()).withColumn("__row", F.monotonically_increasing_id())


def _order() -> list:
    return [F.col("__file"), F.col("__row"), *(F.col(c) for c in COUNTS)]


def preprocess(spark: SparkSession, pileup: str, out: str | None = None, options: CleanOptions = CleanOptions(), gzip: bool = False) -> DataFrame:
    """Cleaned records of a pileup file, written as BED if ``out`` is given."""
    cleaned = clean(file_order(sources.read_pileup(spark, pileup, options.scan_min_cov)), _order(), options)
    if out:
        sinks.write_bed(cleaned, out, gzip)
    return cleaned


def contig_pileup(spark: SparkSession, pileup: str, contig: str, options: CleanOptions = CleanOptions()) -> DataFrame:
    """Cleaned records of one contig; ``toPandas().to_dict('list')`` gives them as columns."""
    return clean(file_order(sources.read_contig(spark, pileup, contig, options.scan_min_cov)), _order(), options)


def _records(spark: SparkSession, pileup: str, min_cov: int) -> DataFrame:
    return last_wins(file_order(sources.read_pileup(spark, pileup, min_cov)), _order())


def motif_summary(spark: SparkSession, fasta: str, pileup: str, bin_motifs: str, contig_bin: str, out: str | None = None, min_cov: int = 5, min_methylation: float = 0.7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotated records, summary, contigs without sequence and their records), written below ``out`` if given."""
    sequences = sources.read_fasta(spark, fasta)
    motifs = ann.contig_motifs(sources.read_contig_bin(spark, contig_bin), sources.read_bin_motifs(spark, bin_motifs))
    # written once: annotation, summary and report read the same records
    records = checkpointed(_records(spark, pileup, 0))
    missing = ann.contigs_without_sequence(records, sequences)
    annotated = checkpointed(ann.annotate(ann.on_contigs(records, sequences), occurrences(sequences, motifs)))
    summary = ann.summarise(annotated, min_cov, min_methylation)
    if out:
        sinks.write_annotated(annotated, f"{out}/annotated_records")
        sinks.write_summary(summary, f"{out}/summary")
        sinks.write_missing(missing, f"{out}/contigs_without_sequence")
    return annotated, summary, missing


def discover(spark: SparkSession, fasta: str, pileup: str, out: str | None = None, min_cov: int = 5, options=search.CountOptions()) -> DataFrame:
    """Motifs of each contig by counts or, with ``MixtureOptions``, by mixture; written below ``out`` if given."""
    sequences, records = sources.read_fasta(spark, fasta), _records(spark, pileup, min_cov)
    by = search.discover_by_mixture if isinstance(options, search.MixtureOptions) else search.discover_by_counts
    motifs = by(records, sequences, options)
    if out:
        sinks.write_motifs(motifs, f"{out}/motifs")
    return motifs
