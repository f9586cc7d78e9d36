"""Motifs of contigs, records annotated with motifs, and the summary per contig, modification and strand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from methyloom.functions.measures import f32, frac32
from methyloom.functions.modcodes import canonical_mod_type
from methyloom.functions.motif import is_valid_col, pretty_col
from methyloom.operators.clean import COLUMNS, KEY
from methyloom.operators.occurrences import MOTIF


def bin_motif_set(bin_motifs: DataFrame) -> DataFrame:
    """(bin, motif): forward and complement motifs of each bin that are valid, each once."""
    sides = F.explode(
        F.array(
            F.struct(F.col("motif").alias("motif_seq"), F.col("mod_position").alias("mod_position")),
            F.struct(F.col("motif_complement").alias("motif_seq"), F.col("mod_position_complement").alias("mod_position")),
        )
    ).alias("m")
    return (
        bin_motifs.where("bin is not null")
        .select("bin", canonical_mod_type(F.col("mod_type")).alias("mod_type"), sides)
        .select("bin", "m.motif_seq", "mod_type", F.col("m.mod_position").cast("int").alias("mod_position"))
        .where(is_valid_col(F.col("motif_seq"), F.col("mod_type"), F.col("mod_position")))
        .distinct()
    )


def contig_motifs(contig_bin: DataFrame, bin_motifs: DataFrame) -> DataFrame:
    """(contig_id, motif): the motifs of a contig's bins, each once."""
    bins = contig_bin.where("contig is not null and bin is not null").select(F.col("contig").alias("contig_id"), "bin").distinct()
    return bins.join(bin_motif_set(bin_motifs), "bin").select("contig_id", *MOTIF).distinct()


def unmatched_bins(contig_bin: DataFrame, bin_motifs: DataFrame) -> DataFrame:
    """Bins with motifs but without a contig."""
    return bin_motif_set(bin_motifs).select("bin").distinct().join(contig_bin.select("bin"), "bin", "left_anti")


def latest_sequences(contigs: DataFrame) -> DataFrame:
    """(contig_id, seq): the sequence loaded last; null sequences never count."""
    last = F.max_by("seq", F.struct("loaded_at", "seq")).alias("seq")
    return contigs.where("contig_id is not null and seq is not null").groupBy("contig_id").agg(last)


def contigs_without_sequence(records: DataFrame, sequences: DataFrame) -> DataFrame:
    """Contigs of records that have no sequence, with their number of records."""
    per_contig = records.groupBy("contig_id").agg(F.count("*").alias("n_records"))
    return per_contig.join(sequences.select("contig_id"), "contig_id", "left_anti")


HOT_SHARE = 1_000


def on_contigs(records: DataFrame, contigs: DataFrame, keep: bool = True) -> DataFrame:
    """Records on the given contigs, or those on no such contig.

    Contigs of at least 1/``HOT_SHARE`` of all records are at most so many, their answer is broadcast;
    records of the others, none of which is that large, meet the list by contig.
    """
    loads = records.groupBy("contig_id").agg(F.count("*").alias("n"))
    hot = loads.where(F.col("n") * HOT_SHARE >= loads.agg(F.sum("n")).scalar()).select("contig_id")
    how = "left_semi" if keep else "left_anti"
    few = F.broadcast(hot)
    heavy = records.join(F.broadcast(hot.join(contigs.select("contig_id"), "contig_id", how)), "contig_id", "left_semi")
    return heavy.unionByName(records.join(few, "contig_id", "left_anti").join(contigs.select("contig_id"), "contig_id", how))


def annotate(records: DataFrame, found: DataFrame) -> DataFrame:
    """Records with ``in_motif`` and the sorted, comma-joined pretty motifs at their position.

    Occurrences are gathered per position before the join, so no record is repeated; the join is on
    position too, so a contig that holds most records spreads over all partitions, and in the order
    of the record key, so that records which the key dedupe has placed are not moved again.
    """
    pretty = pretty_col(F.col("motif_seq"), F.col("mod_type"), F.col("mod_position"))
    at = found.groupBy(*KEY).agg(F.array_join(F.sort_array(F.collect_set(pretty)), ",").alias("motifs"))
    joined = records.join(at, KEY, "left")
    return joined.select(*COLUMNS, F.col("motifs").isNotNull().alias("in_motif"), F.coalesce("motifs", F.lit("")).alias("motifs"))


def summarise(annotated: DataFrame, min_cov: int = 5, threshold: float = 0.7) -> DataFrame:
    """The 19 columns of the summary; both strands appear for every modification of a contig."""
    covered = F.col("n_valid_cov") > min_cov
    high = F.coalesce(frac32(F.col("n_mod"), F.col("n_valid_cov")) > f32(threshold), F.lit(False))
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    total = lambda c, of, name: F.coalesce(F.sum(F.when(c, F.col(of).cast("long"))), F.lit(0)).alias(name)
    sides = []
    for name, side in (("in_motif", covered & F.col("in_motif")), ("not_in_motif", covered & ~F.col("in_motif"))):
        sides += [count(side, f"n_records_{name}")]
        sides += [total(side, of, f"{of}_{name}") for of in ("n_mod", "n_canonical", "n_valid_cov", "n_diff")]
        sides += [count(side & high, f"n_gt_threshold_{name}")]
    # motif strings per group are a small set: distinct ones meet, not one per record
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.when(covered & F.col("in_motif"), F.split("motifs", ","))))))
    keys = ["contig_id", "mod_type", "strand"]
    per_strand = annotated.groupBy(*keys).agg(listed.alias("list"), count(covered, "n_records"), count(~covered, "n_records_below_cov"), *sides)
    # a second, tiny grouping brings the two strands together; a strand without records has nulls
    values = [c for c in per_strand.columns if c not in keys]
    both = per_strand.groupBy("contig_id", "mod_type").agg(*(F.max(F.when(F.col("strand") == s, F.struct(*values))).alias(n) for n, s in (("plus", "+"), ("minus", "-"))))
    strands = F.explode(F.array(F.struct(F.lit("+").alias("strand"), F.col("plus").alias("v")), F.struct(F.lit("-").alias("strand"), F.col("minus").alias("v")))).alias("s")
    summed = both.select("contig_id", "mod_type", strands).select("contig_id", "mod_type", "s.strand", "s.v.*")
    counts = [c for c in values if c != "list"]
    return summed.select(
        *keys,
        F.coalesce(F.array_join("list", ","), F.lit("")).alias("motifs"),
        F.coalesce(F.size("list"), F.lit(0)).cast("long").alias("n_motifs"),
        *(F.coalesce(c, F.lit(0)).alias(c) for c in counts),
    )
