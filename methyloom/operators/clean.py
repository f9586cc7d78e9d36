"""Cleaning of pileup records: coverage, last-wins keys, strongest modification, dense neighbourhoods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from methyloom.functions.measures import diff_fraction, f32, frac32, percent_text
from methyloom.functions.modcodes import mod_code

KEY = ["contig_id", "position", "strand", "mod_type"]
COUNTS = ["n_mod", "n_valid_cov", "n_canonical", "n_diff"]
COLUMNS = [*KEY, *COUNTS]


@dataclass(frozen=True)
class CleanOptions:
    """Coverage kept by the scan (>=) and by the filter (>), and the density window."""

    scan_min_cov: int = 5
    min_cov: int = 5
    window: int = 8
    n_high: int = 2
    fraction: float = 0.4


def min_coverage(df: DataFrame, c: int) -> DataFrame:
    return df.where(F.col("n_valid_cov") >= c)


def strict_coverage(df: DataFrame, c: int) -> DataFrame:
    return df.where(F.col("n_valid_cov") > c)


def min_diff_fraction(df: DataFrame, fraction: float) -> DataFrame:
    """Records with coverage whose share of differing reads is at least ``fraction``."""
    return df.where(diff_fraction(F.col("n_diff"), F.col("n_valid_cov")) >= f32(fraction))


def last_wins(df: DataFrame, order: list[Column]) -> DataFrame:
    """One record per key: the last in a declared total order. Partial maxima combine before the shuffle."""
    kept = F.max_by(F.struct(*COUNTS), F.struct(*order)).alias("r")
    return df.groupBy(*KEY).agg(kept).select(*KEY, "r.*")


def strongest_modification(df: DataFrame) -> DataFrame:
    """Records whose n_mod is the highest among the modifications of their position and strand; ties stay."""
    top = F.max("n_mod").over(Window.partitionBy("contig_id", "position", "strand"))
    return df.withColumn("__top", top).where(F.col("n_mod") == F.col("__top")).drop("__top")


BUCKET = 1 << 16


def without_dense_neighbourhoods(df: DataFrame, window: int, n_high: int, fraction: float, bucket: int = BUCKET) -> DataFrame:
    """Drop all records within ``window`` of a position around which ``n_high`` or more are highly modified.

    Both passes use the same frame, so one exchange and one sort serve them. A contig is cut into
    buckets of positions, each with the records up to two windows beyond its ends, so that a contig
    that holds most records is not one task; the copies are dropped again.
    """
    if window < 0 or 2 * window >= bucket:
        raise ValueError("the window must be shorter than half a bucket")
    own = F.floor(F.col("position") / bucket)
    offset = F.col("position") - own * bucket
    places = F.array_compact(F.array(own, F.when(offset < 2 * window, own - 1), F.when(offset + 2 * window >= bucket, own + 1)))
    frame = Window.partitionBy("contig_id", "mod_type", "strand", "__bucket").orderBy("position").rangeBetween(-window, window)
    high = F.coalesce(frac32(F.col("n_mod"), F.col("n_valid_cov")) > f32(fraction), F.lit(False)).cast("int")
    return (
        df.withColumn("__bucket", F.explode(places))
        .withColumn("__high", F.sum(high).over(frame))
        .withColumn("__dense", F.max((F.col("__high") >= n_high).cast("int")).over(frame))
        .where((F.col("__dense") == 0) & (F.col("__bucket") == own))
        .drop("__bucket", "__high", "__dense")
    )


def clean(df: DataFrame, order: list[Column], options: CleanOptions = CleanOptions()) -> DataFrame:
    """Scan coverage, key dedupe, strongest modification, strict coverage, density windows: in this order.

    Records are placed by (contig, position, strand) once: that serves the dedupe and the comparison
    of modifications, and a contig of any size spreads over all partitions.
    """
    placed = min_coverage(df, options.scan_min_cov).repartition("contig_id", "position", "strand")
    scanned = last_wins(placed, order)
    strong = strict_coverage(strongest_modification(scanned), options.min_cov)
    return without_dense_neighbourhoods(strong, options.window, options.n_high, options.fraction).select(*COLUMNS)


def contig_runs(df: DataFrame, file: str, line: str, contig: str = "contig_id", block: int = 1 << 20) -> DataFrame:
    """Contiguous runs of one contig in the order of a file: (file, run, contig, first and last line, records).

    Runs are numbered within blocks of lines; what a block begins with is compared with the last row of
    the block before it, and the runs of earlier blocks are carried on, so one file is many tasks.
    """
    rows = df.withColumn("__block", F.floor(F.col(line) / block))
    w = Window.partitionBy(file, "__block").orderBy(line)
    inner = F.when(F.row_number().over(w) > 1, (~F.col(contig).eqNullSafe(F.lag(contig).over(w))).cast("int")).otherwise(0)
    marked = rows.withColumn("__start", inner)
    blocks = marked.groupBy(file, "__block").agg(F.sum("__start").alias("__inner"), F.min_by(contig, line).alias("__first"), F.max_by(contig, line).alias("__last"))
    order = Window.partitionBy(file).orderBy("__block")  # one row per block
    begins = F.when(F.row_number().over(order) == 1, 1).otherwise((~F.col("__first").eqNullSafe(F.lag("__last").over(order))).cast("int"))
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        blocks.withColumn("__begins", begins)
        .withColumn("__before", F.coalesce(F.sum(F.col("__inner") + F.col("__begins")).over(earlier), F.lit(0)))
        .select(F.col(file).alias("__file"), F.col("__block").alias("__of"), (F.col("__before") + F.col("__begins")).alias("__carried"))
    )
    own = marked.withColumn("__own", F.sum("__start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = own.join(carried, F.col(file).eqNullSafe(F.col("__file")) & F.col("__block").eqNullSafe(F.col("__of")))
    return (
        runs.withColumn("run", F.col("__carried") + F.col("__own"))
        .groupBy(file, "run", contig)
        .agg(F.min(line).alias("first_line"), F.max(line).alias("last_line"), F.count("*").alias("n_records"))
    )


# The 18 columns of a pileup in BED form.
BED_FIELDS = (
    "chrom", "start_position", "end_position", "modified_base_code", "score", "strand", "start_position_compat",
    "end_position_compat", "color", "Nvalid_cov", "fraction_modified", "Nmod", "Ncanonical", "Nother_mod",
    "Ndelete", "Nfail", "Ndiff", "Nnocall",
)


def bed_fields(df: DataFrame) -> DataFrame:
    """The 18 columns of each record."""
    end, na = F.col("position") + 1, F.lit("NA")
    values = [
        F.col("contig_id"), F.col("position"), end, mod_code(F.col("mod_type")), F.col("n_valid_cov"), F.col("strand"),
        F.col("position"), end, F.lit("255,0,0"), F.col("n_valid_cov"), percent_text(F.col("n_mod"), F.col("n_valid_cov")),
        F.col("n_mod"), F.col("n_canonical"), na, na, na, F.col("n_diff"), na,
    ]
    return df.select(*(v.alias(n) for v, n in zip(values, BED_FIELDS, strict=True)))
