"""Sequence windows around positions, base frequencies per offset, and divergence.

Sequences are cut into overlapping tiles first, and positions meet tiles by an equi-join on (contig,
tile): work is even however long one contig is, and no substring walks a whole contig.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from methyloom.functions.iupac import reverse_complement_col
from methyloom.functions.modcodes import MOD_BASE
from methyloom.session import parallelism

TILE = 512
COARSE = 128 * TILE


def tiles(sequences: DataFrame, flank: int) -> DataFrame:
    """(contig_id, tile, length, start, piece): pieces of TILE bases with ``flank`` more on both sides.

    A substring walks its text from the start, so sequences are cut coarsely first, then finely. The
    coarse pieces are dealt to all tasks: they are small, and what is made of them is not.
    """
    last = lambda size: F.floor((F.col("length") - 1) / size)
    begin = lambda at: F.greatest(at - flank, F.lit(0))
    cut = lambda text, first, n: F.substr(text, (first + 1).cast("int"), n.cast("int"))
    off, fine = F.col("coarse") * COARSE, F.col("tile") * TILE
    coarse = (
        sequences.where("seq is not null and seq <> ''")
        .withColumn("length", F.length("seq").cast("long"))
        .withColumn("coarse", F.explode(F.sequence(F.lit(0).cast("long"), last(COARSE))))
        .select("contig_id", "length", "coarse", begin(off).alias("from"), cut(F.col("seq"), begin(off), off + COARSE + flank - begin(off)).alias("text"))
    )
    coarse = coarse.repartition(4 * parallelism(sequences.sparkSession), "contig_id", "coarse")
    per = COARSE // TILE
    within = F.sequence(F.col("coarse") * per, F.least((F.col("coarse") + 1) * per - 1, last(TILE)))
    return coarse.withColumn("tile", F.explode(within)).select(
        "contig_id", "tile", "length", begin(fine).alias("start"),
        cut(F.col("text"), begin(fine) - F.col("from"), fine + TILE + flank - begin(fine)).alias("piece"),
    )


def _cut(center: Column, flank: int) -> Column:
    return F.substr(F.col("piece"), (center - flank - F.col("start") + 1).cast("int"), F.lit(2 * flank + 1))


def _inside(center: Column, flank: int) -> Column:
    return (center >= flank) & (center + flank < F.col("length"))


def windows_at(positions: DataFrame, sequences: DataFrame, flank: int) -> DataFrame:
    """``positions`` (contig_id, position, ...) with ``kmer``: flank bases on each side; those cut off by an end are dropped."""
    keyed = positions.withColumn("tile", F.floor(F.col("position") / TILE))
    joined = keyed.join(tiles(sequences, flank), ["contig_id", "tile"]).where(_inside(F.col("position"), flank))
    return joined.select(*positions.columns, _cut(F.col("position"), flank).alias("kmer"))


def oriented(kmer: Column, strand: Column) -> Column:
    """The window as its strand reads it."""
    return F.when(strand == "-", reverse_complement_col(kmer)).otherwise(kmer)


def background_windows(sequences: DataFrame, flank: int) -> DataFrame:
    """(contig_id, mod_type, strand, position, kmer) around every base that can carry a modification."""
    strands = {"A": "+", "C": "+", "T": "-", "G": "-"}
    off = F.col("tile") * TILE
    first, last = F.greatest(off, F.lit(flank)), F.least(off + TILE, F.col("length") - flank) - 1
    centers = (
        tiles(sequences, flank)
        .where(first <= last)
        .withColumn("position", F.explode(F.sequence(first, last)))
        .select("contig_id", "position", _cut(F.col("position"), flank).alias("kmer"))
    )
    base = F.substr(F.col("kmer"), F.lit(flank + 1), F.lit(1))
    carries = {b: [m for m, c in MOD_BASE.items() if c == b] for b in "AC"}
    carries |= {"T": carries["A"], "G": carries["C"]}
    kinds = None
    for b, strand in strands.items():
        value = F.array(*[F.struct(F.lit(m).alias("mod_type"), F.lit(strand).alias("strand")) for m in carries[b]])
        kinds = F.when(base == b, value) if kinds is None else kinds.when(base == b, value)
    return (
        centers.withColumn("k", F.explode(kinds))
        .select("contig_id", "k.mod_type", "k.strand", "position", oriented(F.col("kmer"), F.col("k.strand")).alias("kmer"))
    )


def methylated_windows(leveled: DataFrame, sequences: DataFrame, flank: int) -> DataFrame:
    """(contig_id, mod_type, strand, position, kmer) around records of the high level."""
    high = leveled.where("level = 'High'").select("contig_id", "mod_type", "strand", "position")
    cut = windows_at(high, sequences, flank)
    return cut.withColumn("kmer", oriented(F.col("kmer"), F.col("strand")))


def matching(windows: DataFrame, motif_regex: str, motif_length: int, motif_position: int, flank: int, negate: bool = False) -> DataFrame:
    """Windows whose centre is the modified position of a motif (or those where it is not)."""
    first = flank - motif_position
    if first < 0 or first + motif_length > 2 * flank + 1:
        raise ValueError("the motif does not fit the window")
    hit = F.substr(F.col("kmer"), F.lit(first + 1), F.lit(motif_length)).rlike(f"(?s)\\A{motif_regex}\\z")
    return windows.where(~hit if negate else hit)


def pssm(windows: DataFrame, by: list[str], flank: int, pseudocount: float = 0.0) -> DataFrame:
    """(by, offset, base, freq): base frequencies per offset; other characters count in the total only.

    One pass: windows are taken apart where they are, and each task sends its counts per offset only.
    """
    at = windows.select(*by, "kmer", F.explode(F.sequence(F.lit(0), F.lit(2 * flank))).alias("offset"))
    base = F.substr(F.col("kmer"), F.col("offset") + 1, F.lit(1))
    each = [F.count(F.when(base == b, 1)).alias(f"__{b}") for b in "ACGT"]
    counts = at.groupBy(*by, "offset").agg(F.count("*").alias("__total"), *each)
    rows = F.explode(F.array(*[F.struct(F.lit(b).alias("base"), F.col(f"__{b}").alias("n")) for b in "ACGT"])).alias("__b")
    freq = (F.col("__b.n") + pseudocount) / (F.col("__total") + 4 * pseudocount)
    return counts.select(*by, "offset", "__total", rows).select(*by, "offset", F.col("__b.base").alias("base"), freq.alias("freq"))


def kl_divergence(p: DataFrame, q: DataFrame, by: list[str]) -> DataFrame:
    """(by, offset, kl) of two frequency tables, each frequency raised by 1e-6."""
    keys = [*by, "offset", "base"]
    a, b = F.col("freq") + 1e-6, F.col("other") + 1e-6
    joined = p.join(q.withColumnRenamed("freq", "other"), keys)
    return joined.groupBy(*by, "offset").agg(F.sum(a * F.log(a / b)).alias("kl"))


def bases_above(table: DataFrame, by: list[str], min_freq: float) -> DataFrame:
    """(by, offset, bases): bases more frequent than ``min_freq``, in the order A, C, G, T."""
    kept = F.array_join(F.sort_array(F.collect_list(F.when(F.col("freq") > min_freq, F.col("base")))), "")
    return table.groupBy(*by, "offset").agg(kept.alias("bases"))
