"""File sources: pileups, FASTA, contig bins and bin motifs.

Schemas are fixed and positional; nothing is inferred. Gzip files (also of many members) are read as
they are; they do not split, so large ones are best converted once with ``to_partitioned``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from methyloom.functions.modcodes import canonical_mod_type
from methyloom.operators.clean import BED_FIELDS, COLUMNS

BED_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in BED_FIELDS])

#: Logical fields of a record and the file columns they come from.
FIELD_MAPPING = {
    "contig_id": "chrom", "position": "start_position", "mod_type": "modified_base_code", "strand": "strand",
    "n_valid_cov": "Nvalid_cov", "n_mod": "Nmod", "n_canonical": "Ncanonical", "n_diff": "Ndiff",
}


def leading_integer(text: Column, kind: str = "int") -> Column:
    """The integer that a text begins with, null if it begins with none or it does not fit."""
    return F.when(text.rlike(r"\A[+-]?[0-9]"), F.regexp_extract(text, r"\A([+-]?[0-9]+)", 1)).try_cast(kind)


def read_pileup(spark: SparkSession, path: str, min_cov: int = 0, mapping: dict[str, str] | None = None) -> DataFrame:
    """Valid records of a pileup file with at least ``min_cov`` coverage; rows that do not parse are dropped.

    Only the eight mapped columns are read. Use ``operators.quarantine`` to keep what fails.
    """
    m = FIELD_MAPPING | (mapping or {})
    rows = spark.read.csv(path, sep="\t", header=False, schema=BED_SCHEMA, quote='"', escape='"', mode="PERMISSIVE")
    number = lambda name, kind="int": leading_integer(F.col(m[name]), kind).alias(name)
    strand = F.col(m["strand"])
    typed = rows.select(
        F.col(m["contig_id"]).alias("contig_id"), number("position", "long"), F.when(strand.isin("+", "-"), strand).alias("strand"),
        canonical_mod_type(F.col(m["mod_type"])).alias("mod_type"), *(number(c) for c in ("n_mod", "n_valid_cov", "n_canonical", "n_diff")),
    )
    return typed.dropna(subset=COLUMNS).where(F.col("n_valid_cov") >= min_cov)


def read_contig(spark: SparkSession, path: str, contig: str, min_cov: int = 5) -> DataFrame:
    """The records of one contig of a pileup file, which is read whole; ``of_contig`` reads less."""
    return read_pileup(spark, path, min_cov).where(F.col("contig_id") == contig)


BUCKETS = 1_000


def _bucket(contig: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(contig), F.lit(buckets)).cast("int")


def to_partitioned(records: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Parquet in ``buckets`` directories by hash of the contig, sorted inside, whatever the number of contigs.

    A reader of one contig opens one directory, and of its files the row groups that may hold the contig.
    """
    placed = records.withColumn("bucket", _bucket(F.col("contig_id"), buckets)).repartition("bucket", F.floor(F.col("position") / 1_000_000))
    placed.sortWithinPartitions("bucket", "contig_id", "position").write.partitionBy("bucket").parquet(path, mode="errorifexists")


def of_contig(written: DataFrame, contig: str, buckets: int = BUCKETS) -> DataFrame:
    """The records of one contig of what ``to_partitioned`` wrote with as many buckets."""
    return written.where((F.col("bucket") == _bucket(F.lit(contig), buckets)) & (F.col("contig_id") == contig)).drop("bucket")


def list_contigs(records: DataFrame) -> DataFrame:
    return records.select("contig_id").distinct()


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, seq): id up to the first white space, line breaks removed, case kept; of equal ids the last wins."""
    texts = spark.read.text(path, lineSep="\n>").withColumn("order", F.monotonically_increasing_id())
    record = F.regexp_replace("value", r"\A>", "")
    parsed = texts.select(
        "order",
        F.regexp_extract(record, r"\A(\S*)", 1).alias("contig_id"),
        F.regexp_replace(F.regexp_replace(record, r"\A[^\n]*(?:\n|\z)", ""), r"[\r\n]", "").alias("seq"),
    )
    last = F.max_by("seq", "order").alias("seq")
    return parsed.where("contig_id <> ''").groupBy("contig_id").agg(last)


def read_contig_bin(spark: SparkSession, path: str) -> DataFrame:
    """(contig, bin) of a headerless file; lines with fewer than two fields are skipped."""
    rows = spark.read.csv(path, sep="\t", header=False, schema="contig string, bin string")
    return rows.where("contig is not null and bin is not null")


BIN_MOTIF_SCHEMA = (
    "bin string, motif string, mod_position int, mod_type string, n_mod int, n_nomod int, motif_type string, "
    "motif_complement string, mod_position_complement int, n_mod_complement int, n_nomod_complement int"
)


def read_bin_motifs(spark: SparkSession, path: str) -> DataFrame:
    """The bin-motifs file; short rows have nulls. ``annotate.bin_motif_set`` validates and dedupes."""
    return spark.read.csv(path, sep="\t", header=True, schema=BIN_MOTIF_SCHEMA, enforceSchema=True)
