"""Queries that go through files: what the sinks write, the sources read back, and nothing is lost on the way.

Files lie in the folder that all executors share.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.operators import annotate as ann
from methyloom.plans import inputs, motif_queries, record_queries
from methyloom.session import shared_folder, table
from methyloom.sinks import files as sinks
from methyloom.sources import files as sources


def q_file_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records written as BED and read as a pileup."""
    path = shared_folder(spark, "bed")
    cleaned = record_queries.cleaned(spark, sf_dir)
    sinks.write_bed(cleaned, path)
    return sources.read_pileup(spark, path).select(*cleaned.columns)


def q_file_bed_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through gzip, counted per contig."""
    path = sinks.gzip_path(shared_folder(spark, "packed"))
    sinks.write_bed(record_queries.cleaned(spark, sf_dir), path, gzip=True)
    return sources.read_pileup(spark, path).groupBy("contig_id").agg(F.count("*").alias("n"), F.sum("position").alias("sum_position"))


def q_file_contig(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records in files by bucket of contigs, those of the contig with the most records read back."""
    path = shared_folder(spark, "buckets")
    cleaned = record_queries.cleaned(spark, sf_dir)
    sources.to_partitioned(cleaned, path)
    written = spark.read.parquet(path)
    largest = written.groupBy("contig_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "contig_id").limit(1).first()
    return sources.of_contig(written, largest["contig_id"] if largest else "").select(*cleaned.columns)


def q_file_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences written as FASTA, two lines each and some words behind the id, and read back."""
    path = shared_folder(spark, "fasta")
    known = inputs.sequences(spark, sf_dir)
    half = F.floor(F.length("seq") / 2).cast("int")
    broken = F.concat(F.substr("seq", F.lit(1), half), F.lit("\n"), F.substr("seq", half + 1, F.length("seq")))
    known.select(F.concat(F.lit(">"), F.col("contig_id"), F.lit(" loaded last\n"), broken)).write.text(path)
    back = sources.read_fasta(spark, path)
    return back.select("contig_id", F.length("seq").alias("n_bases"), F.md5("seq").alias("seq_md5"))


def q_file_contig_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contig-bin file: lines with fewer than two fields are skipped."""
    path = shared_folder(spark, "contig_bin")
    table(spark, sf_dir, "contig_bin").select("contig", "bin").write.csv(path, header=False, nullValue="", **sinks.AS_IT_IS)
    return sources.read_contig_bin(spark, path).groupBy("contig", "bin").agg(F.count("*").alias("n"))


def q_file_bin_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin-motifs file, read, validated and deduped."""
    path = shared_folder(spark, "bin_motifs")
    columns = [c.split(" ")[0] for c in sources.BIN_MOTIF_SCHEMA.split(", ")]
    table(spark, sf_dir, "bin_motifs").select(*columns).write.csv(path, header=True, nullValue="", **sinks.AS_IT_IS)
    return ann.bin_motif_set(sources.read_bin_motifs(spark, path))


def q_file_annotated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated records written with a header and read back."""
    path = shared_folder(spark, "annotated")
    annotated = motif_queries.annotated(spark, sf_dir)
    sinks.write_annotated(annotated, path)
    kinds = dict(annotated.dtypes)
    back = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} {kinds[c]}" for c in sinks.ANNOTATED_COLUMNS))
    return back.withColumn("motifs", F.coalesce("motifs", F.lit("")))


def q_file_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary written with a header and read back."""
    path = shared_folder(spark, "summary")
    summary = motif_queries.q_summary(spark, sf_dir)
    sinks.write_summary(summary, path)
    kinds = dict(summary.dtypes)
    back = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} {kinds[c]}" for c in sinks.SUMMARY_COLUMNS))
    return back.withColumn("motifs", F.coalesce("motifs", F.lit("")))


def q_file_motifs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Motif tables of both discoveries, written with a header and read back: rows that are not as they were found."""
    wrong = None
    for name, query in (("count", motif_queries.q_search_count), ("mixture", motif_queries.q_search_mixture)):
        path = shared_folder(spark, "motifs")
        found = query(spark, sf_dir)
        sinks.write_motifs(found, path)
        back = spark.read.csv(path, sep="\t", header=True, schema=found.schema)
        seq, mod, at = (F.col(f"motif_{c}") for c in ("seq", "mod_type", "mod_position"))
        whole = (F.col("motif") == F.concat_ws("-", seq, mod, at.cast("string"))) & (at >= 0) & (at < F.length(seq)) & (F.col("score") > 0)
        one = back.agg(F.lit(name).alias("model"), F.count(F.when(~F.coalesce(whole, F.lit(False)), 1)).alias("n_wrong"))
        wrong = one if wrong is None else wrong.unionByName(one)
    return wrong


QUERIES = {
    f.__name__: f
    for f in (
        q_file_bed, q_file_bed_gzip, q_file_contig, q_file_fasta, q_file_contig_bin, q_file_bin_motifs, q_file_annotated,
        q_file_summary, q_file_motifs,
    )
}

_CLEAN, _COLS = record_queries.CLEAN, record_queries._COLS

SQL = {
    "q_file_bed": f"with {_CLEAN} select {_COLS} from cleaned",
    "q_file_bed_gzip": f"with {_CLEAN} select contig_id, count(*) as n, cast(sum(position) as bigint) as sum_position from cleaned group by 1",
    "q_file_contig": f"""with {_CLEAN} select {_COLS} from cleaned
      where contig_id = (select contig_id from cleaned group by 1 order by count(*) desc, contig_id limit 1)""",
    "q_file_fasta": f"with {inputs.SEQS} select contig_id, cast(length(seq) as integer) as n_bases, md5(seq) as seq_md5 from seqs where not regexp_matches(contig_id, '\\s')",
    "q_file_contig_bin": "select contig, bin, count(*) as n from contig_bin where contig <> '' and bin <> '' group by 1, 2",
    "q_file_bin_motifs": f"with {inputs.BIN_MOTIFS} select * from bin_motif_set where bin <> ''",
    "q_file_annotated": motif_queries.SQL["q_annotate"],
    "q_file_summary": motif_queries.SQL["q_summary"],
    "q_file_motifs": "select unnest(['count', 'mixture']) as model, cast(0 as bigint) as n_wrong from (select count(*) from contigs)",
}
