"""Pileup lines that keep arriving: a stream that quarantines bad lines and counts good ones by time.

Cleaning needs all records of a contig, so a stream only does what is final per line or per closed
window: it splits lines into records and failures, and aggregates arrivals with a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from methyloom.operators import quarantine as quar

LINES = "line_id long, src_file string, line_no long, raw_line string, received_at timestamp_ntz"


def read_lines(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of parquet files of pileup lines dropped into a folder."""
    return spark.readStream.schema(LINES).parquet(folder)


def split_arrivals(lines: DataFrame, records_path: str, failures_path: str, checkpoint: str):
    """Start a query that appends records and failures of each batch; one batch is written once even if retried."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        records, errors = quar.load_pileup(batch)
        records.write.parquet(f"{records_path}/batch={batch_id}", mode="overwrite")
        errors.write.parquet(f"{failures_path}/batch={batch_id}", mode="overwrite")
        batch.unpersist()

    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()


def arrivals_per_window(lines: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Lines, and lines of the wrong shape, per file and window of arrival; later lines than ``late`` are dropped."""
    # a stream's watermark needs an instant; a batch stays with wall time, whatever the session's zone
    arrived = F.col("received_at").cast("timestamp") if lines.isStreaming else F.col("received_at")
    shaped = quar.parsed(lines.select("src_file", arrived.alias("received_at"), "raw_line"), "raw_line", quar.PILEUP_FIELDS)
    broken = F.count(F.when((F.col("__q_n") != quar.PILEUP_FIELDS) | (F.col("__q_quoting") != "ok"), 1))
    return (
        shaped.withWatermark("received_at", late)
        .groupBy(F.window("received_at", window).alias("w"), "src_file")
        .agg(F.count("*").alias("n_lines"), broken.alias("n_misshapen"))
        .select(F.col("w.start").alias("window_start"), "src_file", "n_lines", "n_misshapen")
    )
