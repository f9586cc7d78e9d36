"""Session helpers: reading tables and cutting lineage in storage that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back from there.

    The folder is the one named by ``spark.checkpoint.dir`` (or set on the context by the caller).
    Only where neither is set and the master is ``local`` is a temporary folder used.
    """
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as parquet to a new path in the shared folder and read back: by column, so far smaller than a checkpoint."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: the unit in which operators size their fan-out."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))

