"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

#: A null document id sorts after every other one.
NULL_ID = 2**63 - 1
#: Bytes of an Arrow batch at most, unless one row is longer.
BATCH_BYTES = 8 << 20
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where all run on this machine."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


def prepare(spark: SparkSession) -> None:
    """Make sure of a shared folder, and keep Arrow batches small where the session has no limits of its own."""
    shared_folder(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")
    usual = 256 << 20
    size = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", str(usual))
    if size.lower() in (str(usual), f"{usual}b", "256mb", "256m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def written(df: DataFrame) -> DataFrame:
    """df as a compressed table in the shared folder, read again: cuts lineage as checkpoint() does, in less space.

    The shuffle files that it took go at the end of the write.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    usual = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, usual)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the tables of frames from ``written`` that nothing reads any more."""
    for df in frames:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df._written_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with null ids as NULL_ID and null texts empty; all other columns are left behind."""
    return docs.select(
        F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
    )


def real_id(name: str = "doc_id"):
    """The id as it was read."""
    return F.when(F.col(name) != NULL_ID, F.col(name)).alias(name)
