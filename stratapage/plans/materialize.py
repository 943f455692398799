"""Cutting lineage between long chains of steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share for checkpoints; a temporary one only where all run on this machine and none is set."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="checkpoint")
        context.setCheckpointDir(shared)
    return context.getCheckpointDir()


#: Columns that a document's rows are in order by: the first of these that a table has.
ORDERS = ("ord", "spot", "segment", "seq", "block_no")
#: A bucket of one file is read in the order that it was written in, and then not sorted again.
IN_ORDER = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def materialize(df: DataFrame, key: str | None = None, buckets: int = 1) -> DataFrame:
    """df written as a compressed table in the shared folder and read again.

    With a key, the table is in buckets by its hash, so that what reads it by
    that key needs no shuffle, and in order, so that windows over a document's
    rows need no sort. The catalog drops its name at once: the frame
    that is returned knows the files.
    """
    spark = df.sparkSession
    name = f"step_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    # most columns are measures of lines: a dictionary of them is made, given up or looked up value by value
    writer = df.write.option("compression", "zstd").option("parquet.enable.dictionary", "false")
    if key is None:
        writer.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    spark.conf.set(IN_ORDER, "true")
    order = [key, *[c for c in ORDERS if c in df.columns][:1]]
    writer.format("parquet").option("path", path).bucketBy(buckets, key).sortBy(*order).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found
