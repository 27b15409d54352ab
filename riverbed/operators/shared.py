"""The folder that all executors and the driver see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Tables of as many partitions or more aren't dealt out anew.
FEW_PARTITIONS = 16


def shared_dir(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``; on one machine (tests) a temporary one if it is unset, else it must be named."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and spark.sparkContext.master.startswith("local"):
        found = tempfile.mkdtemp(prefix="riverbed-")
        spark.sparkContext.setCheckpointDir(found)
    if not found:
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return found.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder.

    A checkpoint keeps the planner's estimate of its size, and that of a join is the product of its sides'. Where one loop goes on
    with what another has made, these numbers get so long that planning takes longer than the work; a table's size is that of its files.
    Rows that repeat take little of a file and much memory, so joins don't send the table to all through the driver for a small file's sake.
    """
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def spread(df: DataFrame) -> DataFrame:
    """``df``, where it has fewer partitions than there are cores (as a small file has) dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, FEW_PARTITIONS) else df
