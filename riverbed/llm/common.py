"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.operators.shared import shared_dir

#: Tables of as many partitions aren't dealt out anew.
SMALL_PARTITIONS = 16
#: U+0020 and U+0009 to U+000D, as a Java pattern.
BLANKS = r"[\x20\x09-\x0D]+"


def spread(df: DataFrame) -> DataFrame:
    """``df``, where it is so small that it has fewer partitions than cores dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < min(cores, SMALL_PARTITIONS) else df


#: Tables of the run at hand; runs in other threads have lists of their own.
_TABLES: ContextVar[list[str] | None] = ContextVar("tables", default=None)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if (tables := _TABLES.get()) is not None:
        tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def tables_for(spark: SparkSession) -> Iterator[None]:
    """Tables that are materialized inside go when it ends; what is needed of them must have been written by then."""
    made: list[str] = []
    token = _TABLES.set(made)
    try:
        yield
    finally:
        _TABLES.reset(token)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def quoted(name: str) -> str:
    """A column's name as Spark reads it whatever it holds, dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


def ascii_lower(text):
    """A-Z lower-cased, other characters as they are; null is the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc32_mod(column, divisor: int):
    """crc32 of the number as decimal text, modulo ``divisor``; null counts as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``label, text`` of at most ``most`` labelled documents, chosen by the hash of their id, as a table of its own.

    ``labels`` has ``doc_id`` and ``label`` (1, 0; others and null ids are ignored). Of repeated labels the largest counts,
    of texts of one id the smallest. A null text is empty.
    """
    known = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id")
    return materialize(rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text")).select("label", "text"), "labelled")
