"""Token ids as Parquet files that can be read in part.

``tokens/`` holds one row for each document in ascending order of ids, over all files: the document's number, its file, the
ids before it in that file, its number of ids, and the ids as a list. The list is dictionary-encoded (16 bits an id), the
other columns are delta-encoded; row groups and pages have a set size, and column indexes let a reader skip pages by
``doc_id`` or place. ``files/`` holds for each file its documents, its ids and the ids of all files before it, so that no
running sum over documents is needed. Both are Spark's own Parquet sources.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riverbed.llm.packing import _encoder, text_slices
from riverbed.operators.shared import shared_dir

TOKENS = "doc_id long, file int, at long, n_tokens long, ids array<int>"
FILES = "file int, n_docs long, n_ids long, start long, first_doc long, last_doc long"


@dataclass(frozen=True)
class Layout:
    """Bytes of a row group, bytes and rows of a page, and the codec."""

    row_group: int = 32 << 20
    page: int = 256 << 10
    page_rows: int = 2048
    codec: str = "zstd"

    def options(self) -> dict[str, str]:
        plain = {f"parquet.enable.dictionary#{c}": "false" for c in ("doc_id", "at", "n_tokens")}
        return plain | {
            "parquet.writer.version": "PARQUET_2_0",  # delta encoding of numbers without a dictionary
            "parquet.block.size": str(self.row_group),
            "parquet.page.size": str(self.page),
            "parquet.page.row.count.limit": str(self.page_rows),
            "parquet.enable.dictionary": "true",
            "compression": self.codec,
        }


def _encoded(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file, at = _encoder(path, end), TaskContext.get().partitionId(), 0
        for batch in batches:
            row = 0
            for texts in text_slices(batch["text"]):
                bounds, made = encoder.encode(texts)
                ids = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(made))
                docs = batch["doc_id"].slice(row, len(texts))
                yield pa.RecordBatch.from_arrays([docs, pa.array(np.full(len(texts), file, np.int32)), pa.array(at + bounds[:-1]), pa.array(np.diff(bounds)), ids], ["doc_id", "file", "at", "n_tokens", "ids"])
                row, at = row + len(texts), at + len(made)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end: int = 1, layout: Layout = Layout(), files: int | None = None) -> None:
    """Writes the ids of all ``docs`` under ``path``, which must not exist, to as many ``files`` at most (None: by size).

    ``tokenizer`` is a file of the tokenizers library that drops white space; ``end`` stands behind each text's ids. Null texts
    are empty: their ``end`` alone is written. Rows without a ``doc_id`` come first; rows of one ``doc_id`` are each a row, in
    the order of their texts' xxhash64. Texts are range-partitioned by id before they are encoded, so each is encoded once and
    a task that is repeated writes the same file again. Other columns are ignored; of an empty table the files have no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = ["doc_id", "tie", "row"]  # with the row's number many rows of one id and text spread over tasks
    rows = rows.withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = (rows.repartitionByRange(files, *keys) if files else rows.repartitionByRange(*keys)).sortWithinPartitions(*keys).select("doc_id", "text")
    rows.mapInArrow(_encoded(tokenizer, end), TOKENS).write.options(**layout.options()).parquet(f"{path}/tokens")
    found = token_rows(docs.sparkSession, path).groupBy("file").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = found.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    starts.select("file", "n_docs", "n_ids", "start", "first_doc", "last_doc").coalesce(1).write.parquet(f"{path}/files")


def token_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows as they stand in the files; columns that aren't asked for aren't read."""
    return spark.read.schema(TOKENS).parquet(f"{path}/tokens")


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file that has documents: ``file, n_docs, n_ids, start, first_doc, last_doc``."""
    return spark.read.schema(FILES).parquet(f"{path}/files")


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids``: documents of ids from ``low`` to ``high``, both included; None: no bound.

    ``start`` is the number of ids of all documents before. Bounds reach the files: row groups and pages beyond them are skipped.
    """
    rows = token_rows(spark, path)
    if low is not None:
        rows = rows.where(F.col("doc_id") >= low)
    if high is not None:
        rows = rows.where(F.col("doc_id") <= high)
    starts = token_files(spark, path).select("file", F.col("start").alias("before"))
    return rows.join(starts, "file").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids")


def read_span(spark: SparkSession, path: str, begin: int, length: int) -> DataFrame:
    """``doc_id, start, ids`` of the pieces of documents at places ``begin`` to ``begin + length`` of all ids, in any order of rows.

    A place is that of an id among all ids, from 0. Files without such places are left out by their row in ``files/``, pages by
    the places in their columns' indexes.
    """
    if length <= 0:
        return read_tokens(spark, path).select("doc_id", "start", "ids").limit(0)
    stop, found = begin + length, token_files(spark, path)
    found = found.where((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > begin)).select("file", "start")
    bounds = found.agg(F.min("file"), F.max("file"), F.min_by("start", "file"), F.max_by("start", "file")).first()
    if bounds[0] is None:
        return read_tokens(spark, path).select("doc_id", "start", "ids").limit(0)
    rows = token_rows(spark, path).where((F.col("file") >= bounds[0]) & (F.col("file") <= bounds[1]))
    if bounds[0] == bounds[1]:
        rows = rows.where((F.col("at") < stop - bounds[2]) & (F.col("at") + F.col("n_tokens") > begin - bounds[2]))
    rows = rows.join(found, "file").withColumn("start", F.col("start") + F.col("at"))
    rows = rows.where((F.col("start") < stop) & (F.col("start") + F.col("n_tokens") > begin))
    skip, end = F.greatest(F.lit(begin) - F.col("start"), F.lit(0)), F.least(F.lit(stop) - F.col("start"), F.col("n_tokens"))
    return rows.select("doc_id", (F.col("start") + skip).alias("start"), F.slice("ids", (skip + 1).cast("int"), (end - skip).cast("int")).alias("ids"))


def _checksums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch["ids"]
        at, ids = lists.offsets.to_numpy(), lists.values.to_numpy().astype("<u4", copy=False)
        raw = memoryview(np.ascontiguousarray(ids)).cast("B")
        sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["start"], pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def token_digests(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of what :func:`read_tokens` gives: length and CRC-32 of the lists themselves."""
    return tokens.select("doc_id", "start", "ids").mapInArrow(_checksums, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/token-files-{uuid.uuid4().hex}"
