"""A corpus pipeline of five stages: each takes the documents that its predecessor kept.

All stages take tables with nulls in any column, repeated rows, other columns and no rows at all; what that gives is said
at each. All but the last return the columns of their input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm import decontamination, jaccard, line_dedup, packing, queries, toxicity
from riverbed.llm.common import materialize, quoted, tables_for
from riverbed.operators.shared import shared_dir


def _identified(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and its column of unique row ids: ``doc_id`` if that is one, else an added column, in a table of its own."""
    unsure = docs.groupBy("doc_id").count().where("doc_id is null or count > 1")
    if unsure.isEmpty():
        return docs, "doc_id"
    name = "_row" + "_" * max(map(len, docs.columns))
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def _without(docs: DataFrame, key: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose ``key`` isn't among the ``doc_id`` of ``gone``."""
    gone = materialize(gone.select(F.col("doc_id").alias(key)).distinct(), "gone")
    return docs.join(gone, key, "left_anti").select([F.col(quoted(c)) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; the machine learns from the labels of the whole table.

    Rows are judged one by one by their text. A null or blank text has the score of no term.
    """
    return toxicity.drop_toxic(docs, queries.toxicity_machine(spark, sf_dir))


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the last of them only; ``text`` and ``n_chars`` change.

    Rows of one ``doc_id`` are one document, each with its own lines. Rows without an id or text stay as they are.
    """
    return line_dedup.drop_shared_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Where ids are missing or come twice, each row is a document of its own and the first row of a group in the table's order
    stays. Rows without words are nobody's copies and stay.
    """
    rows, key = _identified(docs)
    groups = jaccard.ngram_jaccard_join(rows.select(F.col(key).alias("doc_id"), "text"))
    return _without(rows, key, groups.where("component_id <> doc_id"), docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go.

    Where ids are missing or come twice, each row is a document of its own. Rows without words hold nothing and stay.
    """
    rows, key = _identified(docs)
    found = decontamination.contaminated(rows.select(F.col(key).alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(rows, key, found, docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents in sequences of 2048 tokens. A null text is empty: its end alone is packed."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", pack),
]

#: The stages learn models and tokenize; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again. What a stage made for itself goes when it is written."""
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        with tables_for(spark):
            made = stage(spark, docs, sf_dir)
            made.write.parquet(f"{folder}/{name}")
        docs = spark.read.schema(made.schema).parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
