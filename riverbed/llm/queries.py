"""One query for each operator, over the whole of its tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbed.llm import decontamination, divergence, hard_negatives, jaccard, licenses, line_dedup, lm_scores, oracles, packing, quality, secrets, token_counts, token_files, toxicity
from riverbed.llm.common import crc32_mod, spread

#: Tokens beyond which a document is over the limit.
TOKEN_LIMIT = 512
#: Rows whose crc32(doc_id) leaves this modulo 4 give no labels.
LABEL_FOLDS, LABEL_HELD_OUT = 4, 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables come in one partition; they are dealt out to all cores."""
    return spread(_table(spark, sf_dir, "documents"))


def _labels(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    """Labels that may be learnt from."""
    rows = _table(spark, sf_dir, "labels").select("doc_id", F.col(column).alias("label"))
    return rows.where(crc32_mod(F.col("doc_id"), LABEL_FOLDS) != LABEL_HELD_OUT)


def toxicity_machine(spark: SparkSession, sf_dir: str) -> toxicity.Machine:
    return toxicity.train(_table(spark, sf_dir, "documents"), _labels(spark, sf_dir, "toxic"))


def _of_kind(kind: str):
    return lambda span: span["kind"] == kind


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(_documents(spark, sf_dir))
    base = [r.kind for r in secrets.RULES if r.base]
    counts = {f"n_{k}": F.size(F.filter("spans", _of_kind(k))).cast("long") for k in base}
    listed = secrets.listed(F.filter("spans", lambda s: s["kind"].isin(base)))
    return found.select("doc_id", *[c.alias(k) for k, c in counts.items()], F.sha2(listed.cast("binary"), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_join(_documents(spark, sf_dir), n=3, percent=90)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), end=1, size=2048)


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores.lm_scores(_table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item: ``doc_id, item_id``, the item's shingles, the shared ones and their share."""
    found = decontamination.contaminated(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return quality.quality_verdicts(documents, quality.train(documents, _labels(spark, sf_dir, "quality"))).drop("boilerplate")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return line_dedup.line_digests(documents, line_dedup.line_keep_bitmaps(documents, least_docs=5, least_chars=40))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = toxicity.toxicity_scores(_table(spark, sf_dir, "documents"), toxicity_machine(spark, sf_dir))
    held_out = crc32_mod(F.col("doc_id"), LABEL_FOLDS) == LABEL_HELD_OUT
    return scores.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, how much of each text fits into the limit, and a digest of the counts of all its prefixes."""
    counts = token_counts.budget_answers(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), TOKEN_LIMIT)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"), "fitting_chars", "prefix_crc32")


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least_docs=30, most_terms=50)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as files, read back, and only then counted and summed."""
    folder = token_files.new_folder(spark)
    token_files.write_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), folder, end=1)
    return token_files.token_digests(token_files.read_tokens(spark, folder))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row has another label than its own."""
    wrong = F.col("vec_id") % 7 == 0
    rows = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(wrong, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0)


def queries() -> dict:
    found = (op1_secret_scans, op2_ngram_jaccard_join, op3_packing, op4_lm_scoring, op5_benchmark_decontamination, op6_license_scans, op7_quality_rules, op8_line_dedup, op9_toxicity, op10_token_counts)
    found += (op11_source_divergence, op12_token_files, op13_hard_negatives)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
