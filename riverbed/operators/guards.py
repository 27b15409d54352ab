"""Guards against partial, stale or empty input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.operators.joins import fallback


def collapsed(previous: str = "previous", fresh: str = "fresh"):
    """A partition that lost too much at once: half and five of eight or more, or all of five or more."""
    p, f = F.coalesce(F.col(previous), F.lit(0)), F.coalesce(F.col(fresh), F.lit(0))
    return ((p >= 8) & (f * 2 <= p) & (p - f >= 5)) | ((p >= 5) & (f == 0))


def partition_counts(previous: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    one = previous.groupBy(key).agg(F.count("*").alias("previous"))
    return one.join(fresh.groupBy(key).agg(F.count("*").alias("fresh")), key, "full").fillna(0, ["previous", "fresh"]).withColumn("collapsed", collapsed())


def guard_collapse(previous: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """Fresh rows; of a collapsed partition the previous ones."""
    counts = partition_counts(previous, fresh, key).select(key, (~F.col("collapsed")).alias("available"))
    return fallback(fresh, previous.join(counts, key, "left_semi"), counts, key, "available")


def acceptance(as_of, youngest: float = -10, oldest: float = 90):
    """Why a captured partition can't be used, or ``ok``. A count of zero is never taken for emptiness."""
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("captured_at")) / 60
    return (
        F.when(F.coalesce(F.col("http"), F.lit(0)) != 200, "http")
        .when(~F.coalesce(F.col("available"), F.lit(False)), "unavailable")
        .when(F.coalesce(F.col("count"), F.lit(0)) <= 0, "empty")
        .when(F.coalesce(F.col("pagination_expected"), F.lit(False)) & ~F.coalesce(F.col("pagination_complete"), F.lit(False)), "incomplete")
        .when(~F.coalesce(age.between(youngest, oldest), F.lit(False)), "stale")
        .otherwise("ok")
    )


def only_complete(status: DataFrame) -> DataFrame:
    """``status`` whose partitions are available only with rows, and with all pages where there are several."""
    whole = ~F.coalesce(F.col("pagination_expected"), F.lit(False)) | F.coalesce(F.col("pagination_complete"), F.lit(False))
    return status.withColumn("available", F.coalesce(F.col("available"), F.lit(False)) & (F.coalesce(F.col("count"), F.lit(0)) > 0) & whole)


def all_or_nothing(runs: DataFrame, source: str, success: str) -> DataFrame:
    """A source has succeeded only if each of its keys has."""
    return runs.groupBy(source).agg(F.bool_and(F.coalesce(F.col(success), F.lit(False))).alias("success"), F.count("*").alias("keys"), F.sum(F.coalesce(F.col(success), F.lit(False)).cast("int")).alias("succeeded"))


def complete_keys(pages: DataFrame, key: str, ok: str) -> DataFrame:
    """Rows of the keys of which every page was read; a key with one failed page gives none."""
    failed = pages.where(~F.coalesce(F.col(ok), F.lit(False))).select(key).distinct()
    return pages.join(failed, key, "left_anti")


def with_fallback(fresh: DataFrame, older: DataFrame, status: DataFrame, key: str, allowed: bool) -> DataFrame:
    """Fresh rows of the available partitions and, only if that is ``allowed``, older rows of the others."""
    return fallback(fresh, older if allowed else older.where(F.lit(False)), status, key, "available")
