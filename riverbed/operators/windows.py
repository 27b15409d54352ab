"""Ranked, running and previous-row shapes over groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_one(df: DataFrame, group: list, order: list) -> DataFrame:
    return top_k(df, group, order, 1)


def top_k(df: DataFrame, group: list, order: list, k: int) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def with_gap(df: DataFrame, group: list, score: str, ties: list, name: str = "gap") -> DataFrame:
    """The best row of each group and how far the second best lies behind it (null without one)."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), *ties)
    ranked = df.withColumns({name: F.col(score) - F.lead(score).over(w), "_r": F.row_number().over(w)})
    return ranked.where("_r = 1").drop("_r")


def until_stop(df: DataFrame, group: list, order: list, stop: Column) -> DataFrame:
    """Rows up to and with the first one for which ``stop`` holds, as a paginated scan reads its pages."""
    before = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_s", F.coalesce(F.max(stop.cast("int")).over(before), F.lit(0))).where("_s = 0").drop("_s")


def until_nothing_new(df: DataFrame, group: list, page: str, item: str) -> DataFrame:
    """``page, n, n_new`` of each group's pages up to the first one that shows no item for the first time."""
    seen = df.select(*group, page, item).distinct().withColumn("_f", F.min(page).over(Window.partitionBy(*group, item)))
    pages = seen.groupBy(*group, page).agg(F.count("*").alias("n"), F.count_if(F.col(page) == F.col("_f")).alias("n_new"))
    return until_stop(pages, group, [page], F.col("n_new") == 0)


def scanned_pages(df: DataFrame, group: list, page: str, rows: Column, fresh: Column, total: Column | None = None, size: int = 30, most: int = 20) -> DataFrame:
    """Pages that a scan reads: up to one without rows, a later one without anything new, a short one, the last of ``total`` rows, or page ``most``."""
    stop = (rows == 0) | ((F.col(page) > 1) & (fresh == 0)) | (rows < size)
    if total is not None:
        stop = stop | F.coalesce(F.col(page) * size >= total, F.lit(False))
    return until_stop(df.where(F.col(page) <= most), group, [page], stop)


def with_previous(df: DataFrame, key: list, order: list, value: str, least: float) -> DataFrame:
    """``previous``, ``change`` and ``direction`` against the row before; changes under ``least`` count as none."""
    w = Window.partitionBy(*key).orderBy(*order)
    exact = F.col(value).cast("decimal(18,4)")  # binary fractions would round to either side
    change = F.round(exact - F.lag(exact).over(w), 1).cast("double")
    moved = df.withColumns({"previous": F.lag(value).over(w), "change": F.when(F.abs(change) >= least, change)})
    return moved.withColumn("direction", F.when(F.col("change") > 0, "up").when(F.col("change") < 0, "down"))


def carry_forward(df: DataFrame, key: list, order: list, value: str, name: str) -> DataFrame:
    """The last value that was there, up to this row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def last_entries(array: Column, k: int) -> Column:
    return F.slice(array, F.greatest(F.lit(1), F.size(array) - (k - 1)), k)


def ordered_members(df: DataFrame, group: list, order: list[str], fields: list[str], name: str = "members") -> DataFrame:
    """Rows of a group as an array of structs in the given order."""
    keyed = F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], *fields)))
    return df.groupBy(*group).agg(F.transform(keyed, lambda s: F.struct(*[s[f].alias(f) for f in fields])).alias(name))


def counts_with_zeros(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    """A count for each of the values, zeros too."""
    known = df.sparkSession.createDataFrame([(v,) for v in values], f"{column} string")
    return known.join(df.groupBy(column).agg(F.count("*").alias("n")), column, "left").fillna(0, ["n"])
