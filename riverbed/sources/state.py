"""State tables: snapshots by run, read back as of a run, and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, path: str, run: str) -> None:
    """Overwrites the run's own partition only, also with no rows, so a repeated run gives the same table. Runs sort as texts."""
    df.write.mode("overwrite").parquet(f"{path}/run=run {run}")


def read_snapshot(spark: SparkSession, path: str, before: str | None = None) -> DataFrame:
    """The latest snapshot, or the latest one before a run; no rows if there is none."""
    table = spark.read.parquet(path)
    runs = table.select("run").where(F.col("run") < f"run {before}") if before else table.select("run")
    last = runs.agg(F.max("run")).first()[0]
    return table.where(F.col("run") == (last or "")).drop("run")


def write_export(tables: dict[str, DataFrame], path: str) -> None:
    """The tables of an export, each in its own folder."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows, and old ones of other keys."""
    return new.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def report_lines(df: DataFrame, line: Column, order: list, rows: int = 10, chars: int = 4000) -> DataFrame:
    """One text: the first rows' lines, cut to a message's length."""
    top = df.orderBy(*order).limit(rows).withColumn("_n", F.row_number().over(_all(order))).select("_n", line.alias("_l"))
    return top.agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_l"))), lambda s: s["_l"]), "\n"), 1, chars).alias("report"))


def _all(order: list):
    from pyspark.sql import Window

    return Window.orderBy(*order)  # over the few rows of a report
