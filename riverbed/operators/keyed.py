"""Deduplication by key: which row wins, and how rows of one key merge. Ties are always broken by a given order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _numbered(df: DataFrame, keys: list, order: list) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def keep_first(df: DataFrame, keys: list, order: list) -> DataFrame:
    return _numbered(df, keys, order).where("_n = 1").drop("_n")


def keep_last(df: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """``order`` are columns, the largest wins."""
    return keep_first(df, keys, [F.col(c).desc_nulls_last() for c in order])


def fallback_key(first: str, *rest: str) -> Column:
    """The first column, or where it is null or empty the others joined."""
    return F.coalesce(F.nullif(F.trim(F.col(first)), F.lit("")), F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rest]))


def keep_identified(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key; rows with a null or empty key go."""
    return keep_first(df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")), [key], order)


def newest_fields(df: DataFrame, key: str, order: str, fields: list[str], earliest=(), latest=(), any_true=(), removed: str | None = None) -> DataFrame:
    """One row a key: of each field the newest value that is there; minima, maxima and disjunctions of the rest.

    ``removed`` names the time of removal, of which the newest stays where none of the ``any_true`` columns holds.
    """
    there = lambda c: F.when(F.col(c).isNotNull() & (F.col(c).cast("string") != ""), F.col(order))
    made = [F.max_by(c, there(c)).alias(c) for c in [*fields, *([removed] if removed else [])]]
    out = df.groupBy(key).agg(*made, *[F.min(c).alias(c) for c in earliest], *[F.max(c).alias(c) for c in latest], *[F.bool_or(F.coalesce(c, F.lit(True))).alias(c) for c in any_true])
    if removed and any_true:
        gone = ~reduce(lambda x, y: x | y, map(F.col, any_true))
        out = out.withColumn(removed, F.when(gone, F.col(removed)))
    return out


def members_and_parents(df: DataFrame, members: str, key: str, order: str, inherited: list[str]) -> DataFrame:
    """Rows nested in others, then these themselves, with a running number ``place``: members come before all parents.

    A member takes the ``inherited`` columns from its parent where it has none. Rows without a key go.
    """
    fields = df.schema[members].dataType.elementType.fieldNames()
    own = [F.col(f) if f in df.columns else F.lit(None).cast(df.schema[members].dataType.elementType[f].dataType).alias(f) for f in fields]
    inner = df.select(F.col(order).alias("_parent"), *[F.col(c).alias(f"_{c}") for c in inherited], F.posexplode(members).alias("_n", "_m"))
    nested = inner.select(F.struct(F.lit(0).alias("level"), F.col("_parent").alias("parent"), F.col("_n").alias("n")).alias("place"), *[(F.coalesce(F.col(f"_m.{f}"), F.col(f"_{f}")) if f in inherited else F.col(f"_m.{f}")).alias(f) for f in fields])
    parents = df.select(F.struct(F.lit(1).alias("level"), F.col(order).alias("parent"), F.lit(0).alias("n")).alias("place"), *own)
    return nested.unionByName(parents).where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))


def fill_missing(df: DataFrame, key: str, order: str, fields: list[str], mode: str) -> DataFrame:
    """One row a key: of each field the earliest value that is there; the modes that took part, sorted and joined by +."""
    first = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in fields]
    return df.groupBy(key).agg(*first, F.array_join(F.array_sort(F.collect_set(mode)), "+").alias(mode))


def expand_members(df: DataFrame, members: str, key: str, order: list[str]) -> DataFrame:
    """Rows of the nested members, or the row itself without any; then the first of each key."""
    fields = df.schema[members].dataType.elementType.fieldNames()
    rows = df.select(*order, F.explode_outer(members).alias("_m"), *[(F.col(f) if f in df.columns else F.lit(None)).alias(f"_own_{f}") for f in fields])
    return keep_first(rows.select(*order, *[F.coalesce(F.col(f"_m.{f}"), F.col(f"_own_{f}")).alias(f) for f in fields if f not in order]), [key], order)


def distinct_in_order(array: Column) -> Column:
    """Each value once, where it stands first; nulls and empty texts go."""
    return F.array_distinct(F.filter(array, lambda x: x.isNotNull() & (x.cast("string") != "")))


def distinct_candidates(df: DataFrame, group: list[str], values: list[str], order: str, most: int = 300) -> DataFrame:
    """``group, values, place``: the first ``most`` different ``values`` of each group, numbered from 1 as they first come by ``order``.

    Repeats go before anything is sorted, and no task holds or passes on more than ``most`` rows of a group.
    """
    first = df.groupBy(*group, *values).agg(F.min(order).alias("_o"))
    place = F.row_number().over(Window.partitionBy(*group).orderBy("_o", *values))
    return first.withColumn("place", place).where(F.col("place") <= most).drop("_o")
