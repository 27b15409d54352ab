"""Read queries over listings and groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riverbed.functions.numbers import recency
from riverbed.operators.keyed import fallback_key, keep_first


def canonical_order(published: str = "published", first_seen: str = "first_seen") -> list[Column]:
    """Active rows first, then the latest published (none counts as 0), then the first seen."""
    return [F.coalesce(F.col("active"), F.lit(True)).desc(), F.coalesce(F.col(published), F.lit(0)).desc(), F.col(first_seen).asc_nulls_first()]


def serving_rows(df: DataFrame, rows: int = 600, ties: str = "id") -> DataFrame:
    """The rows that a page shows: the first ones in canonical order. State tables keep all."""
    return df.orderBy(*canonical_order(), ties).limit(rows)


def sorted_by(df: DataFrame, column: str, descending: bool = False, ties: str = "id", nulls_last: bool = True) -> DataFrame:
    key = F.col(column) if nulls_last else F.coalesce(F.col(column), F.lit(0))
    return df.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), ties)


def listing_view(df: DataFrame, as_of: Column, watch: list[str], source: str | None = None, state: str | None = None) -> DataFrame:
    """Listings of the watched roads with their state and road's place; ``state``: removed, new or listed."""
    order = F.array_position(F.array(*map(F.lit, watch)), F.col("road"))
    out = df.withColumns({"state": recency(F.col("active"), F.col("new_at"), as_of), "road_place": order}).where("road_place > 0")
    if source:
        out = out.where(F.col("source") == source)
    return out.where(F.col("state") == state) if state else out


def road_counts(view: DataFrame) -> DataFrame:
    return view.groupBy("road_place", "road").agg(F.count("*").alias("n"), F.count_if(F.col("state") == "new").alias("n_new"), F.min("price").alias("lowest"))


def group_view(groups: DataFrame, comparisons: DataFrame, source: str | None = None, status: str | None = None) -> DataFrame:
    """Groups with their status against the inventory; the candidate shows only for a match or a review."""
    out = groups.join(comparisons, "group_id", "left").withColumn("status", F.coalesce("status", F.lit("missing")))
    out = out.withColumn("candidate", F.when(F.col("status").isin("company_match", "review"), F.col("candidate")))
    if source:
        out = out.where(F.array_contains("sources", source))
    return out.where(F.col("status") == status) if status else out


def source_health(runs: DataFrame, as_of: Column, stale_hours: float = 6) -> DataFrame:
    """never, error, stale or ok by the last run of each source."""
    last = runs.groupBy("source").agg(F.max("checked_at").alias("checked_at"), F.max_by("status", "checked_at").alias("last_status"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("checked_at")) / 3600
    return last.withColumn("health", F.when(F.col("checked_at").isNull(), "never").when(F.col("last_status") != "ok", "error").when(age > stale_hours, "stale").otherwise("ok"))


def matches_or_some(df: DataFrame, matched: str, order: list, rows: int, otherwise: int) -> DataFrame:
    """The first ``rows`` that match or, if none does, the first ``otherwise`` of all. Both are a message's length."""
    first = df.orderBy(F.desc(matched), *order).limit(max(rows, otherwise))
    best = F.bool_or(matched).over(Window.partitionBy())  # over the few rows of a message
    place = F.row_number().over(Window.orderBy(F.desc(matched), *order))
    ranked = first.withColumns({"_any": best, "_p": place})
    return ranked.where((F.col("_any") & F.col(matched) & (F.col("_p") <= rows)) | (~F.col("_any") & (F.col("_p") <= otherwise))).drop("_any", "_p")


def header(df: DataFrame, status: str, names: dict[str, str]) -> DataFrame:
    """One row: all groups, and those of each status under its name."""
    return df.agg(F.count("*").alias("groups"), *[F.count_if(F.col(status) == v).alias(k) for k, v in names.items()])


def search(left: DataFrame, right: DataFrame, wanted: Column, rows: int = 5) -> DataFrame:
    """Both sources together, one row for each address or content, matching rows first."""
    both = left.unionByName(right, allowMissingColumns=True)
    once = keep_first(both.withColumn("_k", fallback_key("url", "source", "title", "address", "price")), ["_k"], ["ord"]).drop("_k")
    return once.withColumn("matched", F.coalesce(wanted, F.lit(False))).orderBy(F.desc("matched"), "ord").limit(rows)


def active_of(df: DataFrame, sources: list[str]) -> DataFrame:
    """Active rows (those that say nothing are) of the allowed sources."""
    return df.where(F.coalesce(F.col("active"), F.lit(True)) & F.col("source").isin(*sources))


def direct_only(text: Column, own: tuple, brand: str) -> Column:
    """Whether a text names the company itself; its franchise's brand alone doesn't."""
    names = F.lit(False)
    for name in own:
        names = names | F.contains(text, F.lit(name))
    return F.when(F.contains(text, F.lit(brand)), names).otherwise(names)


def reply(df: DataFrame, logs: DataFrame, rows: int = 10, otherwise: int = 5, chars: int = 3900) -> DataFrame:
    """One text: the rows that match or else some of any kind or, without rows, the logs; cut to a message's length.

    ``df``: ``ord, source, title, matched``; ``logs``: ``place, log``. All that is gathered are the message's own lines.
    """
    shown = matches_or_some(df, "matched", ["ord"], rows, otherwise).withColumn("_n", F.row_number().over(Window.orderBy("ord")))
    lines = shown.agg(F.array_sort(F.collect_list(F.struct("_n", F.format_string("%d. [%s] %s", "_n", "source", "title").alias("line")))).alias("l"), F.bool_or("matched").alias("found"))
    said = logs.where("log <> ''").orderBy("place").limit(chars).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "log"))), lambda x: F.concat(F.lit("- "), x["log"])), "\n").alias("said"))
    head = F.when(F.size("l") == 0, "nothing").when(F.col("found"), "matched").otherwise("some")
    parts = F.array_compact(F.array(head, F.nullif(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("")), F.nullif("said", F.lit(""))))
    return lines.join(said, how="cross").select(F.substring(F.array_join(parts, "\n"), 1, chars).alias("reply"))  # one row by one row
