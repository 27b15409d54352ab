"""Successive snapshots: lifecycle of rows and history of their prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riverbed.operators.windows import last_entries

HISTORY = "array<struct<price:double,at:timestamp,direction:string,change:double>>"


def merge_snapshot(previous: DataFrame, current: DataFrame, runs: DataFrame, gone: DataFrame, as_of: Column, values: list[str]) -> DataFrame:
    """The next state of all rows.

    ``previous``: ``id, source``, ``values`` and ``first_seen, last_seen, new_at, active, removed_at``. ``current``: ``id,
    source``, ``values``. ``runs``: ``source, success, baseline_ready``. ``gone``: ``id`` of rows proven inactive. A source
    that failed, or has no run, keeps its rows as they are. A row seen for the first time is new only if its source has a
    baseline. A row that isn't in the snapshot stays active until it is proven inactive. Ids are unique in each input.
    """
    state = ["first_seen", "last_seen", "new_at", "active", "removed_at"]
    old = previous.select(F.col("id"), F.col("source").alias("p_source"), *[F.col(c).alias(f"p_{c}") for c in [*values, *state]], F.lit(True).alias("had"))
    good = runs.where("success").select("source", "baseline_ready")
    new = current.join(good, "source").select("id", F.col("source").alias("c_source"), *[F.col(c).alias(f"c_{c}") for c in values], "baseline_ready", F.lit(True).alias("has"))
    ok = good.select(F.col("source").alias("p_source"), F.lit(True).alias("ok"))
    rows = old.join(new, "id", "full").join(ok, "p_source", "left").join(gone.select("id", F.lit(True).alias("is_gone")), "id", "left")
    has, had = F.col("has").isNotNull(), F.col("had").isNotNull()
    was_active = F.coalesce(F.col("p_active"), F.lit(True))
    removed = ~has & F.coalesce(F.col("ok"), F.lit(False)) & was_active & F.col("is_gone").isNotNull()
    pick = lambda c: F.when(has, F.col(f"c_{c}")).otherwise(F.col(f"p_{c}"))
    return rows.select(
        "id", F.coalesce("c_source", "p_source").alias("source"), *[pick(c).alias(c) for c in values],
        F.coalesce("p_first_seen", F.when(has, as_of)).alias("first_seen"),
        F.when(has, as_of).otherwise(F.col("p_last_seen")).alias("last_seen"),
        F.when(had, F.col("p_new_at")).when(F.col("baseline_ready"), as_of).alias("new_at"),
        F.when(has, True).when(removed, False).otherwise(was_active).alias("active"),
        F.when(has, None).when(removed, as_of).otherwise(F.col("p_removed_at")).alias("removed_at"),
        F.when(has & had, "seen").when(has, "added").when(removed, "removed").otherwise("kept").alias("event"),
    )


def reset_sources(previous: DataFrame, runs: DataFrame) -> DataFrame:
    """``previous`` without the sources that are ``complete`` now but weren't in their last run (``was_complete``)."""
    upgraded = runs.where(F.col("complete") & ~F.coalesce("was_complete", F.lit(False))).select("source")
    return previous.join(upgraded, "source", "left_anti").select(previous.columns)


def of_version(previous: DataFrame, stored: int | None, wanted: int) -> DataFrame:
    """The previous state, or none of its rows if it was kept by another version, so that a new baseline begins."""
    return previous if stored == wanted else previous.where(F.lit(False))


def run_summary(merged: DataFrame) -> DataFrame:
    """Counts of a run by source."""
    at = lambda test: F.count_if(test)
    return merged.groupBy("source").agg(at(F.col("active")).alias("active"), at((F.col("event") == "added") & F.col("new_at").isNotNull()).alias("new"), at(F.col("event") == "removed").alias("removed"), F.count("*").alias("total"))


def run_messages(summary: DataFrame, runs: DataFrame, mark: str = "；") -> DataFrame:
    """``source, message``: what the last run said, without what an earlier summary put behind the mark, and the new counts."""
    said = F.substring_index(F.coalesce("message", F.lit("")), mark, 1)
    counts = F.format_string("active %d, new %d, removed %d of %d", "active", "new", "removed", "total")
    return summary.join(runs, "source", "left").select("source", F.concat(said, F.lit(mark), counts).alias("message"))


def run_of_source(previous: DataFrame, current: DataFrame, runs: DataFrame, gone: DataFrame, as_of: Column, values: list[str], source: str) -> DataFrame:
    """The next state after a run of one source alone: rows of all others stay as they are."""
    return merge_snapshot(previous, current.where(F.col("source") == source), runs.where(F.col("source") == source), gone, as_of, values)


def track_price(current: DataFrame, previous: DataFrame, as_of: Column, least: float = 0.1, entries: int = 12) -> DataFrame:
    """``current`` (``id, price``) with the change against ``previous`` (``id, price, history`` and the last change).

    Without a price the change and the history end; without a predecessor or its price a history begins. A change of
    ``least`` and more is appended to the history, of which the last ``entries`` stay; else the last change is carried on.
    """
    old = previous.select("id", F.col("price").alias("p_price"), F.coalesce(F.col("history"), F.array().cast(HISTORY)).alias("p_history"), *[F.col(c).alias(f"p_{c}") for c in ("change", "direction", "changed_at")])
    rows = current.join(old, "id", "left")
    entry = lambda price, direction, change: F.array(F.struct(price.alias("price"), as_of.alias("at"), direction.cast("string").alias("direction"), change.cast("double").alias("change"))).cast(HISTORY)
    price, before = F.col("price"), F.col("p_price")
    diff = F.round(price - before, 1)
    moved = F.coalesce(F.abs(diff) >= least, F.lit(False))
    begins = before.isNull()
    direction = F.when(diff > 0, "up").otherwise("down")
    seeded = F.when(F.size("p_history") > 0, F.col("p_history")).otherwise(entry(before, F.lit(None), F.lit(None)))
    history = F.when(price.isNull(), F.array().cast(HISTORY)).when(begins, entry(price, F.lit(None), F.lit(None))).when(moved, last_entries(F.concat(seeded, entry(price, direction, F.abs(diff))), entries)).otherwise(last_entries(seeded, entries))
    keep = price.isNotNull() & ~begins
    return rows.select(
        *current.columns, history.alias("history"),
        F.when(keep & moved, before).alias("previous_price"),
        F.when(keep, F.when(moved, F.abs(diff)).otherwise(F.col("p_change"))).alias("change"),
        F.when(keep, F.when(moved, direction).otherwise(F.col("p_direction"))).alias("direction"),
        F.when(keep, F.when(moved, as_of).otherwise(F.col("p_changed_at"))).alias("changed_at"),
    )
