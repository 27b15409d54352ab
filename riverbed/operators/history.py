"""Any earlier state: intervals in which a row stood as it is, made of snapshots, and reads as of any instant.

A row of a snapshot that is as it was before adds nothing, so storage grows with changes, not with runs. Instants are seconds
since 1970. An interval takes in its beginning, not its end; one without an end still holds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Open intervals end here, in seconds since 1970; instants lie before it.
FOREVER = 1 << 40
#: Levels of blocks of 1, 2, 4 ... seconds.
LEVELS = 40


def _same(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return reduce(lambda x, y: x & y, [a[c].eqNullSafe(b[c]) for c in a], F.lit(True))


def validity_intervals(snapshots: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """``key, values, valid_from, valid_to`` of all snapshots: rows of one ``at`` are a run, ``at`` in seconds.

    An interval begins where a row comes, comes back or changes, and ends with the first run in which it is gone or otherwise.
    Keys are unique within a run.
    """
    runs = snapshots.select(at).distinct()
    order = Window.orderBy(at)  # a row for each run
    runs = runs.select(at, F.row_number().over(order).alias("_run"), F.lead(at).over(order).alias("_next"))
    w = Window.partitionBy(*key).orderBy("_run")
    rows = snapshots.join(runs, at)
    before = {c: F.lag(c).over(w) for c in values}
    goes_on = (F.lag("_run").over(w) == F.col("_run") - 1) & _same({c: F.col(c) for c in values}, before)
    rows = rows.withColumn("_new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("_n", F.sum("_new").over(w))
    ends = F.max_by("_next", "_run")
    return rows.groupBy(*key, "_n").agg(*[F.min_by(c, "_run").alias(c) for c in values], F.min(at).alias("valid_from"), ends.alias("valid_to")).drop("_n")


def next_intervals(held: DataFrame, snapshot: DataFrame, key: list[str], at: Column, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """Of the open intervals ``held`` and the next run's ``snapshot``: the intervals that it closes, and those open after it.

    The closed ones are only ever appended; what is compared and written again is the current state, not the history.
    """
    new = snapshot.select(*key, *[F.col(c).alias(f"_{c}") for c in values], F.lit(True).alias("_here"))
    both = held.withColumn("_held", F.lit(True)).join(new, key, "full")
    same = F.coalesce(F.col("_held") & F.col("_here") & _same({c: F.col(c) for c in values}, {c: F.col(f"_{c}") for c in values}), F.lit(False))
    closed = both.where(F.col("_held") & ~same).select(*key, *values, "valid_from", at.alias("valid_to"))
    kept = both.where(same).select(*key, *values, "valid_from", "valid_to")
    opened = both.where(F.col("_here") & ~same).select(*key, *[F.col(f"_{c}").alias(c) for c in values], at.alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))
    return closed, kept.unionByName(opened)


def as_of(intervals: DataFrame, instant: Column) -> DataFrame:
    """The state at one instant, without its interval."""
    return intervals.where((F.col("valid_from") <= instant) & (F.coalesce("valid_to", F.lit(FOREVER)) > instant)).drop("valid_from", "valid_to")


def interval_blocks(begin: Column, end: Column) -> Column:
    """An interval of whole seconds as the fewest blocks of 2^level seconds that begin at a multiple of their length: two a level at most."""

    def of_level(level: Column) -> Column:
        size = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        low, high = F.call_function("div", begin + size - 1, size), F.call_function("div", end, size)  # whole blocks inside
        odd_low, odd_high = (low % 2 == 1) & (low < high), (high % 2 == 1) & (low < high)
        block = lambda n: F.struct(level.alias("level"), n.alias("block"))
        return F.array_compact(F.array(F.when(odd_low, block(low)), F.when(odd_high, block(high - 1))))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), of_level))


def instant_blocks(instant: Column) -> Column:
    """The block of each level in which an instant lies."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda n: F.struct(n.alias("level"), F.call_function("shiftright", instant, n).alias("block")))


def states_at(intervals: DataFrame, instants: DataFrame, instant: str) -> DataFrame:
    """Each row of ``instants`` with every row that held then.

    Intervals are cut into blocks of lengths that are powers of two, so that they meet instants by equality of blocks: some 2 log
    (length) rows an interval and :data:`LEVELS` an instant, and no pair is made that doesn't match. Instants from 1970 on.
    """
    blocks = interval_blocks(F.greatest(F.col("valid_from"), F.lit(0)), F.coalesce("valid_to", F.lit(FOREVER)))
    one = intervals.withColumn("_b", F.explode(blocks))
    two = instants.withColumn("_b", F.explode(instant_blocks(F.col(instant))))
    return two.join(one, "_b").drop("_b", "valid_from", "valid_to")


def counts_at(intervals: DataFrame, instants: DataFrame, instant: str, by: list[str], count: str) -> DataFrame:
    """Each row of ``instants`` with the number of rows that held then, by their columns ``by`` (no row where none did).

    As :func:`states_at`, with the rows of a block counted before they meet instants, and equal instants met once: what is
    joined grows with blocks and instants, not with their pairs.
    """
    blocks = interval_blocks(F.greatest(F.col("valid_from"), F.lit(0)), F.coalesce("valid_to", F.lit(FOREVER)))
    held = intervals.select(*by, F.explode(blocks).alias("_b")).groupBy("_b", *by).agg(F.count("*").alias("_n"))
    moments = instants.select(F.col(instant).alias("_t")).where("_t is not null").distinct()
    found = moments.select("_t", F.explode(instant_blocks(F.col("_t"))).alias("_b")).join(held, "_b").groupBy("_t", *by).agg(F.sum("_n").alias(count))
    return instants.join(found.withColumnRenamed("_t", instant), instant)
