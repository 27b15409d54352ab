"""Histories, reads at any instant, groups kept up to date, and listings as a stateful stream."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from riverbed.operators import graph, history, snapshots
from riverbed.streaming import lifecycle

ROW = "id string, price double, kind string, at long"


def make_runs(rng, n):
    runs, rows = [], {}
    for k in range(n):
        for i in range(12):
            u = rng.random()
            if u < 0.2:
                rows.pop(f"i{i}", None)
            elif u < 0.5:
                rows[f"i{i}"] = (rng.choice([1.0, 2.0, None]), rng.choice("ab"))
        runs.append((1000 + 37 * k + rng.randrange(9), dict(rows)))
    return [r for r in runs if r[1]]


@pytest.fixture(scope="module")
def runs():
    return make_runs(random.Random(8), 14)


@pytest.fixture(scope="module")
def intervals(spark, runs):
    rows = [(i, p, k, at) for at, state in runs for i, (p, k) in state.items()]
    return history.validity_intervals(spark.createDataFrame(rows, ROW), ["id"], "at", ["price", "kind"]).cache()


def test_intervals_hold_changes_only(runs, intervals):
    want = set()
    for i in {i for _, state in runs for i in state}:
        for state, part in itertools.groupby(enumerate(runs), lambda r: r[1][1].get(i)):
            part = list(part)
            if state is not None:
                last = part[-1][0]
                want.add((i, *state, part[0][1][0], runs[last + 1][0] if last + 1 < len(runs) else None))
    got = [tuple(r) for r in intervals.select("id", "price", "kind", "valid_from", "valid_to").collect()]
    assert set(got) == want and len(got) == len(want) < sum(len(s) for _, s in runs)


def test_a_thousand_instants(spark, runs, intervals):
    first, last = runs[0][0], runs[-1][0]
    moments = [0, first - 1, last + 10**6, *range(first - 5, last + 5)] + random.Random(1).choices(range(last + 100), k=700)
    instants = spark.createDataFrame([(n, t) for n, t in enumerate(moments)], "n int, t long")
    got: dict = {}
    for r in history.states_at(intervals, instants, "t").collect():
        assert r.id not in got.setdefault(r.n, {})
        got[r.n][r.id] = (r.price, r.kind)
    for n, t in enumerate(moments):
        known = [s for at, s in runs if at <= t]
        assert got.get(n, {}) == (known[-1] if known else {})
    one = runs[5][0] + 1
    assert {r.id: (r.price, r.kind) for r in history.as_of(intervals, F.lit(one)).collect()} == runs[5][1]


def test_run_by_run(spark, runs, intervals):
    held, closed = spark.createDataFrame([], "id string, price double, kind string, valid_from long, valid_to long"), []
    for at, state in runs:
        snapshot = spark.createDataFrame([(i, *x, at) for i, x in state.items()], ROW)
        done, held = history.next_intervals(held, snapshot, ["id"], F.lit(at).cast("long"), ["price", "kind"])
        closed += [tuple(r) for r in done.collect()]
        held = spark.createDataFrame(held.collect(), held.schema)
    columns = ["id", "price", "kind", "valid_from", "valid_to"]
    assert sorted(closed + [tuple(r) for r in held.select(columns).collect()], key=repr) == sorted((tuple(r) for r in intervals.select(columns).collect()), key=repr)


def test_blocks_cover_an_interval_once(spark):
    rng = random.Random(2)
    spans = [(a, a + rng.choice([0, 1, 2, 3, 100, 12345])) for a in (rng.randrange(100_000) for _ in range(60))] + [(0, 1 << 40), (5, 5), (1, 2)]
    rows = spark.createDataFrame(spans, "a long, b long").select("a", "b", history.interval_blocks(F.col("a"), F.col("b")).alias("x")).collect()
    for r in rows:
        parts = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.x)
        assert [p for p in parts] == sorted(parts) and len(parts) <= 80
        edge = r.a
        for low, high in parts:
            assert low == edge
            edge = high
        assert edge == max(r.b, r.a)


def test_groups_kept_up_to_date(spark):
    """Ten runs in a row: only touched components are worked out, and all is as in a full run."""
    rng = random.Random(4)
    edges: set = set()
    groups = spark.createDataFrame([], "node long, component long, cluster long")
    known = spark.createDataFrame([], "a long, b long")
    for _ in range(10):
        gone = {e for e in edges if rng.random() < 0.15}
        new = {tuple(sorted(rng.sample(range(70), 2))) for _ in range(14)}
        frame = lambda x: spark.createDataFrame(sorted(x), "a long, b long")
        groups, known = graph.update_groups(groups, known, frame(new), frame(gone))
        groups = spark.createDataFrame(groups.collect(), groups.schema)
        edges = edges - gone | new
        assert {tuple(r) for r in known.collect()} == edges
        first, lowest = {}, {}
        for node in sorted({x for e in edges for x in e}):  # first fit: the smallest cluster of an earlier neighbour
            first[node] = min([first[a] for a, b in edges if b == node], default=node)
            lowest[node] = node
        for _ in range(len(lowest)):
            for a, b in edges:
                lowest[a] = lowest[b] = min(lowest[a], lowest[b])
        assert {tuple(r) for r in groups.collect()} == {(n, lowest[n], first[n]) for n in first}


FEED = "id string, source string, price double, at timestamp, gone boolean, baseline_ready boolean"


@pytest.fixture
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_listings_as_a_stateful_stream(spark, state_store, tmp_path):
    """States are those of the batch merge, run by run, also where a batch fails and the stream starts again."""
    rng, day = random.Random(3), dt.timedelta(days=6)
    start, days = dt.datetime(2024, 1, 1), 7
    current, merged = [], spark.createDataFrame([], "id string, source string, price double, first_seen timestamp, last_seen timestamp, new_at timestamp, active boolean, removed_at timestamp")
    feed = str(tmp_path / "feed")
    for k in range(days):
        at = start + k * day
        seen = {f"i{i}": rng.choice([1.0, 2.0, None]) for i in range(9) if rng.random() < 0.6 and i <= 2 * k + 3}
        gone = sorted({f"i{i}" for i in range(9) if rng.random() < 0.3} - set(seen))
        ready = k > 0
        rows = [(i, "s", p, at, False, ready) for i, p in seen.items()] + [(i, "s", None, at, True, ready) for i in gone] + [("tick", "s", 1.0, at, False, False)]
        spark.createDataFrame(rows, FEED).coalesce(1).write.mode("append").parquet(feed)
        runs = spark.createDataFrame([("s", True, ready)], "source string, success boolean, baseline_ready boolean")
        now = spark.createDataFrame([(i, "s", p) for i, p in seen.items()], "id string, source string, price double")
        merged = snapshots.merge_snapshot(merged, now, runs, spark.createDataFrame([(i,) for i in gone], "id string"), F.lit(at), ["price"]).drop("event")
        merged = spark.createDataFrame(merged.collect(), merged.schema)
    out, failed = str(tmp_path / "out"), []

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if number == 3 and not failed:
            failed.append(number)
            raise ValueError("lost")

    def go():
        stream = spark.readStream.schema(FEED).option("maxFilesPerTrigger", 1).parquet(feed)
        query = lifecycle.lifecycle_events(stream, "1 second").writeStream.foreachBatch(write).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination()

    with pytest.raises(Exception, match="lost"):
        go()
    go()
    events = spark.read.parquet(out)
    ms = lambda c: F.unix_millis(c).alias(c)
    want = merged.select("id", "source", "price", ms("first_seen"), ms("last_seen"), ms("new_at"), "active", ms("removed_at"))
    got = lifecycle.latest_states(events).where("id <> 'tick'")
    assert failed and sorted(map(tuple, got.collect())) == sorted((tuple(r) for r in want.collect()), key=lambda r: r[0])
    # new ones that are still there after 14 days are told once, when the watermark has passed that time
    told = {r.id: r.at for r in events.where("event = 'listed'").collect()}
    new = {r.id: r.new_at for r in got.collect() if r.new_at is not None}
    assert told and all(new[i] + 14 * 86_400_000 == t for i, t in told.items()) and events.where("event = 'listed'").count() == len(told)


def test_counts_at_are_those_of_the_states(spark):
    """Counted by blocks before they meet instants, so no instant meets each row that holds (F11)."""
    rng = random.Random(3)
    made = [(k, rng.choice("ab"), (b := rng.randrange(200)), rng.choice([None, b + rng.randrange(1, 90)])) for k in range(80)]
    intervals = spark.createDataFrame(made, "id int, kind string, valid_from long, valid_to long")
    instants = spark.createDataFrame([(k, rng.choice([None, *range(0, 260, 7)])) for k in range(60)], "at int, t long")
    want = {(r.at, r.kind, r["count"]) for r in history.states_at(intervals, instants, "t").groupBy("at", "kind").count().collect()}
    assert {(r.at, r.kind, r.n) for r in history.counts_at(intervals, instants, "t", ["kind"], "n").collect()} == want
