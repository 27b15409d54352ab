"""Connected components of a graph that stays distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riverbed.llm.common import materialize


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's own edges as stars around the smallest node of each of its trees; flushed when they are many."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    def stars():
        nodes = [(x, root(x)) for x in parent]
        return pa.RecordBatch.from_arrays([pa.array([r for x, r in nodes if x != r], pa.int64()), pa.array([x for x, r in nodes if x != r], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            parent.setdefault(a, a), parent.setdefault(b, b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 1 << 20:
            yield stars()
            parent.clear()
    yield stars()


def _stars(links: DataFrame) -> bool:
    """Whether each node is either a centre or has one centre."""
    ends = links.select(F.col("a").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.max("up").alias("up"), F.sum("down").alias("down")).where("down > 1 OR (up = 1 AND down > 0)").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``a, b`` (long, undirected, no nulls) to ``node, component``: the smallest node that each node can reach.

    Nodes without an edge to another node aren't returned. Each task first reduces its own edges to stars; then large-star and small-star
    steps alternate until only stars are left, which takes a logarithmic number of rounds. Neighbours are only ever
    aggregated by ``min``, never gathered; every round is written to the shared folder.
    """
    links = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = materialize(links.mapInArrow(_forest, "a long, b long").distinct(), "links")
    while not _stars(links):
        both = links.union(links.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")
        large = large.distinct()
        # small star: each node's smaller neighbours and itself go to the smallest of them
        down = large.toDF("v", "u")
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).union(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        links = materialize(small.where("a <> b").distinct(), "links")
    centres = links.select("a").distinct().select(F.col("a").alias("node"), F.col("a").alias("component"))
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).union(centres)
