"""Sources on many texts at once."""

from pyspark.sql import functions as F

from riverbed import further_queries
from riverbed.sources import json_tables


def test_json_is_read_by_parts(spark):
    """Of a batch of 1,000 texts the objects of a few stand in memory at a time."""

    def of(text):
        class Kept(list):
            def __del__(self):
                counts["alive"] -= 1

        counts["alive"] = counts.get("alive", 0) + 1
        return Kept([{"path": str(counts["alive"]), "object": text}])

    counts: dict = {}
    rows = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("t"))
    found = rows.select("t", json_tables._by_parts(F.col("t"), of, json_tables.OBJECTS, json_tables._OBJECTS).alias("o")).collect()
    assert all(r.o[0].object == r.t for r in found) and len(found) == 1000
    assert max(int(r.o[0].path) for r in found) <= 2 * json_tables.TEXTS_AT_ONCE


def test_pages_of_a_small_file_go_to_all_cores(spark):
    cards = further_queries.htm_04_06_cards(spark, "/root/testdata/sf0.001")
    assert cards.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
