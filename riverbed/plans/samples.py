"""Listings, inventories and captures made of the sample tables, on which the queries run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings: the brand is the road, the size the area, the type the address."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("ord"), F.concat(F.lit("s"), F.col("p_partkey") % 3, F.lit(":"), F.col("p_partkey")).alias("id"),
        F.concat(F.lit("s"), F.col("p_partkey") % 3).alias("source"), F.col("p_brand").alias("road"), F.col("p_name").alias("title"),
        F.col("p_type").alias("address"), F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("area"),
    )


LISTINGS_SQL = """SELECT p_partkey AS ord, 's' || (p_partkey % 3) || ':' || p_partkey AS id, 's' || (p_partkey % 3) AS source,
 p_brand AS road, p_name AS title, p_type AS address, p_retailprice AS price, CAST(p_size AS DOUBLE) AS area FROM part"""

#: Homes made of parts, as SQL and as columns: titles with rooms, features and floors, addresses of five kinds, ids that come twice.
HOMES_SQL = """SELECT p_partkey AS ord, 's' || (p_partkey % 3) || ':' || CASE WHEN p_partkey % 50 = 0 AND p_partkey > 0 THEN p_partkey - 3 ELSE p_partkey END AS id, 's' || (p_partkey % 3) AS source, p_brand AS road,
 p_name || CASE p_partkey % 8 WHEN 0 THEN ' 三房邊間' WHEN 4 THEN ' 三房邊間' WHEN 1 THEN ' 頂加內外梯' WHEN 5 THEN ' 頂加內外梯' WHEN 3 THEN ' 5樓景觀' WHEN 7 THEN ' 6樓景觀' ELSE '' END AS title,
 CASE p_partkey % 5 WHEN 0 THEN '光復街' || (p_partkey % 7) || '號' WHEN 1 THEN '中山路二段' || (p_partkey % 4 + 1) || '巷' WHEN 2 THEN '明月社區板橋區' WHEN 3 THEN '清風社區板橋區' ELSE p_type END AS address,
 CAST(900 + (p_partkey % 5) * 20 AS DOUBLE) AS price, CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_size % 12 AS DOUBLE) + (p_partkey % 7) * CAST(0.05 AS DOUBLE) END AS area FROM part"""


def homes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")

    def of(value, texts: dict):
        out = None
        for n, text in texts.items():
            out = F.when(value == n, text) if out is None else out.when(value == n, text)
        return out

    endings = of(k % 8, {n: F.lit(t) for n, t in {0: " 三房邊間", 4: " 三房邊間", 1: " 頂加內外梯", 5: " 頂加內外梯", 3: " 5樓景觀", 7: " 6樓景觀"}.items()}).otherwise("")
    address = of(k % 5, {0: F.concat(F.lit("光復街"), k % 7, F.lit("號")), 1: F.concat(F.lit("中山路二段"), k % 4 + 1, F.lit("巷")), 2: F.lit("明月社區板橋區"), 3: F.lit("清風社區板橋區")})
    return p.select(
        k.alias("ord"), F.concat(F.lit("s"), k % 3, F.lit(":"), F.when((k % 50 == 0) & (k > 0), k - 3).otherwise(k)).alias("id"), F.concat(F.lit("s"), k % 3).alias("source"), F.col("p_brand").alias("road"),
        F.concat("p_name", endings).alias("title"), address.otherwise(F.col("p_type")).alias("address"), (900 + (k % 5) * 20).cast("double").alias("price"),
        F.when(k % 17 != 0, (F.col("p_size") % 12).cast("double") + (k % 7).cast("double") * 0.05).alias("area"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, body``: each conversation as a JSON document with its turns in order."""
    turn = F.struct("turn", "role", "text")
    lists = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    return lists.select("conv_id", F.to_json(F.struct(F.col("conv_id").alias("id"), turns.alias("turns")), {"ignoreNullFields": "false"}).alias("body"))
