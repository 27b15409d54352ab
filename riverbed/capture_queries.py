"""Queries of captured payloads and pages, of lookups, resets and guards."""

from __future__ import annotations

from pyspark.sql import functions as F

from riverbed.functions import numbers as N
from riverbed.functions import text as T
from riverbed.operators import guards, joins, snapshots, windows
from riverbed.plans import views
from riverbed.plans.samples import table
from riverbed.queries import query
from riverbed.sources import html_pages, json_tables


@query("""SELECT event_id, 0 AS place, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, 1, user_id FROM events""")
def src_06_08_embedded_json(spark, sf_dir):
    """Items of the JSON script of a page; each event makes one page."""
    e = table(spark, sf_dir, "events")
    page = F.concat(F.lit('<html><script>var a;</script><script id="__NEXT_DATA__" type="application/json">{"props": {"list": ['), "props", F.lit(', {"k": '), "user_id", F.lit("}]}}</script></html>"))
    bodies = e.select("event_id", F.try_element_at(json_tables.embedded_scripts(page), F.lit(1)).alias("body"))
    rows = bodies.select("event_id", F.posexplode(json_tables.items_of(F.col("body"), ("$.props.list",))).alias("place", "item"))
    return rows.select("event_id", F.col("place").cast("long").alias("place"), json_tables.field(F.col("item"), "k", kind="bigint").alias("k"))


@query("""WITH r AS (SELECT DISTINCT o_custkey, year(o_orderdate) AS page, o_orderpriority AS id FROM orders), f AS (SELECT *, min(page) OVER (PARTITION BY o_custkey, id) AS first FROM r),
 p AS (SELECT o_custkey, page, count(*) AS n, count(*) FILTER (WHERE page = first) AS n_new FROM f GROUP BY ALL),
 s AS (SELECT *, coalesce(max(CASE WHEN n_new = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM p)
 SELECT o_custkey, page, n, n_new FROM s WHERE stopped = 0""")
def src_09_12_paginated_scan(spark, sf_dir):
    """Pages of a scan up to the first one without a new id; a customer's years are pages, priorities are ids."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").cast("long").alias("page"), F.col("o_orderpriority").alias("id"))
    return windows.until_nothing_new(o, ["o_custkey"], "page", "id")


@query("""SELECT c_custkey, c_nationkey FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey % 7 <> 0 AND n_regionkey <> 2 AND (n_regionkey <> 1 OR n_nationkey % 2 = 0) AND n_nationkey * 5 BETWEEN -10 AND 90""")
def src_13_15_accepted_inventory(spark, sf_dir):
    """Inventory rows of the partitions whose capture is fresh, complete and not empty."""
    k, region = F.col("n_nationkey"), F.col("n_regionkey")
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    status = table(spark, sf_dir, "nation").select(
        k.alias("c_nationkey"), F.when(k % 7 == 0, 503).otherwise(200).alias("http"), F.lit(True).alias("available"), F.when(region == 2, 0).otherwise(9).alias("count"), (region == 1).alias("pagination_expected"),
        (k % 2 == 0).alias("pagination_complete"), F.timestamp_seconds(F.unix_timestamp(now) - k * 300).alias("captured_at"),
    )
    good = status.where(guards.acceptance(now) == "ok").select("c_nationkey")
    return table(spark, sf_dir, "customer").join(F.broadcast(good), "c_nationkey", "left_semi").select("c_custkey", "c_nationkey")


@query("""WITH d AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS v FROM orders GROUP BY o_custkey)
 SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE v END AS value, CASE WHEN c_acctbal > 0 THEN 'own' WHEN v IS NOT NULL THEN 'detail' ELSE 'none' END AS origin FROM customer LEFT JOIN d USING (c_custkey)""")
def src_20_21_flt_09_detail_lookup(spark, sf_dir):
    """A missing attribute from captured details; only rows that lack it are looked up."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("value"))
    details = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("value"))
    return joins.fill_from(c, details, "c_custkey", "value", "origin")


@query("""SELECT p_partkey, '好屋' || p_partkey AS title, '板橋區光復街' || p_partkey || '號' AS numbered, '板橋區中山路二段' || (1 + p_partkey % 90) || '巷' AS lane, CAST(10 + p_partkey % 10 AS INTEGER) AS floor FROM part""")
def str_07_11_12_20_badges_and_addresses(spark, sf_dir):
    k = F.col("p_partkey")
    ten = F.concat(F.lit("十"), F.element_at(F.array(*map(F.lit, ["", "一", "二", "三", "四", "五", "六", "七", "八", "九"])), (k % 10 + 1).cast("int")))
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("AI煥裝優質好屋"), k).alias("t"), F.concat(F.lit("板橋區 光復街"), k, F.lit("號")).alias("a"), F.concat(F.lit("板橋區中山路二段"), 1 + k % 90, F.lit("巷 x")).alias("b"), ten.alias("n"))
    return p.select("p_partkey", T.strip_badges("t").alias("title"), T.numbered_address("a").alias("numbered"), T.lane_address("b").alias("lane"), T.numeral("n").cast("int").alias("floor"))


@query("""SELECT p_partkey, format('{:,}', 1000 + p_partkey) AS shown, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_partkey AS VARCHAR) ELSE p_partkey || '.5' END AS short,
 CASE WHEN p_partkey % 3 = 0 THEN p_retailprice ELSE p_partkey + 300.0 END AS price FROM part""")
def num_04_09_10_shown_numbers(spark, sf_dir):
    k = F.col("p_partkey")
    shown, half = N.thousands(1000 + k), N.shortened(k + F.when(k % 2 == 0, 0.0).otherwise(0.5))
    price = N.own_price(F.when(k % 3 == 0, F.col("p_retailprice")), F.concat(300 + k, F.lit("萬")))
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("shown"), half.alias("short"), price.alias("price"))


@query("""SELECT p_partkey, [CAST(1 + p_partkey % 9 AS INTEGER)] AS floors FROM part""")
def flr_09_title_floors(spark, sf_dir):
    k = F.col("p_partkey")
    han = F.element_at(F.array(*map(F.lit, ["一", "二", "三", "四", "五", "六", "七", "八", "九"])), (k % 9 + 1).cast("int"))
    title = F.when(k % 2 == 0, F.concat(F.lit("好"), 1 + k % 9, F.lit("樓"))).otherwise(F.concat(F.lit("好"), han, F.lit("樓三房")))
    return table(spark, sf_dir, "part").select("p_partkey", N.title_floors(title).alias("floors"))


@query("SELECT c_custkey, c_mktsegment AS source FROM customer WHERE c_mktsegment <> (SELECT min(c_mktsegment) FROM customer)")
def sta_04_source_reset(spark, sf_dir):
    """State without the rows of a source that is complete for the first time; its next snapshot is its baseline."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("source"))
    first = c.agg(F.min("source").alias("first"))
    runs = c.select("source").distinct().join(F.broadcast(first), F.lit(True)).select("source", F.lit(True).alias("complete"), (F.col("source") != F.col("first")).alias("was_complete"))
    return snapshots.reset_sources(c, runs)


@query("""SELECT p_partkey AS id, p_retailprice AS price, CAST(NULL AS DOUBLE) AS previous_price, CAST(NULL AS DOUBLE) AS change, 1 AS entries FROM part""")
def sta_02_new_baseline(spark, sf_dir):
    """Prices tracked against a state of another version: all histories begin anew."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_retailprice").alias("price"))
    old = p.select("id", (F.col("price") + 10).alias("price"), F.lit(None).cast(snapshots.HISTORY).alias("history"), F.lit(5.0).alias("change"), F.lit("up").alias("direction"), F.lit(None).cast("timestamp").alias("changed_at"))
    out = snapshots.track_price(p, snapshots.of_version(old, stored=2, wanted=3), F.lit("2024-02-01 00:00:00").cast("timestamp"))
    return out.select("id", "price", "previous_price", "change", F.size("history").alias("entries"))


@query("""WITH n AS (SELECT c_nationkey, count(*) FILTER (WHERE c_acctbal > 9000) AS count FROM customer GROUP BY c_nationkey) SELECT c_nationkey, count, count > 0 AND c_nationkey % 6 <> 0 AS available FROM n""")
def dq_02_05_empty_is_unavailable(spark, sf_dir):
    """A partition without rows, or whose pages aren't complete, can't be used."""
    n = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") > 9000).alias("count"))
    status = n.withColumns({"available": F.lit(True), "pagination_expected": F.lit(True), "pagination_complete": F.col("c_nationkey") % 6 != 0})
    return guards.only_complete(status).select("c_nationkey", "count", "available")


@query("""SELECT event_id, '$.a[1]' AS path, 'u' || user_id AS id FROM events""")
def jsn_05_06_relevant_objects(spark, sf_dir):
    """Objects that hold an id in one of their own values; the id also stands in a key, which doesn't count."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"a": [{"o": '), "props", F.lit('}, {"id": "U'), "user_id", F.lit('", "x": 1}], "k'), "user_id", F.lit('": {"y": [1, 2]}}'))
    leaves = e.select("event_id", F.concat(F.lit("u"), "user_id").alias("id"), json_tables.walk_json(body, 10, 200).alias("leaves"))
    return leaves.select("event_id", F.explode(json_tables.objects_with(F.col("leaves"), F.col("id"))).alias("path"), "id")


@query("""SELECT page_id, CAST(page_id * 3 AS INTEGER) AS total, '樓層：' || (1 + page_id % 9) || '/12樓' AS snippet FROM pages""")
def htm_07_08_11_labels(spark, sf_dir):
    """A page's number of results, and what stands around a label."""
    k = F.col("page_id")
    page = F.concat(F.lit("<p>全部 ("), k * 3, F.lit(")</p> 樓層："), 1 + k % 9, F.lit("/12樓"))
    found = T.snippets(page, "樓層：[0-9]+/[0-9]+樓", 0)
    return table(spark, sf_dir, "pages").select("page_id", html_pages.total_results(page).alias("total"), F.try_element_at(found, F.lit(1)).alias("snippet"))


@query("""WITH r AS (SELECT *, contains(p_name, 'red') AS matched FROM part), n AS (SELECT count(*) FILTER (WHERE matched) AS m FROM r),
 k AS (SELECT *, row_number() OVER (ORDER BY matched DESC, p_partkey) AS place FROM r) SELECT p_partkey, matched FROM k, n WHERE CASE WHEN m > 0 THEN matched AND place <= 10 ELSE place <= 5 END""")
def srt_04_matches_or_some(spark, sf_dir):
    """A reply's rows: ten that match, or five of any kind if none does."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.contains("p_name", F.lit("red")).alias("matched"))
    return views.matches_or_some(p, "matched", ["p_partkey"], 10, 5)


@query("""WITH s AS (SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL) SELECT sum(n)::BIGINT AS groups, coalesce(sum(n) FILTER (WHERE status = 'F'), 0)::BIGINT AS n_f,
 coalesce(sum(n) FILTER (WHERE status = 'O'), 0)::BIGINT AS n_o, coalesce(sum(n) FILTER (WHERE status = 'X'), 0)::BIGINT AS n_x FROM s""")
def snk_02_header(spark, sf_dir):
    """Header of a comparison: how many groups there are, and how many of each status, zeros too."""
    return views.header(table(spark, sf_dir, "orders"), "o_orderstatus", {"n_f": "F", "n_o": "O", "n_x": "X"})


@query("""WITH m AS (SELECT o_custkey AS cluster, count(*) AS n, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen, bool_or(o_orderstatus <> 'F') AS active, max(o_orderdate) FILTER (WHERE o_orderstatus = 'F') AS gone,
 count(*) FILTER (WHERE o_orderstatus <> 'F') AS active_count, min(o_orderdate) FILTER (WHERE o_totalprice > 300000) AS new_at, count(*) FILTER (WHERE o_totalprice > 300000) AS n_new FROM orders GROUP BY o_custkey)
 SELECT cluster, first_seen, last_seen, CASE WHEN n_new = n THEN new_at END AS new_at, active, CASE WHEN NOT active THEN gone END AS removed_at, active_count FROM m""")
def er_06_07_cluster_lifecycle(spark, sf_dir):
    """Orders of a customer as one cluster; it is new only if all of its rows are."""
    o, date = table(spark, sf_dir, "orders"), F.col("o_orderdate")
    rows = o.select(F.col("o_custkey").alias("cluster"), date.alias("first_seen"), date.alias("last_seen"), F.when(F.col("o_totalprice") > 300000, date).alias("new_at"), (F.col("o_orderstatus") != "F").alias("active"), F.when(F.col("o_orderstatus") == "F", date).alias("removed_at"))
    from riverbed.operators.entities import cluster_lifecycle

    return cluster_lifecycle(rows, all_new=True)
