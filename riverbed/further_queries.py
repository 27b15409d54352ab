"""Queries of states on disk, scans, floors, titles, filters, reports and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from riverbed.functions import numbers as N
from riverbed.functions import text as T
from riverbed.operators import entities, guards, joins, keyed, snapshots, windows
from riverbed.operators.shared import shared_dir, spread
from riverbed.plans import views
from riverbed.plans.samples import LISTINGS_SQL, conversations, listings, table
from riverbed.queries import query
from riverbed.sources import html_pages, json_tables, state


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# states on disk


@query("SELECT c_custkey, c_acctbal, 'read' AS origin FROM customer UNION ALL SELECT s_suppkey, s_acctbal, 'missing' FROM supplier")
def src_01_02_17_state_documents(spark, sf_dir):
    """Rows of state documents, written as JSON first; where there is no document, the given rows."""
    c, path = table(spark, sf_dir, "customer"), _place(spark, "state")
    c.groupBy((F.col("c_custkey") % 7).alias("part")).agg(F.collect_list(F.struct("c_custkey", "c_acctbal")).alias("listings")).write.partitionBy("part").json(path)
    kept = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("c_acctbal"))
    schema = "c_custkey long, c_acctbal double"
    read = [json_tables.read_state(spark, p, schema, missing=kept).withColumn("origin", F.lit(o)) for p, o in ((path, "read"), (path + "-not-there", "missing"))]
    return read[0].unionByName(read[1])


@query("SELECT event_id, user_id, 'last' AS version FROM events WHERE user_id % 3 = 1 UNION ALL SELECT event_id, user_id, 'before' FROM events WHERE user_id % 3 = 0")
def src_03_snk_01_snapshots(spark, sf_dir):
    """Three runs' snapshots, the second written again and the third without rows: the latest one, and the one before a run."""
    e, path = table(spark, sf_dir, "events").select("event_id", "user_id"), _place(spark, "snapshots")
    for run, rest in (("r1", 0), ("r2", 2), ("r2", 1)):
        state.write_snapshot(e.where(F.col("user_id") % 3 == rest), path, run)
    last = state.read_snapshot(spark, path).withColumn("version", F.lit("last"))
    return last.unionByName(state.read_snapshot(spark, path, "r2").withColumn("version", F.lit("before")))


@query("""SELECT 'groups' AS part, o_custkey AS id, array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), '+') AS content FROM orders GROUP BY o_custkey
 UNION ALL SELECT 'comparisons', o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'header', count(*) FILTER (WHERE o_orderstatus = 'F'), 'F' FROM orders""")
def snk_02_export(spark, sf_dir):
    """Groups, comparisons and their header as three tables, written and read back; all their rows."""
    o, path = table(spark, sf_dir, "orders"), _place(spark, "export")
    groups = o.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderstatus")).alias("sources"))
    state.write_export({"groups": groups, "comparisons": o.where("o_orderstatus = 'P'"), "header": views.header(o, "o_orderstatus", {"n_f": "F"})}, path)
    contents = {"groups": ("o_custkey", F.array_join("sources", "+")), "comparisons": ("o_orderkey", F.col("o_orderpriority")), "header": ("n_f", F.lit("F"))}
    rows = [spark.read.parquet(f"{path}/{name}").select(F.lit(name).alias("part"), F.col(key).cast("long").alias("id"), content.alias("content")) for name, (key, content) in contents.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query("""WITH r AS (SELECT p_partkey AS ord, p_brand AS source, p_name AS title, contains(p_name, 'red') AS matched, row_number() OVER (ORDER BY contains(p_name, 'red') DESC, p_partkey) AS n FROM part),
 m AS (SELECT 'matched' AS branch, 'matched' || chr(10) || string_agg(n || '. [' || source || '] ' || title, chr(10) ORDER BY n) || chr(10) || '- one' || chr(10) || '- two' AS reply FROM r WHERE matched AND n <= 10),
 f AS (SELECT 'some' AS branch, 'some' || chr(10) || string_agg(k || '. [' || p_brand || '] ' || p_name, chr(10) ORDER BY k) AS reply FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS k FROM part) WHERE k <= 5)
 SELECT * FROM m UNION ALL SELECT * FROM f UNION ALL SELECT 'nothing', 'nothing' || chr(10) || '- one' || chr(10) || '- two'""")
def snk_05_reply(spark, sf_dir):
    """A reply of each kind: what matches, else some of all, else the logs."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.col("p_brand").alias("source"), F.col("p_name").alias("title"), F.contains("p_name", F.lit("red")).alias("matched"))
    logs = spark.createDataFrame([(0, "one"), (1, ""), (2, "two")], "place int, log string")
    made = {"matched": views.reply(p, logs), "some": views.reply(p.withColumn("matched", F.lit(False)), logs.where("false")), "nothing": views.reply(p.where("false"), logs)}
    rows = [df.select(F.lit(k).alias("branch"), "reply") for k, df in made.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


# scans


@query("""SELECT event_id, 'json' AS origin, CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'anchor', CAST(event_id + 1 AS VARCHAR) FROM events
 UNION ALL SELECT event_id, 'anchor', CAST(event_id AS VARCHAR) FROM events WHERE event_id % 2 = 1""")
def src_07_json_or_anchors(spark, sf_dir):
    """Items of a page's embedded JSON, and from its links those that the JSON lacks."""
    e, k = table(spark, sf_dir, "events").select("event_id"), F.col("event_id")
    body = F.when(k % 2 == 0, F.concat(F.lit('<script type="application/json">{"list": [{"id": "'), k, F.lit('"}]}</script>'))).otherwise("")
    pages = e.withColumn("html", F.concat(body, F.lit('<a href="/house/'), k, F.lit('">x</a> <a href="/house/'), k + 1, F.lit('">y</a> <a href="/other">z</a>')))
    items = pages.select("event_id", F.explode(json_tables.embedded_scripts(F.col("html"))).alias("body"))
    one = json_tables.explode_items(items, "body", {"id": ("id", "postId")}, ["event_id"]).select("event_id", F.lit("json").alias("origin"), "id", F.lit(0).alias("rank"))
    two = pages.select("event_id", F.explode(html_pages.anchors(F.col("html"), "/house/")).alias("a")).select("event_id", F.lit("anchor").alias("origin"), N.id_of_url("a.href").alias("id"), F.lit(1).alias("rank"))
    return keyed.keep_first(one.unionByName(two), ["event_id", "id"], ["rank"]).drop("rank")


_PAGES = """g AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS page, CASE WHEN event_type = 'error' THEN 7 ELSE 30 END AS n, CAST(CASE WHEN value < 1 THEN 0 ELSE 5 END AS INTEGER) AS fresh, event_type FROM events)"""


@query(f"""WITH {_PAGES}, s AS (SELECT *, coalesce(max(CASE WHEN n < 30 OR (page > 1 AND fresh = 0) OR page * 30 >= 400 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM g WHERE page <= 20)
 SELECT user_id, page FROM s WHERE stopped = 0""")
def src_09_13_14_scan_ends(spark, sf_dir):
    """Pages of a scan up to a short one, one without anything new, the last one by the total, or the limit of pages."""
    return windows.scanned_pages(_pages(spark, sf_dir), ["user_id"], "page", F.col("n"), F.col("fresh"), F.lit(400)).select("user_id", "page")


def _pages(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long")
    return e.select("user_id", page.alias("page"), F.when(F.col("event_type") == "error", 7).otherwise(30).alias("n"), F.when(F.col("value") < 1, 0).otherwise(5).alias("fresh"), "event_type")


@query(f"WITH {_PAGES} SELECT user_id, page FROM g WHERE user_id NOT IN (SELECT user_id FROM g WHERE event_type = 'error' AND page = 3)")
def src_10_whole_key_fails(spark, sf_dir):
    """Keys whose third page failed give nothing at all."""
    pages = _pages(spark, sf_dir).withColumn("ok", ~((F.col("event_type") == "error") & (F.col("page") == 3)))
    return guards.complete_keys(pages, "user_id", "ok").select("user_id", "page")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_acctbal END AS value, CASE WHEN c_custkey % 3 = 0 THEN 'timeout' END AS error FROM customer""")
def src_21_lookup_errors(spark, sf_dir):
    """Captured lookups: a failed one is a row with its error and no value."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    captured = c.select(k, F.when(k % 3 == 0, F.lit(None)).otherwise(F.to_json(F.struct(F.col("c_acctbal").alias("v")))).alias("body"), F.when(k % 3 == 0, "timeout").alias("error"))
    looked = captured.select(k, json_tables.field(F.try_parse_json("body"), "v", kind="double").alias("value"), "error")
    return c.select("c_custkey").join(looked, "c_custkey", "left")


# texts


@query("SELECT p_partkey, '板橋…''&lt; ' || p_name || ' &amp;x &#0; A' AS text FROM part")
def str_01_entities(spark, sf_dir):
    """Names and numbers of characters in both bases; what an ampersand makes isn't read again."""
    raw = F.concat(F.lit("&#26495;&#x6A4B;&hellip;&apos;&amp;lt;&nbsp; "), "p_name", F.lit(" &#38;amp;x\n &#0; &#x41;"))
    return table(spark, sf_dir, "part").select("p_partkey", T.normalize_text(raw).alias("text"))


@query("""SELECT p_partkey, p_partkey % 4 <> 3 AS specific FROM part""")
def str_13_specific_addresses(spark, sf_dir):
    """A number, a lane, or four letters beyond the names of roads; the road alone isn't specific."""
    k = F.col("p_partkey")
    address = F.when(k % 4 == 0, F.concat(F.lit("光復街"), k, F.lit("號"))).when(k % 4 == 1, "新北市板橋區某巷").when(k % 4 == 2, "板橋區明月清風").otherwise("新北市板橋區光復街")
    return table(spark, sf_dir, "part").select(k, T.is_specific_address(address).alias("specific"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '三房邊間' WHEN 1 THEN '三房邊間,三房邊,房邊間' ELSE '' END AS top FROM part")
def str_15_top_tokens(spark, sf_dir):
    """Of the words that two titles share the longest, ties by text; one, or all three."""
    k = F.col("p_partkey")
    other = F.when(k % 3 < 2, "好三房邊間").otherwise("頂加內外梯")
    shared = T.shared_tokens(T.ngram_tokens(F.lit("三房邊間")), T.ngram_tokens(other))
    return table(spark, sf_dir, "part").select(k, F.array_join(F.when(k % 3 == 0, T.top_tokens(shared, 1)).otherwise(T.top_tokens(shared, 6)), ",").alias("top"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '頂加,邊間' ELSE '邊間' END AS words FROM part")
def str_18_shared_keywords(spark, sf_dir):
    k = F.col("p_partkey")
    found = T.shared_keywords(F.lit("頂加邊間一樓"), F.when(k % 2 == 0, "河景頂加邊間").otherwise("邊間三房"), ("河景", "頂加", "邊間", "三房"))
    return table(spark, sf_dir, "part").select(k, F.array_join(found, ",").alias("words"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN '明月好屋' WHEN 1 THEN '清風' ELSE 'id' || p_partkey END AS title FROM part")
def str_19_card_titles(spark, sf_dir):
    """The richest link that isn't a button; else what stands before the place without badges; else the id."""
    k = F.col("p_partkey")
    links = F.when(k % 3 == 0, F.array(F.lit("看地圖"), F.lit("明月好屋"), F.lit("1,288萬好好好好好"))).otherwise(F.array(F.lit("看地圖"), F.lit("收藏")))
    text = F.when(k % 3 == 1, "優質新上架清風 新北市板橋區光復街").otherwise("新北市板橋區光復街")
    otherwise = T.title_before(text, "新北市板橋區", F.concat(F.lit("id"), k))
    return table(spark, sf_dir, "part").select(k, F.coalesce(T.plausible_title(links), otherwise).alias("title"))


@query("""SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ',') AS links FROM pages""")
def str_22_harvested_links(spark, sf_dir):
    """Distinct addresses of a page (as texts: sorted)."""
    found = F.transform(T.harvest("html", 'href="[^"]*"', 300), lambda x: F.regexp_extract(x, 'href="([^"]*)"', 1))
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(F.array_sort(found), ",").alias("links"))


# numbers, floors, times, ciphers


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size || '.5坪' WHEN 1 THEN p_size || '坪' WHEN 2 THEN '0.5坪' END AS area FROM part""")
def num_03_area_texts(spark, sf_dir):
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("約 "), "p_size", F.lit(".5 坪"))).when(k % 4 == 1, F.concat("p_size", F.lit(".0"))).when(k % 4 == 2, "0.50").otherwise("不詳")
    return table(spark, sf_dir, "part").select(k, N.area_text(raw).alias("area"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size ELSE p_retailprice END AS area FROM part")
def num_11_first_name(spark, sf_dir):
    """A field under the first of its names that has a value; 0 counts as none."""
    p = table(spark, sf_dir, "part").withColumns({"size": F.when(F.col("p_partkey") % 3 == 0, F.col("p_size").cast("double")).when(F.col("p_partkey") % 3 == 1, 0.0), "area": F.col("p_retailprice")})
    return p.select("p_partkey", N.first_known("size", "area").alias("area"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '1/5樓' WHEN 1 THEN '2~3/7樓' WHEN 2 THEN (1 + p_partkey % 9) || '/12樓' END AS floor,
 CASE p_partkey % 4 WHEN 0 THEN '1' WHEN 1 THEN '2,3' WHEN 2 THEN CAST(1 + p_partkey % 9 AS VARCHAR) ELSE '' END AS floors FROM part""")
def flr_02_04_glued_and_split(spark, sf_dir):
    """Digits of an area glued to a floor, ranges of split levels, and a floor above the total, which is none."""
    k = F.col("p_partkey")
    raw = F.when(k % 4 == 0, "主20.241/5樓").when(k % 4 == 1, "2～3/7樓").when(k % 4 == 2, F.concat(F.lit("好 "), 1 + k % 9, F.lit("/12樓"))).otherwise("")
    floors = N.floors_in(F.when(k % 4 == 0, "1/5樓").otherwise(raw))
    return table(spark, sf_dir, "part").select(k, N.floor_of(raw).alias("floor"), F.array_join(floors.cast("array<string>"), ",").alias("floors"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '2,5,8' ELSE '2,5' END AS floors FROM part")
def flr_05_floors_of_members(spark, sf_dir):
    """Floors in a listing's own texts and in those of its members."""
    k = F.col("p_partkey")
    member = F.struct(F.lit("二樓 好").alias("title"), F.lit("5/9樓").alias("address"))
    p = table(spark, sf_dir, "part").select(k, F.when(k % 3 == 0, "8樓").otherwise("好").alias("title"), F.lit("").alias("address"), F.array(member).alias("members"))
    return p.select("p_partkey", F.array_join(entities.listing_floors(["title", "address"], "members").cast("array<string>"), ",").alias("floors"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN CAST(floor(epoch(date_trunc('day', ts))) AS BIGINT) ELSE CAST(floor(epoch(ts)) AS BIGINT) END AS seconds, CAST(floor(epoch(ts)) AS BIGINT) - 28800 AS from_local FROM events""")
def tim_01_02_written_times(spark, sf_dir):
    """ISO texts with a T, a blank or a date only, decimals; and local times of a zone."""
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    iso = lambda p: F.date_format(ts, p)
    raw = F.when(k % 4 == 0, F.concat(iso("yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))).when(k % 4 == 1, iso("yyyy-MM-dd HH:mm:ss")).when(k % 4 == 2, F.concat(F.unix_timestamp(ts).cast("string"), F.lit(".75"))).otherwise(iso("yyyy-MM-dd"))
    return table(spark, sf_dir, "events").select("event_id", N.to_unix(raw).alias("seconds"), N.local_to_unix(iso("yyyy-MM-dd HH:mm:ss"), "Asia/Taipei").alias("from_local"))


@query("SELECT c_custkey, c_name AS plain, 'F58C4C04D6E5F1BA779EABFB5F7BFBD6' AS known_block, 48 AS key_bytes FROM customer")
def cry_01_derived_keys(spark, sf_dir):
    """A key and a vector out of a password, a round trip with them, and the first block of a published test vector."""
    key, vector = N.derived_key("a made-up password", b"a made-up salt", 1000)
    c = table(spark, sf_dir, "customer").withColumn("code", N.encrypt_cbc(F.col("c_name").cast("binary"), F.lit(key), F.lit(vector)))
    # fixed values: AES-256-CBC of NIST SP 800-38A, F.2.5
    known = [bytes.fromhex(x) for x in ("603deb1015ca71be2b73aef0857d77811f352c073b6108d72d9810a30914dff4", "000102030405060708090a0b0c0d0e0f", "6bc1bee22e409f96e93d7e117393172a")]
    block = F.substring(F.hex(F.unbase64(N.encrypt_cbc(F.lit(known[2]), F.lit(known[0]), F.lit(known[1])))), 1, 32)
    return c.select("c_custkey", N.decrypt_cbc(F.col("code"), F.lit(key), F.lit(vector)).alias("plain"), block.alias("known_block"), F.lit(len(key + vector)).alias("key_bytes"))


# merges of rows


@query("""SELECT user_id, min(CASE WHEN event_type = 'click' THEN event_id END) AS new_at, bool_or(event_type <> 'error') AS active, CASE WHEN NOT bool_or(event_type <> 'error') THEN max(event_id) END AS removed_at FROM events GROUP BY user_id""")
def ded_05_lifecycle(spark, sf_dir):
    """The earliest time of novelty, if there is any; the newest time of removal only where no row is active."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    rows = e.select("user_id", k.alias("ord"), F.when(F.col("event_type") == "click", k).alias("new_at"), (F.col("event_type") != "error").alias("active"), F.when(F.col("event_type") == "error", k).alias("removed_at"))
    return keyed.newest_fields(rows, "user_id", "ord", [], ["new_at"], [], ["active"], "removed_at")


@query("""WITH m AS (SELECT o_orderkey AS id, 0 AS level, o_custkey AS parent, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE 'road' || o_custkey END AS road FROM orders),
 p AS (SELECT min(o_orderkey) AS id, 1 AS level, o_custkey AS parent, 'road' || o_custkey AS road FROM orders GROUP BY o_custkey)
 SELECT id, arg_max(road, level) AS road FROM (SELECT * FROM m UNION ALL SELECT * FROM p) GROUP BY id""")
def ded_08_members_and_parents(spark, sf_dir):
    """Members with their parents' defaults beside the parents, which come later; then one row an id, the newest field first."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderdate", F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("road"))
    nested = windows.ordered_members(o, ["o_custkey"], ["o_orderdate", "id"], ["id", "road"]).select("o_custkey", "members", F.array_min(F.transform("members", lambda m: m["id"])).alias("id"), F.concat(F.lit("road"), "o_custkey").alias("road"))
    rows = keyed.members_and_parents(nested, "members", "id", "o_custkey", ["road"])
    return keyed.newest_fields(rows, "id", "place", ["road"])


@query("SELECT p_partkey, 'b,a,' || p_brand AS listed FROM part")
def ded_09_distinct_in_order(spark, sf_dir):
    values = F.array(F.lit("b"), F.lit(None), F.lit("a"), F.lit("b"), F.lit(""), F.col("p_brand"), F.lit("a"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(keyed.distinct_in_order(values), ",").alias("listed"))


# filters and joins


@query(f"SELECT ord FROM ({LISTINGS_SQL}) WHERE ord % 4 <> 1 AND source IN ('s0', 's2')")
def flt_06_active_of_sources(spark, sf_dir):
    """Active rows of allowed sources; rows that say nothing are active."""
    rows = listings(spark, sf_dir).withColumn("active", F.when(F.col("ord") % 4 == 1, False).when(F.col("ord") % 4 == 2, True))
    return views.active_of(rows, ["s0", "s2"]).select("ord")


@query("SELECT p_partkey, p_partkey % 4 IN (0, 3) AS direct FROM part")
def flt_08_direct_company(spark, sf_dir):
    """The company's own inventory, not its franchise's; who names both is the company."""
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, "永慶直營 好屋").when(k % 4 == 1, "永慶不動產 好屋").when(k % 4 == 2, "別家").otherwise("永慶不動產 永慶房屋(股)公司")
    return table(spark, sf_dir, "part").select(k, views.direct_only(text, ("永慶房屋(股)公司", "永慶直營"), "永慶不動產").alias("direct"))


@query(f"SELECT ord, 'new' AS state FROM ({LISTINGS_SQL}) WHERE road IN ('Brand#3', 'Brand#1') AND source = 's1' AND ord % 5 <> 0 AND ord % 2 = 0")
def flt_05_10_view_filters(spark, sf_dir):
    """A view of one source and one state; rows without an id aren't listed."""
    as_of = F.lit("2024-02-01 00:00:00").cast("timestamp")
    rows = listings(spark, sf_dir).withColumns({"active": F.col("ord") % 5 != 0, "new_at": F.when(F.col("ord") % 2 == 0, as_of)})
    known = keyed.keep_identified(rows, "id", ["ord"])
    return views.listing_view(known, as_of, ["Brand#3", "Brand#1"], source="s1", state="new").select("ord", "state")


@query("SELECT page_id, page_id % 6 = 4 OR (page_id % 3 = 1 AND contains(html, 'Nicht')) AS gone FROM pages")
def joi_11_probes(spark, sf_dir):
    """Rows joined with the answers to a probe of their pages: only every third was asked for."""
    p, k = table(spark, sf_dir, "pages"), F.col("page_id")
    probes = p.where(k % 3 == 1).select(k, F.when(k % 6 == 4, 404).otherwise(200).alias("status"), F.col("html").alias("body"))
    return joins.probed(p.select("page_id"), probes, "page_id", ["Nicht"])


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'older' ELSE 'fresh' END AS origin, allowed FROM customer, (VALUES (true), (false)) AS v(allowed) WHERE c_nationkey % 3 <> 0 OR allowed""")
def dq_04_fallback_switch(spark, sf_dir):
    """Older rows stand in for unavailable partitions only where that is allowed."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    status = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), (F.col("n_nationkey") % 3 != 0).alias("available"))
    made = [guards.with_fallback(c.withColumn("origin", F.lit("fresh")), c.withColumn("origin", F.lit("older")), status, "c_nationkey", allowed).select("c_custkey", "origin", F.lit(allowed).alias("allowed")) for allowed in (True, False)]
    return made[0].unionByName(made[1])


# runs


@query("""SELECT event_type AS source, 'said；active ' || count(*) FILTER (WHERE value > 2) || ', new ' || count(*) FILTER (WHERE user_id % 2 = 0) || ', removed ' || count(*) FILTER (WHERE value <= 2 AND user_id % 2 = 1) || ' of ' || count(*) AS message
 FROM events GROUP BY event_type""")
def sta_07_messages(spark, sf_dir):
    """What a run said, with the counts of this run in place of those that stood behind it."""
    e = table(spark, sf_dir, "events")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    merged = e.select(F.col("event_type").alias("source"), (F.col("value") > 2).alias("active"), F.when(F.col("user_id") % 2 == 0, at).alias("new_at"), F.when(F.col("user_id") % 2 == 0, "added").when(F.col("value") <= 2, "removed").otherwise("kept").alias("event"))
    runs = e.select(F.col("event_type").alias("source")).distinct().withColumn("message", F.lit("said；active 1, new 2, removed 3 of 4"))
    return snapshots.run_messages(snapshots.run_summary(merged), runs)


@query(f"""SELECT id, source, CASE WHEN source = 's1' THEN price ELSE price + 1 END AS price, source = 's1' AS seen FROM ({LISTINGS_SQL})""")
def sta_08_one_source(spark, sf_dir):
    """A run of one source: its rows are seen anew, all others stay as they were."""
    p, then, now = listings(spark, sf_dir), F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    previous = p.select("id", "source", (F.col("price") + 1).alias("price"), then.alias("first_seen"), then.alias("last_seen"), none.alias("new_at"), F.lit(True).alias("active"), none.alias("removed_at"))
    runs = p.select("source").distinct().withColumns({"success": F.lit(True), "baseline_ready": F.lit(True)})
    made = snapshots.run_of_source(previous, p.select("id", "source", "price"), runs, p.where("false").select("id"), now, ["price"], "s1")
    return made.select("id", "source", "price", (F.col("last_seen") == now).alias("seen"))


# semi-structured


@query("""SELECT event_id, path, object FROM (SELECT event_id, unnest(['$', '$.a[0]', '$.b']) AS path, unnest(['{"a":[{"k":' || user_id || '},3],"b":{"c":null}}', '{"k":' || user_id || '}', '{"c":null}']) AS object FROM events)""")
def jsn_01_every_object(spark, sf_dir):
    """Every object of a document with its path."""
    body = F.concat(F.lit('{"a": [{"k": '), "user_id", F.lit('}, 3], "b": {"c": null}}'))
    e = table(spark, sf_dir, "events").select("event_id", F.explode(json_tables.json_objects(body)).alias("o"))
    return e.select("event_id", "o.path", "o.object")


@query("SELECT conv_id, 1 + 2 * least(count(*), 5) AS within, 1 + least(count(*), 1) AS shallow, least(1 + count(*), 3) AS capped FROM conversations GROUP BY conv_id")
def jsn_03_04_limits(spark, sf_dir):
    """Lists are read to their limit, objects to a depth, and a report takes so many."""
    body = F.col("body")
    leaves, shallow, capped = json_tables.walk_json(body, 16, 5), json_tables.json_objects(body, 2, 1), json_tables.json_objects(body, 16, 9, 3)
    return conversations(spark, sf_dir).select("conv_id", *[F.size(x).cast("long").alias(n) for n, x in (("within", leaves), ("shallow", shallow), ("capped", capped))])


@query("SELECT event_id, '1' AS k, CAST(user_id AS VARCHAR) AS name, event_type AS area FROM events")
def jsn_10_aliases(spark, sf_dir):
    """Fields under any of their names, the first one first."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"items": [{"id": 1, "postId": 2, "name": "'), "user_id", F.lit('", "size": "'), "event_type", F.lit('"}]}'))
    rows = json_tables.explode_items(e.select("event_id", body.alias("body")), "body", {"k": ("id", "postId"), "name": ("title", "name"), "area": ("area", "size")}, ["event_id"])
    return rows.drop("place")


@query("""SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS DOUBLE) + 0.5 AS area, CAST(1200 + p_partkey % 7 AS DOUBLE) AS price, '3/12樓' AS floor FROM part""")
def htm_04_06_cards(spark, sf_dir):
    """The smallest element of one id that has the place and the label, as a typed record."""
    k = F.col("p_partkey")
    card = F.concat(F.lit('<li><a href="/house/'), k, F.lit('">'), "p_name", F.lit("</a> 新北市光復街 公寓 30年 建坪 "), "p_size", F.lit(".5 3/12樓 1,2"), F.lpad((k % 7).cast("string"), 2, "0"), F.lit("</li>"))
    page = F.concat(F.lit("<div><div>"), card, F.lit('<p>more of it</p></div><section><a href="/house/999999999">x</a> 新北市光復街 建坪</section></div>'))
    cards = spread(table(spark, sf_dir, "part")).select(k, F.explode(html_pages.smallest_cards(page, r"/house/(\d+)", ("新北市光復街", "建坪"))).alias("c")).where("c.id <> '999999999'")
    record = html_pages.card_record(F.col("c.text"), "新北市光復街")
    return cards.select("p_partkey", "c.id", *[v.alias(c) for c, v in record.items()])


@query("SELECT page_id, '樓層 ' || page_id || '|所在樓層' AS texts FROM pages")
def htm_07_label_texts(spark, sf_dir):
    """Short texts of elements that hold a label, each once; long ones and those without it don't count."""
    page = F.concat(F.lit("<body><div>"), F.repeat(F.lit("long "), F.lit(60)), F.lit("<p>樓層 "), "page_id", F.lit("</p></div><i>所在樓層</i><b>所在樓層</b><u>other</u></body>"))
    found = html_pages.label_texts(page, "所在樓層|樓層", 40)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(found, "|").alias("texts"))


@query("SELECT event_id, CAST(unnest([0, 1, 2]) AS BIGINT) AS block, CAST(unnest([user_id, event_id, 7]) AS BIGINT) AS k FROM events")
def src_08_all_blocks(spark, sf_dir):
    """Items of every JSON block of a page, of each kind of block."""
    e = table(spark, sf_dir, "events")
    block = lambda kind, value: F.concat(F.lit(f'<script {kind}>{{"list": [{{"k": '), value, F.lit("}]}</script><script>var x;</script>"))
    page = F.concat(block('id="__NEXT_DATA__"', F.col("user_id")), block('type="application/json"', F.col("event_id")), block('type="application/ld+json"', F.lit(7)))
    blocks = e.select("event_id", F.posexplode(json_tables.embedded_scripts(page)).alias("block", "body"))
    rows = json_tables.explode_items(blocks, "body", {"k": ("k",)}, ["event_id", "block"])
    return rows.select("event_id", F.col("block").cast("long").alias("block"), F.col("k").cast("long").alias("k"))


@query("""SELECT page_id, '/house/' || page_id AS href, 'link' AS text, 'before link behind' AS parent FROM pages UNION ALL SELECT page_id, '/house/2', 'two', 'two' FROM pages""")
def htm_01_parent_texts(spark, sf_dir):
    """Links of one kind with their text and that of the element around them."""
    page = F.concat(F.lit('<p>before <a href="/house/'), "page_id", F.lit('"><b>link</b></a> behind</p><li><a href="/house/2">two</a></li><a href="/x">x</a>'))
    found = table(spark, sf_dir, "pages").select("page_id", F.explode(html_pages.anchors(page, "^/house/")).alias("a"))
    return found.select("page_id", "a.*")


@query("SELECT page_id, 'a' || page_id || ',b' AS ids, 2 AS n_scripts FROM pages")
def htm_09_element_ids(spark, sf_dir):
    """Ids of a page's elements, each once, and its scripts."""
    page = F.concat(F.lit("<p id=\"b\"></p><div class='x' id='a"), "page_id", F.lit("'></div><i id=\"b\"></i><script></script><SCRIPT src='y'></SCRIPT>"))
    report = html_pages.page_report(page)
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(report["element_ids"], ",").alias("ids"), report["n_scripts"].alias("n_scripts"))


# order


@query("SELECT o_orderkey FROM orders ORDER BY coalesce(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END, 0), o_orderkey")
def srt_03_nulls_as_zero(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("shown", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return views.sorted_by(o, "shown", False, "o_orderkey", nulls_last=False).select("o_orderkey")


@query("""WITH r AS (SELECT o_custkey AS cluster, o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 1000000000000000000 ELSE o_orderkey % 5 END AS rank, o_orderdate, o_totalprice AS price FROM orders)
 SELECT cluster, arg_min(id, (rank, o_orderdate, id)) AS main, count(*) AS member_count, min(price) AS effective_price FROM r GROUP BY cluster""")
def srt_06_oldest_first(spark, sf_dir):
    """The main member of a cluster: the first one published, then the first seen, then the least id."""
    o = table(spark, sf_dir, "orders")
    rank = N.published_rank(F.when(F.col("o_orderstatus") != "P", (F.col("o_orderkey") % 5).cast("string")))
    rows = o.select(F.col("o_custkey").alias("cluster"), F.col("o_orderkey").alias("id"), rank.alias("rank"), "o_orderdate", F.col("o_totalprice").alias("price"))
    made = entities.cluster_records(rows, ("rank", "o_orderdate", "id"), last=False)
    return made.select("cluster", F.col("id").alias("main"), "member_count", "effective_price")
