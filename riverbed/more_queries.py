"""Further queries: captures, reports, cards, sorts and composed steps."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from riverbed.functions import numbers as N
from riverbed.functions import text as T
from riverbed.operators import history, joins, keyed, windows
from riverbed.operators.shared import shared_dir
from riverbed.plans import views
from riverbed.plans.samples import conversations, table
from riverbed.queries import query
from riverbed.sources import html_pages, json_tables, state


@query("SELECT p_partkey, '板橋區中山路二段' || p_partkey || '號' AS folded, '板橋區中山路二段' || p_partkey || '號abc' AS key FROM part")
def str_02_05_fold_variants(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("t", F.concat(F.lit(" 板橋區中山路2段"), "p_partkey", F.lit("號 ")))
    return p.select("p_partkey", T.fold_variants("t").alias("folded"), T.match_key(F.concat("t", F.lit("-ABC"))).alias("key"))


@query("SELECT p_partkey, repeat('好', (2 + p_partkey % 5)::INTEGER) || 'x' AS title FROM part")
def str_19_plausible_title(spark, sf_dir):
    """Of a price, a short and a rich text the rich one."""
    rich = F.concat(F.repeat(F.lit("好"), (2 + F.col("p_partkey") % 5).cast("int")), F.lit("x"))
    candidates = F.array(F.lit("1,288萬好好好好好好好好"), F.lit("看"), rich, F.lit("abc"))
    return table(spark, sf_dir, "part").select("p_partkey", T.plausible_title(candidates).alias("title"))


@query("""SELECT doc_id, len(s) AS n, md5(array_to_string([trim(regexp_replace(x, '[\\s]+', ' ', 'g')) for x in s], '|')) AS joined
 FROM (SELECT doc_id, regexp_extract_all(text, '(?s).{0,20}(?:thing).{0,20}') AS s FROM documents)""")
def str_21_snippets(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", T.snippets("text", "thing", 20).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n"), F.md5(F.array_join("s", "|").cast("binary")).alias("joined"))


@query("""SELECT p_partkey, CASE WHEN 280 + p_partkey % 99 BETWEEN 300 AND 100000 THEN (280 + p_partkey % 99)::DOUBLE ELSE 1500.0 END AS price, p_size::DOUBLE AS area,
 CASE WHEN p_size < 1000 THEN p_size::DOUBLE END AS area_value FROM part""")
def num_03_05_06_card_numbers(spark, sf_dir):
    """The last price in range wins; cards name the price before last first."""
    p = table(spark, sf_dir, "part")
    card = F.concat(F.lit("1,500萬 降 "), F.lit(280) + F.col("p_partkey") % 99, F.lit("萬 "), "p_size", F.lit("坪"))
    return p.select("p_partkey", N.card_price(card).alias("price"), N.card_area(card).alias("area"), N.area_value(F.concat("p_size", F.lit("坪"))).alias("area_value"))


@query("""SELECT o_custkey, coalesce(min(CASE WHEN o_totalprice > 200000 THEN o_totalprice END), 1.0) AS effective, coalesce(arg_min(CASE WHEN o_totalprice > 200000 THEN o_totalprice END, o_orderkey) FILTER (WHERE o_totalprice > 200000), 7.0) AS first_area
 FROM orders GROUP BY o_custkey""")
def num_07_08_members(spark, sf_dir):
    """The smallest positive price among members, and the first member that has a value."""
    o = table(spark, sf_dir, "orders").withColumn("v", F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice")))
    m = windows.ordered_members(o, ["o_custkey"], ["o_orderkey"], ["v"]).withColumn("m", F.transform("members", lambda x: x["v"]))
    return m.select("o_custkey", N.effective_price(F.lit(1.0), F.col("m")).alias("effective"), F.coalesce(N.first_present(F.lit(None).cast("double"), F.col("m")), F.lit(7.0)).alias("first_area"))


@query("""SELECT p_partkey, (1 + p_partkey % 9) || '/' || (9 + p_partkey % 5) || '樓' AS floor, CAST(1 + p_partkey % 9 AS INTEGER) AS rooms, CAST(10 + p_partkey % 80 AS INTEGER) AS hint FROM part""")
def flr_07_08_labelled_floors(spark, sf_dir):
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.concat(F.lit("所在樓 "), 1 + k % 9, F.lit(" 總樓 "), 9 + k % 5).alias("t"), F.concat(1 + k % 9, F.lit(" 房 "), 10 + k % 80, F.lit("樓")).alias("u"))
    return p.select("p_partkey", N.labelled_floor("t").alias("floor"), N.room_hint("u").alias("rooms"), N.floor_hint("u").alias("hint"))


@query("""SELECT event_id, coalesce(CASE WHEN event_type <> 'error' THEN event_id END, 1000000000000000000) AS rank, CASE WHEN user_id % 2 = 0 OR event_type = 'click' THEN event_id END AS trusted FROM events""")
def tim_06_07_published(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = F.when(F.col("event_type") != "error", F.col("event_id").cast("string")).otherwise("?")
    source = F.when(F.col("user_id") % 2 == 0, "free").otherwise("strict")
    return e.select("event_id", N.published_rank(text).alias("rank"), N.trusted_time(F.col("event_id"), F.col("event_type"), source, ["strict"], "click").alias("trusted"))


#: Leaves of a conversation's document, in its order, as SQL; ``i`` is the place of a turn.
_LEAVES_SQL = """SELECT conv_id, 0 AS n, '$.id' AS path, CAST(conv_id AS VARCHAR) AS value FROM (SELECT DISTINCT conv_id FROM conversations)
 UNION ALL SELECT conv_id, 1 + 2 * i + unnest([0, 1]), '$.turns[' || i || '].' || unnest(['role', 'text']), unnest([coalesce(role, 'null'), coalesce(text, 'null')]) FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS i FROM conversations)"""


def _conversation_leaves(spark, sf_dir):
    leaves = conversations(spark, sf_dir).select("conv_id", F.posexplode(json_tables.walk_json(F.col("body"), widest=100_000)).alias("n", "x"))
    return leaves.select("conv_id", "n", "x.path", "x.value")


@query(_LEAVES_SQL)
def jsn_01_conversation_leaves(spark, sf_dir):
    """All scalar values of conversations' documents with their paths."""
    return _conversation_leaves(spark, sf_dir)


@query(f"""WITH l AS (SELECT conv_id, regexp_replace(path, '[0-9]+', '', 'g') AS path, value, min(n) AS n FROM ({_LEAVES_SQL}) GROUP BY ALL),
 p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n, path, value) AS place FROM l) SELECT conv_id, path, value, place FROM p WHERE place <= 300""")
def ded_10_distinct(spark, sf_dir):
    """Different (path, value) of each conversation's document, wherever in a list they stand; the first 300, as a report shows them."""
    leaves = _conversation_leaves(spark, sf_dir).withColumn("path", F.regexp_replace("path", "[0-9]+", ""))
    return keyed.distinct_candidates(leaves, ["conv_id"], ["path", "value"], "n", 300)


@query("""WITH o AS (SELECT o_custkey, list(o_orderkey) FILTER (WHERE o_orderdate >= TIMESTAMP '1998-01-01') AS ids, list(o_orderkey) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01') AS base FROM orders GROUP BY o_custkey),
 s AS (SELECT o_custkey, len([x for x in coalesce(ids, []) if NOT list_contains(coalesce(base, []), x)]) AS new, len([x for x in coalesce(ids, []) if list_contains(coalesce(base, []), x)]) AS known FROM o)
 SELECT *, new + known > 0 AND new > known AS is_next FROM s""")
def agg_11_overlap_sizes(spark, sf_dir):
    date, none = F.col("o_orderdate"), F.array().cast("array<bigint>")
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_list(F.when(date >= "1998-01-01", F.col("o_orderkey"))).alias("ids"), F.collect_list(F.when(date < "1999-01-01", F.col("o_orderkey"))).alias("base"))
    sizes = joins.overlap_sizes(F.coalesce("ids", none), F.coalesce("base", none))
    return o.select("o_custkey", sizes["new"].cast("long").alias("new"), sizes["known"].cast("long").alias("known"), sizes["is_next"].alias("is_next"))


@query("SELECT o_orderpriority, array_to_string(list(DISTINCT o_orderstatus ORDER BY o_orderstatus), '+') AS statuses FROM orders WHERE o_totalprice > 100000 GROUP BY o_orderpriority")
def agg_09_coverage(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_totalprice > 100000")
    return o.groupBy("o_orderpriority").agg(F.array_join(F.array_sort(F.collect_set("o_orderstatus")), "+").alias("statuses"))


@query("""SELECT p_partkey FROM part WHERE len(list_distinct(regexp_extract_all(p_name || ' ' || p_type || ' ' || p_name, '[a-z]*(?:ring|gear)'))) = 1""")
def flt_12_single_value(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.where(joins.single_value(F.concat_ws(" ", "p_name", "p_type", "p_name"), "[a-z]*(?:ring|gear)")).select("p_partkey")


@query("SELECT page_id, page_id % 10 IN (3, 4) AND page_id % 10 = 4 OR contains(html, 'Nicht') AS inactive FROM pages")
def flt_07_src_22_inactive(spark, sf_dir):
    status = F.when(F.col("page_id") % 10 == 4, 404).when(F.col("page_id") % 10 == 5, 500)
    return table(spark, sf_dir, "pages").select("page_id", joins.proven_inactive(status, F.col("html"), ["Nicht"]).alias("inactive"))


@query("""WITH c AS (SELECT p_partkey, p_brand, p_size, p_name FROM part WHERE p_partkey % 2 = 0), p AS (SELECT p_partkey, p_brand, p_size, p_name FROM part WHERE p_partkey % 2 = 1),
 s AS (SELECT c.p_partkey AS key, min(p.p_partkey) AS previous FROM c JOIN p ON p.p_partkey = c.p_partkey + 1 AND c.p_partkey % 3 = 0 AND c.p_brand = p.p_brand GROUP BY 1),
 r AS (SELECT c.p_partkey AS key, min(p.p_partkey) AS previous FROM c JOIN p ON c.p_brand = p.p_brand AND c.p_size = p.p_size AND c.p_name = p.p_name WHERE c.p_partkey NOT IN (SELECT key FROM s) GROUP BY 1)
 SELECT * FROM s UNION ALL SELECT * FROM r""")
def joi_09_match_previous(spark, sf_dir):
    """Even parts against odd ones: by an id that every third shares with the next, else by name and size in a brand."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, "p_brand", "p_size", "p_name", F.when(k % 2 == 1, F.array(k)).when(k % 3 == 0, F.array(k + 1)).otherwise(F.array().cast("array<bigint>")).alias("ids"))
    same = (F.col("a.p_size") == F.col("b.p_size")) & (F.col("a.p_name") == F.col("b.p_name"))
    return joins.match_previous(p.where(k % 2 == 0), p.where(k % 2 == 1), "p_partkey", "ids", ["p_brand"], lambda pairs: pairs.where(same), "p_partkey", ("p_size", 1))


@query("""SELECT l_orderkey, n - 1 AS place, p_partkey, p_name FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem))
 JOIN part ON p_partkey = l_partkey""")
def joi_13_in_list_order(spark, sf_dir):
    lists = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_partkey")).alias("ids"))
    return joins.in_list_order(lists, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "ids", "p_partkey", "l_orderkey").select("l_orderkey", "place", "p_partkey", "p_name")


@query("""WITH old AS (SELECT c_custkey, c_acctbal AS balance FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, -1.0 AS balance FROM customer WHERE c_custkey % 5 = 0)
 SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)""")
def sta_05_snk_03_cache_refresh(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", F.col("c_acctbal").alias("balance"))
    return state.upsert(old, c.where("c_custkey % 5 = 0").select("c_custkey", F.lit(-1.0).alias("balance")), "c_custkey")


@query("""SELECT event_type AS source, count(*) AS total, count(*) FILTER (WHERE event_type <> 'view' OR user_id % 2 = 0) AS trusted FROM events GROUP BY event_type""")
def sta_06_time_provenance(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("user_id") % 2 == 0, "publishTime").otherwise("updateTime"))
    known = e.withColumn("t", N.trusted_time(F.col("ts"), F.col("kind"), F.col("event_type"), ["view"]))
    return known.groupBy(F.col("event_type").alias("source")).agg(F.count("*").alias("total"), F.count("t").alias("trusted"))


@query("SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS first_pass, 0 AS removed_by_second")
def dq_06_idempotence(spark, sf_dir):
    """A second pass of a dedupe removes nothing."""
    once = keyed.keep_identified(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    twice = keyed.keep_identified(once, "o_custkey", ["o_orderdate", "o_orderkey"])
    counts = once.agg(F.count("*").alias("first_pass")).join(twice.agg(F.count("*").alias("second")), how="cross")
    return counts.select("first_pass", (F.col("first_pass") - F.col("second")).alias("removed_by_second"))


@query("SELECT page_id, contains(html, '<article>') AND NOT contains(html, 'Nicht') AND page_id % 9 <> 0 AS usable FROM pages")
def dq_07_preflight(spark, sf_dir):
    html = F.col("html")
    good = joins.any_contains(html, ["<article>"]) & ~joins.any_contains(html, ["Nicht"]) & (F.when(F.col("page_id") % 9 == 0, 503).otherwise(200) == 200)
    return table(spark, sf_dir, "pages").select("page_id", good.alias("usable"))


@query("""SELECT event_id, event_type AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 50""")
def jsn_02_08_candidates(spark, sf_dir):
    """Records out of walked objects: leaves of one object come together again, then a guard on the value."""
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit('{"x": [{"o": '), "props", F.lit(', "name": "'), "event_type", F.lit('"}]}'))
    leaves = e.select("event_id", F.explode(json_tables.walk_json(body)).alias("x"))
    found = leaves.groupBy("event_id").agg(F.max(F.when(F.col("x.key") == "name", F.col("x.value"))).alias("name"), F.max(F.when(F.col("x.key") == "k", F.col("x.value"))).cast("long").alias("k"))
    return found.where("k > 50")


@query("SELECT event_id, event_type AS kind, user_id::VARCHAR AS user_text FROM events")
def jsn_09_product_string(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("p", json_tables.product_string(F.concat(F.lit("kind="), "event_type", F.lit("~empty=~user="), "user_id")))
    return e.select("event_id", F.col("p")["kind"].alias("kind"), F.col("p")["user"].alias("user_text"))


@query("""SELECT page_id, count(*) AS n_cards, max(length(t)) AS longest FROM (SELECT DISTINCT ON (page_id, href) page_id, href, t FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 1)) AS href,
 unnest(regexp_extract_all(html, '<li><a href="/([^"]*)">([^<]*)</a></li>', 2)) AS t FROM pages)) GROUP BY page_id""")
def htm_02_05_cards(spark, sf_dir):
    cards = table(spark, sf_dir, "pages").select("page_id", F.explode(html_pages.cards(F.col("html"), "^/(.+)$", "")).alias("c"))
    return cards.groupBy("page_id").agg(F.count("*").alias("n_cards"), F.max(F.length("c.text")).cast("long").alias("longest"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice END DESC NULLS LAST, o_orderkey")
def srt_02_nulls_last(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("shown", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")))
    return views.sorted_by(o, "shown", True, "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY list_position(['3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW'], o_orderpriority), o_totalprice > 400000 DESC, o_orderstatus = 'F' DESC, o_orderkey")
def srt_05_07_ranked(spark, sf_dir):
    place = F.array_position(F.array(*map(F.lit, ["3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"])), F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").orderBy(place, (F.col("o_totalprice") > 400000).desc(), (F.col("o_orderstatus") == "F").desc(), "o_orderkey").select("o_orderkey")


@query("""SELECT o_custkey AS group_id, CASE WHEN o_custkey % 3 = 0 THEN 'company_match' WHEN o_custkey % 3 = 1 THEN 'review' ELSE 'missing' END AS status, CASE WHEN o_custkey % 3 < 2 THEN o_custkey * 10 END AS candidate
 FROM orders GROUP BY o_custkey HAVING bool_or(o_orderstatus = 'P')""")
def qry_02_group_view(spark, sf_dir):
    groups = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.collect_set("o_orderstatus").alias("sources"))
    k = F.col("group_id")
    compared = groups.select(k, F.when(k % 3 == 0, "company_match").when(k % 3 == 1, "review").otherwise("missing").alias("status"), (k * 10).alias("candidate"))
    return views.group_view(groups, compared, source="P").select("group_id", "status", "candidate")


@query("SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS place, o_orderkey FROM orders")
def qry_04_audit_expansion(spark, sf_dir):
    nested = windows.ordered_members(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderkey"])
    return nested.select("o_custkey", F.posexplode("members").alias("place", "m")).select("o_custkey", F.col("place").cast("long").alias("place"), F.col("m.o_orderkey").alias("o_orderkey"))


@query("""WITH b AS (SELECT p_partkey AS ord, p_name AS title, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS n FROM part)
 SELECT ord, title, contains(title, 'red') AS matched FROM b WHERE n = 1 ORDER BY matched DESC, ord LIMIT 20""")
def qry_05_search(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("ord"), F.lit("").alias("url"), F.lit("s").alias("source"), F.col("p_name").alias("title"), F.col("p_brand").alias("address"), F.lit(None).cast("string").alias("price"))
    found = views.search(rows.where("ord % 2 = 0"), rows.where("ord % 2 = 1"), F.contains("title", F.lit("red")), 20)
    return found.select("ord", "title", "matched")


@query("""SELECT substr(string_agg(o_orderkey || ' ' || o_orderstatus, chr(10) ORDER BY k), 1, 4000) AS report FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 10""")
def snk_04_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return state.report_lines(o, F.concat_ws(" ", "o_orderkey", "o_orderstatus"), [F.desc("o_totalprice"), "o_orderkey"])


#: Users of each day as snapshots: the last of their kinds of events.
_DAILY_SQL = "SELECT user_id, max(event_type) AS kind, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) * 86400 AS moment FROM events GROUP BY user_id, CAST(ts AS DATE)"


def _day(column):
    return F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long") * 86400


def _daily(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id", _day("ts").alias("at")).agg(F.max("event_type").alias("kind"))


@query("SELECT event_id, user_id FROM events WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM events WHERE CAST(ts AS DATE) < DATE '2024-01-20')")
def src_03_previous_version(spark, sf_dir):
    """Rows of the latest run before a given one, read from the snapshots that were written."""
    path = f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"
    table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("run "), F.to_date("ts").cast("string")).alias("run")).write.partitionBy("run").parquet(path)
    return state.read_snapshot(spark, path, "2024-01-20").select("event_id", "user_id")


@query(f"""WITH s AS ({_DAILY_SQL}), r AS (SELECT moment, row_number() OVER (ORDER BY moment) AS run, lead(moment) OVER (ORDER BY moment) AS next FROM (SELECT DISTINCT moment FROM s)),
 j AS (SELECT s.*, run, next, CASE WHEN lag(run) OVER w = run - 1 AND lag(kind) OVER w = kind THEN 0 ELSE 1 END AS new FROM s JOIN r USING (moment) WINDOW w AS (PARTITION BY user_id ORDER BY run)),
 n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY run) AS n FROM j)
 SELECT user_id, min(kind) AS kind, CAST(min(moment) AS BIGINT) AS valid_from, CAST(arg_max_null(next, run) AS BIGINT) AS valid_to FROM n GROUP BY user_id, n""")
def src_03_validity_intervals(spark, sf_dir):
    """All daily snapshots as intervals: a user's row anew only where it changes, goes or comes back."""
    return history.validity_intervals(_daily(spark, sf_dir), ["user_id"], "at", ["kind"])


@query(f"""WITH s AS ({_DAILY_SQL}) SELECT event_id, kind, count(*) AS users FROM events e JOIN s ON s.moment = date_diff('day', DATE '1970-01-01', CAST(e.ts AS DATE)) * 86400 WHERE event_id % 10 = 3 GROUP BY event_id, kind""")
def win_05_states_at(spark, sf_dir):
    """Users by kind at the instants of every tenth event, from the intervals of change alone."""
    made = history.validity_intervals(_daily(spark, sf_dir), ["user_id"], "at", ["kind"])
    instants = table(spark, sf_dir, "events").where("event_id % 10 = 3").select("event_id", (_day("ts") + F.hour("ts") * 3600 + F.minute("ts") * 60).alias("instant"))
    return history.counts_at(made, instants, "instant", ["kind"], "users").select("event_id", "kind", "users")


@query("SELECT 'customer' AS origin, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_name, NULL FROM supplier")
def set_01_union(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("origin"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return c.unionByName(s, allowMissingColumns=True)
