"""Registered queries of the catalogue engine over the driver's tables, and the same in SQL for DuckDB.

The tables are no vendor records: events and orders stand for observations, users and customers for products; a
purchase weighs 3, a click 2, anything else 1; order states O, F and P are in stock, out of stock and unknown.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.functions import stock, text, urls
from stockloom.operators import catalog, crawl, merge, messages, scan, snapshot
from stockloom.sources import feeds, html_pages

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SPLIT = "1998-04-25"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _state() -> Column:
    return stock.tri_state(F.when(F.col("o_orderstatus") == "O", "in_stock").when(F.col("o_orderstatus") == "F", "0").otherwise("?"))


STATE = "case o_orderstatus when 'O' then 1 when 'F' then 0 else -1 end"
WEIGHT = "case event_type when 'purchase' then 3 when 'click' then 2 else 1 end"


@query(f"select count(*) filter (s = 1) as in_stock, count(*) filter (s = 0) as out_of_stock, count(*) filter (s = -1) as unknown from (select {STATE} s from orders)")
def tri_state_counts(spark, d):
    return _t(spark, d, "orders").select(_state().alias("s")).agg(*stock.state_counts(F.col("s")))


def _picked(spark, d):
    e = _t(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    kind = F.when(F.col("event_type") == "purchase", "product_scanner").when(F.col("event_type") == "click", "category_scanner").otherwise("discoverer")
    e = e.withColumn("scan_type", kind)
    parts = [e.where(F.col("scan_type") == k) for k in ("discoverer", "product_scanner", "category_scanner")]
    rows = merge.stacked(*parts, order=("event_id",))
    return merge.priority_pick(rows, "user_id", stock.scan_weight(F.col("scan_type")), F.col("value"), F.col("event_id")).select("user_id", "event_id", "event_type", "value", stock.scan_weight(F.col("scan_type")).alias("weight"))


PICKED = f"select user_id, event_id, event_type, value, {WEIGHT} as weight from events qualify row_number() over (partition by user_id order by {WEIGHT} desc, value desc, event_id) = 1"


@query(PICKED)
def merge_priority_pick(spark, d):
    return _picked(spark, d)


@query(f"select weight, count(*) as n from ({PICKED}) group by weight")
def merge_scan_type_counts(spark, d):
    return _picked(spark, d).groupBy("weight").agg(F.count("*").alias("n"))


@query("select min(doc_id) as doc_id, count(*) as merged from documents where text is not null group by source, md5(lower(text))")
def content_dedup(spark, d):
    docs = _t(spark, d, "documents").where("text IS NOT NULL")
    return docs.groupBy("source", F.md5(F.lower("text")).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("merged")).select("doc_id", "merged")


@query("""with o as (select user_id, min(ts) f from events where ts < timestamp '2024-01-15' group by 1), n as (select user_id, min(ts) f, max(ts) l from events where ts >= timestamp '2024-01-15' group by 1)
select n.user_id, coalesce(o.f, n.f) as first_seen_at, n.l as last_seen_at from n left join o using (user_id)""")
def first_last_seen(spark, d):
    e = _t(spark, d, "events")
    cut = F.lit("2024-01-15").cast("timestamp")
    old = e.where(F.col("ts") < cut).groupBy("user_id").agg(F.min("ts").alias("first_seen_at"))
    new = e.where(F.col("ts") >= cut).groupBy("user_id").agg(F.min("ts").alias("first_seen_at"), F.max("ts").alias("now"))
    return merge.carried_times(new, old, F.col("now"), "user_id").select("user_id", "first_seen_at", "last_seen_at")


def _latest(spark, d, late: bool) -> DataFrame:
    o = _t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderpriority", _state().alias("in_stock"))
    cut = F.lit(SPLIT).cast("timestamp")
    o = o.where(F.col("o_orderdate") >= cut if late else F.col("o_orderdate") < cut)
    best = F.max_by(F.struct("in_stock", "o_orderdate", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey"))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", "b.*")


def _latest_sql(op: str) -> str:
    return f"(select o_custkey, {STATE} as in_stock, o_orderdate, o_orderpriority from orders where o_orderdate {op} timestamp '{SPLIT}' qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1)"


@query(f"select * from (select coalesce(a.o_custkey, b.o_custkey) as o_custkey, case when a.o_custkey is null then 'added' when b.o_custkey is null then 'deleted' when a.in_stock <> b.in_stock then 'changed' end as change from {_latest_sql('<')} a full join {_latest_sql('>=')} b on a.o_custkey = b.o_custkey) where change is not null")
def catalog_diff(spark, d):
    return merge.diff(_latest(spark, d, False), _latest(spark, d, True), "o_custkey", "in_stock")


RESTOCK = f"select n.o_custkey, n.in_stock, p.in_stock as previous_in_stock, coalesce(p.in_stock <> n.in_stock, false) as changed, coalesce(p.in_stock = 0 and n.in_stock = 1, false) as restocked, coalesce(p.in_stock = 1 and n.in_stock = 0, false) as destocked from {_latest_sql('>=')} n left join {_latest_sql('<')} p on n.o_custkey = p.o_custkey"


def _flags(spark, d):
    return snapshot.against_previous(_latest(spark, d, True).select("o_custkey", "in_stock"), _latest(spark, d, False), "o_custkey")


@query(RESTOCK)
def restock_flags(spark, d):
    return _flags(spark, d).select("o_custkey", "in_stock", "previous_in_stock", "changed", "restocked", "destocked")


@query(f"select count(*) as total_products, count(*) filter (restocked) as restocked, count(*) filter (destocked) as destocked, count(*) filter (changed) as changed, count(*) filter (in_stock = -1) as unknown from ({RESTOCK})")
def restock_stats(spark, d):
    return snapshot.stats(_flags(spark, d))


@query(f"select p.o_custkey, coalesce(n.in_stock, p.in_stock) as in_stock, coalesce(case when n.o_orderpriority like '1%' then n.o_orderpriority end, p.o_orderpriority) as price from {_latest_sql('<')} p left join {_latest_sql('>=')} n on n.o_custkey = p.o_custkey")
def live_overlay(spark, d):
    old = _latest(spark, d, False).select("o_custkey", "in_stock", F.col("o_orderpriority").alias("price"))
    new = _latest(spark, d, True).select("o_custkey", "in_stock", F.when(F.startswith("o_orderpriority", F.lit("1")), F.col("o_orderpriority")).alias("price"))
    return snapshot.overlaid(old, new, "o_custkey", ("in_stock",), ("price",))


@query(f"select l.o_custkey, c_mktsegment as type from {_latest_sql('>=')} l join customer on c_custkey = l.o_custkey where in_stock = -1 and c_mktsegment <> 'BUILDING'")
def unknown_targets(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    rows = _latest(spark, d, True).join(c, "o_custkey").withColumn("type", F.when(F.col("c_mktsegment") == "BUILDING", "category").otherwise("product"))
    return snapshot.targets(rows, True).select("o_custkey", F.col("c_mktsegment").alias("type"))


@query(f"select n.o_custkey, case when n.in_stock = -1 then timestamp '1999-01-01' when n.in_stock = p.in_stock then p.o_orderdate end as checked_at from {_latest_sql('>=')} n left join {_latest_sql('<')} p on n.o_custkey = p.o_custkey")
def checked_at_carry(spark, d):
    old = _latest(spark, d, False).select("o_custkey", F.col("in_stock").alias("was"), F.col("o_orderdate").alias("at"))
    new = _latest(spark, d, True).join(old, "o_custkey", "left")
    when = snapshot.carried_check_time(F.col("in_stock"), F.col("was"), F.col("in_stock") == -1, F.lit("1999-01-01").cast("timestamp"), F.col("at"))
    return new.select("o_custkey", when.alias("checked_at"))


@query("select r_name as site, count(*) as product_count, string_agg(n_name, ',' order by n_nationkey) as names from nation join region on n_regionkey = r_regionkey group by r_name")
def site_grouped(spark, d):
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("site"), F.lit("x").alias("platform"), F.lit("product").alias("type"), F.col("n_nationkey").alias("ordinal"), F.col("n_name").alias("name_raw"))
    return catalog.grouped(rows, "ordinal").select("site", "product_count", F.array_join(F.transform("products", lambda p: p["name_raw"]), ",").alias("names"))


@query("select page_id, substr(sha1(url), 1, 16) as product_id from pages")
def content_id(spark, d):
    return _t(spark, d, "pages").select("page_id", stock.content_id(F.col("url")).alias("product_id"))


@query(r"""with p as (select page_id, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) s, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) h,
 regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/{2,}', '/', 'g') p, regexp_extract(url, '\?([^#]*)', 1) q from pages),
k as (select page_id, lower(split_part(x, '=', 1)) || '=' || (case when contains(x, '=') then regexp_replace(x, '^[^=]*=', '') else '' end) kv, lower(split_part(x, '=', 1)) key, i from (select page_id, unnest(string_split(q, '&')) x, generate_subscripts(string_split(q, '&'), 1) i from p where q <> '') where x <> ''),
j as (select page_id, string_agg(kv, '&' order by key, i) q2 from k where key not in ('sid','session','phpsessid','utm_source','utm_medium','utm_campaign','utm_term','utm_content') group by page_id)
select page_id, s || '://' || h || (case when p = '' then '/' when length(p) > 1 then regexp_replace(p, '/$', '') else p end) || coalesce('?' || q2, '') as url from p left join j using (page_id)""")
def url_normalize(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.normalize(F.col("url")).alias("url"))


_DENIED = "[" + ", ".join(f"'{x}'" for x in urls.DENIED) + "]"
_LIKELY = "[" + ", ".join(f"'{x}'" for x in urls.LIKELY) + "]"


@query(rf"""with p as (select page_id, lower(url) u, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) p from pages)
select page_id, case when u not like 'http%' then 'non-http-scheme' when len(list_filter({_DENIED}, lambda t: contains(p, t))) > 0 then 'denylist:' || list_filter({_DENIED}, lambda t: contains(p, t))[1]
when contains(u, 'a=view') or contains(u, 'a=checkout') then 'cart-action-page' when len(list_filter({_LIKELY}, lambda t: contains(u, t))) = 0 then 'not-product-like' else 'ok' end as reason from p""")
def url_classify(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.classify_reason(F.col("url")).alias("reason"))


@query(rf"""with p as (select page_id, lower(url) u, lower(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)) p, lower(regexp_extract(url, '\?([^#]*)', 1)) q from pages)
select page_id, case when u not like 'http%' then 'non-http-scheme' when len(list_filter({_DENIED}, lambda t: contains(p, t))) > 0 then 'blocked-path:' || list_filter({_DENIED}, lambda t: contains(p, t))[1]
when contains(p, '&') then 'malformed-path-ampersand' when regexp_matches(p, '\.(png|jpg|jpeg|gif|webp|svg|ico|css|js|woff|woff2|ttf|eot|pdf|zip|tar|gz)$') then 'media-or-static-file'
when regexp_matches('&' || q, '&currency(=|&|$)') then 'blocked-query:currency' else 'ok' end as reason from p""")
def url_skip(spark, d):
    return _t(spark, d, "pages").select("page_id", urls.skip_reason(F.col("url")).alias("reason"))


@query("select lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as host, count(*) as n from pages group by 1")
def host_counts(spark, d):
    return _t(spark, d, "pages").groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


@query("""select page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || h as link from (select page_id, url, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) h from pages)""")
def link_extract(spark, d):
    p = _t(spark, d, "pages").select("page_id", "url", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("h"))
    return p.select("page_id", urls.resolved(F.col("url"), F.col("h")).alias("link"))


@query("select o_orderkey, '$' || cast(cast(floor(o_totalprice) as bigint) as varchar) || ' USD' as prices from orders")
def price_extract(spark, d):
    p = F.concat(F.lit("$"), F.floor("o_totalprice").cast("bigint").cast("string"), F.lit(" USD"))
    noisy = F.concat(F.lit("from "), p, F.lit(" or "), p, F.lit(", save 5 $ now"))
    return _t(spark, d, "orders").select("o_orderkey", F.array_join(text.prices(noisy), "|").alias("prices"))


@query("select doc_id from documents where contains(lower(text), 'license') or contains(text, '@')")
def marker_match(spark, d):
    return _t(spark, d, "documents").where(text.has_marker(F.col("text"), ("license", "@"))).select("doc_id")


@query(r"select min(doc_id) as doc_id, count(*) as n from documents group by md5(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^ | $', '', 'g'))")
def text_signature(spark, d):
    return _t(spark, d, "documents").groupBy(F.md5(text.squeezed(F.col("text"))).alias("k")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).select("doc_id", "n")


def _scans(spark, d) -> DataFrame:
    hits = _t(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("id")).distinct().withColumn("is_hit", F.lit(True))
    ids = _t(spark, d, "part").where("p_partkey <= 400").select(F.col("p_partkey").alias("id"))
    sites = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("site"))
    every = sites.select("site", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(400).cast("long"))).alias("id")).join(ids, "id", "left_semi")
    return every.join(hits, ["site", "id"], "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))


SCANS = "(select s_suppkey site, p_partkey id, h.l_suppkey is not null hit from supplier cross join part left join (select distinct l_suppkey, l_partkey from lineitem where l_quantity >= 49) h on h.l_suppkey = s_suppkey and h.l_partkey = p_partkey where p_partkey <= 400)"


@query(f"""with a as (select site, id, max(case when hit then id end) over (partition by site order by id rows between unbounded preceding and 1 preceding) b, max(case when hit then id end) over (partition by site order by id) u from {SCANS}),
c as (select site, max(id) m, min(id) filter (id > greatest(60, coalesce(least(400, b + 60), 60))) v, min(id) filter (id - coalesce(u, 0) >= 40 and id >= 20) s from a group by site)
select site, least(m, 400, coalesce(v - 1, 400), coalesce(s, 400)) as last_id, case when s = least(400, coalesce(v - 1, 400), coalesce(s, 400)) then 'streak' when v - 1 = least(400, coalesce(v - 1, 400), coalesce(s, 400)) then 'reach' else 'hard-cap' end as reason from c""")
def scan_stop(spark, d):
    df = scan.processed(_scans(spark, d), start=F.lit(1), hard=F.lit(400), floor=20, tail=60, streak=40)
    return df.where("processed").groupBy("site").agg(F.max("id").alias("last_id"), F.max("reason").alias("reason"))


@query("select l_suppkey as site, max(l_partkey) as high, greatest(0, max(l_partkey) - 60) as resume from lineitem where l_quantity >= 49 group by 1")
def highwater(spark, d):
    hits = _t(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("id"))
    return scan.high_water(hits, "site", F.lit(0), 60)


@query()
def scan_stop_whole(spark, d):
    """scan_stop over every hit, each supplier up to the greatest part key."""
    hits = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("id"))
    parts = _t(spark, d, "part").select(F.col("p_partkey").alias("id"))
    return scan.stops(_t(spark, d, "supplier").select(F.col("s_suppkey").alias("site")), parts, hits, floor=20, tail=60, streak=40)


@query()
def highwater_whole(spark, d):
    """highwater over every hit."""
    hits = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("id"))
    return scan.high_water(hits, "site", F.lit(0), 60)


def _edges(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem").where("l_quantity >= 49 AND l_discount < 0.02").select("l_partkey", "l_suppkey").distinct()
    other = li.withColumnRenamed("l_suppkey", "dst")
    return li.join(other, "l_partkey").select(F.lit("s").alias("site"), F.col("l_suppkey").alias("src"), "dst").where("src != dst").distinct()


@query("""with recursive li as (select distinct l_partkey p, l_suppkey s from lineitem where l_quantity >= 49 and l_discount < 0.02), e as (select distinct a.s src, b.s dst from li a join li b using (p) where a.s <> b.s),
w(node, depth) as (select cast(1 as bigint), 0 union select e.dst, w.depth + 1 from w join e on e.src = w.node where w.depth < 4) select node, min(depth) as depth from w group by node""")
def bfs_layers(spark, d):
    seeds = spark.range(1, 2).select(F.lit("s").alias("site"), F.col("id").alias("node"))
    return crawl.layers(_edges(spark, d), seeds, max_depth=4, max_pages=None).select("node", "depth")


@query("select c_custkey, c_name, n_name from customer join nation on c_nationkey = n_nationkey where contains(lower(c_name || ' ' || c_mktsegment || ' ' || n_name), 'auto') and c_acctbal > 0")
def dashboard_search(spark, d):
    rows = _t(spark, d, "customer").join(_t(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("c_acctbal > 0")
    return catalog.searched(rows, ("c_name", "c_mktsegment", "n_name"), "AUTO").select("c_custkey", "c_name", "n_name").orderBy("n_name", "c_custkey")


@query(f"select count(*) as total, count(*) filter (s = 1) as in_stock, count(*) filter (s = 0) as out_of_stock, count(*) - count(*) filter (s = 1) - count(*) filter (s = 0) as unknown from (select {STATE} s from orders)")
def dashboard_stats(spark, d):
    return catalog.dashboard_stats(_t(spark, d, "orders").select(_state().alias("in_stock")))


@query(f"select o_custkey, section, row_number() over (partition by section order by lower(c_name), o_custkey) as place from (select r.o_custkey, c_name, case when restocked then 'restocked' when destocked then 'destocked' else 'changed' end section from ({RESTOCK}) r join customer on c_custkey = r.o_custkey where changed)")
def alert_sections(spark, d):
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = _flags(spark, d).where("changed").join(c, "o_custkey")
    return messages.sectioned(rows, [F.lower("c_name"), F.col("o_custkey")]).select("o_custkey", "section", "place")


@query("select event_id, case when m < 60 then m || 'm ago' when m < 1440 then (m // 60) || 'h ago' else (m // 1440) || 'd ago' end as age from (select event_id, (epoch(timestamp '2024-02-01') - floor(epoch(ts))::bigint)::bigint // 60 m from events)")
def age_label(spark, d):
    minutes = F.floor((F.lit(1706745600) - F.floor(F.unix_timestamp("ts"))) / 60)
    return _t(spark, d, "events").select("event_id", text.age_label(minutes).alias("age"))


@query("select event_id, cast(json_extract(props, '$.k') as int) as k, case when cast(json_extract(props, '$.k') as int) > 0 then 1 else 0 end as in_stock from events")
def json_feed(spark, d):
    k = F.from_json("props", "k int")["k"]
    return _t(spark, d, "events").select("event_id", k.alias("k"), feeds.feed_state(k.cast("string")).alias("in_stock"))


@query("select l_suppkey as site, count(distinct l_partkey) as found, count(distinct l_partkey) >= 50 as accepted from lineitem group by 1")
def accept_count(spark, d):
    from stockloom.operators import registry

    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_partkey").alias("url"))
    return registry.accepted(rows, 50)


@query()
def page_signals(spark, d):
    """One row a page and platform: each parser judges every page."""
    pages = _t(spark, d, "pages").select("page_id", F.col("url").alias("final_url"), "html", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("platform"))
    return html_pages.parsed(pages)


@query()
def message_chunks(spark, d):
    rows = messages.sectioned(_flags(spark, d).where("changed"), [F.col("o_custkey")])
    blocks = rows.select("section", "place", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" now "), stock.badge(F.col("in_stock"))).alias("block"))
    titles = {"restocked": "*Restocked*", "destocked": "*Out of stock*", "changed": "*Changed*"}
    return messages.chunked(blocks, limit=1000, header="*Stock changed*", titles=titles)
