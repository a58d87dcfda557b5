"""More registered queries, each of one operator over the driver's tables, and the same in SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F

from stockloom.functions import stock, text, urls
from stockloom.operators import catalog, merge, messages, registry, scan, snapshot
from stockloom.plans.catalogue import SPLIT, STATE, _flags, _latest, _latest_sql, _t, query
from stockloom.sources import feeds

#: What is put behind the host of each page's URL: hard cases of normalising, classifying and skipping.
HARD = (
    "", "?b=2&utm_source=x&a=1+2", "//x//y/?=5&Lang=fr&currency=2", "/a.png/", "/p?&amp;Gid=3&sid=9", "/a;p=1?b=%C3%A9&c=~*", "/store/vps?lang=de", "/index.php?rp=%2Fstore%2Fvps", "/index.php?rp=//login",
    "/index.php?rp=/Store/A/B&rp=/contact", "/cart.php?a=view", "/cart.php?a=add&pid=3", "/cart.php?gid=3", "/cart.php?language=en", "/cart.php", "/?data=confproduct", "/cart.php?a=confproduct&i=0", "/contact.php", "/x/cdn-cgi/l",
    "/a&b", "/?action=a&cmd=hbchat&action=embed", "/?languagechange=1", "/?locale=en-GB", "/store/a/b/?x=%41#top", "/?cmd=cart&action=add&id=4", "/?cat_id=3",
)
_values = ", ".join(f"({i}, '{v}')" for i, v in enumerate(HARD))
_list = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"
_enc = lambda x: f"replace(url_encode({x}), '%20', '+')"

#: n: the normal form of every hard URL; k: its pairs.
NORMAL = rf"""u as (select page_id, v, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || s as url from pages, (values {_values}) t(v, s)),
p as (select page_id, v, url, lower(regexp_extract(url, '^([A-Za-z]+)://', 1)) sc, lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) h, regexp_replace(regexp_replace(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/{{2,}}', '/', 'g') pa, regexp_extract(url, '\?([^#]*)', 1) q from u),
k as (select page_id, v, i, regexp_replace(lower(trim(url_decode(replace(split_part(x, '=', 1), '+', ' ')))), '^&*(amp;)*', '') as key, url_decode(replace(case when contains(x, '=') then regexp_replace(x, '^[^=]*=', '') else '' end, '+', ' ')) as val
 from (select page_id, v, unnest(string_split(q, '&')) x, generate_subscripts(string_split(q, '&'), 1) i from p where q <> '') where x <> ''),
j as (select page_id, v, string_agg({_enc('key')} || '=' || {_enc('val')}, '&' order by key, i) as q2 from k where key <> '' and not list_contains({_list(urls.VOLATILE)}, key) group by page_id, v),
n as (select page_id, v, p.url as given, sc, case when pa = '' then '/' when length(pa) > 1 then regexp_replace(pa, '/$', '') else pa end as pa, sc || '://' || h || (case when pa = '' then '/' when length(pa) > 1 then regexp_replace(pa, '/$', '') else pa end) || coalesce('?' || q2, '') as url from p left join j using (page_id, v)),
r as (select page_id, v, i, key, trim(lower(val)) as val from k where not list_contains({_list(urls.VOLATILE)}, key))"""


def _hard(spark, d):
    variants = F.posexplode(F.array(*[F.lit(v) for v in HARD])).alias("v", "s")
    rows = _t(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*", 0).alias("root"), variants)
    return rows.select("page_id", "v", F.concat("root", "s").alias("u"))


@query(f"with {NORMAL} select page_id, v, url from n")
def url_normalize_hard(spark, d):
    return _hard(spark, d).select("page_id", "v", urls.normalize(F.col("u")).alias("url"))


@query(f"""with {NORMAL}, b as (select page_id, v, min(list_filter({_list(urls.DENIED)}, lambda t: contains(val, t))[1]) as denied, bool_or(contains(val, '/store/')) as store from (select page_id, v, val from r where key = 'rp') group by page_id, v)
select page_id, v, case when len(list_filter({_list(urls.DENIED)}, lambda t: contains(lower(pa), t))) > 0 then 'denylist:' || list_filter({_list(urls.DENIED)}, lambda t: contains(lower(pa), t))[1]
 when contains(lower(url), 'a=view') or contains(lower(url), 'a=checkout') then 'cart-action-page' when denied is not null then 'blocked-route:' || denied
 when not coalesce(store, false) and len(list_filter({_list(urls.LIKELY)}, lambda t: contains(lower(url), t))) = 0 then 'not-product-like' else 'ok' end as reason from n left join b using (page_id, v)""")
def url_classify_hard(spark, d):
    return _hard(spark, d).select("page_id", "v", urls.classify_reason(F.col("u")).alias("reason"))


@query(f"""with {NORMAL}, x as (select page_id, v, key, i, case when key = 'currency' then 'blocked-query:currency' when key = 'languagechange' then 'blocked-query:languagechange'
 when list_contains({_list(urls.LANGUAGE_KEYS)}, key) and val <> '' and not list_contains({_list(urls.ENGLISH)}, val) then 'non-english-language:' || val
 when key = 'rp' then 'blocked-route:' || list_filter({_list(urls.DENIED)}, lambda t: contains(val, t))[1] end as why from r),
y as (select page_id, v, arg_min(why, (key, i)) as why from x where why is not null group by page_id, v),
z as (select page_id, v, arg_max(val, i) filter (key = 'action') = 'embed' and arg_max(val, i) filter (key = 'cmd') = 'hbchat' as chat from r group by page_id, v)
select page_id, v, case when len(list_filter({_list(urls.DENIED)}, lambda t: contains(lower(pa), t))) > 0 then 'blocked-path:' || list_filter({_list(urls.DENIED)}, lambda t: contains(lower(pa), t))[1]
 when list_contains(string_split(lower(pa), '/'), 'cdn-cgi') then 'blocked-path:cdn-cgi' when contains(pa, '&') then 'malformed-path-ampersand'
 when len(list_filter({_list(urls.STATIC)}, lambda t: suffix(lower(pa), t))) > 0 then 'media-or-static-file' when coalesce(chat, false) then 'blocked-query:hbchat' else coalesce(why, 'ok') end as reason
from n left join y using (page_id, v) left join z using (page_id, v)""")
def url_skip_hard(spark, d):
    return _hard(spark, d).select("page_id", "v", urls.skip_reason(F.col("u")).alias("reason"))


@query(f"""with {NORMAL}, a as (select page_id, v, arg_min(trim(lower(val)), i) filter (key = 'a') as a, count(*) filter (key = 'pid') > 0 as pid, count(*) filter (key <> '' and not list_contains({_list(urls.LANGUAGE_KEYS)}, key)) = 0 as bare,
 arg_min(lower(val), i) filter (key = 'rp' and contains(lower(val), '/store/') and regexp_matches(lower(val), '/store/+[^/]')) as rp from (select page_id, v, i, lower(trim(url_decode(split_part(x, '=', 1)))) as key, url_decode(replace(case when contains(x, '=') then regexp_replace(x, '^[^=]*=', '') else '' end, '+', ' ')) as val from (select page_id, v, unnest(string_split(q, '&')) x, generate_subscripts(string_split(q, '&'), 1) i from p where q <> '') where x <> '') group by page_id, v),
s as (select page_id, v, p.pa, a, pid, coalesce(bare, true) as bare, len(list_filter(string_split(regexp_replace(case when regexp_matches(lower(p.pa), '/store/+[^/]') then lower(p.pa) else rp end, '^.*?/store/', ''), '/'), lambda t: t <> '')) as m from p left join a using (page_id, v))
select page_id, v, case when a = 'confproduct' then 'confproduct' when coalesce(m, 0) >= 2 then 'store_product' when m = 1 then 'store_category' when suffix(lower(pa), 'cart.php') and a = 'add' and pid then 'cart_add' when suffix(lower(pa), 'cart.php') and bare then 'cart_root' else 'other' end as route from s""")
def url_route(spark, d):
    return _hard(spark, d).select("page_id", "v", urls.route_label(F.col("u")).alias("route"))


@query("""select page_id, i, case i when 0 then root || '/p/q?z=1' when 1 then root || path || '?z=1' when 2 then regexp_extract(url, '^[A-Za-z]+:') || '//h.example/x' when 3 then root || folder || 'd/e' when 4 then root || case when folder = '/' then '/' else regexp_replace(folder, '[^/]+/$', '') end || 'd' when 5 then 'https://o.example/' end as link
from (select page_id, url, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') as root, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as path, regexp_replace(case when regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) end, '[^/]*$', '') as folder from pages), range(6) t(i)""")
def url_resolve(spark, d):
    hrefs = F.posexplode(F.array(*[F.lit(x) for x in ("/p/./q?z=1", "?z=1", "//h.example/x", "./d/e", "../d", "https://o.example/")])).alias("i", "href")
    return _t(spark, d, "pages").select("page_id", "url", hrefs).select("page_id", F.col("i").cast("long").alias("i"), urls.resolved(F.col("url"), F.col("href")).alias("link"))


@query("""select h as root, 'https://' || h || '/' || '|https://' || h || '/index.php|https://' || h || '/cart.php|https://' || h || '/store|https://' || h || '/index.php?rp=%2Fstore' as seeds from (select distinct lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)) as h from pages)""")
def url_seeds(spark, d):
    hosts = _t(spark, d, "pages").select(urls.host(F.col("url")).alias("root")).distinct()
    return hosts.select("root", F.array_join(urls.seeds(F.concat(F.lit("https://"), "root")), "|").alias("seeds"))


@query(f"""with {NORMAL}, c as (select page_id, v, given, case when contains(lower(pa), '/store/') then regexp_replace(lower(pa), '^.*?/store/', '') when starts_with(rp, '/store/') then regexp_replace(rp, '^.*?/store/', '') end as tail from (select n.page_id, n.v, given, regexp_extract(given, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) as pa, (select arg_max(lower(val), i) from k where k.page_id = n.page_id and k.v = n.v and key = 'rp') as rp from n))
select page_id, v, contains(lower(given), 'a=add&pid=') or contains(lower(given), 'action=add&id=') or coalesce(len(list_filter(string_split(tail, '/'), lambda t: t <> '')), 0) >= 2 as product, contains(lower(given), 'gid=') or contains(lower(given), 'cat_id=') or coalesce(len(list_filter(string_split(tail, '/'), lambda t: t <> '')), 0) = 1 as category from c""")
def url_candidates(spark, d):
    return _hard(spark, d).select("page_id", "v", urls.is_product_candidate(F.col("u")).alias("product"), urls.is_category_candidate(F.col("u")).alias("category"))


@query("""select event_id, case when trunc(value) in (-1, 0, 1) then cast(trunc(value) as int) else -1 end as of_double, case when value > 50 then 1 else 0 end as of_flag, case event_id % 6 when 0 then 1 when 1 then 0 when 2 then -1 when 3 then -1 when 4 then 0 else 1 end as of_text from events""")
def tri_state_values(spark, d):
    e = _t(spark, d, "events")
    words = F.element_at(F.array(*[F.lit(x) for x in ("In_Stock", " 0 ", "1.0", "2", "out_of_stock", "+1")]), (F.col("event_id") % 6 + 1).cast("int"))
    return e.select("event_id", stock.tri_state(F.col("value")).alias("of_double"), stock.tri_state(F.col("value") > 50).alias("of_flag"), stock.tri_state(words).alias("of_text"))


@query("""select page_id, case when page_id % 5 = 3 then true when page_id % 4 in (1, 3) then page_id % 5 in (0, 2) or page_id % 7 = 0 when page_id % 4 = 0 then page_id % 5 = 0 else false end as challenge, page_id % 4 = 0 as success, page_id % 4 = 3 as retriable from pages""")
def response_marks(spark, d):
    p = F.col("page_id")
    status = F.element_at(F.array(*[F.lit(x) for x in (200, 403, 404, 503)]), (p % 4 + 1).cast("int"))
    body = F.element_at(F.array(*[F.lit(x) for x in ("Just a Moment...", "plain", "Enable JavaScript and cookies to continue", "/cdn-cgi/challenge-platform/x", "text")]), (p % 5 + 1).cast("int"))
    headers = F.when(p % 7 == 0, F.create_map(F.lit("Server"), F.lit("CloudFlare")))
    return _t(spark, d, "pages").select("page_id", stock.challenge_page(status, body, headers).alias("challenge"), stock.succeeded(status).alias("success"), stock.retriable(status).alias("retriable"))


@query("""select c_custkey, least(greatest(case when c_custkey % 3 = 0 then 7 else cast(c_custkey as int) - 20 end, 1), 900) as bounded, case when c_custkey % 2 = 0 then c_name when c_custkey % 3 = 0 then '' else 'k' || c_custkey end as key,
case c_custkey % 3 when 0 then 'Unknown' when 1 then 'In stock' else 'Out of stock' end as badge, case c_custkey % 3 when 0 then -1 when 1 then 1 else 0 end as flag, case c_custkey % 4 when 0 then 3 when 1 then 2 when 2 then 1 else 0 end as weight from customer""")
def scalar_coercions(spark, d):
    k = F.col("c_custkey")
    third = F.when(k % 3 == 0, F.lit(None).cast("boolean")).otherwise(k % 3 == 1)
    kind = F.element_at(F.array(*[F.lit(x) for x in ("product_scanner", "category_scanner", "discoverer", "other")]), (k % 4 + 1).cast("int"))
    given = F.when(k % 3 == 0, "x").otherwise((k - 20).cast("string"))
    return _t(spark, d, "customer").select(
        "c_custkey", stock.positive_int(given, 7, 1, 900).alias("bounded"), stock.stock_key(F.when(k % 2 == 0, F.col("c_name")).otherwise(""), F.when(k % 3 != 0, F.concat(F.lit("k"), k.cast("string")))).alias("key"),
        stock.badge(stock.flag_state(third)).alias("badge"), stock.flag_state(third).alias("flag"), stock.scan_weight(kind).alias("weight"),
    )


@query(r"""select page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as html_escaped, md5(replace(replace(replace(html, '<', chr(92) || 'u003c'), '>', chr(92) || 'u003e'), '&', chr(92) || 'u0026')) as json_escaped,
md5(regexp_replace(html, '([_*\[\]()~`>#+\-=|{}.!])', '\\\1', 'g')) as markdown from pages""")
def escapes(spark, d):
    h = F.col("html")
    return _t(spark, d, "pages").select("page_id", F.md5(text.html_escaped(h)).alias("html_escaped"), F.md5(text.json_in_html(h)).alias("json_escaped"), F.md5(text.markdown_escaped(h)).alias("markdown"))


@query("""select c_custkey, c_name as name, 'https://shop.example/' || c_custkey as url, case when c_custkey % 5 = 0 then null else cast(c_custkey as int) end as expected, c_custkey % 2 = 0 as scan, c_custkey % 3 = 0 as discover,
case when c_custkey % 4 = 3 then 'unsupported-action' when c_custkey % 4 = 2 then 'ok' else 'ok' end as reason from customer""")
def issue_forms(spark, d):
    k = F.col("c_custkey")
    box = lambda on, label: F.concat(F.when(on, "- [x] ").otherwise("- [ ] "), F.lit(label))
    action = F.element_at(F.array(*[F.lit(x) for x in ("add", "Edit", "add", "drop")]), (k % 4 + 1).cast("int"))
    body = F.concat_ws("\n\n", F.concat(F.lit("### Action\n\n"), action), F.concat(F.lit("### Name\n<!-- hint -->\n"), "c_name"), F.concat(F.lit("### URL\n\nhttps://shop.example/"), k.cast("string")),
                       F.concat(F.lit("### Expected products\n\n"), F.when(k % 5 == 0, "none").otherwise(F.concat(F.lit("about "), k.cast("string"), F.lit(" or 7")))), F.concat(F.lit("### Options\n\n"), box(k % 2 == 0, "Scan"), F.lit("\n"), box(k % 3 == 0, "Discover")))
    e = registry.entries(_t(spark, d, "customer").select("c_custkey", body.alias("body")))
    boxes = text.checkboxes(F.try_element_at(text.form_fields(F.col("body")), F.lit("options")))
    return e.select("c_custkey", "name", "url", "expected", boxes["scan"].alias("scan"), boxes["discover"].alias("discover"), "reason")


DEDUP = """with g as (select doc_id, source, lang, text, case doc_id % 3 when 0 then 3 when 1 then 2 else 1 end as w, doc_id % 10 = 9 as exempt from documents where text is not null),
k as (select *, case when exempt then 'url:' || doc_id else source || chr(1) || lang || chr(1) || regexp_replace(text, '^[ \\t\\n\\r\\f\\v]+|[ \\t\\n\\r\\f\\v]+$', '', 'g') end as key from g),
r as (select *, row_number() over (partition by key order by w desc, doc_id) as n, count(*) over (partition by key) as c from k)
select max(doc_id) filter (n = 1) as doc_id, string_agg(case when n = 2 then e || '|content-dedup-merged' else e end, '|' order by n) as evidence from (select *, 'd' || doc_id || case when exempt then '|oos-marker' else '' end as e from r) group by key"""


@query(DEDUP.replace("\\\\", "\\"))
def content_dedup_records(spark, d):
    k = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("product_scanner", "category_scanner", "discoverer")]), (k % 3 + 1).cast("int"))
    own = F.concat(F.lit("d"), k.cast("string"))
    rows = _t(spark, d, "documents").where("text IS NOT NULL").select(
        F.col("source").alias("site"), F.col("lang").alias("name_raw"), F.col("text").alias("description_raw"), k.cast("string").alias("canonical_url"), kind.alias("scan_type"), k.alias("first_ordinal"), "doc_id",
        F.when(k % 10 == 9, F.array(own, F.lit("oos-marker"))).otherwise(F.array(own)).alias("evidence"),
    )
    return merge.content_dedup(rows).select("doc_id", F.array_join("evidence", "|").alias("evidence"))


MERGED = """with s as (select 'https://x.example/store/p/' || (l_partkey % 500) as url, case when l_linenumber = 1 then 0 when l_linenumber = 2 then 1 else 2 end as src, l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where l_linenumber <= 3),
a as (select *, case src when 0 then 1 when 1 then 3 else 2 end as w, 'n' || lpad(cast(l_orderkey as varchar), 9, '0') || '-' || l_linenumber || '-' || l_partkey as name from s),
b as (select * from a qualify row_number() over (partition by url order by w desc, cast(l_quantity as int) % 3 desc, src, name) = 1)
select url as canonical_url, name as name_raw, cast(cast(l_quantity as int) % 3 - 1 as int) as in_stock, case when cast(regexp_extract(url, '[0-9]+$') as int) % 2 = 0 then '2020' else 'now' end as first_seen_at, 'now' as last_seen_at, substr(sha1(url), 1, 16) as product_id from b"""


@query(MERGED)
def merge_records(spark, d):
    li = _t(spark, d, "lineitem").where("l_linenumber <= 3")
    n = F.col("l_quantity").cast("int") % 3
    name = F.concat(F.lit("n"), F.lpad(F.col("l_orderkey").cast("string"), 9, "0"), F.lit("-"), F.col("l_linenumber").cast("string"), F.lit("-"), F.col("l_partkey").cast("string"))
    url = F.concat(F.lit("HTTPS://X.example/store//p/"), (F.col("l_partkey") % 500).cast("string"), F.lit("/?utm_source=z"))

    def source(line: int, kind: str):
        return li.where(F.col("l_linenumber") == line).select(
            F.lit("s").alias("site"), F.lit("a").alias("platform"), url.alias("canonical_url"), F.lit(kind).alias("scan_type"), (n - 1).cast("string").alias("in_stock"), name.alias("name_raw"), name.alias("description_raw"),
            F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.lit("e"), i.cast("string"))).alias("evidence"))

    previous = spark.range(0, 500, 2).select(F.concat(F.lit("https://x.example/store/p/"), F.col("id").cast("string")).alias("canonical_url"), F.lit("2020").alias("first_seen_at"))
    out = merge.merge_records(source(1, "discoverer"), source(2, "product_scanner"), source(3, "category_scanner"), previous, F.lit("now"))
    return out.select("canonical_url", "name_raw", "in_stock", "first_seen_at", "last_seen_at", "product_id")


@query(f"""with r as (select n.o_custkey, n.in_stock as now_state, p.in_stock as was, n.o_orderpriority as price from {_latest_sql('<')} p left join {_latest_sql('>=')} n on n.o_custkey = p.o_custkey),
q as (select p.o_custkey, p.in_stock as was, n.in_stock as verdict, n.o_orderpriority as pr from {_latest_sql('<')} p left join {_latest_sql('>=')} n on n.o_custkey = p.o_custkey),
f as (select *, pr is not null and pr not like '5%' as ok from q),
g as (select *, case when was = -1 and ok and verdict in (0, 1) then verdict else was end as state, was = -1 as checked from f),
h as (select g.*, case when o_custkey % 3 = 0 then null when o_custkey % 3 = 1 then 1 else 0 end as prev from g)
select 'c' || o_custkey as canonical_url, state as in_stock, prev as previous_in_stock, coalesce(prev <> state, false) as changed, case when checked then 'now' when prev is not null and prev = state then 'then' else 'now' end as checked_at,
case when not checked then 'own' when ok then 'seen|tier:t' when pr is null then 'fetch-error:missing' else 'fetch-error:timeout' end as evidence from h""")
def snapshot_refresh(spark, d):
    old, new = _latest(spark, d, False), _latest(spark, d, True)
    url = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    products = old.select(F.lit("x").alias("product_id"), url.alias("canonical_url"), F.lit("s").alias("site"), F.lit("product").alias("type"), F.lit("n").alias("name_raw"), "in_stock", F.array(F.lit("own")).alias("evidence"), F.col("o_custkey").alias("ordinal"), F.lit("").alias("checked_at"))
    verdict = snapshot.page_verdict(F.lit(""), F.lit("a"), F.col("in_stock"), F.array(F.lit("seen")), F.lit(-1))
    pages = new.select(url.alias("canonical_url"), (~F.startswith("o_orderpriority", F.lit("5"))).alias("ok"), F.lit("timeout").alias("error"), F.lit("t").alias("tier"), verdict.alias("verdict"))
    previous = old.where("o_custkey % 3 <> 0").select(url.alias("canonical_url"), F.when(F.col("o_custkey") % 3 == 1, 1).otherwise(0).alias("in_stock"), F.lit("then").alias("checked_at"), F.lit(2).alias("ordinal"))
    stale = previous.withColumn("in_stock", F.lit(-1)).withColumn("ordinal", F.lit(1))
    _, shot, _ = snapshot.refreshed(products, previous.unionByName(stale), pages, F.lit("now"))
    return shot.select("canonical_url", "in_stock", "previous_in_stock", "changed", "checked_at", F.array_join("evidence", "|").alias("evidence"))


@query(r"""select p_partkey, case when p_partkey % 4 = 0 then '🟢 *In Stock* ' when p_partkey % 4 = 1 then '🔴 *Out of Stock* ' else '⚪ *Unknown* ' end || regexp_replace(p_name, '([_*\[\]()~`>#+\-=|{}.!])', '\\\1', 'g') || chr(10) || '*Site:* ' || case when p_partkey % 5 = 0 then 'Unknown Site' else regexp_replace(p_brand, '([_*\[\]()~`>#+\-=|{}.!])', '\\\1', 'g') end || chr(10) || '*Price:* ' || p_size || chr(10)
|| case when p_partkey % 7 = 0 then '🔗 *Link:* N/A' else '🔗 [Open Product](https://x.example/a\(' || p_partkey || '\))' end as block from part""")
def product_text_blocks(spark, d):
    k = F.col("p_partkey")
    state = F.when(k % 4 == 0, 1).when(k % 4 == 1, 0).otherwise(-1)
    url = F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("https://x.example/a("), k.cast("string"), F.lit(")")))
    blocks = messages.product_blocks(F.col("p_name"), F.when(k % 5 != 0, F.col("p_brand")), F.col("p_size"), state, url)
    return _t(spark, d, "part").select("p_partkey", F.get(blocks, F.lit(0))["block"].alias("block"))


CHANGES = f"(select n.o_custkey, n.in_stock, coalesce(p.in_stock = 0 and n.in_stock = 1, false) as up, coalesce(p.in_stock = 1 and n.in_stock = 0, false) as down from {_latest_sql('>=')} n left join {_latest_sql('<')} p on n.o_custkey = p.o_custkey where p.in_stock <> n.in_stock)"


@query(f"select count(*) filter (up) as restocked, count(*) filter (down) as destocked, count(*) filter (not up and not down) as other, '🟢 *' || count(*) filter (up) || '* back in stock • 🔴 *' || count(*) filter (down) || '* out of stock • ⚪ *' || count(*) filter (not up and not down) || '* other' as header from {CHANGES}")
def section_header(spark, d):
    return messages.section_header(_flags(spark, d).where("changed"))


@query(f"""with recursive b as (select row_number() over (order by s, o_custkey) as k, s, row_number() over (partition by s order by o_custkey) as i, case s when 0 then '*Restocked*' when 1 then '*Out of stock*' else '*Changed*' end as title,
 'customer ' || o_custkey || ' now ' || case in_stock when 1 then 'In stock' when 0 then 'Out of stock' else 'Unknown' end as block from (select *, case when up then 0 when down then 1 else 2 end as s from {CHANGES})),
w(k, part, len, fresh) as (select k, 0, cast(15 + 2 + length(title) + 2 + length(block) as bigint), false from b where k = 1
 union all select b.k, case when fits then w.part else w.part + 1 end, cast(case when fits then w.len + more else 12 + 2 + length(title) + 2 + length(block) end as bigint), not fits
 from (select w.*, w.len + case when b.i = 1 then 2 + length(b.title) else 0 end + 2 + length(b.block) <= 936 as fits, case when b.i = 1 then 2 + length(b.title) else 0 end + 2 + length(b.block) as more from w join b on b.k = w.k + 1) w join b on b.k = w.k + 1)
select part, string_agg(case when k = 1 then '*Stock changed*' || chr(10) || chr(10) || title || chr(10) || chr(10) || block when fresh then '_\\(cont\\.\\)_' || chr(10) || chr(10) || title || chr(10) || chr(10) || block when i = 1 then title || chr(10) || chr(10) || block else block end, chr(10) || chr(10) order by k) as message from w join b using (k) group by part""")
def message_chunks_whole(spark, d):
    """The chunker over every change, as `message_chunks`, with SQL."""
    rows = messages.sectioned(_flags(spark, d).where("changed"), [F.col("o_custkey")])
    blocks = rows.select("section", "place", F.concat(F.lit("customer "), F.col("o_custkey").cast("string"), F.lit(" now "), stock.badge(F.col("in_stock"))).alias("block"))
    return messages.chunked(blocks, limit=1000, header="*Stock changed*", titles={"restocked": "*Restocked*", "destocked": "*Out of stock*", "changed": "*Changed*"})


@query("select n_regionkey || '-' || n_nationkey as plan, n_name as name_raw, cast(case when n_nationkey % 3 = 0 then 0 else 1 end as int) as in_stock, r_name || ' - N' || n_nationkey as location, case when n_nationkey % 2 = 0 then 'traffic' else 'bandwidth' end as product_type, 'Month: ' || n_nationkey as price_raw from nation join region on r_regionkey = n_regionkey")
def vendor_feeds(spark, d):
    n = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("n_nationkey").cast("string")
    plan = F.struct(F.concat(F.col("n_regionkey").cast("string"), F.lit("-"), k).alias("id"), F.col("n_name").alias("plan_name"), F.when(F.col("n_nationkey") % 3 == 0, "").otherwise(k).alias("stock"), F.when(F.col("n_nationkey") % 2 == 0, "1T").otherwise(" ").alias("flow"), F.create_map(F.lit("month"), k).alias("price_datas"))
    node = lambda label: F.struct(k.alias("id"), F.concat(F.lit("N"), k).alias(label), F.lit("").alias("detail"), F.array(plan).alias("plans"))

    def payloads(label: str, wrap):
        areas = n.groupBy("n_regionkey").agg(F.array(F.struct(F.lit("1").alias("id"), F.first("r_name").alias("area_name"), F.collect_list(node(label)).alias("nodes"))).alias("areas"))
        return areas.select("n_regionkey", F.lit("s").alias("site"), F.to_json(wrap(F.col("areas"))).alias("json"))

    first = payloads("node_name", lambda a: F.struct(a.alias("data"))).where("n_regionkey % 2 = 0")
    second = payloads("group_name", lambda a: F.struct(F.struct(a.alias("areas")).alias("data"))).where("n_regionkey % 2 = 1")
    html = F.concat(F.lit("<html><PRE style='x'>"), F.replace(F.replace("json", F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("</pre></html>"))
    a = feeds.plans(first.select("site", html.alias("payload")))
    b = feeds.plans(second.select("site", F.col("json").alias("payload")), "data.areas", "group_name")
    both = a.unionByName(b)
    return both.select(F.col("plan_id").alias("plan"), "name_raw", F.col("in_stock").cast("int").alias("in_stock"), F.get("locations_raw", F.lit(0)).alias("location"), "product_type", "price_raw")


@query("select s_suppkey as name, case when s_suppkey % 4 = 0 then 'new' || s_suppkey else 'old' || s_suppkey end as url from supplier where s_suppkey % 5 <> 0 union all select s_suppkey, 'new' || s_suppkey from supplier where s_suppkey % 5 = 0 and s_suppkey % 3 = 0")
def registry_upsert(spark, d):
    s = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("name"))
    named = lambda p: F.concat(F.lit(p), F.col("name").cast("string")).alias("url")
    sites = s.where("name % 5 <> 0").select("name", named("old"))
    changes = s.where("name % 4 = 0").select(F.lit("edit").alias("action"), "name", named("new")).unionByName(s.where("name % 3 = 0").select(F.lit("add").alias("action"), "name", named("new")))
    return registry.upserted(sites, changes)


@query("select l_suppkey as site, l_linenumber as counter, max(l_partkey) as value from lineitem group by 1, 2")
def state_marks(spark, d):
    rows = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("site"), F.col("l_linenumber").alias("counter"), F.col("l_partkey").alias("value"))
    return registry.with_state(rows.where("value % 2 = 0"), rows.where("value % 2 = 1"))


@query("select n_nationkey, n_name as name_raw, r_name as site, case when n_nationkey % 4 = 0 then 'category' else 'product' end as type from nation join region on r_regionkey = n_regionkey")
def grouped_round_trip(spark, d):
    rows = _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.select(F.col("r_name").alias("site"), F.lit("x").alias("platform"), F.when(F.col("n_nationkey") % 4 == 0, "category").otherwise("product").alias("type"), F.col("n_nationkey").alias("i"), "n_nationkey", F.col("n_name").alias("name_raw"))
    return catalog.unnested(catalog.grouped(rows, "i")).select("n_nationkey", "name_raw", "site", "type")


@query(f"select count(*) as total_products, count(distinct o_custkey % 7) as total_sites, count(*) filter (s = 1) as in_stock, count(*) filter (s = 0) as out_of_stock, count(*) filter (s = -1) as unknown, count(distinct o_custkey % 7) as sites from (select o_custkey, {STATE} as s from orders)")
def catalogue_document(spark, d):
    o = _t(spark, d, "orders")
    rows = o.select((F.col("o_custkey") % 7).cast("string").alias("site"), F.lit("x").alias("platform"), F.lit("product").alias("type"), F.col("o_orderkey").alias("i"), stock.tri_state(F.when(F.col("o_orderstatus") == "O", "1").when(F.col("o_orderstatus") == "F", "0").otherwise("?")).alias("in_stock"))
    doc = catalog.document(rows, "i", "run", "now")
    return doc.select("stats.total_products", "stats.total_sites", "stats.in_stock", "stats.out_of_stock", "stats.unknown", F.size("sites").cast("long").alias("sites"))


@query("select distinct p_brand as site from part")
def site_names(spark, d):
    return catalog.site_list(_t(spark, d, "part").select(F.col("p_brand").alias("site")))


@query("""with h as (select l_suppkey as site, l_orderkey as id, l_partkey as u, l_quantity > 25 as wanted from (select *, row_number() over (partition by l_suppkey, l_orderkey order by l_linenumber, l_partkey, l_quantity) as n from lineitem) where n = 1)
select site, id, wanted and row_number() over (partition by site, case when wanted then u end order by id) = 1 as is_hit from h""")
def scan_first_seen(spark, d):
    li = _t(spark, d, "lineitem")
    one = li.groupBy(F.col("l_suppkey").alias("site"), F.col("l_orderkey").alias("id")).agg(F.min(F.struct("l_linenumber", "l_partkey", "l_quantity")).alias("r"))
    return scan.first_seen(one, "site", F.col("r.l_partkey"), "id", F.col("r.l_quantity") > 25).select("site", "id", "is_hit")


@query(f"""select (select count(*) from {_latest_sql('>=')}) as merged, (select count(*) from {_latest_sql('>=')} where in_stock = -1) as unknown, count(*) filter (a.o_custkey is null) as new, count(*) filter (b.o_custkey is null) as deleted,
count(*) filter (a.in_stock <> b.in_stock) as changed, (select count(*) from {_latest_sql('<')} where in_stock = -1) as checked from {_latest_sql('<')} a full join {_latest_sql('>=')} b on a.o_custkey = b.o_custkey""")
def merge_run_stats(spark, d):
    old, new = _latest(spark, d, False), _latest(spark, d, True)
    return merge.run_stats(new, merge.diff(old, new, "o_custkey", "in_stock"), snapshot.targets(old.withColumn("type", F.lit("product")), True))


@query("""with l as (select user_id as host, epoch(ts) as t0, event_id as id, event_type = 'purchase' as ok from events), i as (select *, sum(cast(ok as int)) over (partition by host order by t0, id rows unbounded preceding) as k from l),
f as (select *, sum(cast(not ok as int)) over (partition by host, k order by t0, id rows unbounded preceding) as failures from i)
select id, cast(failures as bigint) as failures, not ok and failures = 5 as opens from f""")
def circuit_islands(spark, d):
    e = _t(spark, d, "events").select(F.col("user_id").alias("host"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("id"), (F.col("event_type") == "purchase").alias("ok"))
    return scan.circuit(e).select("id", "failures", "opens")


@query("""select s_suppkey as name, case when s_suppkey % 7 = 0 then 'feed_a' when s_suppkey % 7 = 1 then 'feed_b' when s_suppkey % 2 = 0 and s_suppkey % 5 in (0, 1) then 'ids_a' when s_suppkey % 2 = 0 and s_suppkey % 5 in (2, 3) then 'ids_b' end as scanner from supplier where s_suppkey % 11 <> 0""")
def site_routing(spark, d):
    k = F.col("s_suppkey")
    rows = _t(spark, d, "supplier").select(
        k.alias("name"), (k % 11 != 0).alias("enabled"), F.when(k % 7 == 0, " Feed_A ").when(k % 7 == 1, "feed_b").alias("special_crawler"), (k % 2 == 0).alias("product_scanner"),
        F.when(k % 5 < 2, "A").when(k % 5 < 4, "b").otherwise("other").alias("category"),
    )
    return scan.routed(rows).select("name", "scanner")


@query("select l_partkey as url from (select distinct l_partkey from lineitem where l_quantity > 40) except select l_partkey from lineitem where l_returnflag = 'R' and l_quantity > 49")
def live_candidates(spark, d):
    li = _t(spark, d, "lineitem").withColumnRenamed("l_partkey", "url")
    return registry.wanted_urls(li.where("l_quantity > 40").select("url").distinct(), li.where("l_returnflag = 'R' AND l_quantity > 49"))
