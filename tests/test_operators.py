import random

import pytest
from pyspark.sql import functions as F

from stockloom.functions import stock, text, urls
from stockloom.operators import catalog, crawl, merge, messages, registry, scan, snapshot
from stockloom.plans import catalogue
from stockloom.sources import feeds, html_pages


def one(spark, kind, value, f):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "state"), [("1", 1), ("0", 0), (" -1 ", -1), ("in_stock", 1), ("OUT_OF_STOCK", 0), ("2", -1), ("x", -1), (None, -1), ("", -1)])
def test_tri_state(spark, value, state):
    assert one(spark, "string", value, stock.tri_state) == state


@pytest.mark.parametrize(("url", "normal"), [
    ("HTTPS://Shop.Example.com//a//b/?b=2&utm_source=x&a=1#top", "https://shop.example.com/a/b?a=1&b=2"),
    ("//shop.example.com", "https://shop.example.com/"),
    ("https://x.example/?x", "https://x.example/?x="),
    ("https://x.example/?/cart/vps&step=3&sid=9", "https://x.example/?/cart/vps&step=3"),
    ("https://x.example/p?&amp;Gid=3", "https://x.example/p?gid=3"), ("https://x.example/?=5", "https://x.example/"), ("https://x/p?a=1+2&b=%41%zz&c=~*", "https://x/p?a=1+2&b=A%25zz&c=~%2A"),
])
def test_normalize(spark, url, normal):
    assert one(spark, "string", url, urls.normalize) == normal


@pytest.mark.parametrize(("url", "reason"), [
    ("ftp://x/store/a", "non-http-scheme"), ("https://x/contact.php", "denylist:contact"), ("https://x/cart.php?a=view", "cart-action-page"),
    ("https://x/index.php?rp=/login", "blocked-route:login"), ("https://x/about", "not-product-like"), ("https://x/index.php?rp=/store/vps", "ok"),
    ("https://x/shop/server?type=1", "not-product-like"), ("x.example/store/vps", "ok"),
])
def test_classify(spark, url, reason):
    assert one(spark, "string", url, urls.classify_reason) == reason


@pytest.mark.parametrize(("url", "reason"), [
    ("https://x/a.png", "media-or-static-file"), ("https://x/a?currency=2&lang=fr", "blocked-query:currency"), ("https://x/a?lang=fr&currency=2", "blocked-query:currency"), ("https://x/a?lang=fr", "non-english-language:fr"), ("https://x/a.png/", "media-or-static-file"), ("https://x/?action=a&action=embed&cmd=hbchat", "blocked-query:hbchat"),
    ("https://x/a?lang=en", "ok"), ("https://x/cdn-cgi/l", "blocked-path:cdn-cgi"), ("https://x/a&b", "malformed-path-ampersand"), ("https://x/?cmd=hbchat&action=embed", "blocked-query:hbchat"),
])
def test_skip(spark, url, reason):
    assert one(spark, "string", url, urls.skip_reason) == reason


def test_text(spark):
    assert one(spark, "string", "Semi-Annually", text.cycles) == ["Semi-Annually", "Annually"]
    got = one(spark, "string", '{"half_year": "5", "month": "1"}', lambda v: text.price_cycles(F.from_json(v, "map<string,string>")))
    assert got["cycles"] == ["Half Year", "Month"] and got["price_raw"] == "Half Year: 5; Month: 1"
    assert one(spark, "string", "### Name\n\nShop\n\n### URL\n<!-- hint -->\nhttps://x", text.form_fields) == {"name": "Shop", "url": "https://x"}
    assert one(spark, "string", "- [x] A\n- [ ] B", text.checkboxes) == {"a": True, "b": False}


RECORD = "site string, platform string, canonical_url string, scan_type string, in_stock string, name_raw string, description_raw string, evidence array<string>"


def records(spark, *rows):
    return spark.createDataFrame([("s", "a", u, t, i, n, d, e) for u, t, i, n, d, e in rows], RECORD)


def test_merge(spark):
    none = records(spark)
    previous = spark.createDataFrame([("https://x/store/a", "2020")], "canonical_url string, first_seen_at string")
    found = records(spark, ("https://x/store/a", "discoverer", "-1", "", "", ["d"]))
    products = records(spark, ("https://x/store/a", "product_scanner", "1", "A", "d", ["p"]), ("https://x/store/b", "product_scanner", "0", "A", "d", ["q"]), ("https://x/store/c", "product_scanner", "0", "A", "d", ["p", "r"]), ("https://x/store/z", "product_scanner", "0", "A", "d", ["oos-marker"]))
    out = {r["canonical_url"]: r for r in merge.merge_records(found, products, none, previous, F.lit("now")).collect()}
    assert set(out) == {"https://x/store/a", "https://x/store/z"}
    assert out["https://x/store/a"]["evidence"] == ["p", "q", "content-dedup-merged", "r"]
    assert out["https://x/store/a"]["first_seen_at"] == "2020" and out["https://x/store/z"]["first_seen_at"] == "now"


def loop_scan(hits, start, hard, floor, tail, limit, learned):
    """The scan as a loop: goes on while ids are within reach and the streak is not full."""
    tail, limit = max(1, tail), max(8, limit)
    reach, last, done = min(hard, max(floor, learned + tail)), start - 1, []
    i = start
    while i <= min(reach, hard):
        done.append(i)
        if i in hits:
            last = i
            reach = max(reach, min(hard, i + tail))
        if i - last >= limit and i >= floor:
            break
        i += 1
    return done


def test_scan(spark):
    rng = random.Random(1)
    for _ in range(6):
        hard, floor, tail, limit, learned = rng.randint(20, 120), rng.randint(0, 30), rng.randint(1, 30), rng.randint(1, 25), rng.randint(0, 30)
        hits = {i for i in range(hard + 1) if rng.random() < 0.08}
        rows = spark.createDataFrame([("s", i, i in hits) for i in range(hard + 1)], "site string, id int, is_hit boolean")
        out = scan.processed(rows, hard=F.lit(hard), floor=floor, tail=tail, streak=limit, learned=F.lit(learned)).where("processed")
        assert sorted(r["id"] for r in out.collect()) == loop_scan(hits, 0, hard, floor, tail, limit, learned)


def test_whole_scans(spark):
    d = "/root/testdata/sf0.001"
    read = lambda name, *c: [tuple(r) for r in spark.read.parquet(f"{d}/{name}.parquet").select(*c).distinct().collect()]
    hits, parts = read("lineitem", "l_suppkey", "l_partkey"), [p for (p,) in read("part", "p_partkey")]
    of = {s: {p for x, p in hits if x == s} for s, _ in hits}
    got = {r["site"]: (r["high"], r["resume"]) for r in catalogue.QUERIES["highwater_whole"](spark, d).collect()}
    assert got == {s: (max(p), max(0, max(p) - 60)) for s, p in of.items()}
    stops = {r["site"]: r["last_id"] for r in catalogue.QUERIES["scan_stop_whole"](spark, d).collect()}
    known = set(parts)
    assert stops == {s: max(i for i in loop_scan(of.get(s, set()) & known, 1, max(parts), 20, 60, 40, 0) if i in known) for (s,) in read("supplier", "s_suppkey")}


def test_stops(spark):
    """Sparse ids: the same stops as from a row for each site and id."""
    rng = random.Random(5)
    ids = sorted({1, *(rng.randrange(3000) for _ in range(700)), *range(1100, 1400)})
    frame = lambda rows: spark.createDataFrame(rows, "site long, id long")
    hits = [(n, i) for n in range(1, 12) for i in range(3000) if rng.random() < n / 150]
    sites, parts = spark.range(13).select(F.col("id").alias("site")), spark.createDataFrame([(i,) for i in ids], "id long")
    every = sites.crossJoin(parts).join(frame(hits).withColumn("is_hit", F.lit(True)), ["site", "id"], "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))
    for streak, reason in ((40, "streak"), (90, "reach")):
        want = scan.processed(every, start=F.lit(1), hard=F.lit(max(ids)), floor=20, tail=60, streak=streak).where("processed").groupBy("site").agg(F.max("id").alias("last_id"), F.max("reason").alias("reason"))
        got = sorted(map(tuple, scan.stops(sites, parts, frame(hits), 20, 60, streak).collect()))
        assert got == sorted(map(tuple, want.collect())) and reason in {r for *_, r in got}


def test_pages_in_slices():
    """A large batch of pages is read in slices, whole and in order."""
    pages = [f"<h1>n{i}</h1>" for i in range(200)]
    out = list(html_pages.read_pages(iter([html_pages.pd.Series(pages), html_pages.pd.Series(pages[:1])])))
    assert max(map(len, out)) <= html_pages.SLICE and [n for t in out for n in t["name_a"]] == [f"n{i}" for i in (*range(200), 0)]


def test_snapshot(spark):
    now = spark.createDataFrame([("a", 1), ("b", 0), ("c", -1), ("d", 1)], "k string, in_stock int")
    old = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "k string, in_stock int")
    got = {r["k"]: (r["changed"], r["restocked"], r["destocked"]) for r in snapshot.against_previous(now, old, "k").collect()}
    assert got == {"a": (True, True, False), "b": (True, False, True), "c": (True, False, False), "d": (False, False, False)}


def test_crawl(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d"), ("t", "a", "z")], "site string, src string, dst string")
    seeds = spark.createDataFrame([("s", "a")], "site string, node string")
    assert {(r["node"], r["depth"]) for r in crawl.layers(edges, seeds, 2).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_crawl_without_cap(spark, monkeypatch):
    star = spark.range(2, 3502).select(F.lit("s").alias("site"), F.lit(1).cast("long").alias("src"), F.col("id").alias("dst"))
    monkeypatch.setattr(catalogue, "_edges", lambda spark, d: star)
    assert catalogue.QUERIES["bfs_layers"](spark, "").count() == 3501
    seeds = spark.createDataFrame([("s", 1)], "site string, node long")
    assert crawl.layers(star, seeds, 1, 10).count() == 10


def test_catalogue_round_trip(spark):
    rows = spark.createDataFrame([("s", "a", "product", 1, "x"), ("s", "a", "category", 2, "y"), ("t", "b", "product", 3, "z")], "site string, platform string, type string, i int, name_raw string")
    flat = catalog.unnested(catalog.grouped(rows, "i"))
    assert {(r["site"], r["type"], r["name_raw"]) for r in flat.collect()} == {("s", "product", "x"), ("s", "category", "y"), ("t", "product", "z")}


def test_messages(spark):
    rows = spark.createDataFrame([("s", i, "b" * 50) for i in range(1, 30)], "section string, place int, block string")
    parts = messages.chunked(rows, 300).collect()
    assert all(len(r["message"]) <= 236 for r in parts) and "".join(r["message"] for r in parts).count("b") == 29 * 50


def test_messages_are_whole(spark):
    rows = [("s", i, "b" * 50) for i in range(1, 6)] + [("t", 1, "c" * 500), ("t", 2, "d")]
    got = [r["message"] for r in messages.chunked(spark.createDataFrame(rows, "section string, place int, block string"), 300, header="H", titles={"s": "S", "t": "T"}).orderBy("part").collect()]
    mark, b = messages.CONTINUED, "b" * 50
    assert got == ["\n\n".join(x) for x in (["H", "S", b, b, b, b], [mark, "S", b], [mark, "T", "c" * 500], [mark, "T", "d"])]
    many = spark.range(1, 10101).select(F.lit("s").alias("section"), F.col("id").cast("int").alias("place"), F.lit("b").alias("block"))
    out = messages.chunked(many, 300).orderBy("part").collect()
    assert [r["part"] for r in out] == list(range(len(out))) and "".join(r["message"] for r in out).count("b") == 10100
    assert len({len(r["message"]) for r in out[1:-1]}) == 1
    one = spark.createDataFrame([("n", "https://x/" + "u" * 400, "5", 1, "")], "n string, u string, p string, s int, site string")
    parts = one.select(F.inline(messages.product_blocks(F.col("n"), F.col("site"), F.col("p"), F.col("s"), F.col("u"), 300))).collect()
    assert parts[0]["block"] == "🟢 *In Stock* n\n*Site:* Unknown Site\n*Price:* 5"
    assert [r["force"] for r in parts] == [False, True] and parts[1]["block"].count("u") == 400 and messages.filled([("T", [tuple(r) for r in parts])], "H", 236)[1].startswith(mark)


def test_registry(spark):
    sites = spark.createDataFrame([("a", "u1")], "name string, url string")
    changes = spark.createDataFrame([("add", "a", "x"), ("add", "b", "y"), ("edit", "c", "z"), ("edit", "a", "w")], "action string, name string, url string")
    assert {(r["name"], r["url"]) for r in registry.upserted(sites, changes).collect()} == {("a", "w"), ("b", "y")}


def test_feed(spark):
    body = '<html><pre>{"data":[{"area_name":"EU","nodes":[{"node_name":"N1","plans":[{"id":"1","plan_name":"P","stock":"3","flow":"","price_datas":{"month":"5"}}]},{"node_name":"N2"}]}]}</pre></html>'
    r = feeds.plans(spark.createDataFrame([("s", body)], "site string, payload string")).collect()
    assert [(x["name_raw"], x["in_stock"], x["product_type"], x["locations_raw"], x["price_raw"]) for x in r] == [("P", 1, "bandwidth", ["EU - N1"], "Month: 5")]


def test_pages(spark):
    rows = [
        ("a", "https://x/cart.php?a=confproduct&i=0", "<h2 class=product-title>Plan<p class=alert>Out of stock", (1, True, False, ["confproduct-final-url", "oos-marker", "has-product-info"])),
        ("a", "https://x/store/vps/one", "<div class='alert alert-danger message-danger'>Out of Stock</div><h2>One</h2>", (0, True, False, ["oos-marker", "message-danger", "has-product-info"])),
        ("a", "https://x/store/vps", "<div class=alert>Out of Stock</div><a href='/store/vps/one'>x</a>", (-1, False, True, ["oos-marker", "product-link-count:1"])),
        ("a", "https://x/store/vps/one", "<div class=alert>Careful</div><h1>Configure</h1><p>$5 USD</p>", (-1, True, False, ["has-pricing"])),
        ("a", "https://x/store/vps/one", "<select name=billingcycle><option>Monthly $5</select><div class=alert>缺货中</div>", (0, True, False, ["oos-marker", "has-configurable-options", "has-product-info", "has-pricing"])),
        ("b", "https://x/?cmd=cart&action=add&id=4", "<p>$5 USD</p><button disabled>Out of stock</button>", (0, True, False, ["oos-marker", "disabled-oos-button", "add-id-url", "has-pricing"])),
        ("b", "https://x/?cmd=cart&action=add&id=4", "<p>$5 USD</p><button disabled>Order</button>", (1, True, False, ["add-id-url", "has-pricing"])),
        ("b", "https://x/cart/vps", "<p>No services yet</p><a href='/about'>n</a>", (-1, False, False, ["no-services-yet"])),
        ("b", "https://x/cart/vps", "<noscript>unavailable</noscript><a href='/?cmd=cart&cat_id=2'>n</a>", (-1, False, True, ["category-link-count:1"])),
        ("b", "https://x/?step=3", "<script>var errors=['Sold out: unavailable']</script>", (0, True, False, ["js-errors-array", "order-step"])),
    ]
    out = html_pages.parsed(spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, platform string, final_url string, html string")).orderBy("i").collect()
    assert [(r["in_stock"], r["is_product"], r["is_category"], r["evidence"]) for r in out] == [r[3] for r in rows]


def test_inline_links_and_add_forms(spark):
    form = "<form><input type=hidden name=action value=add><input type=hidden name=id value=7></form>"
    rows = [("https://x/a", "<script>go('/index.php?/cart/&action=add&id=5')</script>"), ("https://x/a", form), ("https://x/a", "<script>u='cart.php?gid=2'</script>"), ("https://x/a", "<p>none")]
    df = spark.createDataFrame(rows, "final_url string, html string").withColumn("platform", F.lit("b"))
    got = [(r["is_category"], r["evidence"]) for r in html_pages.parsed(df).collect()]
    assert got == [(True, ["product-link-count:1"]), (True, ["product-link-count:1"]), (False, []), (False, [])]
    found = df.withColumn("s", html_pages.signals(F.col("html"))).select(html_pages.crawl_links(F.col("final_url"), F.col("s")).alias("u")).collect()
    add = "https://x/index.php?/cart/&action=add&id="
    assert [r["u"] for r in found][1:] == [[f"{add}7"], ["https://x/cart.php?gid=2"], []] and f"{add}5" in found[0]["u"]


def test_page_signals_by_both_platforms(spark, tmp_path):
    rows = [
        (1, "https://x/store/vps/one", "<div class='alert message-danger'>Out of stock</div><h2>One</h2>"),
        (2, "https://x/?cmd=cart&action=add&id=4", "<p>$5 USD</p><button disabled>Order</button>"),
        (3, "https://x/about", "<p>none"),
    ]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {(r["page_id"], r["platform"]): (r["in_stock"], r["is_product"], r["is_category"]) for r in catalogue.QUERIES["page_signals"](spark, str(tmp_path)).collect()}
    assert got == {
        (1, "a"): (0, True, False), (1, "b"): (0, False, False), (2, "a"): (-1, False, False), (2, "b"): (1, True, False), (3, "a"): (-1, False, False), (3, "b"): (-1, False, False),
    }


def test_discover(spark):
    """Dead pages, off-host and skipped links, entry points of a site whose root shows nothing, and candidates by form."""
    r = "https://x.example"
    pages = [
        (f"{r}/", f"{r}/login", True, 200, "<a href='/about'>a</a><a href='https://y.example/store/a/b'>off</a><a href='/pic.png'>p</a>"),
        (f"{r}/about", f"{r}/about", True, 200, "<p>x"), (f"{r}/store", f"{r}/store", True, 200, "<a href='/store/vps'>v</a><a href='/store/vps/one'>1</a><a href='/store/vps/two?currency=2'>2</a>"),
        (f"{r}/store/vps/one", f"{r}/store/vps/gone", False, 404, ""), (f"{r}/store/vps", f"{r}/store/vps", True, 200, "<a href='../cart.php?a=add&pid=3'>3</a>"), (f"{r}/cart.php", f"{r}/cart.php", True, 404, "no"),
    ]
    pages = spark.createDataFrame(pages, "url string, final_url string, ok boolean, status int, html string")
    got = crawl.discover(spark.createDataFrame([("s", f"{r}")], "site string, root string"), pages).collect()
    by = {k: {x["url"].removeprefix(r) for x in got if x["kind"] == k} for k in ("visited", "product", "category")}
    cart = {"/cart.php?a=add&pid=3", "/store/cart.php?a=add&pid=3"}  # the anchor, and the same text taken as an inline URL
    assert by["product"] == cart and by["category"] == {"/store/vps", "/store/cart.php?a=add&pid=3"}
    assert by["visited"] == {"/", "/about", "/index.php", "/cart.php", "/store", "/index.php?rp=%2Fstore", "/store/vps", "/store/vps/one"} | cart


def test_id_scans(spark):
    kind = "site string, id int, ok boolean, requested_url string, final_url string, is_category boolean, is_product boolean, in_stock int, name string, evidence array<string>, prices array<string>, cycles array<string>, locations array<string>, product_links array<string>"
    row = lambda i, final, cat=False, prod=False, state=-1, name="", ev=(), links=(), ok=True: ("s", i, ok, f"https://x/cart.php?gid={i}", final, cat, prod, state, name, list(ev), [], [], [], list(links))
    a = spark.createDataFrame([row(1, "https://x/store/vps", True, links=["/store/vps/a"]), row(2, "https://x/store/vps/", True), row(3, "https://x/about"), row(4, "https://x/store/web", True, ok=False)], kind)
    hits = scan.category_hits(a, "a")
    assert {r["id"] for r in hits.where("is_hit").collect()} == {1}
    assert [(r["id"], r["type"], r["canonical_url"]) for r in scan.category_rows(hits).collect()] == [(1, "category", "https://x/store/vps?language=english"), (1, "product", "https://x/store/vps/a?language=english")]
    b = spark.createDataFrame([row(1, "https://x/c/a", prod=True), row(2, "https://x/c/b", True, ev=["no-services-yet"]), row(3, "https://x/c/a", True)], kind)
    assert {r["id"] for r in scan.category_hits(b, "b").where("is_hit").collect()} == {1}
    conf, info, out = ["confproduct-final-url", "has-product-info"], ["has-product-info"], ["oos-marker"]
    p = spark.createDataFrame([
        row(1, "https://x/cart.php?a=confproduct&i=0", name="A b", ev=conf), row(2, "https://x/cart.php?a=confproduct&i=1", name=" a  B", ev=conf), row(3, "https://x/store/v/one", name="One", ev=info),
        row(4, "https://x/store/v/one", name="Two", ev=info), row(5, "https://x/cart.php?a=add&pid=9", ev=out), row(6, "https://x/cart.php?a=add&pid=9", ev=out), row(7, "https://x/about", ev=info)], kind)
    assert {r["id"]: r["in_stock"] for r in scan.product_hits(p, "a").where("is_hit").collect()} == {1: 1, 3: 1, 5: 0, 6: 0}
    q = spark.createDataFrame([row(1, "u", prod=True, state=1), row(2, "u", state=0), row(3, "u")], kind)
    assert {r["id"]: r["in_stock"] for r in scan.product_hits(q, "b").where("is_hit").collect()} == {1: 1, 2: 0}
