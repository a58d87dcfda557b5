"""Product pages: one Arrow pass takes the signals out of a page, the decisions on them are Column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import stock, text, urls
from stockloom.functions.urls import let

# Markers and headings by platform, and the parts of a page that each signal is read from.
OUT_A = ("out of stock", "sold out", "currently unavailable", "is currently unavailable", "缺貨中", "缺货中", "無庫存", "无库存")
OUT_B = ("out of stock", "currently unavailable", "unavailable")
NO_SERVICES = "no services yet"
GENERIC_HEADINGS = ("configure", "shopping cart", "order summary", "choose billing cycle", "configure server")
CYCLES = ("#sectionCycles", ".check-cycle", "#inputBillingcycle", "select[name*=billing]", "select[name*=cycle]")
ALERTS = (".message-danger", ".message", ".alert-danger", ".alert", ".errorbox")
PRODUCT = ("#frmConfigureProduct", "#productDescription", ".product-description", ".product-info .description", ".product-info", ".product-details", ".product-detail", ".cart-item", *CYCLES)
TITLES = (
    ".product-title", ".product-info .title", "#frmConfigureProduct h1", "#frmConfigureProduct h2", ".product-details h1", ".product-details h2",
    ".product-detail h1", ".product-detail h2", ".product-info h1", ".product-info h2",
)
NAMES_A = (".product-title", "h1", "h2", ".panel-title", ".product-info .title", ".product-info")
NAMES_B = ("h1", "h2", ".product-name", ".main-title", ".plan-title", ".producttitle")
DESCRIPTIONS_A = (
    "#productDescription", ".product-description", ".product-info .description", "#frmConfigureProduct", ".message-danger", ".message", ".panel-body",
    ".bordered-section", ".product-box", ".cart-item", ".product-info",
)
DESCRIPTIONS_B = (".product-description", ".plan-description", ".plan-body", ".plan-features", ".bordered-section", ".product-box", ".cart-item", ".content-area")
DESCRIBED = ("#productDescription", ".product-description", ".product-info .description", ".product-info")
PLACES_A = ("location", "datacenter", "region", "country", "zone", "节点", "地区", "機房")
PLACES_B = ("location", "region", "zone", "country", "datacenter")
MOST_DESCRIPTION = 5000

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset(("script", "style", "template", "rt", "rp"))
SIGNALS = (
    "base string, alert array<string>, product array<string>, boxes array<string>, full_a string, full_b string, title string, name_a string, name_b string, description_a string, description_b string, "
    "order_form boolean, options boolean, described boolean, proceed boolean, order_inputs boolean, disabled_button boolean, cycle_text string, locations_a array<string>, locations_b array<string>, "
    "hrefs array<string>, actions array<string>, adds array<string>, inline array<string>, crawl_inline array<string>"
)

#: Cart URLs in raw HTML and scripts, as the second platform's parser and as a crawl take them.
INLINE = re.compile(r"""(https?://[^'"\s<>]+|/index\.php\?/cart/[^'"\s<>]+|/cart/[^'"\s<>]+)""", re.IGNORECASE)
CRAWL_INLINE = re.compile(r"""(https?://[^'"\s<>]+|(?:/index\.php\?/cart/[^'"\s<>]+|/store/[^'"\s<>]+|/cart/[^'"\s<>]+|cart/[^'"\s<>]+|cart\.php\?[^'"\s<>]+))""", re.IGNORECASE)


class Node:
    """An element: its children are nodes and texts."""

    __slots__ = ("tag", "attrs", "parent", "children", "words")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.words = frozenset(attrs.get("class", "").split())

    def texts(self, without: frozenset = UNSEEN) -> Iterator[str]:
        for c in self.children:
            if isinstance(c, str):
                if c.strip():
                    yield c.strip()
            elif c.tag not in without:
                yield from c.texts(without)

    def text(self) -> str:
        return "\n".join(self.texts())


class _Tree(HTMLParser):
    """All elements of a page, in order."""

    def __init__(self, page: str):
        super().__init__(convert_charrefs=True)
        self.top = self.open = Node("", {}, None)
        self.nodes: list[Node] = []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        self.nodes.append(node)
        if tag not in VOID:
            self.open = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.open = self.open.parent

    def handle_endtag(self, tag):
        node = self.open
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


_SIMPLE = re.compile(r"^([a-z0-9]*)(?:#([\w-]+)|\.([\w-]+)|\[(\w+)\*=(\w+)\])?$")


def _is(node: Node, simple: str) -> bool:
    """Whether a node has a tag, #id, .class or [name*=part], or a tag with one of these."""
    tag, own_id, word, name, part = _SIMPLE.match(simple).groups()
    if tag and node.tag != tag or own_id and node.attrs.get("id") != own_id or word and word not in node.words:
        return False
    return not name or part in node.attrs.get(name, "")


def select(nodes: list[Node], *selectors: str) -> list[Node]:
    """Nodes that any selector finds, by selector and then in page order, each once; a selector has one step or two."""
    out: dict[int, Node] = {}
    for selector in selectors:
        *above, last = selector.split()
        for node in nodes:
            if id(node) not in out and _is(node, last):
                up = node.parent
                while above and up is not None and not _is(up, above[0]):
                    up = up.parent
                if up is not None or not above:
                    out[id(node)] = node
    return list(out.values())


def distinct_texts(nodes: list[Node]) -> list[str]:
    """The first of the texts that are equal but for case and white space."""
    out: dict[str, str] = {}
    for node in nodes:
        own = node.text()
        squeezed = " ".join(own.split()).lower()
        if squeezed:
            out.setdefault(squeezed, own)
    return list(out.values())


def _pick(nodes: list[Node], most: int, generic: tuple[str, ...] = ()) -> str:
    return next((t for t in (n.text() for n in nodes) if t and len(t) <= most and t.strip().lower() not in generic), "")


def _in_turn(nodes: list[Node], *selectors: str) -> list[Node]:
    """As `select`, but a node comes once for every selector that finds it."""
    return [n for s in selectors for n in select(nodes, s)]


def _description(nodes: list[Node], selectors: tuple[str, ...], name: str) -> str:
    """The text of the first selector's first node that has more than ten letters, without the name in front."""
    first = (found[0].text() for found in (select(nodes, s) for s in selectors) if found)
    out = next((t for t in first if len(t) > 10), "")[:MOST_DESCRIPTION]
    rest = out[len(name) :].strip() if name and out.startswith(name) else ""
    return rest or out


def read_page(html: str | None) -> dict:
    page = html or ""
    tree = _Tree(page)
    nodes = tree.nodes
    cleaned = re.sub(r"(?is)<noscript\b.*?(?:</noscript\s*>|\Z)", "", page)
    inside = {id(n) for n in nodes if n.tag == "noscript"}
    for n in nodes:
        if id(n.parent) in inside:
            inside.add(id(n))
    nodes_b = [n for n in nodes if id(n) not in inside]
    without = UNSEEN | {"noscript"}
    product = select(nodes, *PRODUCT)
    name_a, name_b = _pick(_in_turn(nodes, *NAMES_A), 140, GENERIC_HEADINGS), _pick(_in_turn(nodes_b, *NAMES_B), 160)
    below = [n for root in product for n in nodes if n.tag in ("button", "a") or n.tag == "input" and n.attrs.get("type", "").lower() in ("submit", "button") if _below(n, root)]
    adds, order_inputs = [], False
    for form in (n for n in nodes_b if n.tag == "form"):
        hidden = {n.attrs["name"]: n.attrs.get("value", "") for n in nodes_b if n.tag == "input" and n.attrs.get("type", "").lower() == "hidden" and "name" in n.attrs and _below(n, form)}
        number = hidden.get("id", "").strip()
        if hidden.get("action") == "add" and number.isdigit():
            adds.append(f"/index.php?/cart/&action=add&id={number}")
        order_inputs |= hidden.get("make", "").strip().lower() == "order" or any(k.startswith(("subproducts[", "addon[")) for k in hidden)
    button = next((n for n in nodes_b if n.tag == "button" and "disabled" in n.attrs), None)
    locations_a: list[str] = []
    for n in nodes:
        if n.tag == "select" and any(h in n.text().lower() or h in n.attrs.get("name", "").lower() or h in n.attrs.get("id", "").lower() for h in PLACES_A):
            locations_a += [o.text() for o in nodes if o.tag == "option" and _below(o, n) and o.text()]
    named = [n for n in nodes_b if n.tag in ("label", "strong") or n.words & {"title", "field-name"}]
    locations_b = ["\n".join(n.parent.texts(without))[:160] for n in named if any(h in n.text().lower() for h in PLACES_B)]
    return {
        "base": next((n.attrs["href"].strip() for n in nodes if n.tag == "base" and n.attrs.get("href", "").strip()), ""),
        "alert": distinct_texts(select(nodes, *ALERTS)), "product": distinct_texts(product), "boxes": distinct_texts(select(nodes, "#order-boxes")),
        "full_a": " ".join(tree.top.texts()), "full_b": " ".join(tree.top.texts(without)), "title": _pick(select(nodes, *TITLES), 140, GENERIC_HEADINGS), "name_a": name_a, "name_b": name_b,
        "description_a": _description(nodes, DESCRIPTIONS_A, name_a), "description_b": _description(nodes_b, DESCRIPTIONS_B, name_b),
        "order_form": bool(select(nodes, "#frmConfigureProduct")), "options": bool(select(nodes, *CYCLES)), "described": bool(select(nodes, *DESCRIBED)),
        "proceed": any("continue" in (n.text() or n.attrs.get("value", "").strip()).lower() for n in below),
        "order_inputs": order_inputs, "disabled_button": button is not None and "out of stock" in button.text().lower(),
        "cycle_text": "\n".join(n.text() for n in select(nodes, *CYCLES)), "locations_a": list(dict.fromkeys(locations_a)), "locations_b": list(dict.fromkeys(x for x in locations_b if x)),
        "hrefs": list(dict.fromkeys(n.attrs["href"] for n in nodes if n.tag == "a" and n.attrs.get("href"))), "actions": list(dict.fromkeys(n.attrs["action"] for n in nodes if n.tag == "form" and n.attrs.get("action"))),
        "adds": list(dict.fromkeys(adds)), "inline": list(dict.fromkeys(INLINE.findall(cleaned))), "crawl_inline": list(dict.fromkeys(CRAWL_INLINE.findall(page))),
    }


def _below(node: Node, root: Node) -> bool:
    up = node.parent
    while up is not None and up is not root:
        up = up.parent
    return up is root


#: Pages whose signals are held at once.
SLICE = 64


def read_pages(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for page in pages:
        for at in range(0, len(page), SLICE):
            yield pd.DataFrame([read_page(h) for h in page.iloc[at : at + SLICE]])


def signals(html: Column) -> Column:
    @F.pandas_udf(SIGNALS)
    def run(pages: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from read_pages(pages)

    return run(html)


def _root(base: Column, s: Column) -> Column:
    """What links of a page are relative to; <base href> counts."""
    return F.when(s["base"] != "", urls.resolved(base, s["base"])).otherwise(base)


def links(base: Column, s: Column, *more: str) -> Column:
    """Absolute URLs of anchors and of the signals named in more, distinct, in order."""
    return let(_root(base, s), lambda root: F.array_distinct(F.transform(F.concat(*[s[c] for c in ("hrefs", *more)]), lambda h: urls.resolved(root, stock.stripped(h)))))


def crawl_links(base: Column, s: Column) -> Column:
    """All links that a crawl follows: also forms, URLs in scripts and raw HTML, and add forms."""
    return links(base, s, "actions", "adds", "crawl_inline")


def _link_kinds(s: Column) -> Column:
    """(products, categories): the hrefs of a page on the first platform, as they stand."""

    def kind(href: Column) -> Column:
        low = F.lower(href)
        p = urls.path(low)
        routes = F.transform(F.filter(urls.pairs(urls.query(low), F.lower), lambda x: (x["key"] == "rp") & F.contains(F.lower(x["value"]), F.lit("/store/"))), lambda x: F.lower(x["value"]))
        tail = F.regexp_replace(F.when(F.contains(p, F.lit("/store/")), p).otherwise(F.get(routes, F.lit(0))), "^.*?/store/", "")
        n = F.coalesce(F.size(F.filter(F.split(tail, "/"), lambda x: x != "")), F.lit(0))
        return F.when(F.contains(low, F.lit("a=add&pid=")) | (n >= 2), 2).when(n == 1, 1).otherwise(0)

    marked = F.transform(s["hrefs"], lambda h: F.struct(h.alias("href"), kind(h).alias("kind")))
    of = lambda m, k: F.transform(F.filter(m, lambda x: x["kind"] == k), lambda x: x["href"])
    return let(marked, lambda m: F.struct(of(m, 2).alias("products"), of(m, 1).alias("categories")))


def _evidence(*parts: tuple[Column, Column | str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(v) if isinstance(v, str) else v) for c, v in parts]))


def _count(label: str, items: Column) -> tuple[Column, Column]:
    return F.size(items) > 0, F.concat(F.lit(f"{label}:"), F.size(items).cast("string"))


def _verdict(state: Column, is_product: Column, is_category: Column, name: Column, description: Column, prices: Column, cycles: Column, locations: Column, evidence: Column, products: Column, categories: Column) -> Column:
    return F.struct(
        state.alias("in_stock"), is_product.alias("is_product"), is_category.alias("is_category"), name.alias("name"), description.alias("description"), prices.alias("prices"), cycles.alias("cycles"),
        locations.alias("locations"), evidence.alias("evidence"), products.alias("product_links"), categories.alias("category_links"),
    )


def decide_a(url: Column, s: Column, html: Column, markers: tuple[str, ...] = OUT_A) -> Column:
    """The verdict of the first platform's parser."""

    def of(x: Column) -> Column:
        route, products, categories, prices = x["route"], x["links"]["products"], x["links"]["categories"], x["prices"]
        like = route.isin("confproduct", "store_product", "cart_add")
        seen = F.concat(s["alert"], F.when(like, s["product"]).otherwise(F.array().cast("array<string>")), F.when(route == "cart_add", s["boxes"]).otherwise(F.array().cast("array<string>")))
        out = F.exists(seen, lambda t: text.has_marker(t, markers))
        title = (s["title"] != "") | (route.isin("confproduct", "store_product") & (s["name_a"] != ""))
        priced = F.size(text.prices(F.array_join(s["product"], "\n"))) > 0
        info = like & (title | priced | s["described"] | s["proceed"] | s["order_form"] | s["options"])

        def judged(f: Column) -> Column:
            out, info = f["out"], f["info"]
            state = F.when(route == "confproduct", True).when(like & out, False).when(info, True)
            is_product = route.isin("confproduct", "store_product") | ((route == "cart_add") & (info | out))
            is_category = (route == "store_category") | (route.isin("cart_root", "other") & ((F.size(products) > 0) | (F.size(categories) > 0)))
            evidence = _evidence(
                (route == "confproduct", "confproduct-final-url"), (out, "oos-marker"), (F.contains(F.lower(html), F.lit("message-danger")), "message-danger"), (s["order_form"], "has-order-form"),
                (s["options"], "has-configurable-options"), (info, "has-product-info"), (F.size(prices) > 0, "has-pricing"), _count("product-link-count", products), _count("category-link-count", categories),
            )
            name = F.coalesce(F.nullif(s["name_a"], F.lit("")), F.element_at(F.concat(F.array(F.lit("")), urls.store_segments(url)), -1))
            return _verdict(state, is_product, is_category, name, s["description_a"], prices, text.cycles(s["cycle_text"]), s["locations_a"], evidence, products, categories)

        return let(F.struct(out.alias("out"), info.alias("info")), judged)

    return let(F.struct(urls.route_label(url).alias("route"), _link_kinds(s).alias("links"), text.prices(s["full_a"]).alias("prices")), of)


def decide_b(url: Column, s: Column, html: Column, markers: tuple[str, ...] = OUT_B) -> Column:
    """The verdict of the second platform's parser."""
    low = F.lower(url)
    is_cart = lambda u: F.contains(F.lower(urls.path(u)), F.lit("/cart/")) | (F.startswith(urls.query(u), F.lit("/")) & F.contains(F.lower(urls.query(u)), F.lit("/cart/"))) | F.contains(F.lower(u), F.lit("cmd=cart"))
    all_links = let(_root(url, s), lambda root: F.struct(
        F.transform(s["adds"], lambda h: urls.resolved(root, h)).alias("adds"), F.transform(F.concat(s["hrefs"], s["inline"]), lambda h: urls.resolved(root, stock.stripped(h))).alias("others")))
    found = let(all_links, lambda a: F.struct(
        F.array_distinct(F.concat(a["adds"], F.filter(a["others"], lambda u: is_cart(u) & urls.numeric_add(u)))).alias("products"),
        F.array_distinct(F.filter(a["others"], lambda u: F.contains(F.lower(u), F.lit("cmd=cart&cat_id=")))).alias("categories")))
    raw = F.lower(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<noscript\b.*?(?:</noscript\s*>|\z)", ""))
    step, add = F.contains(low, F.lit("step=3")), F.contains(low, F.lit("action=add&id="))

    def of(x: Column) -> Column:
        products, categories, prices = x["links"]["products"], x["links"]["categories"], x["prices"]
        gone = x["out"] | x["js"] | s["disabled_button"]
        confirmed = add & ((F.size(prices) > 0) | (F.size(products) > 0) | gone)
        blocking = F.contains(F.lower(s["full_b"]), F.lit(NO_SERVICES)) & ~(step | (F.size(products) > 0) | (F.size(prices) > 0))

        def judged(f: Column) -> Column:
            free = ~f["blocking"] & ~F.contains(low, F.lit("/checkdomain/"))
            is_product = f["signal"] & free
            is_category = ((F.size(products) > 0) | (F.size(categories) > 0)) & free & ~is_product
            state = F.when(f["blocking"], F.lit(None)).when(gone, False).when(is_product, True)
            evidence = _evidence(
                (x["out"], "oos-marker"), (x["js"], "js-errors-array"), (s["disabled_button"], "disabled-oos-button"), (f["blocking"], "no-services-yet"), (step, "order-step"), (add, "add-id-url"),
                _count("product-link-count", products), _count("category-link-count", categories), (F.size(prices) > 0, "has-pricing"),
            )
            segment = F.element_at(F.concat(F.array(F.lit("")), urls.route_segments(url)), -1)
            name = F.when((s["name_b"] == "") & is_category, segment).otherwise(s["name_b"])
            return _verdict(state, is_product, is_category, name, s["description_b"], prices, text.cycles(s["full_b"]), s["locations_b"], evidence, products, categories)

        return let(F.struct((step | confirmed | s["order_inputs"]).alias("signal"), blocking.alias("blocking")), judged)

    held = let(raw, lambda r: F.contains(r, F.lit("var errors")) & F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(r, m)))
    return let(F.struct(found.alias("links"), text.prices(s["full_b"]).alias("prices"), text.has_marker(s["full_b"], markers).alias("out"), held.alias("js")), of)


def parsed(pages: DataFrame, markers_a: tuple[str, ...] = OUT_A, markers_b: tuple[str, ...] = OUT_B) -> DataFrame:
    """pages (final_url, html, platform, ...) with in_stock, is_product, is_category, name, description, prices, cycles, locations, evidence and the
    links of either kind. The marker lists are those of a configuration, which hold for both platforms there."""
    df = pages.withColumn("_s", signals(F.col("html")))
    s, url, html = F.col("_s"), F.col("final_url"), F.coalesce("html", F.lit(""))
    active = tuple(m for m in markers_b if m != NO_SERVICES)
    df = df.withColumn("_d", F.when(F.col("platform") == "b", decide_b(url, s, html, active)).otherwise(decide_a(url, s, html, markers_a)))
    kept = [c for c in pages.columns if c != "html"]
    return df.select(*kept, stock.flag_state(F.col("_d.in_stock")).alias("in_stock"), *[f"_d.{c}" for c in ("is_product", "is_category", "name", "description", "prices", "cycles", "locations", "evidence", "product_links", "category_links")])
