"""URL normalisation and classification as Column expressions.

A URL is taken apart by one pattern rather than by parse_url, which gives null for URLs that are only unusual. What several
steps need is computed once and held by `let`, so that no step repeats the ones before it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.stock import stripped

# Fixed values, in their order of precedence.
DENIED = (
    "contact", "contact.php", "announcements", "announcement", "knowledgebase", "submitticket", "supporttickets", "supporttickets.php",
    "clientarea", "login", "password", "pwreset", "forgot", "register", "affiliates",
)
STATIC = (".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".ico", ".css", ".js", ".woff", ".woff2", ".ttf", ".eot", ".pdf", ".zip", ".tar", ".gz")
VOLATILE = ("sid", "session", "phpsessid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content")
ENGLISH = ("en", "en-us", "en_us", "en-gb", "en_gb", "english")
LANGUAGE_KEYS = ("language", "lang", "locale")
ROUTE_KEYS = ("rp",)
LIKELY = ("/store/", "cart.php", "/cart/", "cmd=cart", "action=add", "a=add")
SEEDS = ("/", "/index.php", "/cart.php", "/store", "/index.php?rp=/store")

PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, PARTS, 1))


def host(url: Column) -> Column:
    """Lower-case host with its port."""
    return F.lower(F.regexp_extract(url, PARTS, 2))


def path(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, PARTS, 4)


def same_host(a: Column, b: Column) -> Column:
    return host(a) == host(b)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unquoted(text: Column) -> Column:
    """Percent decoding of a query's part: + is a space, a bad escape stays as it is."""
    return F.coalesce(F.try_url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25")), text)


def quoted(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def query_key(key: Column) -> Column:
    return F.regexp_replace(F.lower(stripped(key)), r"^&*(?:amp;)*", "")


def pairs(q: Column, key=query_key) -> Column:
    """array of (key, value), decoded, keys normalised, in their order."""
    items = F.filter(F.split(q, "&"), lambda x: x != "")
    value = lambda x: F.when(F.contains(x, F.lit("=")), F.regexp_replace(x, "^[^=]*=", "")).otherwise("")
    return F.transform(items, lambda x: F.struct(key(unquoted(F.substring_index(x, "=", 1))).alias("key"), unquoted(value(x)).alias("value")))


def normalized_pairs(q: Column, english: bool = False) -> Column:
    """Without empty and volatile keys and, sorted by key, in a stable order; with English forced if asked."""
    kept = F.filter(pairs(q), lambda p: (p["key"] != "") & ~p["key"].isin(*VOLATILE))
    if english:
        kept = F.filter(kept, lambda p: ~p["key"].isin(*LANGUAGE_KEYS))
        kept = F.concat(kept, F.array(F.struct(F.lit("language").alias("key"), F.lit("english").alias("value"))))
    marked = F.transform(kept, lambda p, i: F.struct(p["key"].alias("key"), i.alias("i"), p["value"].alias("value")))
    return F.array_sort(marked)


def _joined(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda p: F.concat_ws("=", quoted(p["key"]), quoted(p["value"]))), "&")


def normalize(url: Column, english: bool = False, base: Column | None = None) -> Column:
    def of(p: Column) -> Column:
        q = p["query"]
        clean = F.regexp_replace(F.regexp_replace(p["path"], ";[^/]*$", ""), "/{2,}", "/")
        clean = F.when(clean == "", "/").when(F.length(clean) > 1, F.regexp_replace(clean, "/$", "")).otherwise(clean)

        def whole(path: Column) -> Column:
            pseudo = F.startswith(q, F.lit("/")) & F.contains(F.lower(q), F.lit("/cart/"))
            route = F.regexp_replace(q, "&.*$", "")
            rest = F.when(F.contains(q, F.lit("&")), F.regexp_replace(q, "^[^&]*&", "")).otherwise("")
            # of a pseudo-route only what follows it is parsed
            tail = _joined(normalized_pairs(F.when(pseudo, rest).otherwise(q), english))
            untouched = F.lit(english) & (q == "") & F.contains(F.lower(path), F.lit("/cart/&"))
            new = let(tail, lambda t: F.when(pseudo, F.when(t == "", route).otherwise(F.concat_ws("&", route, t))).when(untouched, "").otherwise(t))
            bare = (p["host"] == "") & ~(p["scheme"].isin("", "http", "https", "ftp") & F.startswith(path, F.lit("/")))
            start = F.concat(F.when(p["scheme"] == "", "https").otherwise(p["scheme"]), F.when(bare, ":").otherwise("://"), p["host"], path)
            return let(new, lambda n: F.when(n == "", start).otherwise(F.concat_ws("?", start, n)))

        return let(clean, whole)

    given = stripped(url if base is None else resolved(base, url))
    return let(given, lambda u: let(F.struct(scheme(u).alias("scheme"), host(u).alias("host"), path(u).alias("path"), query(u).alias("query")), of))


def decoded(text: Column) -> Column:
    """Percent decoding that leaves `+` and bad escapes alone."""
    return F.coalesce(F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B"))), text)


def merge_key(url: Column) -> Column:
    return decoded(F.lower(normalize(url)))


def _first(text: Column, tokens: tuple[str, ...]) -> Column:
    """The first token in list order that text contains, or null."""
    return F.get(F.filter(F.array(*[F.lit(t) for t in tokens]), lambda t: F.contains(text, t)), F.lit(0))


def _some(values: Column) -> Column:
    """The first that is not null."""
    return F.get(F.filter(values, lambda x: x.isNotNull()), F.lit(0))


def classify_reason(url: Column, extra_likely: tuple[str, ...] = (), denied: tuple[str, ...] = DENIED) -> Column:
    """Why a URL, once normal, is no product page, or ok. denied and extra_likely are the configurable lists."""

    def of(low: Column) -> Column:
        routes = F.transform(F.filter(pairs(query(low)), lambda p: p["key"] == "rp"), lambda p: F.lower(stripped(p["value"])))

        def judged(x: Column) -> Column:
            likely = F.exists(F.array(*[F.lit(t) for t in (*LIKELY, *extra_likely)]), lambda t: F.contains(low, t)) | F.exists(x["routes"], lambda r: F.contains(r, F.lit("/store/")))
            return (
                F.when(~F.startswith(scheme(low), F.lit("http")), "non-http-scheme")
                .when(x["path"].isNotNull(), F.concat(F.lit("denylist:"), x["path"]))
                .when(F.contains(low, F.lit("a=view")) | F.contains(low, F.lit("a=checkout")), "cart-action-page")
                .when(x["route"].isNotNull(), F.concat(F.lit("blocked-route:"), x["route"]))
                .when(~likely, "not-product-like")
                .otherwise("ok")
            )

        found = let(routes, lambda r: F.struct(r.alias("routes"), _first(path(low), denied).alias("path"), _some(F.transform(r, lambda v: _first(v, denied))).alias("route")))
        return let(found, judged)

    return let(F.lower(normalize(url)), of)


def skip_reason(url: Column, denied: tuple[str, ...] = DENIED, static: tuple[str, ...] = STATIC, english: tuple[str, ...] = ENGLISH) -> Column:
    """Why a crawl leaves a URL, once normal, out, or ok; of the query the first pair with a reason decides."""

    def reason(x: Column) -> Column:
        tag = F.lower(stripped(x["value"]))
        rooted = F.regexp_replace(tag, "/{2,}", "/")
        route = F.when(F.startswith(rooted, F.lit("/")) | (rooted == ""), rooted).otherwise(F.concat(F.lit("/"), rooted))
        found = _first(route, denied)
        return (
            F.when(x["key"] == "currency", "blocked-query:currency")
            .when(x["key"] == "languagechange", "blocked-query:languagechange")
            .when(x["key"].isin(*LANGUAGE_KEYS) & (tag != "") & ~tag.isin(*english), F.concat(F.lit("non-english-language:"), tag))
            .when(x["key"].isin(*ROUTE_KEYS) & found.isNotNull(), F.concat(F.lit("blocked-route:"), found))
        )

    def of(low: Column) -> Column:
        def judged(x: Column) -> Column:
            value = lambda k: F.lower(stripped(F.coalesce(F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(x["pairs"], lambda p: p["key"] == k), lambda p: p["value"])), -1), F.lit(""))))
            blocked = _first(x["path"], denied)
            ends = F.exists(F.array(*[F.lit(e) for e in static]), lambda e: F.endswith(x["path"], e))
            return (
                F.when(~F.startswith(scheme(low), F.lit("http")), "non-http-scheme")
                .when(blocked.isNotNull(), F.concat(F.lit("blocked-path:"), blocked))
                .when(F.array_contains(F.split(x["path"], "/"), "cdn-cgi"), "blocked-path:cdn-cgi")
                .when(F.contains(x["path"], F.lit("&")), "malformed-path-ampersand")
                .when(ends, "media-or-static-file")
                .when((value("action") == "embed") & (value("cmd") == "hbchat"), "blocked-query:hbchat")
                .otherwise(F.coalesce(_some(F.transform(x["pairs"], reason)), F.lit("ok")))
            )

        return let(F.struct(path(low).alias("path"), pairs(query(low)).alias("pairs")), judged)

    return let(F.lower(normalize(url)), of)


def without_language(url: Column) -> Column:
    kept = F.filter(pairs(query(url)), lambda p: ~p["key"].isin(*LANGUAGE_KEYS))
    base = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), r"\?.*$", "")
    return F.when(F.size(kept) == 0, base).otherwise(F.concat_ws("?", base, _joined(kept)))


def resolved(base: Column, href: Column) -> Column:
    """href against base: absolute, scheme- and root-relative, query and plain names; dot segments are resolved."""
    root = F.concat(scheme(base), F.lit("://"), F.regexp_extract(base, PARTS, 2))
    folder = F.regexp_replace(F.when(path(base) == "", "/").otherwise(path(base)), "[^/]*$", "")
    return (
        F.when(href.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme(base), F.lit(":"), href))
        .when(F.startswith(href, F.lit("/")), F.concat(root, _dotless(href)))
        .when(F.startswith(href, F.lit("?")), F.concat(root, path(base), href))
        .when(F.startswith(href, F.lit("#")) | (href == ""), base)
        .otherwise(F.concat(root, _dotless(F.concat(folder, href))))
    )


def _dotless(target: Column) -> Column:
    """A rooted path, with what follows it, without its dot segments."""
    p = F.regexp_extract(target, r"^([^?#]*)", 1)
    rest = F.substring(target, F.length(p) + 1, F.length(target))
    steps = F.split(F.regexp_replace(p, "^/", ""), "/")
    ends_open = p.rlike(r"/\.{1,2}$")
    kept = F.aggregate(
        steps, F.array().cast("array<string>"),
        lambda a, x: F.when(x == ".", a).when(x == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(x))),
    )
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends_open & (F.size(kept) > 0), "/").otherwise(""), rest)


def _segments(text: Column) -> Column:
    return F.filter(F.split(text, "/"), lambda s: s != "")


def store_segments(url: Column) -> Column:
    """Segments after the first /store/ of the path or, if there are none, of a route parameter."""
    routes = F.transform(F.filter(pairs(query(url), F.lower), lambda p: p["key"].isin(*ROUTE_KEYS)), lambda p: F.lower(p["value"]))
    tails = F.transform(F.filter(F.concat(F.array(F.lower(path(url))), routes), lambda t: F.contains(t, F.lit("/store/"))), lambda t: _segments(F.regexp_replace(t, "^(?s).*?/store/", "")))
    return F.coalesce(F.get(F.filter(tails, lambda s: F.size(s) > 0), F.lit(0)), F.array().cast("array<string>"))


def route_segments(url: Column) -> Column:
    """Segments after /cart/ of a pseudo-route query, else of the path."""
    q, p = query(url), path(url)
    source = F.regexp_replace(F.when(F.startswith(q, F.lit("/")), q).when(F.contains(F.lower(p), F.lit("/cart/")), p).otherwise(""), "&.*$", "")
    return F.when(source.rlike("(?i)/cart/"), _segments(F.regexp_replace(source, "^(?i).*?/cart/", ""))).otherwise(F.array().cast("array<string>"))


def cart_segments(url: Column) -> Column:
    q = query(url)
    return _segments(F.when(F.startswith(q, F.lit("/")), F.regexp_replace(q, "&.*$", "")).otherwise(path(url)))


def cart_slug(url: Column) -> Column:
    s = cart_segments(url)
    return F.when((F.size(s) == 2) & (F.get(s, F.lit(0)) == "cart"), url)


def route_label(url: Column) -> Column:
    """confproduct, store_product, store_category, cart_add, cart_root or other; of a repeated key the first counts."""

    def of(x: Column) -> Column:
        n = F.size(x["segments"])
        first = lambda k: F.get(F.filter(x["pairs"], lambda p: p["key"] == k), F.lit(0))["value"]
        action = F.lower(stripped(F.coalesce(first("a"), F.lit(""))))
        cart = F.endswith(F.lower(path(url)), F.lit("cart.php"))
        bare = ~F.exists(x["pairs"], lambda p: (p["key"] != "") & ~p["key"].isin(*LANGUAGE_KEYS))
        return (
            F.when(action == "confproduct", "confproduct").when(n >= 2, "store_product").when(n == 1, "store_category")
            .when(cart & (action == "add") & first("pid").isNotNull(), "cart_add").when(cart & bare, "cart_root").otherwise("other")
        )

    return let(F.struct(store_segments(url).alias("segments"), pairs(query(url), lambda k: F.lower(stripped(k))).alias("pairs")), of)


def numeric_add(url: Column) -> Column:
    return F.lower(url).rlike(r"[?&]action=add&id=\d+(?:[&#]|$)")


def seeds(root: Column) -> Column:
    """Normal forms of the root and of the usual entry points of its host."""
    return F.array_distinct(F.concat(F.array(normalize(root)), F.transform(F.array(*[F.lit(x) for x in SEEDS[1:]]), lambda x: normalize(resolved(root, x)))))


def _candidate_segments(url: Column) -> Column:
    """Segments after /store/ of the path, else of the last route parameter that starts with it."""
    p = F.lower(path(url))
    routes = F.transform(F.filter(pairs(query(url), F.lower), lambda x: x["key"] == "rp"), lambda x: F.lower(x["value"]))
    route = F.element_at(F.concat(F.array(F.lit("")), routes), -1)
    text = F.when(F.contains(p, F.lit("/store/")), p).when(F.startswith(route, F.lit("/store/")), route)
    return F.coalesce(_segments(F.regexp_replace(text, "^.*?/store/", "")), F.array().cast("array<string>"))


def is_product_candidate(url: Column) -> Column:
    low = F.lower(url)
    return F.contains(low, F.lit("a=add&pid=")) | F.contains(low, F.lit("action=add&id=")) | (F.size(_candidate_segments(url)) >= 2)


def is_category_candidate(url: Column) -> Column:
    low = F.lower(url)
    return F.contains(low, F.lit("gid=")) | F.contains(low, F.lit("cat_id=")) | (F.size(_candidate_segments(url)) == 1)
