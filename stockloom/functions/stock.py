"""Availability as a tri-state: 1 in stock, 0 out of stock, -1 unknown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def tri_state(value: Column, default: int = -1) -> Column:
    """Numbers whose whole part is -1, 0 or 1, booleans, whole numbers as text, and the words in_stock and out_of_stock; all else is the default."""
    text = F.lower(stripped(value.cast("string")))
    whole = F.regexp_replace(text, "_", "").try_cast("int")
    number = F.when(F.typeof(value) == "boolean", value.cast("string").try_cast("boolean").cast("int"))
    number = number.when(F.typeof(value).isin("double", "float") | F.startswith(F.typeof(value), F.lit("decimal")), F.signum(value.cast("string").try_cast("double")) * F.floor(F.abs(value.cast("string").try_cast("double"))))
    number = number.when(text.rlike(r"^[+-]?\d+(?:_\d+)*$"), whole)
    return F.when(number.isin(-1, 0, 1), number).when(text == "in_stock", 1).when(text == "out_of_stock", 0).otherwise(default).cast("int")


def record_state(has_key: Column, value: Column, legacy: Column) -> Column:
    """The new field wins wherever its key is present, even if null."""
    return F.when(has_key, tri_state(value)).otherwise(tri_state(legacy))


def flag_state(flag: Column) -> Column:
    return F.when(flag.isNull(), -1).when(flag, 1).otherwise(0).cast("int")


def state_counts(state: Column) -> list[Column]:
    return [F.count_if(state == 1).alias("in_stock"), F.count_if(state == 0).alias("out_of_stock"), F.count_if(~state.isin(0, 1)).alias("unknown")]


def badge(state: Column) -> Column:
    return F.when(state == 1, "In stock").when(state == 0, "Out of stock").otherwise("Unknown")


def stock_key(canonical: Column, source: Column) -> Column:
    return F.coalesce(F.nullif(canonical, F.lit("")), F.nullif(source, F.lit("")), F.lit(""))


def content_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 16)


#: The weight of each kind of scan.
WEIGHTS = {"product_scanner": 3, "category_scanner": 2, "discoverer": 1}


def scan_weight(scan_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    return F.coalesce(F.element_at(table, scan_type), F.lit(0))


def positive_int(value: Column, default: int, least: int = 1, most: int | None = None) -> Column:
    n = F.greatest(F.coalesce(stripped(value.cast("string")).try_cast("int"), F.lit(default)), F.lit(least))
    return F.least(n, F.lit(most)) if most is not None else n


def succeeded(status: Column) -> Column:
    return F.coalesce((status >= 200) & (status < 400), F.lit(False))


def retriable(status: Column) -> Column:
    return F.coalesce(status.isin(408, 425, 429, 500, 502, 503, 504), F.lit(False))


# Fixed values.
STRONG_CHALLENGE = (
    "just a moment", "attention required", "cf-chl", "__cf_chl", "cf browser verification", "cf-browser-verification", "challenge-platform",
    "cdn-cgi/challenge-platform", "checking your browser before accessing", "please stand by, while we are checking your browser", "ddos protection by cloudflare",
)
WEAK_CHALLENGE = ("enable javascript and cookies to continue", "to work with the site requires support for javascript and cookies")


def challenge_page(status: Column, text: Column, headers: Column | None = None) -> Column:
    """Whether a response is a challenge: the platform's script always, other marks by status. headers: a map, names in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = lambda marks: F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(low, m))
    server = F.lit(False)
    if headers is not None:
        entries = F.transform(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("k"), F.lower(e["value"]).alias("v")))
        server = F.exists(entries, lambda e: ((e["k"] == "cf-ray") & (e["v"] != "")) | ((e["k"] == "server") & F.contains(e["v"], F.lit("cloudflare"))))
    barred = F.coalesce(status.isin(403, 429, 503), F.lit(False)) & (held(STRONG_CHALLENGE) | held(WEAK_CHALLENGE) | server)
    return F.contains(low, F.lit("challenge-platform")) | barred | (F.coalesce(status == 200, F.lit(False)) & held(STRONG_CHALLENGE))
