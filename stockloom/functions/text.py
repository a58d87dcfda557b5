"""Text, price and form expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockloom.functions.stock import stripped

# Fixed values.
PRICE = r"(?:[$€£¥]|HK\$)\s?[0-9][0-9,.]*\s?(?:USD|CAD|HKD)?"
CYCLES = {"monthly": "Monthly", "quarterly": "Quarterly", "semi-annually": "Semi-Annually", "annually": "Annually", "biennially": "Biennially", "triennially": "Triennially"}
MARKDOWN = r"([_*\[\]()~`>#+\-=|{}.!\\])"


def prices(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(PRICE), F.lit(0)))


def cycles(text: Column) -> Column:
    low = F.lower(text)
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in CYCLES.items()])
    return F.transform(F.filter(every, lambda c: F.contains(low, c["k"])), lambda c: c["v"])


def has_marker(text: Column, markers: tuple[str, ...]) -> Column:
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(m) for m in markers]), lambda m: F.contains(low, m))


def squeezed(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", ""))


def signature(name: Column, *lists: Column) -> Column:
    return F.struct(squeezed(name).alias("name"), *[F.transform(x, squeezed).alias(f"list{i}") for i, x in enumerate(lists)])


def titled(text: Column) -> Column:
    """A capital after anything that is no letter."""
    return F.array_join(F.transform(F.split(F.lower(text), r"(?<=[^A-Za-z])|(?=[^A-Za-z])"), lambda w: F.initcap(w)), "")


def price_cycles(price_map: Column) -> Column:
    """(names, text) from an ordered map of cycle to price."""
    items = F.transform(F.map_entries(price_map), lambda e: F.struct(titled(F.replace(e["key"], F.lit("_"), F.lit(" "))).alias("name"), e["value"].alias("value")))
    return F.struct(F.transform(items, lambda e: e["name"]).alias("cycles"), F.array_join(F.transform(items, lambda e: F.concat_ws(": ", e["name"], e["value"])), "; ").alias("price_raw"))


def markdown_escaped(text: Column) -> Column:
    return F.regexp_replace(text, MARKDOWN, r"\\$1")


def html_escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def json_in_html(text: Column) -> Column:
    for a, b in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def age_label(minutes: Column) -> Column:
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def form_fields(body: Column) -> Column:
    """Heading to text of a form in markdown; comments of one line are left out."""
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.replace(body, F.lit("\r"), F.lit(""))), r"\n###\s+"), lambda p: stripped(p) != "")
    clean = lambda p: stripped(F.regexp_replace(F.regexp_replace(p, r"^[^\n]*\n?", ""), r"(?m)^\s*<!--.*-->\s*$", ""))
    return F.map_from_entries(F.transform(parts, lambda p: F.struct(F.lower(stripped(F.regexp_extract(p, r"^([^\n]*)", 1))).alias("k"), clean(p).alias("v"))))


def first_positive(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"\d+", 0).try_cast("int"), F.lit(0))


def lenient_bool(text: Column, default: bool = False) -> Column:
    t = F.lower(stripped(text))
    return F.when(t.rlike(r"^(?:true|yes|y|1|on|enabled)$") | t.rlike(r"\[x\]"), True).when(t.rlike(r"^(?:false|no|n|0|off|disabled)$") | t.rlike(r"\[ \]"), False).otherwise(default)


def checkboxes(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"^\s*-\s*\[[ xX]\]"))
    items = F.transform(lines, lambda x: F.struct(F.lower(stripped(F.regexp_replace(x, r"^\s*-\s*\[[ xX]\]", ""))).alias("k"), x.rlike(r"\[[xX]\]").alias("v"), ))
    distinct = F.filter(items, lambda e, i: ~F.exists(F.slice(items, i + 2, F.size(items)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(distinct)
