"""Alerts as rows: sections, blocks and length-bounded messages. Nothing is sent."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import stock, text

#: Opens each message after a break.
CONTINUED = "_\\(cont\\.\\)_"


def sectioned(changed: DataFrame, order: list[Column]) -> DataFrame:
    section = F.when(F.col("restocked"), "restocked").when(F.col("destocked"), "destocked").otherwise("changed")
    df = changed.withColumn("section", section)
    return df.withColumn("place", F.row_number().over(Window.partitionBy("section").orderBy(*order)))


def catalogue_changes(changes: DataFrame, products: DataFrame, key: str = "canonical_url") -> DataFrame:
    """Each changed URL with its product, or a stub of it."""
    return changes.join(products, key, "left").withColumn("name_raw", F.coalesce("name_raw", F.col(key)))


def run_stats(title: str, stats: dict[str, int]) -> Column:
    """The title and a line for each number, names in words with capitals."""
    line = lambda k, v: F.concat(F.lit("  *"), text.markdown_escaped(F.lit(k.replace("_", " ").title())), F.lit(":* "), text.markdown_escaped(F.lit(str(v))))
    return F.concat(F.lit("📈 *"), text.markdown_escaped(F.lit(title)), F.lit("*\n\n"), F.concat_ws("\n", *[line(k, v) for k, v in stats.items()]), F.lit("\n"))


# Icons, labels and what stands for a missing field.
LABELS = {1: ("🟢", "In Stock"), 0: ("🔴", "Out of Stock"), -1: ("⚪", "Unknown")}
NO_NAME, NO_SITE, NO_PRICE = "Unnamed Product", "Unknown Site", "Unknown"
LINK = "Open Product"


def limits(most: int) -> tuple[int, int]:
    """Bounds of a message and of a block."""
    message = max(80, most - 64)
    return message, max(60, message - 120)


def _or(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(stock.stripped(value.cast("string")), F.lit("")), F.lit(default))


def status_line(state: Column, name: Column) -> Column:
    icon = F.when(state == 1, LABELS[1][0]).when(state == 0, LABELS[0][0]).otherwise(LABELS[-1][0])
    label = F.when(state == 1, LABELS[1][1]).when(state == 0, LABELS[0][1]).otherwise(LABELS[-1][1])
    return F.concat(icon, F.lit(" *"), text.markdown_escaped(label), F.lit("* "), text.markdown_escaped(_or(name, NO_NAME)))


def metadata(name: Column, site: Column, price: Column, state: Column) -> Column:
    """State and name, site and price, a line each."""
    return F.concat_ws("\n", status_line(state, name), F.concat(F.lit("*Site:* "), text.markdown_escaped(_or(site, NO_SITE))), F.concat(F.lit("*Price:* "), text.markdown_escaped(_or(price, NO_PRICE))))


def product_block(name: Column, site: Column, price: Column, state: Column, url: Column) -> Column:
    """A product's lines with its link."""
    u = F.coalesce(stock.stripped(url), F.lit(""))
    link = F.concat(F.lit(f"🔗 [{LINK}]("), F.regexp_replace(u, r"([\\()])", r"\\$1"), F.lit(")"))
    return F.concat_ws("\n", metadata(name, site, price, state), F.when(u == "", F.concat(F.lit("🔗 *Link:* "), text.markdown_escaped(F.lit("N/A")))).otherwise(link))


def product_blocks(name: Column, site: Column, price: Column, state: Column, url: Column, limit: int = 4096) -> Column:
    """array of (block, force): the product's block or, if that is too long, one without the link and the whole URL, forced into a new message."""
    item = lambda block, force: F.struct(block.alias("block"), F.lit(force).alias("force"))
    u = F.coalesce(stock.stripped(url), F.lit(""))
    full = product_block(name, site, price, state, url)
    short = F.array(item(metadata(name, site, price, state), False), item(F.concat(F.lit("🔗 "), text.markdown_escaped(u)), True))
    return F.when((u != "") & (F.length(full) > limits(limit)[1]), short).otherwise(F.array(item(full, False)))


def section_header(changed: DataFrame) -> DataFrame:
    """One row: the numbers of restocked, destocked and other rows, and the header line that tells them."""
    n = changed.agg(
        F.count_if("restocked").alias("restocked"), F.count_if(F.col("destocked") & ~F.col("restocked")).alias("destocked"), F.count_if(~F.col("restocked") & ~F.col("destocked")).alias("other"),
    )
    told = F.format_string("🟢 *%d* back in stock • 🔴 *%d* out of stock • ⚪ *%d* other", "restocked", "destocked", "other")
    return n.withColumn("header", told)


def filled(sections: list[tuple[str, list[tuple[str, bool]]]], header: str, most: int) -> list[str]:
    """Messages of sections (title, blocks (text, forced into a new message)); a block is never cut, so one that is longer alone is a longer message."""
    out: list[str] = []
    held = [header] if header else []

    def fits(new: list[str]) -> bool:
        return len("\n\n".join(x for x in held + new if x)) <= most

    def flush() -> None:
        if held:
            out.append("\n\n".join(x for x in held if x))

    for title, blocks in sections:
        for i, (block, force) in enumerate(blocks):
            new = [title, block] if i == 0 else [block]
            if force and held:
                flush()
                held = [CONTINUED, title]
            if fits(new) or (i == 0 and header and not out and held == [header]):
                held = held + new
            else:
                flush()
                held = [CONTINUED, title, block]
    flush()
    return out


def chunked(blocks: DataFrame, limit: int = 4096, group: str = "section", header: str = "", titles: dict[str, str] | None = None) -> DataFrame:
    """(part, message): blocks (section, place, block and, if there is one, force) filled greedily, in order, into messages of bounded length.

    One fold goes over all sections, those of titles first, so all blocks of an alert are one group."""
    titles = titles or {}
    most = limits(limit)[0]

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        names = [*titles, *sorted(set(rows[group]) - set(titles))]
        parts = {k: v.sort_values(["place", "i"]) for k, v in rows.groupby(group)}
        out = filled([(titles.get(k, k), list(zip(parts[k]["block"], parts[k]["force"], strict=True))) for k in names if k in parts], header, most)
        return pd.DataFrame({"part": range(len(out)), "message": out})

    force = F.col("force") if "force" in blocks.columns else F.lit(False)
    i = F.col("i") if "i" in blocks.columns else F.lit(0)
    df = blocks.select(group, "place", i.alias("i"), "block", force.alias("force"))
    return df.groupBy(F.lit(0).alias("alert")).applyInPandas(fold, "part int, message string")
