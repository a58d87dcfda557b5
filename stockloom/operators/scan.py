"""Sequential id scans with an adaptive stop, in closed form over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import text, urls


def first_seen(rows: DataFrame, site: str, key: Column, id: str, wanted: Column) -> DataFrame:
    """rows with `is_hit`: the first wanted row of its key at its site."""
    w = Window.partitionBy(site, F.when(wanted, key)).orderBy(id)
    return rows.withColumn("is_hit", wanted & (F.row_number().over(w) == 1))


def processed(ids: DataFrame, site: str = "site", start: Column | None = None, hard: Column | None = None, floor: int = 20, tail: int = 60, streak: int = 20, learned: Column | None = None) -> DataFrame:
    """ids (site, id, is_hit) with `processed`, and the scan's `reason` of stopping: hard-cap, reach or streak.

    reach(i) follows the last hit before i by `tail`, streak(i) counts from the last hit up to i; the scan goes on
    until an id is beyond reach, or a streak of at least 8 misses is full from `floor` on."""
    tail, streak = max(1, tail), max(8, streak)
    start = start if start is not None else F.lit(0)
    hard = hard if hard is not None else F.lit(2**31 - 1)
    learned = learned if learned is not None else F.lit(0)
    order = Window.partitionBy(site).orderBy("id")
    hit = F.when(F.col("is_hit"), F.col("id"))
    least = F.least(hard, F.greatest(F.lit(floor), learned + tail))
    df = ids.where(F.col("id") >= start)
    df = df.withColumn("_before", F.max(hit).over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("_upto", F.max(hit).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    df = df.withColumn("_beyond", F.col("id") > F.greatest(least, F.coalesce(F.least(hard, F.col("_before") + tail), least)))
    df = df.withColumn("_full", (F.col("id") - F.coalesce("_upto", start - 1) >= streak) & (F.col("id") >= floor))
    whole = Window.partitionBy(site)
    df = df.withColumn("_v", F.min(F.when(F.col("_beyond"), F.col("id"))).over(whole)).withColumn("_s", F.min(F.when(F.col("_full"), F.col("id"))).over(whole))
    last = F.least(hard, F.coalesce(F.col("_v") - 1, hard), F.coalesce(F.col("_s"), hard))
    reason = F.when(F.col("_s") == last, "streak").when(F.col("_v") - 1 == last, "reach").otherwise("hard-cap")
    return df.withColumn("processed", F.col("id") <= last).withColumn("reason", reason).drop("_before", "_upto", "_beyond", "_full", "_v", "_s")


def _around(ids: DataFrame, asked: DataFrame, width: int = 1024) -> DataFrame:
    """Of each `at` of asked: `found`, the least id from there on, and `before`, the greatest one below. Only the bounds of strips of `width` ids pass through one task."""
    rows = ids.select(F.col("id").alias("at"), "id").unionByName(asked.select("at", F.lit(None).cast("long").alias("id"))).withColumn("strip", F.floor(F.col("at") / width))
    strips = rows.groupBy("strip").agg(F.min("id").alias("least"), F.max("id").alias("most"))
    order, own = Window.orderBy("strip"), Window.partitionBy("strip").orderBy("at")
    strips = strips.select("strip", F.min("least").over(order.rangeBetween(1, Window.unboundedFollowing)).alias("later"), F.max("most").over(order.rangeBetween(Window.unboundedPreceding, -1)).alias("earlier"))
    rows = rows.withColumn("found", F.min("id").over(own.rangeBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("before", F.max("id").over(own.rangeBetween(Window.unboundedPreceding, -1)))
    return rows.where("id IS NULL").join(strips, "strip").select("at", F.coalesce("found", "later").alias("found"), F.coalesce("before", "earlier").alias("before"))


def stops(sites: DataFrame, ids: DataFrame, hits: DataFrame, floor: int = 20, tail: int = 60, streak: int = 20) -> DataFrame:
    """(site, last_id, reason) of a scan of all ids from 1 to the greatest at each site, as `processed` has it, without a row for each site and id:
    where the scan would stop after a hit follows from that hit alone, and counts if no hit comes before. Id 0 stands for the start."""
    tail, streak = max(1, tail), max(8, streak)
    ids = ids.select(F.col("id").cast("long").alias("id")).where("id >= 1").distinct()
    hard = ids.agg(F.max("id").alias("hard"))
    steps = ids.unionByName(hard.select(F.lit(0).cast("long").alias("id"))).crossJoin(F.broadcast(hard))  # one row
    beyond = F.greatest(F.least("hard", F.lit(max(floor, tail))), F.least("hard", F.col("id") + tail)) + 1
    beyond = F.when(F.col("id") > 0, beyond)  # before any hit `processed` has no reach but the greatest id
    steps = steps.withColumn("full", F.greatest(F.col("id") + streak, F.lit(floor))).withColumn("beyond", beyond)
    near = _around(ids, steps.select(F.explode(F.array("full", "beyond")).alias("at")).where("at IS NOT NULL").distinct())
    steps = steps.join(near.select(F.col("at").alias("full"), F.col("found").alias("s")), "full", "left")
    steps = steps.join(near.select(F.col("at").alias("beyond"), F.col("found").alias("v"), "before"), "beyond", "left").select("id", "hard", "s", "v", "before")
    sites = sites.select("site").distinct()
    rows = hits.select("site", F.col("id").cast("long").alias("id")).join(sites, "site", "left_semi").unionByName(sites.select("site", F.lit(0).cast("long").alias("id"))).distinct()
    rows = rows.join(steps, "id").withColumn("next", F.lead("id").over(Window.partitionBy("site").orderBy("id")))
    s = F.when(F.col("next").isNull() | (F.col("s") < F.col("next")), F.col("s"))
    v = F.when(F.col("v").isNotNull() & (F.col("next").isNull() | (F.col("v") <= F.col("next"))), F.struct("v", "before"))
    rows = rows.groupBy("site").agg(F.max("hard").alias("hard"), F.min(s).alias("s"), F.min(v).alias("v"))
    last = F.least("hard", F.coalesce(F.col("v.v") - 1, "hard"), F.coalesce("s", "hard"))
    reason = F.when(F.col("s") == last, "streak").when(F.col("v.v") - 1 == last, "reach").otherwise("hard-cap")
    out = rows.select("site", F.when(reason == "reach", F.col("v.before")).otherwise(last).alias("last_id"), reason.alias("reason"))
    return out.where("last_id IS NOT NULL")


def high_water(hits: DataFrame, site: str, learned: Column, tail: int) -> DataFrame:
    high = F.greatest(F.max("id"), F.max(learned))
    return hits.groupBy(site).agg(high.alias("high")).withColumn("resume", F.greatest(F.lit(0), F.col("high") - tail))


def _english(url: Column) -> Column:
    return urls.normalize(url, english=True)


def category_hits(rows: DataFrame, platform: str) -> DataFrame:
    """rows (site, id, ok, final_url and the parser's verdict) with `key`, the normal final URL, and `is_hit`: the first category page of its key.
    On the second platform a product page counts too, unless it shows that there are no services."""
    wanted = F.col("is_category") if platform == "a" else (F.col("is_category") | F.col("is_product")) & ~F.array_contains("evidence", "no-services-yet")
    df = rows.withColumn("key", _english(F.col("final_url")))
    return first_seen(df, "site", F.col("key"), "id", F.coalesce(F.col("ok") & wanted, F.lit(False)))


def category_rows(hits: DataFrame) -> DataFrame:
    """What a category scan yields: a row for each hit, and one for each product link of every page that was fetched."""
    own = hits.where("is_hit").select("site", "id", F.col("key").alias("canonical_url"), F.col("name").alias("name_raw"), F.lit("category").alias("type"), "evidence")
    link = hits.where("ok").select("site", "id", "final_url", "evidence", F.explode("product_links").alias("link"))
    link = link.select("site", "id", _english(urls.resolved(F.col("final_url"), F.col("link"))).alias("canonical_url"), F.lit("").alias("name_raw"), F.lit("product").alias("type"), F.concat("evidence", F.array(F.lit("category-product-link"))).alias("evidence"))
    return own.unionByName(link).withColumn("in_stock", F.lit(-1)).orderBy("id")


def product_hits(rows: DataFrame, platform: str) -> DataFrame:
    """rows (site, id, ok, requested_url, final_url, verdict) with `canonical_url`, the state `in_stock` and `is_hit`: the first page wanted of its signature.

    First platform: wanted are configuration pages (in stock), and product-like ones that are out of stock or have product information; equal
    pages are told by the final URL of a store's product, the requested URL of a cart link without information, else by content.
    Second platform: wanted are products, and pages out of stock; equal ones are told by the requested URL."""
    held = lambda e: F.array_contains("evidence", e)
    if platform == "a":
        route = urls.route_label(F.col("final_url"))
        like = route.isin("confproduct", "store_product", "cart_add")
        state = F.when(held("confproduct-final-url"), 1).when(like & held("oos-marker"), 0).when(like & held("has-product-info"), 1)
        content = F.to_json(text.signature(F.coalesce("name", F.lit("")), F.col("prices"), F.col("cycles"), F.col("locations")))
        key = F.when(route == "store_product", F.concat(F.lit("url:"), _english(F.col("final_url")))).when((route == "cart_add") & ~held("has-product-info"), F.concat(F.lit("url:"), _english(F.col("requested_url")))).otherwise(content)
        df = rows.withColumn("canonical_url", F.when(route == "store_product", _english(F.col("final_url"))).otherwise(_english(F.col("requested_url"))))
    else:
        state = F.when(F.col("is_product") | (F.col("in_stock") == 0), F.col("in_stock"))
        key = _english(F.col("requested_url"))
        df = rows.withColumn("canonical_url", F.lower(key))
    df = df.withColumn("_key", key).withColumn("in_stock", state.cast("int"))
    return first_seen(df, "site", F.col("_key"), "id", F.coalesce(F.col("ok"), F.lit(False)) & F.col("in_stock").isNotNull()).drop("_key")


def circuit(log: DataFrame, threshold: int = 5, cooldown: float = 180, key: str = "host") -> DataFrame:
    """A fetch log (host, at in seconds, id, ok) with `failures`, those in a row up to this fetch, and `opens`: where a row of them reaches the threshold."""
    w = Window.partitionBy(key).orderBy("at", "id")
    island = F.sum(F.col("ok").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = log.withColumn("_island", island)
    within = Window.partitionBy(key, "_island").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("failures", F.sum((~F.col("ok")).cast("int")).over(within))
    return df.withColumn("opens", ~F.col("ok") & (F.col("failures") == threshold)).withColumn("open_until", F.when(F.col("opens"), F.col("at") + cooldown)).drop("_island")


def routed(sites: DataFrame) -> DataFrame:
    """Enabled sites with `scanner`, the product scan that fits: a special crawler's, whatever the flag, else the platform's; null is none."""
    special = F.lower(F.trim(F.coalesce("special_crawler", F.lit(""))))
    platform = F.lower(F.coalesce("category", F.lit("")))
    scanner = F.when(special.isin("feed_a", "feed_b"), special).when(F.coalesce(F.col("product_scanner"), F.lit(False)) & platform.isin("a", "b"), F.concat(F.lit("ids_"), platform))
    return sites.where("enabled").withColumn("scanner", scanner)
