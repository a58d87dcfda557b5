"""Merging of scan records: priority pick, content dedup, timestamps, diff."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import stock, urls

MERGED = "content-dedup-merged"
EXEMPT = "oos-marker"


def sanitized(records: DataFrame, extra_likely: tuple[str, ...] = ()) -> DataFrame:
    """Records with normal URLs and defaults, without those whose URL is no product page."""
    have = set(records.columns)
    col = lambda c, default=None: F.col(c) if c in have else F.lit(default)
    url = urls.merge_key(stock.stock_key(col("canonical_url").cast("string"), col("source_url").cast("string")))
    df = records.withColumn("_url", url).where(urls.classify_reason(F.col("_url"), extra_likely) == "ok")
    state = stock.tri_state(F.col("in_stock")) if "in_stock" in have else stock.tri_state(col("stock_status").cast("string"))
    text = lambda c, default="": F.coalesce(col(c).cast("string"), F.lit(default)).alias(c)
    first_line = stock.stripped(F.regexp_extract(stock.stripped(F.coalesce(col("name_raw").cast("string"), F.lit(""))), r"^([^\n\r]*)", 1))
    optional = [c for c in ("price_raw", "cycles", "locations_raw") if c in have]
    return df.select(
        text("site"), text("platform"), F.col("_url").alias("canonical_url"),
        F.coalesce(urls.merge_key(F.nullif(col("source_url").cast("string"), F.lit(""))), F.col("_url")).alias("source_url"),
        F.coalesce(col("scan_type").cast("string"), col("source_priority").cast("string"), F.lit("product_scanner")).alias("scan_type"),
        text("type", "product"), F.coalesce(col("time_used").cast("int"), F.lit(0)).alias("time_used"), first_line.alias("name_raw"), text("description_raw"),
        state.alias("in_stock"), F.coalesce(col("evidence"), F.array().cast("array<string>")).alias("evidence"),
        col("first_seen_at").cast("string").alias("first_seen_at"), col("last_seen_at").cast("string").alias("last_seen_at"), *optional,
    )


def stacked(*sources: DataFrame, order: tuple[str, ...] = ("canonical_url",)) -> DataFrame:
    """All sources with an ordinal that follows (source number, order): no row numbering over the whole table."""
    parts = [s.withColumn("ordinal", F.struct(F.lit(i).alias("source"), *[F.col(c) for c in order])) for i, s in enumerate(sources)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def priority_pick(records: DataFrame, key: str, weight: Column, evidence: Column, ordinal: Column) -> DataFrame:
    """Per key the record of the greatest weight, then most evidence, then the first; `first_ordinal` is the key's first."""
    w = Window.partitionBy(key)
    best = F.row_number().over(w.orderBy(weight.desc(), evidence.desc(), ordinal.asc()))
    return records.withColumn("first_ordinal", F.min(ordinal).over(w)).withColumn("_r", best).where("_r = 1").drop("_r")


def content_dedup(records: DataFrame) -> DataFrame:
    """One record for each (site, name, description); its evidence is the ordered union, with a marker after the
    first duplicate's. Records without a name or site, and those marked out of stock, are exempt."""
    trimmed = [stock.stripped(F.coalesce(F.col(c), F.lit(""))) for c in ("site", "name_raw", "description_raw")]
    exempt = F.array_contains("evidence", EXEMPT) | (trimmed[0] == "") | (trimmed[1] == "")
    df = records.withColumn("_key", F.when(exempt, F.concat(F.lit("url:"), F.col("canonical_url"))).otherwise(F.to_json(F.array(*trimmed))))
    df = df.withColumn("_weight", stock.scan_weight(F.col("scan_type")))
    w = Window.partitionBy("_key").orderBy(F.desc("_weight"), "first_ordinal")
    df = df.withColumn("_r", F.row_number().over(w))
    union = df.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_r", "evidence"))).alias("_all"))
    union = union.select("_key", F.transform("_all", lambda x: x["evidence"]).alias("_all"))
    marked = F.when(F.size("_all") > 1, F.concat(F.slice("_all", 1, 2), F.array(F.array(F.lit(MERGED))), F.slice("_all", 3, F.greatest(F.size("_all") - 2, F.lit(0))))).otherwise(F.col("_all"))
    union = union.select("_key", F.when(F.size("_all") > 1, F.array_distinct(F.flatten(marked))).otherwise(F.get("_all", F.lit(0))).alias("_evidence"))
    return df.where("_r = 1").drop("evidence", "_r", "_weight").join(union, "_key").withColumnRenamed("_evidence", "evidence").drop("_key")


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row a key, the last in order; rows without a key are dropped."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def carried_times(records: DataFrame, previous: DataFrame, now: Column, key: str = "canonical_url") -> DataFrame:
    old = previous.select(F.col(key), F.col("first_seen_at").alias("_first"))
    df = records.join(old, key, "left")
    return df.withColumn("first_seen_at", F.coalesce("_first", "first_seen_at", now)).withColumn("last_seen_at", now).drop("_first")


def merge_records(discovered: DataFrame, products: DataFrame, categories: DataFrame, previous: DataFrame, now: Column, extra_likely: tuple[str, ...] = ()) -> DataFrame:
    df = stacked(*[sanitized(s, extra_likely) for s in (discovered, products, categories)], order=("canonical_url", "name_raw"))
    df = priority_pick(df, "canonical_url", stock.scan_weight(F.col("scan_type")), F.size("evidence"), F.col("ordinal"))
    df = carried_times(content_dedup(df), previous, now)
    return df.drop("ordinal", "first_ordinal").withColumn("product_id", stock.content_id(F.col("canonical_url"))).orderBy("canonical_url")


def diff(old: DataFrame, new: DataFrame, key: str, state: str) -> DataFrame:
    """(key, change): added, deleted or changed."""
    a, b = old.select(key, F.col(state).alias("_old"), F.lit(True).alias("_a")), new.select(key, F.col(state).alias("_new"), F.lit(True).alias("_b"))
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def run_stats(merged: DataFrame, changes: DataFrame, checked: DataFrame) -> DataFrame:
    """One row: the numbers of merged, new, deleted and changed records, of checked ones, and of those still unknown."""
    of = lambda k: F.count_if(F.col("change") == k)
    a = merged.agg(F.count("*").alias("merged"), F.count_if(F.col("in_stock") == -1).alias("unknown"))
    b = changes.agg(of("added").alias("new"), of("deleted").alias("deleted"), of("changed").alias("changed"))
    return a.crossJoin(b).crossJoin(checked.agg(F.count("*").alias("checked")))  # one row each
