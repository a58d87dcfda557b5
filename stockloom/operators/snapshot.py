"""Stock snapshots: targets, checks, overlays and change flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import stock, text

# Markers on pages without a parser of their own.
OUT_MARKERS = ("out of stock", "currently unavailable", "sold out", "缺貨中", "缺货中")


def targets(products: DataFrame, only_unknown: bool) -> DataFrame:
    df = products.where(F.col("type") != "category")
    return df.where("in_stock = -1") if only_unknown else df


def change_flags(state: Column, previous: Column) -> list[Column]:
    return [
        F.coalesce(previous != state, F.lit(False)).alias("changed"),
        F.coalesce((previous == 0) & (state == 1), F.lit(False)).alias("restocked"),
        F.coalesce((previous == 1) & (state == 0), F.lit(False)).alias("destocked"),
    ]


def against_previous(current: DataFrame, previous: DataFrame, key: str, state: str = "in_stock") -> DataFrame:
    """current with previous_in_stock and the change flags; previous has one row a key."""
    df = current.join(previous.select(key, F.col(state).alias("previous_in_stock")), key, "left")
    return df.select("*", *change_flags(F.col(state), F.col("previous_in_stock")))


def overlaid(products: DataFrame, checked: DataFrame, key: str, always: tuple[str, ...], present: tuple[str, ...]) -> DataFrame:
    """Checked values over products': `always` fields wherever the row was checked, `present` ones only where not null."""
    fields = [F.col(c).alias(f"_{c}") for c in (*always, *present)]
    df = products.join(checked.select(key, F.lit(True).alias("_checked"), *fields), key, "left")
    for c in always:
        df = df.withColumn(c, F.when(F.col("_checked"), F.col(f"_{c}")).otherwise(F.col(c)))
    for c in present:
        df = df.withColumn(c, F.coalesce(f"_{c}", c))
    return df.drop("_checked", *[f"_{c}" for c in (*always, *present)])


def page_verdict(html: Column, platform: Column, parsed_state: Column, parsed_evidence: Column, fallback: Column) -> Column:
    """(in_stock, evidence): the parsers' verdict (1, 0, or -1 where they are undecided, which keeps the fallback) on their
    platforms; else the out-of-stock markers, and failing these the state so far."""
    marked = text.has_marker(F.coalesce(html, F.lit("")), OUT_MARKERS)
    with_parser = platform.isin("a", "b")
    state = F.when(with_parser, F.when(parsed_state.isin(0, 1), parsed_state).otherwise(fallback)).when(marked, 0).otherwise(fallback)
    note = F.when(with_parser, F.coalesce(parsed_evidence, F.array().cast("array<string>"))).when(marked, F.array(F.lit("generic-oos-marker"))).otherwise(F.array(F.lit("special-fallback")))
    return F.struct(state.cast("int").alias("in_stock"), note.alias("evidence"))


def checked(products: DataFrame, pages: DataFrame, key: str, now: Column) -> DataFrame:
    """Products with the state and evidence that their page shows; a failed or missing fetch keeps the state and says why. pages: key,
    ok, error, tier and verdict (page_verdict's); optional price_raw, cycles and locations_raw of a good fetch."""
    extra = [c for c in ("price_raw", "cycles", "locations_raw") if c in pages.columns]
    seen = pages.select(key, "ok", "error", "tier", F.col("verdict").alias("_verdict"), *[F.col(c).alias(f"_{c}") for c in extra])
    df = products.drop(*extra).join(seen, key, "left")
    good = F.coalesce(F.col("ok"), F.lit(False))
    note = F.concat(F.lit("fetch-error:"), F.coalesce("error", F.lit("missing")))
    evidence = F.when(good, F.concat(F.col("_verdict.evidence"), F.array(F.concat(F.lit("tier:"), F.coalesce("tier", F.lit("")))))).otherwise(F.array(note))
    df = df.withColumn("in_stock", F.when(good, F.col("_verdict.in_stock")).otherwise(F.col("in_stock"))).withColumn("evidence", evidence).withColumn("checked_at", now)
    for c in extra:
        df = df.withColumn(c, F.when(good, F.col(f"_{c}")))
    return df.drop("ok", "error", "tier", "_verdict", *[f"_{c}" for c in extra])


def projected(products: DataFrame) -> DataFrame:
    """Products in the shape of a snapshot: the lookup key as canonical_url, blanks for missing texts; price, cycles and locations only if there."""
    have = set(products.columns)
    blank = lambda c: (F.coalesce(F.col(c), F.lit("")) if c in have else F.lit("")).alias(c)
    key = stock.stock_key(F.col("canonical_url") if "canonical_url" in have else F.lit(None).cast("string"), F.col("source_url") if "source_url" in have else F.lit(None).cast("string"))
    null = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind).alias(c)
    return products.select(
        null("product_id", "string"), key.alias("canonical_url"), blank("site"), blank("name_raw"), stock.tri_state(F.col("in_stock")).alias("in_stock"), null("checked_at", "string"),
        (F.coalesce("evidence", F.array().cast("array<string>")) if "evidence" in have else F.array().cast("array<string>")).alias("evidence"), *[c for c in ("price_raw", "cycles", "locations_raw") if c in have],
    )


def refreshed(products: DataFrame, previous: DataFrame, pages: DataFrame, now: Column, only_unknown: bool = True, order: str = "ordinal") -> tuple[DataFrame, DataFrame, DataFrame]:
    """A whole refresh: (products, snapshot, checked rows in the targets' order). products: canonical_url, site, type, name_raw, in_stock,
    evidence, `order`; previous: one snapshot row or more a key, of which the last by `order` counts; pages as for `checked`."""
    goods = products.where(F.lower(F.coalesce("type", F.lit("product"))) != "category")
    aim = goods.where("in_stock = -1") if only_unknown else goods
    rows = checked(aim, pages, "canonical_url", now)
    fields = [c for c in ("price_raw", "cycles", "locations_raw") if c in rows.columns and c in goods.columns]
    over = overlaid(goods, rows, "canonical_url", ("in_stock", "evidence"), tuple(fields))
    w = Window.partitionBy("canonical_url").orderBy(F.desc(order))
    old = previous.where("canonical_url != ''").withColumn("_r", F.row_number().over(w)).where("_r = 1")
    was = old.select("canonical_url", F.col("in_stock").alias("previous_in_stock"), F.col("checked_at").alias("_at"))
    mark = rows.select("canonical_url", F.lit(True).alias("_checked"))
    shot = projected(over.drop("checked_at")).drop("checked_at").join(was, "canonical_url", "left").join(mark, "canonical_url", "left")
    shot = shot.select("*", *change_flags(F.col("in_stock"), F.col("previous_in_stock")))
    at = F.when(F.col("_checked"), now).when(~F.col("changed") & F.col("previous_in_stock").isNotNull() & F.col("_at").isNotNull(), F.col("_at")).otherwise(now)
    shot = shot.withColumn("checked_at", at).drop("_at", "_checked")
    kept = products.where(F.lower(F.coalesce("type", F.lit("product"))) == "category")
    return kept.unionByName(over, allowMissingColumns=True), shot, rows.orderBy(order)


def carried_check_time(state: Column, previous: Column, was_checked: Column, now: Column, previous_time: Column) -> Column:
    return F.when(was_checked, now).when(state.eqNullSafe(previous), previous_time)


def stats(items: DataFrame) -> DataFrame:
    return items.agg(
        F.count("*").alias("total_products"), F.count_if(F.col("restocked")).alias("restocked"), F.count_if(F.col("destocked")).alias("destocked"),
        F.count_if(F.col("changed")).alias("changed"), F.count_if(F.col("in_stock") == -1).alias("unknown"),
    )
