"""The catalogue document: grouping, header statistics, unnesting, and the dashboard's queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stockloom.functions import stock, text


def grouped(products: DataFrame, ordinal: str) -> DataFrame:
    """(site, platform, categories, products, product_count), sites in order of first appearance. Anything but a category is a product."""
    fields = F.struct(F.col(ordinal).alias("_i"), *[c for c in products.columns if c not in ("site", "platform", ordinal)])
    bare = lambda a: F.transform(F.array_sort(a), lambda x: x.dropFields("_i"))
    is_category = F.col("type") == "category"
    df = products.groupBy("site", "platform").agg(
        F.min(ordinal).alias("_first"), F.collect_list(F.when(is_category, fields)).alias("c"), F.collect_list(F.when(~F.coalesce(is_category, F.lit(False)), fields)).alias("p")
    )
    return df.select("site", "platform", bare(F.col("c")).alias("categories"), bare(F.col("p")).alias("products"), F.size("p").cast("long").alias("product_count"), "_first").orderBy("_first").drop("_first")


def unnested(sites: DataFrame) -> DataFrame:
    """The flat catalogue of a grouped one, labelled by type."""
    part = lambda name, label: sites.select("site", "platform", F.explode(name).alias("x")).select("site", "platform", "x.*").withColumn("type", F.lit(label))
    return part("products", "product").unionByName(part("categories", "category"), allowMissingColumns=True)


def document(products: DataFrame, ordinal: str, run_id: str, generated_at: str) -> DataFrame:
    """One row: generated_at, run_id, stats, sites."""
    stats = products.agg(F.count_distinct("site").alias("total_sites"), F.count("*").alias("total_products"), *stock.state_counts(F.col("in_stock")))
    sites = grouped(products, ordinal).agg(F.collect_list(F.struct("site", "platform", "categories", "products", "product_count")).alias("sites"))
    return stats.select(F.struct("*").alias("stats")).crossJoin(sites).select(F.lit(generated_at).alias("generated_at"), F.lit(run_id).alias("run_id"), "stats", "sites")  # one row each


def snapshot_document(items: DataFrame, stats: DataFrame, run_id: str, generated_at: str) -> DataFrame:
    rows = items.agg(F.collect_list(F.struct("*")).alias("items"))
    return stats.select(F.struct("*").alias("stats")).crossJoin(rows).select(F.lit(generated_at).alias("generated_at"), F.lit(run_id).alias("run_id"), "stats", "items")  # one row each


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_stage(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def embedded(document_row: DataFrame) -> DataFrame:
    """The document as JSON that may stand inside HTML."""
    return document_row.select(text.json_in_html(F.to_json(F.struct("*"))).alias("payload"))


def searched(rows: DataFrame, fields: tuple[str, ...], needle: str = "", **equal) -> DataFrame:
    """Rows whose fields, joined by spaces without blanks, contain needle in any case, and that equal the given values."""
    whole = F.lower(F.concat_ws(" ", *[F.nullif(F.col(f).cast("string"), F.lit("")) for f in fields]))
    df = rows.where(F.contains(whole, F.lit(needle.strip().lower()))) if needle.strip() else rows
    for name, value in equal.items():
        df = df.where(F.col(name) == value)
    return df


def sorted_by(rows: DataFrame, column: str, ascending: bool = True, *tie: str) -> DataFrame:
    numeric = dict(rows.dtypes)[column] not in ("string",)
    key = F.col(column) if numeric else F.collate(F.coalesce(F.col(column), F.lit("")), "UNICODE")
    return rows.orderBy(key.asc() if ascending else key.desc(), *tie)


def dashboard_stats(items: DataFrame) -> DataFrame:
    df = items.agg(F.count("*").alias("total"), F.count_if(F.col("in_stock") == 1).alias("in_stock"), F.count_if(F.col("in_stock") == 0).alias("out_of_stock"))
    return df.withColumn("unknown", F.col("total") - F.col("in_stock") - F.col("out_of_stock"))


def site_list(items: DataFrame) -> DataFrame:
    return items.select("site").distinct().orderBy("site")


def shown(items: DataFrame, most: int = 500) -> DataFrame:
    return items.withColumn("description_raw", F.substring("description_raw", 1, most))
