"""Vendor feeds, registry and snapshot documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.functions import stock, text

PLAN = "struct<id:string,plan_name:string,stock:string,flow:string,price_datas:map<string,string>>"
SITE_DEFAULTS = {"enabled": True, "discoverer": True, "product_scanner": True, "category_scanner": True, "category": "", "special_crawler": "", "name": ""}


def _nodes(label: str) -> str:
    return f"array<struct<id:string,area_name:string,nodes:array<struct<id:string,{label}:string,detail:string,plans:array<{PLAN}>>>>>"


def unwrapped(payload: Column) -> Column:
    """JSON that a browser may have wrapped in HTML."""
    t = stock.stripped(payload)
    inner = F.regexp_extract(t, r"(?is)<pre[^>]*>(.*?)</pre>", 1)
    plain = F.replace(F.replace(F.when(inner == "", t).otherwise(inner), F.lit("&quot;"), F.lit('"')), F.lit("&amp;"), F.lit("&"))
    return F.when(F.startswith(t, F.lit("<")), plain).otherwise(t)


def feed_state(number: Column) -> Column:
    return F.when(F.coalesce(stock.stripped(number).try_cast("int"), F.lit(0)) > 0, 1).otherwise(0)


def plans(payloads: DataFrame, areas: str = "data", label: str = "node_name") -> DataFrame:
    """One row a plan of feeds (site, payload): areas at `data` (first vendor) or `data.areas` (second, label group_name)."""
    kind = f"data {_nodes(label)}" if areas == "data" else f"data struct<areas:{_nodes(label)}>"
    df = payloads.select("site", F.from_json(unwrapped(F.col("payload")), kind).alias("j"))
    df = df.select("site", F.explode(f"j.{areas}").alias("a")).select("site", "a", F.explode("a.nodes").alias("n")).select("site", "a", "n", F.explode("n.plans").alias("p"))
    area, node = F.coalesce(F.col("a.area_name"), F.lit("")), F.coalesce(F.col(f"n.{label}"), F.lit(""))
    kind = F.when(F.coalesce(stock.stripped(F.col("p.flow")), F.lit("")) != "", "traffic").otherwise("bandwidth")
    cycles = text.price_cycles(F.col("p.price_datas"))
    return df.select(
        "site", F.col("p.id").alias("plan_id"), F.col("a.id").alias("area_id"), F.col("n.id").alias("node_id"), F.col("p.plan_name").alias("name_raw"), kind.alias("product_type"),
        feed_state(F.col("p.stock")).alias("in_stock"), F.array(F.when(area != "", F.concat_ws(" - ", area, node)).otherwise(node)).alias("locations_raw"),
        F.array(F.concat(F.lit("api-stock:"), F.coalesce(F.col("p.stock"), F.lit("0"))), F.lit("api")).alias("evidence"), cycles["cycles"].alias("cycles"), cycles["price_raw"].alias("price_raw"),
    )


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)


def sites(spark: SparkSession, path: str) -> DataFrame:
    kind = "sites struct<site:array<struct<enabled:boolean,name:string,url:string,discoverer:boolean,category:string,special_crawler:string,product_scanner:boolean,category_scanner:boolean,scan_bounds:map<string,int>>>>"
    df = json_document(spark, path, kind).select(F.explode("sites.site").alias("s")).select("s.*")
    for name, value in SITE_DEFAULTS.items():
        df = df.withColumn(name, F.coalesce(name, F.lit(value)))
    return df


def eligible(registry: DataFrame, stage: str, name: str | None = None) -> DataFrame:
    """Sites of a stage; a special crawler counts for products whatever the flag."""
    flag = F.col(stage) | (F.col("special_crawler") != "") if stage == "product_scanner" else F.col(stage)
    df = registry.where(F.col("enabled") & flag)
    return df.where(F.col("name") == name) if name else df


def stage(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A stage's table, or an empty one if it has not been written."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if there else spark.createDataFrame([], schema)
