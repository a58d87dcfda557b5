"""Registry changes: validation, acceptance by count, guarded upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockloom.functions import text


def accepted(rows: DataFrame, expected: int | Column) -> DataFrame:
    """(site, found, accepted): distinct URLs against the expected number."""
    n = F.count_distinct("url")
    return rows.groupBy("site").agg(n.alias("found"), (n >= expected).alias("accepted"))


def reason(action: Column, name: Column, url: Column) -> Column:
    """The first thing wrong with a change, or ok."""
    return (
        F.when(~F.coalesce(action, F.lit("")).isin("add", "edit"), "unsupported-action").when(F.coalesce(name, F.lit("")) == "", "missing-name")
        .when(~F.coalesce(url, F.lit("")).rlike("^https?://[^/]+"), "invalid-url").otherwise("ok")
    )


def entries(issues: DataFrame) -> DataFrame:
    """Site entries of issue bodies, with the reason of rejection."""
    df = issues.withColumn("f", text.form_fields(F.col("body")))
    at = lambda k: F.try_element_at("f", F.lit(k))
    df = df.select("*", F.lower(at("action")).alias("action"), at("name").alias("name"), at("url").alias("url"), text.first_positive(at("expected products")).alias("expected"))
    return df.withColumn("reason", reason(F.col("action"), F.col("name"), F.col("url"))).drop("f")


def wanted_urls(seen: DataFrame, dead: DataFrame, key: str = "url") -> DataFrame:
    """Candidates without dead links."""
    return seen.join(dead.select(key).distinct(), key, "left_anti")


def upserted(sites: DataFrame, changes: DataFrame) -> DataFrame:
    """Adds of absent names and edits of present ones; all else leaves the registry as it was."""
    fields = [c for c in sites.columns if c != "name"]
    adds = changes.where("action = 'add'").join(sites, "name", "left_anti").select("name", *fields)
    edits = changes.where("action = 'edit'").join(sites.select("name"), "name", "left_semi").select("name", *fields)
    return sites.join(edits, "name", "left_anti").select("name", *fields).unionByName(edits).unionByName(adds)


def with_state(state: DataFrame, update: DataFrame) -> DataFrame:
    """High-water marks (site, counter, value) that never fall."""
    return state.unionByName(update).groupBy("site", "counter").agg(F.max("value").alias("value"))
