"""Layered breadth-first walk of a link graph."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stockloom.functions import urls
from stockloom.sources import html_pages


def _cut(df: DataFrame) -> DataFrame:
    """Lineage is cut in the shared folder if there is one; executors may be lost between layers."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or "/tmp/stockloom-checkpoints")
    return df.checkpoint()


def _within(new: DataFrame, visited: DataFrame, max_pages: int, group: str) -> DataFrame:
    """The first of new, by name, for which each group has room."""
    room = visited.groupBy(group).agg((F.lit(max_pages) - F.count("*")).alias("_room"))
    place = F.row_number().over(Window.partitionBy(group).orderBy("node"))
    return new.join(room, group).withColumn("_r", place).where("_r <= _room")


def layers(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_pages: int | None = 3000, group: str = "site") -> DataFrame:
    """(group, node, depth) of all that is reached from seeds (group, node) over edges (group, src, dst). All groups walk at once; within
    a layer nodes go by name until the group's page cap is full; None is no cap."""
    visited = _cut(seeds.select(group, "node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        new = frontier.join(edges, (frontier[group] == edges[group]) & (frontier["node"] == edges["src"])).select(frontier[group], F.col("dst").alias("node")).distinct()
        new = new.join(visited.select(group, "node"), [group, "node"], "left_anti")
        if max_pages is not None:
            new = _within(new, visited, max_pages, group)
        frontier = _cut(new.select(group, "node", F.lit(depth).alias("depth")))
        if frontier.isEmpty():
            break
        visited = _cut(visited.unionByName(frontier))
    return visited


def discover(sites: DataFrame, pages: DataFrame, max_depth: int = 3, max_pages: int | None = 3000) -> DataFrame:
    """(site, url, kind) of a crawl over stored pages, all sites at once; kind is visited, product or category.

    sites: site, root (URL). pages: url (normal), final_url, ok, status, html. A layer leaves out what is visited, off the
    root's host or skipped; a failed, empty or missing page (or 404) is dead and no candidate, nor is its final URL. A
    second-platform page that parses as a product is a product, any other whose slug page links to two slugs or more a category; links
    are candidates by their form. If layer 0 of a site finds no candidate, its usual entry points join layer 1."""
    roots = _cut(sites.select("site", urls.normalize(F.col("root")).alias("root")))
    frontier = roots.select("site", F.col("root").alias("node"))
    visited = found = dead = None
    for depth in range(max_depth + 1):
        df = frontier.join(roots, "site").where(urls.same_host(F.col("node"), F.col("root")) & (urls.skip_reason(F.col("node")) == "ok")).select("site", "node").distinct()
        if visited is not None:
            df = df.join(visited, ["site", "node"], "left_anti")
            if max_pages is not None:
                df = _within(df, visited, max_pages, "site").select("site", "node")
        df = _cut(df)
        if df.isEmpty():
            break
        visited = df if visited is None else _cut(visited.unionByName(df))
        got = df.join(pages.withColumnRenamed("url", "node"), "node", "left")
        good = F.coalesce(F.col("ok") & (F.coalesce("html", F.lit("")) != "") & ~F.coalesce(F.col("status") == 404, F.lit(False)), F.lit(False))
        got = got.withColumn("good", good)
        lost = got.where("NOT good AND ok IS NOT NULL").select("site", F.explode(F.array_compact(F.array("node", F.nullif("final_url", F.lit(""))))).alias("url"))
        dead = _cut(lost if dead is None else dead.unionByName(lost))
        read = got.where("good").withColumn("s", html_pages.signals(F.col("html")))
        at = F.coalesce(F.nullif("final_url", F.lit("")), F.col("node"))
        read = read.select("site", at.alias("at"), urls.normalize(urls.without_language(at)).alias("fetched"), html_pages.decide_b(at, F.col("s"), F.col("html"))["is_product"].alias("is_product"), html_pages.crawl_links(at, F.col("s")).alias("links"))
        read = _cut(read)
        each = read.select("site", "fetched", F.explode(F.array_distinct(F.transform("links", lambda u: urls.normalize(u)))).alias("link")).join(roots, "site")
        each = _cut(each.where(urls.same_host(F.col("link"), F.col("root")) & (urls.skip_reason(F.col("link")) == "ok")).select("site", "fetched", "link"))
        like = F.contains(F.lower("fetched"), F.lit("/cart/")) | F.contains(F.lower("fetched"), F.lit("cmd=cart"))
        as_page = read.where(F.col("is_product") & like).select("site", F.col("fetched").alias("url"), F.lit("product").alias("kind"))
        slugs = each.groupBy("site", "fetched").agg(F.count_distinct(urls.cart_slug(F.col("link"))).alias("n")).where("n >= 2")
        shelf = read.where(~(F.col("is_product") & like)).select("site", "fetched").join(slugs, ["site", "fetched"]).select("site", urls.cart_slug(F.col("fetched")).alias("url"), F.lit("category").alias("kind")).where("url IS NOT NULL")
        by_form = [each.where(test(F.col("link"))).select("site", F.col("link").alias("url"), F.lit(kind).alias("kind")) for kind, test in (("product", urls.is_product_candidate), ("category", urls.is_category_candidate))]
        new = as_page.unionByName(shelf).unionByName(by_form[0]).unionByName(by_form[1]).distinct()
        found = _cut(new if found is None else found.unionByName(new).distinct())
        frontier = each.select("site", F.col("link").alias("node"))
        if depth == 0:
            barren = roots.join(found.select("site").distinct(), "site", "left_anti")
            frontier = frontier.unionByName(barren.select("site", F.explode(urls.seeds(F.col("root"))).alias("node")))
        frontier = _cut(frontier.distinct())
    if visited is None:
        return sites.sparkSession.createDataFrame([], "site string, url string, kind string")
    alive = found.join(dead, ["site", "url"], "left_anti")
    return visited.select("site", F.col("node").alias("url"), F.lit("visited").alias("kind")).unionByName(alive)
