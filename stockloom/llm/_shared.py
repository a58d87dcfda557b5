"""What the corpus operators share: table reading, cutting of lineage, components of a link graph."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, where the session names no shared folder, as in tests.
LOCAL_FOLDER = "/tmp/stockloom-checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return (folder or LOCAL_FOLDER).rstrip("/")


def staged(df: DataFrame, label: str, done: tuple[DataFrame, ...] = ()) -> DataFrame:
    """df as a table in the cluster's shared folder: lineage is cut and no executor's loss can undo it. `done` are
    staged tables that nothing but df reads; they are deleted once df is written."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stockloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    dropped(*done)
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes staged tables; whatever reads them must have been staged itself."""
    for df in tables:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(df._staged_at)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for temporary columns that clash with none of df's."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Bits of a sieve: it takes at most 8 MB, whatever goes in.
SIEVE = 1 << 26


def sieve(keys: DataFrame, column: str) -> DataFrame:
    """A table of at most SIEVE / 32768 rows that tells of most hashes that they are not in keys[column] (a long), and never so of one that is."""
    bit = F.pmod(F.col(column), F.lit(SIEVE)) + 1
    return staged(keys.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")), "sieve")


def sifted(df: DataFrame, column: str, held: DataFrame, flag: str) -> DataFrame:
    """df with the boolean column `flag`: false where df[column] is in no row of the sieve `held`. Rows stay where they are."""
    bucket, bits = fresh(df, "bucket", "bits")
    bit = F.pmod(F.col(column), F.lit(SIEVE)) + 1
    at = F.bitmap_bit_position(bit)
    small = F.broadcast(held.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits)))  # at most SIEVE bits
    own = df.withColumn(flag, F.bitmap_bucket_number(bit)).join(small, F.col(flag) == F.col(bucket), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    marked = F.coalesce(byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (at % 8 + 1).cast("int"))) != 0, F.lit(False))
    return own.withColumn(flag, marked).drop(bucket, bits)


def shuffles(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over undirected edges, for each node with an edge.

    Alternating large-star and small-star steps; each keeps connectivity, and the edges end as stars
    around each component's smallest node. Rounds grow with the logarithm of a component's size. Every
    step is a minimum by node and a join, so a node with very many edges is pre-aggregated, never collected.
    """
    links = staged(
        edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "links",
    )
    before = None
    for _ in range(most_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        links = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links", done=(links,))
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
