"""Secret scans with corpus-wide ownership frequency.

Three base kinds are found by pattern in every whole text. Besides, long mixed tokens are candidates: the
hashes of all candidate values are counted over the corpus by distinct repositories and owners. A value that
EXAMPLE_OWNERS owners share, or that stands in EXAMPLE_REPOSITORIES repositories, is a copied example; a mixed token of
fewer looks live and becomes a span of its own (kind `token`) unless a base span overlaps it. Only DataFrame functions are used.

Counting goes by (value, owner, repository) first, so a value copied everywhere is combined before the
shuffle, and what is joined back has one row a value.

Defined cases: null text is empty (no spans, the digest of the empty string); null owner or repository
counts as one more owner or repository; verdicts go by value, so rows that repeat a doc_id, or have none, are told each by its own text; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm._shared import staged, table

KINDS = ("assign", "access", "hex", "token")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}+"
HEX = r"[0-9a-f]{24,}+"
TOKEN = r"[A-Za-z0-9+/_-]{28,}+"
#: From so many distinct owners a value counts as a copied example.
EXAMPLE_OWNERS = 3
#: And from so many distinct repositories, whoever owns them.
EXAMPLE_REPOSITORIES = 8


def _found(text: Column, pattern: str, group: int = 0) -> Column:
    """start, end (code points, end exclusive) and value of the leftmost non-overlapping matches."""
    lengths = lambda a: F.transform(a, lambda x: F.length(x))
    whole, value = (F.regexp_extract_all(text, F.lit(pattern), F.lit(g)) for g in (0, group))
    gaps = F.split(text, pattern, -1)
    placed = F.aggregate(
        F.arrays_zip(lengths(gaps).alias("gap"), lengths(whole).alias("n"), value.alias("value")),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out")),
        lambda a, x: F.struct(
            (a["at"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
            F.when(x["n"].isNull(), a["out"])
            .otherwise(
                F.concat(a["out"], F.array(F.struct((a["at"] + x["gap"]).alias("start"), (a["at"] + x["gap"] + x["n"]).alias("end"), x["value"].alias("value"))))
            )
            .alias("out"),
        ),
    )["out"]
    return F.when(text.rlike(pattern), placed).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>"))


def _listed(spans: Column) -> Column:
    """kind:start:end by start, then kind."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def _of_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))


def candidates(docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang")) -> DataFrame:
    """Per document: base spans, further candidate tokens, owner and repository keys."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = lambda *cols: F.xxhash64(*[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in cols])
    df = docs.select(
        "doc_id",
        key(owner).alias("owner"),
        key(*repository).alias("repository"),
        F.filter(_found(text, ASSIGN, 2), lambda s: F.length(s["value"]) >= 6).alias("assign"),
        F.filter(_found(text, ACCESS), lambda s: F.length(s["value"]) >= 20).alias("access"),
        _found(text, HEX).alias("hex"),
        _found(text, TOKEN).alias("token"),
    )
    base = F.concat(*[_of_kind(F.col(k), i) for i, k in enumerate(KINDS[:3])])
    df = df.select("doc_id", "owner", "repository", base.alias("base"), "token")
    mixed = lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 10)
    free = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return df.withColumn("token", _of_kind(F.filter("token", lambda s: mixed(s) & free(s)), 3))


def ownership(found: DataFrame) -> DataFrame:
    """Per hash of a candidate value: its distinct owners and repositories, and its occurrences."""
    each = found.select("owner", "repository", F.explode(F.concat("base", "token")).alias("s"))
    each = each.groupBy(F.sha2(F.col("s.value"), 256).alias("value"), "owner", "repository").agg(F.count("*").alias("n"))
    by_owner = each.groupBy("value", "owner").agg(F.count("*").alias("r"), F.sum("n").alias("n"))
    return by_owner.groupBy("value").agg(F.count("*").alias("n_owners"), F.sum("r").alias("n_repositories"), F.sum("n").alias("n_found"))


def scan(docs: DataFrame, example_owners: int = EXAMPLE_OWNERS, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), example_repositories: int = EXAMPLE_REPOSITORIES) -> DataFrame:
    """doc_id, base (array of spans), added (array of spans), n_live and n_examples (occurrences by verdict)."""
    found = staged(candidates(docs, owner, repository).withColumn("row", F.monotonically_increasing_id()), "secrets")
    example = (F.col("n_owners") >= example_owners) | (F.col("n_repositories") >= example_repositories)
    shared = staged(ownership(found).where(example).select("value"), "secret-examples")
    each = found.select("row", F.explode(F.concat("base", "token")).alias("s"))
    each = each.withColumn("value", F.sha2(F.col("s.value"), 256)).join(shared.withColumn("example", F.lit(True)), "value", "left")
    live = F.col("example").isNull()
    per = each.groupBy("row").agg(
        F.count_if(live).alias("n_live"),
        F.count_if(~live).alias("n_examples"),
        F.collect_list(F.when(live & (F.col("s.kind") == 3), F.col("s"))).alias("added"),
    )
    none = F.array().cast(found.schema["token"].dataType)
    zero = F.lit(0).cast("long")
    return found.select("row", "doc_id", "base").join(per, "row", "left").select(
        "doc_id", "base", F.coalesce("added", none).alias("added"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_examples", zero).alias("n_examples")
    )


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    number = [of(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])]
    return df.select(
        "doc_id", *number, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.concat("base", "added")).alias("spans"), "n_live", "n_examples"
    )
