"""Quality rules: robust multivariate outliers among documents of one language and source.

Each document's counts become four quantised statistics. Every (lang, source) gets a minimum-covariance-determinant
estimate: from several starts (medians and median deviations, mean and covariance of all rows, and those of subsets by hash),
concentration steps are made, in which the h rows nearest by Mahalanobis distance give the next mean and covariance, until no
start's determinant falls any more; the start with the least determinant wins, and the rows that it finds close give the
reweighted estimate that judges the group. Covariances hold a floor in each dimension, so a determinant is never 0.
Only DataFrame functions are used.

The h-subset is cut on a fine logarithmic grid of distances, with the share of the last cell that makes up h, so one pass that sums counts and moments by
(lang, source, start, grid cell) is a whole step: it is combined before the shuffle, has a bounded number of rows
for a group of any size, and, as the statistics are integers, gives the same sums in any order. Medians come from histograms
of the same kind. So no group's rows ever meet in one task.

A group with fewer than `least_group` documents that pass the base rules is too small for an estimate of its
own: it is judged by the estimate over all documents of its language, or, where these are too few as well, by
that over all documents, however many there are. No group goes without a verdict.

Defined cases: null text counts as no text (no words, base_failed); null lang or source is a group of its
own; repeated rows are repeated in the result; rows of one doc_id, or without one, are judged each by its own text; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.llm._shared import fresh, staged, table

SPACE = r"[\x20\x09-\x0D]+"
#: Production parameters: share of rows in the subset, its consistency factor for four dimensions, starts, most steps, the fall of a
#: determinant's logarithm that counts, the squared distance within which rows enter the reweighted estimate (0.975 of
#: chi-squared with four degrees) and its factor, cells of the grid for each e-fold of 1 + d2, the squared distance from which a
#: document is an outlier, the least rows for an estimate of a group's own, and the least standard deviations (in thousandths).
SUBSET = 0.75
CONSISTENCY = 1.485
STARTS = 5
MOST_STEPS = 30
SETTLED = 1e-3
INSIDE = 11.143
REWEIGHTED = 1.096
GRID = 200
CUTOFF = 38.0
LEAST_GROUP = 30
FLOORS = (120, 700, 500, 120)
DIMS = ("x1", "x2", "x3", "x4")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(docs: DataFrame, keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """keep, and the base counts of every whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select(*keep, text.alias("_t"), F.filter(F.split(text, SPACE), lambda w: w != "").alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: F.length(F.translate(x, " \t\x0b\x0c\r", "")) > 0)
    n = F.size("_w")
    windows = F.when(
        n >= 3,
        F.transform(
            F.slice("_w", 1, F.greatest(n - 2, F.lit(0))),
            lambda w, i: F.xxhash64(w, F.get("_w", i + 1), F.get("_w", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        lines.alias("_l"),
        windows.alias("_h"),
    )
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")).drop("_l")
    df = df.withColumn(
        "_s",
        F.when(
            F.size(F.array_distinct("_h")) < F.size("_h"),
            F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        ),
    ).drop("_h")
    same = lambda e, k: (F.get("_s", k - 1)["h"] == e["h"]) | (F.get("_s", k + 1)["h"] == e["h"])
    df = df.withColumn(
        "_p", F.array_sort(F.transform(F.filter("_s", lambda e, k: F.coalesce(same(e, k), F.lit(False))), lambda e: e["i"]))
    ).drop("_s")
    covered = F.aggregate(
        "_p",
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")),
    )["n"]
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def _statistics() -> list[Column]:
    ratio = lambda c, scale, of: F.try_divide(F.lit(float(scale)) * F.col(c), F.col(of))
    return [
        F.round(1000 * F.log(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double")))).cast("long").alias("x1"),
        F.round(1000 * F.log(1 + ratio("n_symbols", 1000, "word_chars"))).cast("long").alias("x2"),
        F.round(1000 * F.log(1 + ratio("n_dup_lines", 1000, "n_words"))).cast("long").alias("x3"),
        F.round(ratio("n_repeat_words", 1000, "n_words")).cast("long").alias("x4"),
    ]


GROUP = ["_lang", "_source"]
EACH = [*GROUP, "_start"]
PAIRS = [(x, y) for i, x in enumerate(DIMS) for y in DIMS[i:]]
MOMENTS = [f"s_{x}" for x in DIMS] + [f"s_{x}{y}" for x, y in PAIRS]


def _moments() -> list[Column]:
    sums = [F.sum(F.col(x).cast("decimal(38,0)")).alias(f"s_{x}") for x in DIMS]
    return [F.count("*").cast("double").alias("n"), *sums, *[F.sum((F.col(x) * F.col(y)).cast("decimal(38,0)")).alias(f"s_{x}{y}") for x, y in PAIRS]]


def _factored(df: DataFrame, consistency: float) -> DataFrame:
    """From moments: mean, Cholesky factor of the covariance and, as logdet, the logarithm of its determinant."""
    keys = [c for c in EACH if c in df.columns]
    df = df.select(*keys, "n", *[F.col(c).cast("double").alias(c) for c in MOMENTS])
    df = df.select("*", *[(F.col(f"s_{x}") / F.col("n")).alias(f"m_{x}") for x in DIMS])
    cov = {}
    for i, x in enumerate(DIMS):
        for j in range(i, len(DIMS)):
            y = DIMS[j]
            c = (F.col(f"s_{x}{y}") / F.col("n") - F.col(f"m_{x}") * F.col(f"m_{y}")) * consistency
            cov[j, i] = F.greatest(c, F.lit(0.0)) + float(FLOORS[i] ** 2) if i == j else c
    for i in range(len(DIMS)):
        for j in range(i + 1):
            c = cov[i, j]
            for k in range(j):
                c = c - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(c, F.lit(1.0))) if i == j else c / F.col(f"l{j}{j}"))
    det = sum((2 * F.log(f"l{i}{i}") for i in range(1, len(DIMS))), 2 * F.log("l00"))
    return df.select(*keys, *[f"m_{x}" for x in DIMS], *[f"l{i}{j}" for i in range(4) for j in range(i + 1)], det.alias("logdet"))


def _distance(df: DataFrame) -> DataFrame:
    """df, joined with an estimate, with its squared Mahalanobis distance d2."""
    for i, x in enumerate(DIMS):
        z = F.col(x) - F.col(f"m_{x}")
        for j in range(i):
            z = z - F.col(f"l{i}{j}") * F.col(f"z{j}")
        df = df.withColumn(f"z{i}", z / F.col(f"l{i}{i}"))
    return df.withColumn("d2", sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, 4)), F.col("z0") * F.col("z0")))


def _concentrated(sound: DataFrame, estimate: DataFrame, subset: float) -> DataFrame:
    """One concentration step of every start of every group: the moments of the h rows nearest by the estimate. Rows are
    summed by cells of a fine grid of distances; of the cell in which the h-th row lies the share counts that makes up h."""
    near = _distance(sound.join(estimate, GROUP))
    cells = near.groupBy(*EACH, F.floor(GRID * F.log1p("d2")).alias("cell")).agg(*_moments())
    w = Window.partitionBy(*EACH)
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    cells = cells.withColumn("share", F.least(F.lit(1.0), (F.ceil(F.sum("n").over(w) * subset) - F.col("before")) / F.col("n"))).where("share > 0")
    part = lambda c: F.when(F.col("share") == 1, F.col(c)).otherwise(F.round(F.col(c).cast("double") * F.col("share")).cast("decimal(38,0)"))
    # whole numbers, so that sums in any order are equal
    return cells.groupBy(*EACH).agg(F.sum(F.round(F.col("n") * F.col("share"))).alias("n"), *[F.sum(part(c)).alias(c) for c in MOMENTS])


def _medians(df: DataFrame, value: Column) -> DataFrame:
    """By group and dim: the least value that at least half the rows do not exceed, from a histogram of whole numbers."""
    counts = df.groupBy(*GROUP, "dim", value.cast("long").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*GROUP, "dim")
    counts = counts.withColumn("upto", F.sum("n").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return counts.where("2 * upto >= all").groupBy(*GROUP, "dim").agg(F.min("v").alias("v"))


def _starts(sound: DataFrame) -> DataFrame:
    """The estimates from which concentration starts: medians and median deviations; mean and covariance of all rows; and
    those of STARTS - 2 subsets by hash."""
    long = sound.select(*GROUP, F.explode(F.map_from_arrays(F.array(*[F.lit(x) for x in DIMS]), F.array(*DIMS))).alias("dim", "x"))
    middle = staged(_medians(long, F.col("x")).withColumnRenamed("v", "m"), "quality-middle")
    spread = _medians(long.join(middle, [*GROUP, "dim"]), F.abs(F.col("x") - F.col("m"))).join(middle, [*GROUP, "dim"])
    of = lambda x, c: F.max(F.when(F.col("dim") == x, F.col(c).cast("double")))
    robust = spread.groupBy(*GROUP).agg(
        *[of(x, "m").alias(f"m_{x}") for x in DIMS], *[F.greatest(1.4826 * of(x, "v"), F.lit(float(f))).alias(f"l{i}{i}") for i, (x, f) in enumerate(zip(DIMS, FLOORS, strict=True))]
    )
    zero = [F.lit(0.0).alias(f"l{i}{j}") for i in range(4) for j in range(i)]
    robust = robust.select("*", *zero, F.lit(0).alias("_start"), F.lit(float("inf")).alias("logdet"))
    member = F.pmod(F.xxhash64(F.lit(7), *DIMS), F.lit(STARTS - 2)).cast("int") + 2
    drawn = sound.select(*GROUP, *DIMS, F.explode(F.array(F.lit(1), member)).alias("_start")).groupBy(*EACH).agg(*_moments())
    return robust.unionByName(_factored(drawn, 1.0))


def _levels(sound: DataFrame, least_group: int) -> DataFrame:
    """By (_lang, _source): `by`, the key of the estimate that judges the group, and `enters`, the keys of those its rows are part of.

    A key is the group itself, (_lang, "*") or ("*", "*"); wider ones are made only where a small group needs them."""
    groups = staged(sound.groupBy(*GROUP).agg(F.count("*").alias("n")), "quality-groups")
    own = F.col("n") >= least_group
    langs = groups.groupBy("_lang").agg((F.sum("n") >= least_group).alias("enough"), F.max(~own).alias("wanted"))
    top = langs.agg(F.max(F.col("wanted") & ~F.col("enough")).alias("all_wanted"))
    key = lambda a, b: F.struct(a.alias("_lang"), b.alias("_source"))
    group, lang, every = key(F.col("_lang"), F.col("_source")), key(F.col("_lang"), F.lit("*")), key(F.lit("*"), F.lit("*"))
    enters = F.array_compact(F.array(F.when(own, group), F.when(F.col("wanted") & F.col("enough"), lang), F.when(F.col("all_wanted"), every)))
    df = groups.join(langs, "_lang").crossJoin(top)
    return staged(df.select(*GROUP, F.when(own, group).when(F.col("enough"), lang).otherwise(every).alias("by"), enters.alias("enters")), "quality-levels", done=(groups,))


def estimated(sound: DataFrame, subset: float = SUBSET, most_steps: int = MOST_STEPS) -> DataFrame:
    """By group of `sound`: mean and Cholesky factor of the reweighted minimum-covariance-determinant estimate."""
    estimate = staged(_starts(sound), "quality-start")
    for _ in range(most_steps):
        step = _factored(_concentrated(sound, estimate, subset), CONSISTENCY)
        before = estimate.select(*EACH, F.col("logdet").alias("before"))
        after = staged(step.join(before, EACH), "quality-step", done=(estimate,))
        moving = after.where(f"before - logdet > {SETTLED}").head(1)
        estimate = after.drop("before")
        estimate._staged_at = after._staged_at
        if not moving:
            break
    best = estimate.groupBy(*GROUP).agg(F.min_by("_start", F.struct("logdet", "_start")).alias("_start"))
    best = staged(estimate.join(best, EACH).drop("logdet"), "quality-best", done=(estimate,))
    inside = _distance(sound.join(best.drop("_start"), GROUP)).where(F.col("d2") <= INSIDE).groupBy(*GROUP).agg(*_moments())
    final = _factored(inside, REWEIGHTED).drop("logdet")
    return staged(final, "quality-estimate", done=(best,))


def judged(docs: DataFrame, cutoff: float = CUTOFF, subset: float = SUBSET, most_steps: int = MOST_STEPS, least_group: int = LEAST_GROUP, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, the base counts, base_failed, distance2 (null where base_failed) and kept."""
    group = [F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-")).alias(f"_{c}") for c in ("lang", "source")]
    names = [f"_k{i}" for i in range(len(keep))]
    docs = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names, strict=True)], "text", *[F.col(c).cast("string").alias(c) for c in ("lang", "source")])
    df = counts(docs, (*names, "lang", "source")).select(*names, *group, *COUNTS, *_statistics())
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    df = staged(df.withColumn("base_failed", base), "quality")
    sound = df.where("NOT base_failed").select(*GROUP, *DIMS)
    levels = _levels(sound, least_group)
    sound = staged(sound.join(levels, GROUP).select(F.explode("enters").alias("k"), *DIMS).select("k.*", *DIMS), "quality-sound")
    by = levels.select(*GROUP, *[F.col(f"by.{c}").alias(f"by{c}") for c in GROUP])
    judges = estimated(sound, subset, most_steps).withColumnsRenamed({"_lang": "by_lang", "_source": "by_source"})
    out = _distance(df.join(by, GROUP, "left").join(judges, ["by_lang", "by_source"], "left"))
    out = out.withColumn("distance2", F.when(~F.col("base_failed"), F.col("d2")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *COUNTS, "base_failed", kept.alias("kept"), "distance2")


def keep_sound(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: docs without the rejected documents. Rows are told apart by doc_id, text, lang and source, so that rows
    which share a doc_id, or have none, are judged each by itself."""
    (row,) = fresh(docs, "row")
    keyed = docs.withColumn(row, F.xxhash64(F.lit(3), "text", F.col("lang").cast("string"), F.col("source").cast("string")))
    rejected = judged(keyed, keep=("doc_id", row)).where("NOT kept").select(F.col("doc_id").alias("_id"), F.col(row).alias("_row")).distinct()
    same = keyed["doc_id"].eqNullSafe(rejected["_id"]) & (keyed[row] == rejected["_row"])
    return keyed.join(rejected, same, "left_anti").select(*[keyed[c] for c in docs.columns])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).drop("distance2")
