"""Toxicity by cumulative-link ordinal regression.

Grades 0 < 1 < ... < K-1 share one weight vector over hashed binary features (the distinct words of the
lower-cased text; those of fewer than LEAST_ROWS labelled rows get no weight); P(grade > k) = sigmoid(w.x - t_k) with rising thresholds t. The expected severity is the sum of
these. Fitting takes at most SAMPLE labelled rows, the smallest by a hash of doc_id, which bounds what reaches the
driver; all documents are scored in full by one pass without a shuffle.

Grades from the labels: 0 not toxic, 1 toxic but of good quality, 2 toxic and of poor quality.

Defined cases: null text is empty (no features: the baseline); labels that are null or without a document are not
used; without labelled rows, every severity is 0; repeated rows give equal rows, and repeated labels count once; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm._shared import table

SAMPLE = 10000
#: Least labelled rows with a feature, and the strength of the L1 penalty, which goes by the root of a feature's share.
LEAST_ROWS = 10
PENALTY = 0.035
BUCKETS = 1 << 18
GRADES = 3
WORDS = re.compile(r"[^\W\d_]+")


def features(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Feature numbers of the distinct words, rising."""
    import zlib

    return np.array(sorted({zlib.crc32(w.encode("utf-8", "replace")) % buckets for w in set(WORDS.findall(text.lower()))}), np.int64)


def fit(rows: list[np.ndarray], grades: np.ndarray, n_grades: int = GRADES, buckets: int = BUCKETS, rounds: int = 500, penalty: float = PENALTY, least_rows: int = LEAST_ROWS, rate: float = 0.3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds, by full-batch adaptive proximal gradient steps on the cumulative-link likelihood with
    an L1 penalty and classes weighted to equal mass (at most tenfold)."""
    weights, thresholds = np.zeros(buckets), np.linspace(1.0, 2.0, n_grades - 1)
    if not len(rows):
        return weights, np.full(n_grades - 1, 50.0)
    index = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    sizes = np.array([len(r) for r in rows])
    owner = np.repeat(np.arange(len(rows)), sizes)
    known = np.bincount(index, minlength=buckets) >= least_rows
    index, owner = index[known[index]], owner[known[index]]
    present = np.bincount(grades, minlength=n_grades)
    mass = np.minimum(10.0, len(grades) / np.maximum(1, (present > 0).sum() * present))[grades]
    mass = mass / mass.sum()
    charge = penalty * np.sqrt(np.bincount(index, mass[owner], buckets))
    past_w, past_t = np.full(buckets, 1e-2), np.full(n_grades - 1, 1e-2)
    for _ in range(rounds):
        score = np.bincount(owner, weights[index], len(rows))
        above = 1 / (1 + np.exp(-np.clip(score[:, None] - thresholds, -35, 35)))
        upper = np.column_stack([np.ones(len(rows)), above])[np.arange(len(rows)), grades]
        lower = np.column_stack([above, np.zeros(len(rows))])[np.arange(len(rows)), grades]
        inside = np.maximum(upper - lower, 1e-9)
        slope = (upper * (1 - upper) - lower * (1 - lower)) / inside * mass
        g_w = np.bincount(index, (-slope)[owner], buckets)
        g_t = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            to = (grades == k + 1) * (upper * (1 - upper) / inside) - (grades == k) * (lower * (1 - lower) / inside)
            g_t[k] = (to * mass).sum()
        past_w += g_w * g_w
        past_t += g_t * g_t
        step = rate / np.sqrt(past_w)
        moved = weights - step * g_w
        weights = np.where(known, np.sign(moved) * np.maximum(np.abs(moved) - step * charge, 0), 0)
        thresholds = np.sort(thresholds - rate * 0.2 * g_t / np.sqrt(past_t))
        thresholds += np.arange(n_grades - 1) * 1e-6
    return weights, thresholds


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, text) of at most `sample` labelled documents; of rows that share a doc_id, the least text counts."""
    grade = F.when(F.col("toxic") == 0, 0).when((F.col("toxic") == 1) & (F.col("quality") == 1), 1).when(F.col("toxic") == 1, 2)
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), grade.alias("grade")).where("grade IS NOT NULL AND doc_id IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(sample)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen.distinct()), "doc_id")  # at most `sample` rows of two numbers
    return found.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t or "").astype(np.int32).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary())], names=["doc_id", "grade", "features"])

    rows = labelled(docs, labels, sample).mapInArrow(run, "doc_id long, grade int, features binary").toPandas()
    rows = rows.sort_values(["doc_id", "grade"])
    return fit([np.frombuffer(b, np.int32).astype(np.int64) for b in rows["features"]], rows["grade"].to_numpy(np.int64))


def scored(docs: DataFrame, weights: np.ndarray, thresholds: np.ndarray) -> DataFrame:
    """doc_id, severity (expected grade) and grade (the likeliest at most the median, that is, the number of P(grade > k) of a half or more)."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast((weights.astype(np.float32), thresholds))  # of a fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, t = model.value
        for batch in batches:
            out = np.zeros((batch.num_rows, len(t)))
            for i, text in enumerate(batch.column(1)):
                x = features(text.as_py() or "", len(w))
                score = float(w[x].sum(dtype=np.float64))
                out[i] = 1 / (1 + np.exp(-np.clip(score - t, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.sum(1)), pa.array((out >= 0.5).sum(1).astype(np.int32))], names=["doc_id", "severity", "grade"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, severity double, grade int")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    df = scored(docs, *trained(docs, table(spark, sf_dir, "labels")))
    return df.select("doc_id", "severity", "grade", (F.col("grade") >= 1).alias("toxic"))
