"""Vector best-fit packing of token sequences.

Every piece demands (tokens, one document, attention cost = tokens squared) of a bin with a capacity for each.
Pieces of one length demand the same, so packing is planned over the histogram of lengths, at most one row a
length, and bins of equal residuals are handled together with their number. Lengths go in descending order;
among the bin kinds with room under every constraint the one is taken that leaves the smallest weighted
residual norm (or has the largest weighted dot product with the demand), and each such bin takes as many pieces
of that length as fit. The plan's size depends on the number of lengths, not on that of documents; each piece
finds its place by its rank within its length. Ranks are counted in salted groups, so that a length shared by
very many documents is dealt over all tasks.

Defined cases: null text is empty (its end id alone); a text is never truncated; pieces longer than a bin
are cut, the first one being the shorter; rows that repeat a doc_id are packed each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.llm._shared import shuffles, staged, table

TOKENS = 1024
END_ID = 2


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def byte_encoder(vocabulary: str):
    """Text -> ids of the byte-level vocabulary; the end-of-text string in a text is its special id, as the
    tokenizers library has it by default."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = "<|endoftext|>"
    encoding = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: len(ranks)})
    return lambda text: encoding.encode(text, allowed_special="all") if special in text else encoding.encode_ordinary(text)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, most: int = TOKENS, end_id: int = END_ID, vocabulary: str | None = None) -> DataFrame:
    """The pieces of every document with the checksum of their ids."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encode = byte_encoder(path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                n = len(ids)
                first = n - (n - 1) // most * most
                cuts = [0, *range(first, n + 1, most)]
                for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, value in zip(out, (doc_id, i, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES)


def plan(
    histogram: dict[int, int], tokens: int = TOKENS, documents: int | None = None, attention: int | None = None,
    weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm",
) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, low, high, each, first, offset): the pieces of that length with ranks from low to
    below high lie `each` to a bin, in bins from `first` on, the first in a bin at `offset`."""
    capacity = (tokens, documents or tokens, attention or tokens * tokens)
    scale = [w / c for w, c in zip(weights, capacity, strict=True)]
    kinds: dict[tuple[int, int, int], list[tuple[int, int]]] = {}  # residuals -> ranges of bins (first, number)
    out, bins = [], 0
    for length in sorted((x for x, n in histogram.items() if n), reverse=True):
        demand = (length, 1, length * length)
        if any(d > c for d, c in zip(demand, capacity, strict=True)):
            raise ValueError(f"a piece of {length} tokens fits no bin")
        left, low = histogram[length], 0
        while left:
            best, kind = None, None
            for residual in kinds:
                each = min(r // d for r, d in zip(residual, demand, strict=True))
                if each < 1:
                    continue
                if rule == "dot":
                    score = -sum(s * s * r * d for s, r, d in zip(scale, residual, demand, strict=True))
                else:
                    score = sum((s * (r - d)) ** 2 for s, r, d in zip(scale, residual, demand, strict=True))
                if best is None or (score, residual) < best:
                    best, kind = (score, residual), residual
            if kind is None:
                kind = capacity
                each = min(r // d for r, d in zip(kind, demand, strict=True))
                need = -(-left // each)
                kinds.setdefault(kind, []).append((bins, need))
                bins += need
            each = min(r // d for r, d in zip(kind, demand, strict=True))
            first, number = kinds[kind].pop()
            if not kinds[kind]:
                del kinds[kind]
            for per in dict.fromkeys((each, left % each)):  # whole bins, then at most one with the rest
                used = min(number, left // per) if per else 0
                if per != each:
                    used = min(used, 1)
                if used:
                    out.append((length, low, low + used * per, per, first, tokens - kind[0]))
                    kinds.setdefault(tuple(r - per * d for r, d in zip(kind, demand, strict=True)), []).append((first, used))
                    first, number, low, left = first + used, number - used, low + used * per, left - used * per
                if per == each and left >= each:
                    break
            if number:
                kinds.setdefault(kind, []).append((first, number))
    return out


def packed(cut: DataFrame, **limits) -> DataFrame:
    """cut (doc_id, piece, start, length, ...) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = staged(cut, "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most one row a length
    segments = plan(histogram, **limits)
    fields = "array<struct<low:long,high:long,each:long,first:long,offset:long>>"
    by_length: dict[int, list] = {}
    for length, *rest in segments:
        by_length.setdefault(length, []).append(tuple(rest))
    places = spark.createDataFrame(list(by_length.items()), f"length long, segments {fields}")
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(max(16, shuffles(spark)))))
    sizes = salted.groupBy("length", "_salt").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("length", "_salt", before.alias("_before"))
    local = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_local", local).join(sizes, ["length", "_salt"]).withColumn("_rank", F.col("_before") + F.col("_local"))
    found = ranked.join(places, "length").withColumn("_at", F.get(F.filter("segments", lambda s: (s["low"] <= F.col("_rank")) & (F.col("_rank") < s["high"])), F.lit(0)))
    step = F.col("_rank") - F.col("_at.low")
    return found.select(
        *cut.columns,
        (F.col("_at.first") + F.floor(step / F.col("_at.each"))).cast("long").alias("sequence_id"),
        (F.col("_at.offset") + step % F.col("_at.each") * F.col("length")).cast("long").alias("offset"),
    )


def pack(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: where each piece of each document lies."""
    return packed(pieces(docs))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents")))
