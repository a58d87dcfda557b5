"""Removal of long repeated substrings by interval expansion on Burrows-Wheeler transforms.

Every LENGTH-byte window is dealt to a key that only its content decides: the least hash of its GRAM-byte grams.
Neighbouring windows in which one gram is the first of the least hash form a run, so equal windows always meet under
one key, in different runs, and a key that one run has holds no repeat: it is dropped before any text moves. Runs of equal
content are one class with their number as its weight, and one text stands for each.

Blocks of whole keys are decided on the Burrows-Wheeler transform of their classes: boundaries between suffixes are
derived by increasing common prefix, breadth first by backward extension, up to the least length. What no boundary below
LENGTH parts is an interval; where the weights of an interval's suffixes come to two or more, its windows repeat.

A key whose classes exceed HOT bytes (a passage that many documents share, between differing neighbours) is dealt
anew: each of its windows becomes a class of its own under the hash of its whole content, and the classes of weight two or more go
through the same transform.

Defined cases: null text is empty; texts shorter than LENGTH bytes are unchanged; a string that repeats within one document counts;
every row counts, so rows that repeat a doc_id and text repeat each other; rows of one doc_id with different texts, and rows without
doc_id, have spans of their own; an empty table gives an empty result; other columns are ignored
by `repeats` and pass through `without_repeats` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm._shared import fresh, sieve, sifted, staged, table

LENGTH = 200
GRAM = 64  # a power of two below LENGTH
BLOCK = 1 << 20
#: A key whose classes hold more bytes than this is dealt anew by window.
HOT = 1 << 21
WHERE = "array<struct<lo:int,hi:int>>"


def _constants(seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(0, 2**64, 256, dtype=np.uint64), rng.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document number, first window, windows, key, fingerprint) of the runs of documents laid end to end."""
    n = len(data)
    nothing = (np.zeros(0, np.int64),) * 5
    if n < length:
        return nothing
    letters, odd = _constants()
    with np.errstate(over="ignore"):
        h = letters[data]
        fold, s = odd[0], 1
        i = 0
        while s < gram:
            h = h[:-s] * odd[i] + h[s:]
            s, i = s * 2, i + 1
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        grams = h
        wide, w = length - gram + 1, 1
        while w * 2 <= wide:
            h = np.minimum(h[:-w], h[w:])
            w *= 2
        if wide > w:
            h = np.minimum(h[: -(wide - w)], h[wide - w :])
        valid = np.zeros(n + 1, bool)
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if b - a >= length:
                valid[a : b - length + 1] = True
        valid = valid[: len(h)]
        change = np.empty(len(h), bool)
        change[0] = True
        np.not_equal(h[1:], h[:-1], out=change[1:])
        change[1:] |= grams[: len(h) - 1] == h[:-1]  # the first gram of that hash has left the window
        change[starts[starts < len(h)]] = True
        change &= valid
        first = np.flatnonzero(change)
        if not len(first):
            return nothing
        seen = np.concatenate([[0], np.cumsum(valid)])
        size = np.diff(np.append(seen[first], seen[-1]))
        key = h[first]
        # fingerprint: a polynomial in an odd base over the run's bytes
        power = np.ones(n + 1, np.uint64)
        power[1:] = fold
        power = np.multiply.accumulate(power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[data ^ 0x5A] * power[:n], out=total[1:])
        last = first + size + length - 1
        inverse = np.full(n + 1, pow(int(fold), -1, 1 << 64), np.uint64)
        inverse[0] = 1
        mark = (total[last] - total[first]) * np.multiply.accumulate(inverse)[first]  # the same wherever the content lies
        mark ^= mark >> np.uint64(32)
        mark *= np.uint64(0xD6E8FEB86659FD93)
    doc = np.searchsorted(starts, first, "right") - 1
    return doc, first - starts[doc], size, key.view(np.int64), mark.view(np.int64)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Documents laid end to end, about BLOCK bytes at a time: (doc_id, text_hash), bytes, starts, ends."""
    ids, texts, size = [], [], 0

    def laid():
        ends = np.cumsum([len(t) for t in texts])
        return ids, np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], ends[:-1]]).astype(np.int64), ends.astype(np.int64)

    for batch in batches:
        for own, text in zip(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "replace")
            if ids and size + len(raw) > BLOCK:
                yield laid()
                ids, texts, size = [], [], 0
            ids.append(own)
            texts.append(raw)
            size += len(raw)
    if ids:
        yield laid()


def suffix_order(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of texts, each closed by an end mark of its own: their order, its inverse, the symbols (end marks
    below bytes), each position's text, its offset there and the letters it has before the end mark."""
    sizes = np.array([len(t) + 1 for t in texts])
    n, m = int(sizes.sum()), len(texts)
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    code = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    text = np.repeat(np.arange(m, dtype=np.int32), sizes)
    at = np.arange(n, dtype=np.int32)
    left = np.repeat((begins + sizes - 1).astype(np.int32), sizes) - at
    code[begins + sizes - 1] = 0
    packed = np.zeros(n, np.int64)
    for j in range(7):
        shifted = np.zeros(n, np.int64)
        shifted[: max(n - j, 0)] = code[j:]
        packed = (packed << 9) | np.where(left > j, shifted, 0)
    order = np.argsort(packed)
    head = np.concatenate([[True], packed[order[1:]] != packed[order[:-1]]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    size = np.diff(np.append(np.flatnonzero(head), n))
    tied = order[np.repeat(size, size) > 1]
    k = 7
    while len(tied):  # twice as many letters decide in each round, for suffixes not yet told apart
        second = np.where(left[tied] < k, text[tied], m + rank[np.minimum(tied + k, n - 1)])
        pair = rank[tied] * (n + m + 1) + second
        by_pair = np.argsort(pair)
        tied, pair = tied[by_pair], pair[by_pair]
        old = rank[tied]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        i = np.arange(len(tied))
        rank[tied] = old + np.maximum.accumulate(np.where(new, i, 0)) - np.maximum.accumulate(np.where(group, i, 0))
        size = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(size, size) > 1]
        k *= 2
    order[rank] = at
    return order, rank, np.where(code > 0, code + m, text), text, at - begins[text], left


def repeated_positions(texts: list[bytes], length: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of all windows of `length` bytes that start more than once in texts (a text of weight w counts w
    times), by breadth-first backward extension of suffix-order boundaries on the Burrows-Wheeler transform."""
    order, rank, symbol, text, offset, left = suffix_order(texts)
    n = len(order)
    before = symbol[order - 1]  # the transform; the first suffix takes the last end mark
    back = rank[order - 1]  # where the suffix with one more letter in front lies
    by_letter = np.argsort(before, kind="stable")
    same = before[by_letter[1:]] == before[by_letter[:-1]]
    x, y = by_letter[:-1][same].astype(np.int32), by_letter[1:][same].astype(np.int32)  # nearest with the same letter in front
    target = (back[x] + 1).astype(np.int32)  # the boundary that parts x and y once both are extended
    close = y == x + 1
    beside = np.zeros(n + 1, np.int32)  # targets of neighbours, by the boundary between them; 0 where there is none
    beside[y[close]] = target[close]
    x, y, target = x[~close], y[~close], target[~close]
    bound = np.zeros(n + 1, bool)
    first = symbol[order]
    bound[1:n] = first[1:] != first[:-1]
    bound[0] = bound[n] = True
    new = np.flatnonzero(bound)
    for _ in range(1, length):
        place = np.searchsorted(new, x, "right")
        parted = (place < len(new)) & (new[np.minimum(place, len(new) - 1)] <= y)
        found = np.concatenate([beside[new], target[parted]])
        found = found[~bound[found]]
        if not len(found):
            break
        bound[found] = True
        new = np.sort(found)
        x, y, target = x[~parted], y[~parted], target[~parted]
    interval = np.cumsum(bound[:n]) - 1
    mass = np.bincount(interval, None if weights is None else np.minimum(weights, 2)[text[order]])
    found = np.sort(order[(mass[interval] > 1) & (left[order] >= length)])
    return text[found], offset[found]


def _ranges(sorted_points: np.ndarray) -> list[dict]:
    cut = np.flatnonzero(np.diff(sorted_points) != 1) + 1
    lo = sorted_points[np.concatenate([[0], cut])] if len(sorted_points) else []
    hi = sorted_points[np.concatenate([cut - 1, [len(sorted_points) - 1]])] + 1 if len(sorted_points) else []
    return [{"lo": int(a), "hi": int(b)} for a, b in zip(lo, hi, strict=True)]


def _raw(text: pa.Scalar) -> bytes:
    return (text.as_py() or "").encode("utf-8", "replace")


ONE = ["key", "mark", "size"]  # what names a class
CLASS = "key long, mark long, size int, n long"


def _class_batch(rows: list[tuple], *more: tuple[str, pa.DataType]) -> pa.RecordBatch:
    kinds = [("key", pa.int64()), ("mark", pa.int64()), ("size", pa.int32()), ("n", pa.int64()), *more]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), kinds, strict=True)], names=[name for name, _ in kinds])


def _rows(df: DataFrame) -> DataFrame:
    """The sieve of df's texts, each told by doc_id and text_hash."""
    return sieve(df.select(F.xxhash64("doc_id", "text_hash").alias("row")), "row")


def _with_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """text and the list `wanted` of classes that one document stands for; no longer than the document."""
    wanted = classes.groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct(*ONE, "n", "at")).alias("wanted"))
    # texts that stand for no class are left where they are
    docs = sifted(docs.withColumn("row", F.xxhash64("doc_id", "text_hash")), "row", _rows(classes), "some").where("some").select("doc_id", "text_hash", "text")
    same = docs["doc_id"].eqNullSafe(wanted["doc_id"]) & (docs["text_hash"] == wanted["text_hash"])
    return docs.join(wanted, same).select("text", "wanted", wanted["doc_id"], wanted["text_hash"])


def _decided(docs: DataFrame, classes: DataFrame, length: int) -> DataFrame:
    """Classes with `spans`, the ranges of their windows that repeat. classes: key, mark, size, n (weight) and the place
    (doc_id, text_hash, at) of one text each."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for text, rows in zip(batch.column(0), batch.column(1), strict=True):
                raw = _raw(text)
                out += [(r["key"], r["mark"], r["size"], r["n"], raw[r["at"] : r["at"] + r["size"] + length - 1]) for r in rows.as_py()]
                if len(out) >= 5000:
                    yield _class_batch(out, ("raw", pa.binary()))
                    out = []
            if out:
                yield _class_batch(out, ("raw", pa.binary()))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(rows: list[tuple]) -> pa.RecordBatch:
            which, where = repeated_positions([r[4] for r in rows], length, np.array([r[3] for r in rows]))
            edge = np.searchsorted(which, np.arange(len(rows) + 1))
            return _class_batch([(*r[:4], _ranges(where[edge[i] : edge[i + 1]])) for i, r in enumerate(rows)], ("spans", pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))))

        held: dict[tuple, tuple] = {}
        weight, last = 0, None
        for batch in batches:
            for row in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                if weight >= BLOCK and row[0] != last:  # whole keys only
                    yield settled(list(held.values()))
                    held, weight = {}, 0
                last = row[0]
                if row[:3] not in held:
                    held[row[:3]] = row
                    weight += len(row[4]) + 1
        if held:
            yield settled(list(held.values()))

    texts = _with_texts(docs, classes).select("text", "wanted").mapInArrow(cut, f"{CLASS}, raw binary")
    return texts.repartition("key").sortWithinPartitions("key", "mark").mapInArrow(decide, f"{CLASS}, spans {WHERE}").where(F.size("spans") > 0)


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, text_hash (that of xxhash64) and `spans`, the sorted maximal byte ranges (lo, hi) to remove, for the texts that have any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, starts, ends in _blocks(batches):
            doc, at, size, key, mark = runs_of(data, starts, ends, length, gram)
            if len(doc):
                own = pa.array(doc)
                columns = [pa.array(key), pa.array(mark), pa.array(size.astype(np.int32)), *[pa.array([x[i] for x in ids], pa.int64()).take(own) for i in (0, 1)], pa.array(at.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=[*ONE, "doc_id", "text_hash", "at"])

    place = ["doc_id", "text_hash", "at"]
    runs = staged(docs.mapInArrow(scan, "key long, mark long, size int, doc_id long, text_hash long, at int"), "runs")
    shared = staged(runs.groupBy("key").agg(F.count("*").alias("found")).where("found > 1").select("key"), "shared-keys")
    runs = staged(runs.join(shared, "key"), "shared-runs", done=(runs, shared))
    # any row with the least hash has the same text, so doc_id and at need not be of one row
    one_of = [F.min_by(c, "text_hash").alias(c) for c in ("doc_id", "at")]
    classes = staged(runs.groupBy(*ONE).agg(F.count("*").alias("n"), F.min("text_hash").alias("text_hash"), *one_of), "classes")
    heavy = classes.groupBy("key").agg(F.sum(F.col("size").cast("long") + length).alias("bytes")).where(F.col("bytes") > hot).select("key")
    heavy = staged(heavy, "hot-keys")
    found = _decided(docs, classes.join(heavy, "key", "left_anti"), length)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        more = [("k1", pa.int64()), ("k2", pa.int64()), ("window", pa.int32()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("at", pa.int32())]
        for batch in batches:
            for text, rows, doc_id, text_hash in zip(batch.column(0), batch.column(1), *[batch.column(i).to_pylist() for i in (2, 3)], strict=True):
                raw, out = _raw(text), []
                for r in rows.as_py():
                    for i in range(r["size"]):
                        a = r["at"] + i
                        k1, k2 = np.frombuffer(hashlib.blake2b(raw[a : a + length], digest_size=16).digest(), np.int64).tolist()
                        out.append((r["key"], r["mark"], r["size"], r["n"], k1, k2, i, doc_id, text_hash, a))
                    if len(out) >= 20000:
                        yield _class_batch(out, *more)
                        out = []
                if out:
                    yield _class_batch(out, *more)

    done = [heavy]
    if heavy.head(1):
        single = staged(_with_texts(docs, classes.join(heavy, "key")).mapInArrow(windows, f"{CLASS}, k1 long, k2 long, window int, doc_id long, text_hash long, at int"), "windows")
        again = single.groupBy(F.col("k1").alias("key"), F.col("k2").alias("mark"), F.lit(1).alias("size")).agg(F.sum("n").alias("n"), F.min("text_hash").alias("text_hash"), *one_of).where("n > 1")
        twice = _decided(docs, staged(again, "window-classes"), length).select(F.col("key").alias("k1"), F.col("mark").alias("k2"))
        point = F.struct(F.col("window").alias("lo"), (F.col("window") + 1).alias("hi"))
        found = found.unionByName(single.join(twice, ["k1", "k2"]).groupBy(*ONE, "n").agg(F.array_sort(F.collect_set(point)).alias("spans")))
        done.append(single)
    found = staged(found, "repeats", done=tuple(done))
    alone = classes.join(found.where("n = 1").drop("n"), ONE).select(*place, "spans")
    copied = runs.join(found.where("n > 1").drop("n"), ONE).select(*place, "spans")
    each = alone.unionByName(copied).select(*place, F.explode("spans").alias("s"))
    each = each.select("doc_id", "text_hash", F.struct((F.col("at") + F.col("s.lo")).alias("lo"), (F.col("at") + F.col("s.hi") + length - 1).alias("hi")).alias("part"))
    parts = each.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    merged = F.aggregate(
        "parts",
        F.array().cast(WHERE),
        lambda a, p: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["hi"] >= p["lo"]), F.concat(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), F.array(F.struct(F.get(a, F.size(a) - 1)["lo"].alias("lo"), F.greatest(F.get(a, F.size(a) - 1)["hi"], p["hi"]).alias("hi"))))).otherwise(F.concat(a, F.array(p))),
    )
    return staged(parts.select("doc_id", "text_hash", merged.alias("spans")), "spans", done=(runs, classes, found))


def _spanned(docs: DataFrame, length: int, text_hash: str, spans: str) -> DataFrame:
    """docs with the columns `text_hash` and `spans` (null where nothing repeats)."""
    found = repeats(docs, length)
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    # rows where nothing repeats are not moved
    row, told = fresh(hashed, "row", "told")
    flagged = sifted(hashed.withColumn(row, F.xxhash64(F.col("doc_id").cast("long"), F.col(text_hash))), row, _rows(found), told)
    still = flagged.where(~F.col(told)).select(*hashed.columns, F.lit(None).cast(found.schema["spans"].dataType).alias(spans))
    moved = flagged.where(told).select(*hashed.columns)
    same = moved["doc_id"].cast("long").eqNullSafe(found["doc_id"]) & (moved[text_hash] == found["text_hash"])
    return still.unionByName(moved.join(found, same, "left").select(*[moved[c] for c in moved.columns], found["spans"].alias(spans)))


def _remaining(text: Column, spans: Column) -> Column:
    """text less its spans; letters of which only some bytes are covered stay whole."""
    raw = text.cast("binary")
    inside = lambda i: F.substring(raw, i + 1, F.lit(1)).between(F.lit(bytearray(b"\x80")), F.lit(bytearray(b"\xbf")))
    moved = lambda i, by: i + F.when(~inside(i), 0).when(~inside(i + by), by).when(~inside(i + 2 * by), 2 * by).otherwise(3 * by)
    starts = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: moved(s["hi"], -1)))
    ends = F.concat(F.transform(spans, lambda s: moved(s["lo"], 1)), F.array(F.octet_length(text)))
    return F.array_join(F.zip_with(starts, ends, lambda a, z: F.substring(raw, a + 1, F.greatest(z - a, F.lit(0))).cast("string")), "")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with each text less its repeated strings; n_chars, where it is a column, follows."""
    text_hash, spans = fresh(docs, "text_hash", "spans")
    df = _spanned(docs, length, text_hash, spans)
    df = df.withColumn("text", F.when(F.col(spans).isNull(), F.col("text")).otherwise(_remaining(F.col("text"), F.col(spans))))
    if "n_chars" in docs.columns:
        df = df.withColumn("n_chars", F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return df.select(*docs.columns)


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage."""
    return without_repeats(docs)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    df = _spanned(docs, LENGTH, "text_hash", "spans")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, found in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                raw = _raw(text)
                h, at, gone, spans = hashlib.sha256(), 0, 0, found.as_py() or []
                for s in spans:
                    h.update(raw[at : s["lo"]])
                    gone += s["hi"] - s["lo"]
                    at = s["hi"]
                h.update(raw[at:])
                out.append((doc_id, len(raw), gone, len(spans), h.hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return df.select("doc_id", "text", "spans").mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
