"""Exact n-gram Jaccard join in a metric space.

A document's set holds its distinct word shingles. Linked are sets whose Jaccard distance is at most 1 - threshold.
Equal sets are one node throughout.

Pivots: unrelated documents all lie at distance 1 from each other, so no document can serve as a pivot for all. Each
document therefore first looks for pivots among those documents that it can be near to: of all nodes that share one of a
document's first shingles (in an order of all shingles, those last that a sample shows to be common, those of rare words first, as many as
the threshold requires, so that two linked documents always share one), the least by hash is a pivot. The region of a pivot holds all nodes that
found it; linked nodes always meet in one, and overlapping neighbourhoods elect the same pivot, so regions stay few.

Windows: within a region, two nodes stay together only if they are near enough by two lower bounds of the distance: that of
the sizes (the difference of the distances to the empty set) and that of the counts of shingles over cells of the shingle space.
A region of more than GROUP nodes is cut into bands of sizes first, of which a node visits two, and a band of more into blocks, each pair of which is
looked at by itself; no region is a cluster as a whole. What such pairs of all regions connect is a cluster; a node is in one only, so its whole set moves once, however many regions it is in.

Recursion: a cluster's nodes then meet with their whole sets. Voronoi cells form around PIVOTS pivot documents, chosen
each as far as can be from those before; a node at distance d from its own pivot also visits the cells of all pivots
within d + 2 (1 - threshold), which the triangle inequality shows to be enough; cells are divided again with pivots
of their own until they are small or no longer shrink. Nodes within the threshold of a pivot are one component, and what one component holds is
never compared within itself. Only edges that join components leave a cluster, fewer than it has nodes.

A cluster (a region, below) with more shingles than LIMIT is cut into slices that carry the same pivots. Each slice is joined by itself and yields
every node's distances to the pivots; then the nodes outside the region's largest component visit those parts of the Voronoi cells that the windows around all pivots leave open.
So no task holds more than about LIMIT shingles of a region, whatever its size.

Defined cases: null or wordless texts have an empty set (n_shingles 0) and are linked with nothing: component_id is their own doc_id;
rows that repeat a doc_id with the same text give equal rows; rows of one doc_id with different texts are documents of their own that share the id; rows
without doc_id take part, and their component_id is null if no document of their component has an id; an empty table gives an empty
result; other columns are ignored by `classes` and pass through `keep_one`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stockloom.llm._shared import components, fresh, sieve, sifted, staged, table

BUCKETS = 1 << 18  # of the word frequency table
#: Distinct texts, about, among which common shingles are looked for, and the most shingles so found.
SAMPLE = 8192
COMMON = 1 << 16
#: Cells of a set's counts, by its size: few for small sets, more above each bound.
CELLS = ((512, 64), (4096, 256), (1 << 62, 1024))
BLOCK = 1 << 20
#: Regions of more nodes than this are cut by sizes, and what is still larger by blocks of about so many nodes, before the windows.
GROUP = 4096
#: Shingles of a region that one task holds, about.
LIMIT = 1 << 21
#: Pivot documents of a division, and the number of nodes below which none is made.
PIVOTS = 8
SMALL = 128


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x7FB5D329728EA185)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of texts, A-Z in lower case, and the index of each text's first word (with a last one)."""
    rng = np.random.default_rng(11)
    letters = rng.integers(0, 2**64, 256, dtype=np.uint64)
    base = int(rng.integers(0, 2**63)) * 2 + 1
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8).copy()
    data[(data >= 65) & (data <= 90)] += 32
    space = (data == 32) | ((data >= 9) & (data <= 13))
    n = len(data)
    start = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    end = np.flatnonzero(space & np.concatenate([[False], ~space[:-1]]))
    with np.errstate(over="ignore"):
        power = np.full(n + 1, base, np.uint64)
        power[0] = 1
        power = np.multiply.accumulate(power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(letters[data] * power[:n], out=total[1:])
        inverse = np.full(n + 1, pow(base, -1, 1 << 64), np.uint64)
        inverse[0] = 1
        h = _mixed((total[end] - total[start]) * np.multiply.accumulate(inverse)[start] + (end - start).astype(np.uint64))
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    return h, np.searchsorted(start, bounds)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k-word shingle in order; of the whole sequence if it is shorter."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        m = min(k, len(words))
        h = np.full(len(words) - m + 1, m, np.uint64)
        for i in range(m):
            h = h * np.uint64(0xD1B54A32D192ED03) + words[i : len(words) - m + 1 + i]
        return _mixed(h)


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of about BLOCK bytes with their texts."""
    for batch in batches:
        raw = [(t.as_py() or "").encode("utf-8", "replace") for t in batch.column(column)]
        at = 0
        while at < len(raw):
            to, size = at, 0
            while to < len(raw) and (to == at or size + len(raw[to]) <= BLOCK):
                size += len(raw[to])
                to += 1
            yield batch.slice(at, to - at), raw[at:to]
            at = to


def word_levels(docs: DataFrame) -> np.ndarray:
    """A rank of commonness for each bucket of word hashes, counted over all documents but for words a task sees once; of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for _, texts in _texts(batches, 0):
            h, _ = word_hashes(texts)
            total += np.bincount((h & np.uint64(BUCKETS - 1)).astype(np.int64), minlength=BUCKETS)
        some = np.flatnonzero(total > 1)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return np.round(4 * np.log2(out + 1)).astype(np.int16)


def _scored(words: np.ndarray, level: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The set of one text's shingles and how common their words are."""
    total = np.concatenate([[0], np.cumsum(level)])
    m = min(k, len(words))
    h, at = np.unique(shingles(words, k), return_index=True)
    return h, (total[m:] - total[:-m])[at]


def common_shingles(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of rare words that several texts of a sample hold, in order, and of how many. They only order the shingles:
    what a sample misses makes regions larger, never a result different."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _texts(batches, 0):
            words, first = word_hashes(texts)
            level = levels[(words & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
            out = [np.zeros(0, np.uint64)]
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if a < b:
                    h, score = _scored(words[a:b], level[a:b], k)
                    out.append(h[np.lexsort((h, score))[: 2 * (len(h) - -(-percent * len(h) // 100) + 1)]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64))], names=["key"])

    every = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64(F.lit(3), "text_hash"), F.lit(every)) == 0).dropDuplicates(["text_hash"]).select("text")
    found = some.mapInArrow(run, "key long").groupBy("key").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(COMMON).toArrow()
    key = found["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], found["n"].to_numpy()[order]


def sketches(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """doc_id, text_hash, n (set size), node (a hash of the set), cells (counts by cell), keys (first shingles)."""
    levels = word_levels(docs)
    common, often = common_shingles(docs, k, percent, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches, 2):
            words, first = word_hashes(texts)
            level = levels[(words & np.uint64(BUCKETS - 1)).astype(np.int64)].astype(np.int64)
            sizes, nodes, cells, keys = [], [], [], []
            for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if a == b:
                    sizes.append(0)
                    nodes.append(None)
                    cells.append(None)
                    keys.append(None)
                    continue
                h, score = _scored(words[a:b], level[a:b], k)
                n = len(h)
                known = np.zeros(n, np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
                    known = np.where(common[at] == h, often[at], 0)
                sizes.append(n)
                nodes.append(_node(h))
                count = next(c for bound, c in CELLS if n < bound)
                cells.append(np.minimum(255, np.bincount((h >> np.uint64(65 - count.bit_length())).astype(np.int64), minlength=count)).astype(np.uint8).tobytes())
                most = n - -(-percent * n // 100) + 1
                keys.append(h[np.lexsort((h, score, known))[:most]].view(np.int64))
            columns = [part.column(0), part.column(1), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()), pa.array(cells, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_hash", "n", "node", "cells", "keys"])

    return docs.mapInArrow(run, "doc_id long, text_hash long, n long, node long, cells binary, keys array<long>")


def _node(h: np.ndarray) -> int:
    """The hash that names a set."""
    n = np.uint64(len(h))
    with np.errstate(over="ignore"):
        return int((_mixed(h + n).sum() ^ n).view(np.int64))


def _most_apart(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Largest symmetric difference of linked sets of sizes n and m."""
    return n + m - 2 * (-(-percent * (n + m) // (100 + percent)))


def _coarse(cells: list[bytes], count: int) -> np.ndarray:
    """Counts of equally long rows, over `count` cells."""
    x = np.frombuffer(b"".join(cells), np.uint8).reshape(len(cells), count, -1)
    return x.sum(-1, dtype=np.int16)


def _near(x: list[bytes], y: list[bytes], n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False where the windows exclude a link of the sets with these cell counts and sizes; counts of different
    resolution are compared at the coarser one."""
    out = np.zeros(len(x), bool)
    most = _most_apart(n, m, percent)
    shape = np.array([(len(a), len(b)) for a, b in zip(x, y, strict=True)]).reshape(-1, 2)
    for la, lb in np.unique(shape, axis=0):
        at = np.flatnonzero((shape[:, 0] == la) & (shape[:, 1] == lb))
        for i in range(0, len(at), 20000):
            some = at[i : i + 20000]
            count = min(la, lb)
            differ = np.abs(_coarse([x[j] for j in some], count) - _coarse([y[j] for j in some], count)).sum(-1, dtype=np.int64)
            out[some] = differ <= most[some]
    return out


def _windowed(cell: np.ndarray, n: np.ndarray, counts: list[bytes], percent: int) -> list[tuple[int, int]]:
    """Of rows sorted by cell: pairs of a cell that are near enough by their sizes and counts; these pairs connect what all such pairs do."""
    least = CELLS[0][1]
    low = np.empty((len(counts), least), np.int16)
    sizes = np.array([len(c) for c in counts])
    for count in np.unique(sizes):
        at = np.flatnonzero(sizes == count)
        low[at] = _coarse([counts[i] for i in at], least)
    out: list[tuple[int, int]] = []
    root = np.arange(len(cell))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = int(root[root[i]])
        return i

    def sift(i: np.ndarray, j: np.ndarray) -> None:
        good = (root[i] != root[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
        i, j = i[good], j[good]
        for at in range(0, len(i), 100_000):
            x, y = i[at : at + 100_000], j[at : at + 100_000]
            good = root[x] != root[y]
            x, y = x[good], y[good]
            good = np.abs(low[x] - low[y]).sum(-1, dtype=np.int64) <= _most_apart(n[x], n[y], percent)
            x, y = x[good], y[good]
            if len(x):
                good = _near([counts[a] for a in x], [counts[b] for b in y], n[x], n[y], percent)
                for a, b in zip(x[good].tolist(), y[good].tolist(), strict=True):
                    s, t = find(a), find(b)
                    if s != t:
                        root[max(s, t)] = min(s, t)
                        out.append((a, b))
                for a in np.unique(np.concatenate([x[good], y[good]])).tolist():
                    root[a] = find(a)

    begin = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    size = np.diff(np.append(begin, len(cell)))
    for g in np.unique(size[(size > 1) & (size <= 64)]):
        starts = begin[size == g]
        i, j = np.triu_indices(g, 1)
        step = max(1, 400_000 // len(i))
        for at in range(0, len(starts), step):
            some = starts[at : at + step, None]
            sift((some + i).ravel(), (some + j).ravel())
    for a, g in zip(begin[size > 64].tolist(), size[size > 64].tolist(), strict=True):
        for i in range(0, g, 64):
            rows, columns = np.arange(i, min(g, i + 64)), np.arange(i + 1, g)
            x, y = np.repeat(rows, len(columns)), np.tile(columns, len(rows))
            sift(a + x[x < y], a + y[x < y])
    return out


def linked(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, small: int = SMALL, pivots: int = PIVOTS) -> list[tuple[int, int]]:
    """Links (i, j) that join what all links of these sets join, beyond the components that `label` names. Exact, by recursive
    division into Voronoi cells."""
    m = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    part = np.unique(label, return_inverse=True)[1] if label is not None else np.arange(m)
    edges: list[tuple[int, int]] = []
    if m < 2 or part.max() == 0:
        return edges
    if m == 2:
        inside = int(size.sum()) - len(np.unique(np.concatenate(sets)))
        return [(0, 1)] if 100 * inside >= percent * (size.sum() - inside) else edges
    code = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    begin = np.concatenate([[0], np.cumsum(size)])
    marked = np.zeros(int(code.max()) + 1, bool)
    apart = 2 * (1 - percent / 100) + 1e-9

    def join(i: int, others: np.ndarray) -> None:
        names, at = np.unique(part[others], return_index=True)
        for name, j in zip(names.tolist(), others[at].tolist(), strict=True):
            if name != part[i]:
                edges.append((i, j))
                part[part == name] = part[i]

    def elements(idx: np.ndarray) -> np.ndarray:
        """Positions in code of the elements of idx, in order."""
        n = size[idx]
        ends = np.cumsum(n)
        return np.arange(ends[-1]) + np.repeat(begin[idx] - (ends - n), n)

    def divide(idx: np.ndarray) -> None:
        if len(idx) < 2 or (part[idx] == part[idx[0]]).all():
            return
        if len(idx) > small:
            e, offset = code[elements(idx)], np.concatenate([[0], np.cumsum(size[idx])[:-1]])
            away, least, pivot = [], np.full(len(idx), 2.0), 0
            for _ in range(pivots):
                own = code[begin[idx[pivot]] : begin[idx[pivot] + 1]]
                marked[own] = True
                inside = np.add.reduceat(marked[e], offset, dtype=np.int64)
                marked[own] = False
                union = size[idx] + len(own) - inside
                join(int(idx[pivot]), idx[100 * inside >= percent * union])
                away.append(1 - inside / union)
                least = np.minimum(least, away[-1])
                pivot = int(least.argmax())
                if least[pivot] <= 0:
                    break
            cells = [idx[d <= least + apart] for d in away]
            if max(map(len, cells)) <= 0.7 * len(idx):
                for cell in cells:
                    divide(cell)
                return
        compare(idx)

    def compare(idx: np.ndarray) -> None:
        """All pairs of idx across components, by counts of common elements: frequent ones as a matrix, others by postings."""
        names, counts = np.unique(part[idx], return_counts=True)
        if len(names) < 2:
            return
        loose = np.flatnonzero(part[idx] != names[counts.argmax()])
        k = len(idx)
        e, owner = code[elements(idx)], np.repeat(np.arange(k), size[idx])
        seen, e, often = np.unique(e, return_inverse=True, return_counts=True)
        frequent = often > max(8, k / 16)
        column = np.cumsum(frequent) - 1
        at = frequent[e]
        dense = np.zeros((k, int(frequent.sum())), np.float32)
        dense[owner[at], column[e[at]]] = 1
        at = ~at & (often[e] > 1)
        rare, rare_owner = e[at], owner[at]
        order = np.argsort(rare, kind="stable")
        posting = rare_owner[order]
        first = np.searchsorted(rare[order], np.arange(len(seen) + 1))
        own = np.searchsorted(rare_owner, np.arange(k + 1))
        step = max(1, min(256, 1_000_000 // k))
        for a in range(0, len(loose), step):
            rows = loose[a : a + step]
            inside = dense[rows] @ dense.T
            terms = np.concatenate([rare[own[r] : own[r + 1]] for r in rows])
            if len(terms):
                which = np.repeat(np.arange(len(rows)), own[rows + 1] - own[rows])
                n = first[terms + 1] - first[terms]
                ends = np.cumsum(n)
                where = np.arange(ends[-1]) + np.repeat(first[terms] - (ends - n), n)
                inside = inside + np.bincount(np.repeat(which, n) * k + posting[where], minlength=len(rows) * k).reshape(len(rows), k)
            hit = (100 + percent) * inside >= percent * (size[idx][None, :] + size[idx[rows]][:, None])
            hit &= part[idx][None, :] != part[idx[rows]][:, None]
            for r in np.flatnonzero(hit.any(1)):
                join(int(idx[rows[r]]), idx[hit[r]])

    divide(np.arange(m))
    return edges


def _sets(raw: pa.Array | pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) for x in raw]


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Batches cut at changes of the first `keys` columns, by which rows are sorted: (key, slice), one key often in several slices in turn."""
    for batch in batches:
        if batch.num_rows:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
            change = np.zeros(batch.num_rows, bool)
            change[0] = True
            for c in columns:
                change[1:] |= c[1:] != c[:-1]
            cuts = [*np.flatnonzero(change).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield tuple(c[a].item() for c in columns), batch.slice(a, b - a)


def _whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """The rows of each key together."""
    held, now = [], None
    for key, some in _grouped(batches, keys):
        if key != now and held:
            yield now, pa.Table.from_batches(held)
            held = []
        now = key
        held.append(some)
    if held:
        yield now, pa.Table.from_batches(held)


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    a, b = zip(*pairs, strict=True) if pairs else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _large_regions(large: DataFrame, held: DataFrame, percent: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Links of regions that no task can hold; large: cell, node, n, load."""
    apart = 1 - percent / 100 + 1e-6
    sliced = large.withColumn("slices", F.ceil(F.col("load") / limit).cast("int")).withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices")).cast("int"))
    first = Window.partitionBy("cell").orderBy(F.xxhash64(F.lit(1), "node"), "node")
    pivots = sliced.withColumn("pivot", F.row_number().over(first)).where(F.col("pivot") <= PIVOTS)
    pivots = pivots.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    rows = sliced.withColumn("pivot", F.lit(PIVOTS + 1)).unionByName(pivots).select("cell", "slice", "pivot", "node", "n")
    rows = rows.join(held, "node").select("cell", "slice", "pivot", "node", "n", "set").repartition("cell", "slice").sortWithinPartitions("cell", "slice", "pivot", "node")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cell, _), t in _whole(batches, 2):
            pivot, node, n = (t.column(c).to_numpy() for c in ("pivot", "node", "n"))
            sets = _sets(t.column("set"))
            links = [(int(node[i]), int(node[j])) for i, j in linked(sets, percent) if node[i] != node[j]]
            members = np.flatnonzero(pivot > PIVOTS)
            code = np.concatenate(sets)
            ends = np.cumsum(n)
            away = np.ones((len(n), PIVOTS), np.float32)
            for p in np.flatnonzero(pivot <= PIVOTS):
                inside = np.add.reduceat(np.isin(code, sets[p]), ends - n, dtype=np.int64)
                away[:, pivot[p] - 1] = 1 - inside / (n + n[p] - inside)
            size = len(links) + len(members)
            none = [None] * len(links)
            columns = [
                pa.array([cell] * size, pa.int64()), pa.array([a for a, _ in links] + node[members].tolist(), pa.int64()), pa.array([b for _, b in links] + [None] * len(members), pa.int64()),
                pa.array(none + n[members].tolist(), pa.int64()), pa.array(none + list(away[members]), pa.list_(pa.float32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["cell", "a", "b", "n", "away"])

    found = staged(rows.mapInArrow(placed, "cell long, a long, b long, n long, away array<float>"), "slices")
    near = found.where("b IS NOT NULL").select("a", "b")
    joined = staged(components(near), "slice-components")
    place = found.where("b IS NULL").select("cell", F.col("a").alias("node"), "n", "away").join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    most = place.groupBy("cell", "component").agg(F.count("*").alias("size")).groupBy("cell").agg(F.max_by("component", F.struct("size", "component")).alias("most"))
    place = place.join(most, "cell").withColumn("loose", F.col("component") != F.col("most")).withColumn("home", F.array_position("away", F.array_min("away")).cast("int")).drop("most")
    place = kept = staged(place, "places", done=(joined,))
    # cells that fit share a part with their neighbours, up to about `limit`; a larger one is cut by hash
    loads = place.groupBy("cell", "loose", "home").agg(F.sum("n").alias("load"))
    before = F.coalesce(F.sum(F.least("load", F.lit(limit))).over(Window.partitionBy("cell", "loose").orderBy("home").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    loads = loads.withColumn("salts", F.ceil(F.col("load") / limit).cast("int")).withColumn("bin", F.when(F.col("salts") > 1, PIVOTS + F.col("home")).otherwise(F.floor(before / limit).cast("int"))).drop("load")
    place = place.join(loads, ["cell", "loose", "home"]).withColumn("part", F.struct("loose", "bin", F.pmod(F.xxhash64(F.lit(2), "node"), F.col("salts")).cast("int").alias("salt"))).drop("salts", "bin", "home")
    every = [(f, f(F.get("away", F.lit(i)))) for f in (F.min, F.max) for i in range(PIVOTS)]
    parts = place.groupBy("cell", "part").agg(F.array(*[c for f, c in every if f is F.min]).alias("lo"), F.array(*[c for f, c in every if f is F.max]).alias("hi"), F.min("n").alias("n_lo"), F.max("n").alias("n_hi"))
    goes = place.where("loose").select("cell", "node", "n", "away", "component", F.col("part").alias("own")).join(parts, "cell")
    open_to = (~F.col("part.loose") | (F.col("own") < F.col("part"))) & (F.col("n") * 100 >= percent * F.col("n_lo")) & (F.col("n_hi") * 100 >= percent * F.col("n"))
    for i in range(PIVOTS):
        open_to &= F.get("away", F.lit(i)).between(F.get("lo", F.lit(i)) - apart, F.get("hi", F.lit(i)) + apart)
    visits = goes.where(open_to).select("cell", "part", F.lit(True).alias("visitor"), "component", "node")
    rows = place.select("cell", "part", F.lit(False).alias("visitor"), "component", "node").unionByName(visits)
    rows = rows.select("cell", F.xxhash64("part").alias("part"), F.col("part.loose").alias("loose"), "visitor", "component", "node").join(held, "node")
    rows = rows.select("cell", "part", "visitor", "loose", "component", "node", "set").repartition("cell", "part").sortWithinPartitions("cell", "part", "visitor", "node")

    def visited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, guests, now, weight = [], [], None, 0

        def settled(last: bool) -> Iterator[pa.RecordBatch]:
            if home and (guests or (last and alone and home[0].column(3)[0].as_py())):
                t = pa.Table.from_batches([*home, *guests])
                node = t.column(5).to_numpy()
                yield _edges([(int(node[i]), int(node[j])) for i, j in linked(_sets(t.column(6)), percent, t.column(4).to_numpy())])

        alone = True
        for key, some in _grouped(batches, 3):
            if key[:2] != now:
                yield from settled(True)
                home, guests, now, weight, alone = [], [], key[:2], 0, True
            for at in range(0, some.num_rows, 64):
                few = some.slice(at, 64)
                if not key[2]:
                    home.append(few)
                else:
                    guests.append(few)
                    weight += few.column(6).nbytes // 8
                    if weight > limit:
                        yield from settled(False)
                        guests, weight, alone = [], 0, False
        yield from settled(True)

    return near, staged(rows.mapInArrow(visited, "a long, b long"), "visits", done=(kept,))


def _cut(wide: DataFrame, percent: int, group: int) -> DataFrame:
    """Regions (cell, node, n) as smaller ones (cell, node): two nodes of a cell whose sizes allow a link still meet, in parts of about 2 * group nodes at most."""
    width = -np.log(min(percent, 99) / 100) * 1.0001
    band = F.floor(F.log("n") / width).cast("int")
    rows = wide.select("cell", "node", F.explode(F.array(band, band + 1)).alias("band"))
    blocks = rows.groupBy("cell", "band").agg(F.count("*").alias("size")).where("size > 1").select("cell", "band", F.ceil(F.col("size") / group).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64(F.lit(4), "node"), F.col("blocks")).cast("int")
    rows = rows.join(blocks, ["cell", "band"]).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.select(F.xxhash64("cell", "band", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "node")


def links(docs: DataFrame, own: DataFrame, reps: DataFrame, words: int, percent: int, group: int = GROUP, limit: int = LIMIT, repeated: bool = True) -> DataFrame:
    """Edges (a, b) of nodes whose components are those of all links. own: node, n, cells, keys; reps: node, doc_id, text_hash of one document each;
    repeated: whether rows of docs may share a doc_id and text."""
    keyed = own.select(F.explode("keys").alias("key"), "node")
    sharing = Window.partitionBy("key")
    met = keyed.withColumn("cell", F.min("node").over(sharing)).withColumn("found", F.count("*").over(sharing)).where("found > 1")
    met = staged(met.select("cell", "node").distinct(), "regions")
    sizes = met.groupBy("cell").agg(F.count("*").alias("size"))
    big = staged(sizes.where(F.col("size") > group).select("cell"), "big-regions")
    few = met.join(big, "cell", "left_anti")
    if big.head(1):
        few = few.unionByName(_cut(met.join(big, "cell").join(own.select("node", "n"), "node"), percent, group))
    few = few.join(own.select("node", "n", "cells"), "node").select("cell", "node", "n", "cells")

    def windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def near(t: pa.Table) -> pa.RecordBatch:
            cell, node, n = (t.column(c).to_numpy() for c in range(3))
            return _edges([(int(node[i]), int(node[j])) for i, j in _windowed(cell, n, t.column(3).to_pylist(), percent)])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 30_000:
                t = pa.Table.from_batches(held)
                cut = int(np.searchsorted(t.column(0).to_numpy(), t.column(0)[-1].as_py()))
                if cut:  # whole regions only
                    yield near(t.slice(0, cut))
                    held = t.slice(cut).to_batches()
        if held:
            yield near(pa.Table.from_batches(held))

    near = few.repartition("cell").sortWithinPartitions("cell").mapInArrow(windowed, "a long, b long")
    near = staged(near, "near", done=(met, big))
    clusters = components(near).select(F.col("component").alias("cell"), "node")
    stay = staged(clusters.join(own.select("node", "n"), "node").select("cell", "node", "n"), "survivors", done=(near,))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, raw in _texts(batches, 1):
            hashed, first = word_hashes(raw)
            held = [np.unique(shingles(hashed[a:b], words)) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([x.tobytes() for x in held], pa.binary())], names=["node", "cell", "set"])

    # a node is in one cluster only, whose name goes with its set, so that no join moves sets again
    need = reps.join(stay.select("node", "cell"), "node").select("node", "cell", F.col("doc_id").alias("rep_id"), F.col("text_hash").alias("rep_hash"))
    need = staged(need, "needed")
    # of the texts, few are needed, and one of equal ones is enough: the others are left where they are
    wanted = sieve(need.select(F.xxhash64("rep_id", "rep_hash").alias("row")), "row")
    docs = sifted(docs.withColumn("row", F.xxhash64("doc_id", "text_hash")), "row", wanted, "needed").where("needed").select("doc_id", "text_hash", "text")
    texts = need.join(docs, F.col("rep_id").eqNullSafe(F.col("doc_id")) & (F.col("rep_hash") == F.col("text_hash"))).select("node", "text", "cell")
    held = texts.mapInArrow(sets, "node long, cell long, set binary")
    held = staged(held.dropDuplicates(["node"]) if repeated else held, "sets")
    loads = stay.groupBy("cell").agg(F.sum("n").alias("load"), F.count("*").alias("size")).where("size > 1")
    large = staged(loads.where(F.col("load") > limit).select("cell", "load"), "large-regions")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _whole(batches, 1):
            if t.num_rows > 1:
                node = t.column(1).to_numpy()
                yield _edges([(int(node[i]), int(node[j])) for i, j in linked(_sets(t.column(2)), percent)])

    rows = held.select("cell", "node", "set")
    divided = bool(large.head(1))
    if divided:
        cells = F.broadcast(large.select("cell"))  # as few as LIMIT goes into all shingles
        rows, held_large = rows.join(cells, "cell", "left_anti"), rows.join(cells, "cell", "left_semi").select("node", "set")
    rows = rows.repartition("cell").sortWithinPartitions("cell", "node")
    out = staged(rows.mapInArrow(joined, "a long, b long"), "edges")
    if divided:
        for more in _large_regions(stay.join(large, "cell"), held_large, percent, limit):
            out = out.unionByName(more)
    return staged(out, "links", done=(stay, held, large))


def _named(docs: DataFrame, words: int, percent: int, group: int = GROUP, limit: int = LIMIT) -> DataFrame:
    """doc_id, text_hash, n, node and component (the name of a node, for rows with words) and component_id of every row of docs (doc_id, text_hash, text)."""
    rows = staged(sketches(docs.select("doc_id", "text_hash", "text"), words, percent), "sketches")
    some = rows.where("n > 0")
    reps = some.groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies")).select("node", "rep.*", "least", "copies")
    reps = staged(reps, "representatives")
    # most sets are those of one row only: such rows are not moved
    told = sifted(some, "node", sieve(reps.where("copies > 1"), "node"), "several")
    own = told.where("NOT several").unionByName(told.where("several").dropDuplicates(["node"]))
    own = staged(own.select("node", "n", "cells", "keys"), "nodes")
    slim = staged(rows.select("doc_id", "text_hash", "n", "node"), "documents", done=(rows,))
    repeated = bool(slim.where("n > 0").groupBy("doc_id", "text_hash").agg(F.count("*").alias("copies")).where("copies > 1").head(1))
    edges = links(docs, own, reps, words, percent, group, limit, repeated)
    named = reps.select("node", "least").join(components(edges), "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = staged(named, "components", done=(own, reps, edges))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return slim.join(named.join(least, "component").select("node", "component", "component_id"), "node", "left")


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def classes(docs: DataFrame, words: int = 5, percent: int = 80, group: int = GROUP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of every document."""
    rows = _named(_hashed(docs), words, percent, group, limit)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Pipeline stage: of each component one row stays, that with the smallest doc_id (rows without one last, then by
    text hash; of rows that repeat both, any one). Rows without words stay."""
    rows = staged(_named(_hashed(docs), 5, 80).select("doc_id", "text_hash", "n", "component"), "stage-components")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")
    first = rows.where("n > 0").groupBy("component").agg(F.min(order).alias("first"), F.count("*").alias("size")).where("size > 1")
    told = rows.where("n > 0").join(first, "component").withColumn("stays", order == F.col("first"))
    by_text, by_id, stays = fresh(docs, "text_hash", "id", "stays")
    key = told.groupBy("doc_id", "text_hash").agg(F.max("stays").alias(stays), F.count("*").alias("copies"))
    key = staged(key.select(F.col("doc_id").alias(by_id), F.col("text_hash").alias(by_text), stays, "copies"), "stage-kept", done=(rows,))
    hashed = docs.withColumn(by_text, F.xxhash64("text"))

    # rows that stay alone are not moved; rows that repeat a doc_id and text are reduced to one
    def match(df: DataFrame, keys: DataFrame) -> Column:
        return df["doc_id"].cast("long").eqNullSafe(keys[by_id]) & (df[by_text] == keys[by_text])

    gone = staged(key.where(f"NOT {stays} OR copies > 1").select(by_id, by_text), "stage-gone")
    (maybe,) = fresh(hashed, "maybe")
    told = sifted(hashed, by_text, sieve(gone, by_text), maybe)
    doubtful = told.where(maybe)
    doubtful = doubtful.join(gone, match(doubtful, gone), "left_anti").select(*docs.columns)
    alone = told.where(~F.col(maybe)).select(*docs.columns).unionByName(doubtful)
    several = staged(key.where(f"{stays} AND copies > 1").select(by_id, by_text), "stage-repeated", done=(key,))
    if not several.head(1):
        return alone
    again = hashed.join(several, match(hashed, several), "left_semi").dropDuplicates(["doc_id", by_text])
    return alone.unionByName(again.select(*[again[c] for c in docs.columns]))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents"), words=4, percent=85)
