"""BPE encoding and decoding over a pair occurrence index.

For the distinct words of a batch that are not known yet, each adjacent pair of symbols is mapped, by its
merge rank, to all its positions. Active ranks are applied in ascending order; each merge updates the lists of
the pairs that it makes. A word's ids, their decimal text and the decoded text are kept for later batches of the
same task in a table of bounded size, which only saves time.

Defined cases: null text is empty (no ids); the vocabulary's special strings in a text are their ids; whole texts
of any length; repeated rows give equal rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockloom.llm._shared import table

#: Most words whose encoding a task keeps.
KEPT_WORDS = 250_000
#: Words that share one index; a small one stays in the processor's caches.
INDEXED_WORDS = 4_000
#: White space by its Unicode property.
SPACE = "\t-\r \x85\xa0  -     　"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> list[str]:
    """A printable letter for each byte: itself where printable, else from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class Occurrences(dict):
    """Positions of each pair's first symbol by the pair's merge rank, with a heap of the active ranks."""

    def __init__(self, found: dict[int, list[int]]):
        super().__init__(found)
        self.active = sorted(found)

    def __missing__(self, rank: int) -> list[int]:
        heapq.heappush(self.active, rank)
        self[rank] = positions = []
        return positions


class WordBpe:
    """Words with an end mark, from a vocabulary file of the tokenizers library."""

    def __init__(self, path: str, kept_words: int = KEPT_WORDS):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocabulary: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocabulary.items()} | {i: s for s, i in self.special.items()}
        self.decimals = {i: str(i) for i in self.strings}
        # codes: 0 to 255 a byte within a word, 256 to 511 a word's last byte, 512 the gap after a word
        self.symbols = [self.vocabulary.get(x + end) for end in ("", self.end) for x in byte_letters()] + [-1]
        within = {s: code for code, s in enumerate(self.symbols[:256])}
        last = {s: code for code, s in enumerate(self.symbols[256:512], 256)}
        self.first_ranks = np.full((513, 513), -1, np.int32)
        self.right: dict[int, dict[int, int]] = {}  # symbol -> the one after it -> rank of the pair
        self.left: dict[int, dict[int, int]] = {}  # symbol -> the one before it -> rank of the pair
        self.merged: list[int] = []
        self.pairs: list[tuple[int, int]] = []
        for a, b in model["merges"]:
            x, y, rank = self.vocabulary[a], self.vocabulary[b], len(self.merged)
            self.pairs.append((x, y))
            self.merged.append(self.vocabulary[a + b])
            if self.right.setdefault(x, {}).setdefault(y, rank) == rank:
                self.left.setdefault(y, {})[x] = rank
                for codes in (within, last):
                    if x in within and y in codes:
                        self.first_ranks[within[x], codes[y]] = rank
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{SPACE}\p{{L}}\p{{N}}]+")
        self.ascii_words = re.compile(r"[a-z]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\t-\r a-z0-9]+")  # the same for ASCII in lower case
        self.splits = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) or r"(?!)")
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.kept_words = kept_words

    def split(self, text: str) -> list[str]:
        """Words, and special strings as they are."""
        out, at = [], 0
        for m in self.splits.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        text = self.normal(text)
        return (self.ascii_words if text.isascii() else self.words).findall(text)

    @staticmethod
    def normal(text: str) -> str:
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()  # letter by letter: no final sigma

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, by pair occurrence indexes over INDEXED_WORDS of them at a time."""
        out = []
        for at in range(0, len(words), INDEXED_WORDS):
            out += self._indexed(words[at : at + INDEXED_WORDS])
        return out

    def _indexed(self, words: list[str]) -> list[list[int]]:
        raw = [word.encode("utf-8", "replace") for word in words]
        gaps = np.cumsum([len(x) + 1 for x in raw]) - 1
        codes = np.frombuffer(b"\0".join(raw) + b"\0", np.uint8).astype(np.int64)
        codes[gaps - 1] += 256
        codes[gaps] = 512
        ranks = self.first_ranks[codes[:-1], codes[1:]]
        positions = np.flatnonzero(ranks >= 0)
        positions = positions[np.argsort(ranks[positions], kind="stable")]
        cuts = np.flatnonzero(np.diff(ranks[positions], prepend=-1))
        firsts, positions, cuts = ranks[positions[cuts]].tolist(), positions.tolist(), [*cuts.tolist(), len(positions)]
        where = Occurrences({r: positions[x:y] for r, x, y in zip(firsts, cuts[:-1], cuts[1:], strict=True)})
        symbol = [self.symbols[c] for c in codes.tolist()]
        at = list(range(len(symbol) + 1))
        after, before = at[1:], [len(symbol) - 1, *at[: len(symbol) - 1]]  # gaps, like symbols taken by a merge, are -1 and in no pair
        while where.active:
            rank = heapq.heappop(where.active)
            (a, b), new = self.pairs[rank], self.merged[rank]
            right, left = self.right.get(new, {}).get, self.left.get(new, {}).get
            for i in sorted(where.pop(rank)):
                if symbol[i] == a and symbol[j := after[i]] == b:  # else an earlier merge took one of the two
                    symbol[i], symbol[j] = new, -1
                    after[i] = k = after[j]
                    before[k] = i
                    if (r := right(symbol[k])) is not None:
                        where[r].append(i)
                    if (r := left(symbol[h := before[i]])) is not None:
                        where[r].append(h)
        left_over = np.array(symbol)
        live = left_over >= 0
        ids, ends = left_over[live].tolist(), np.cumsum(live)[gaps].tolist()
        return [ids[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.kept]
        if len(self.kept) + len(new) > self.kept_words:
            self.kept = {w: self.kept[w] for w in words if w in self.kept}
        plain = [w for w in new if w not in self.special]
        found = dict(zip(plain, self.encode_words(plain), strict=True)) | {w: [self.special[w]] for w in new if w in self.special}
        decimals, strings = self.decimals, self.strings
        for w, ids in found.items():
            self.kept[w] = (len(ids), " ".join([decimals[i] for i in ids]), " ".join([strings[i] for i in ids]))

    def both(self, texts: list[str], letters: int = 2_000_000) -> Iterator[tuple[int, str, str]]:
        """Number of ids, the ids in decimal, and the decoded text, for each text."""
        at = 0
        while at < len(texts):
            block, size = [], 0
            while at < len(texts) and (not block or size + len(texts[at]) <= letters):
                block.append(self.split(texts[at]))
                size += len(texts[at])
                at += 1
            self._learn(set().union(*block))
            kept = self.kept
            for words in block:
                if words:
                    n, ids, decoded = zip(*[kept[w] for w in words], strict=True)
                    yield sum(n), " ".join(ids), " ".join(decoded)
                else:
                    yield 0, "", ""

    def encode(self, text: str) -> list[int]:
        return [int(x) for x in next(self.both([text]))[1].split()]

    def decode(self, ids: list[int]) -> str:
        return " ".join(self.strings[i] for i in ids if i in self.strings)


def encoded(docs: DataFrame, vocabulary: str | None = None, kept_words: int = KEPT_WORDS) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the decoded text."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = WordBpe(path, kept_words)
        digest = lambda s: hashlib.sha256(s.encode("utf-8")).hexdigest()
        collecting = gc.isenabled()
        gc.disable()  # no cycles are made here, and each collection would walk the table of words
        try:
            for whole in batches:
                for at in range(0, whole.num_rows, 500):
                    batch = whole.slice(at, 500)
                    rows = [(n, digest(ids), digest(text)) for n, ids, text in model.both([t or "" for t in batch.column(1).to_pylist()])]
                    n, ids, text = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            if collecting:
                gc.enable()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
