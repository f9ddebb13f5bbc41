"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

1. Seeds are all word n-grams of the test items, common ones too: a copy may have kept only those.
2. One scan of all documents takes the places where an item's seeds occur, and aligns the item with the passage
   around (match +2, mismatch -1, gap -1). An alignment that reaches ``least`` of the item's full score, or the score
   of ENOUGH words in a row, is a leak, so edited, shortened and reordered-by-a-few-words copies are found as well as
   exact ones, and excerpts of long items.

Two bounds keep alignments few and leave out none that could be a leak: errors cost at least 1 each, so
an alignment leaves its seed's diagonal by no more than what the full score has above the least one; and as many
of the item's words as half of the least score must occur in the passage. A copy without any ``n`` words of the
item in a row isn't found, whatever it would score.

Seeds and items travel to the tasks, at most MOST_BYTES of item text at a time; a larger benchmark is taken in
slices of that size, each with its own scan. Documents are never shuffled.

Words are lower-case runs of letters, digits and underscores. Null text: empty. Items that are null or have
fewer than ``n`` words match nothing. Repeated rows and items each count for themselves; null ids stay; extra
columns are ignored; empty tables give no leaks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import filtered

NGRAM, LEAST, ENOUGH, MOST_BYTES = 3, 0.5, 50, 8_000_000
WORDS = re.compile(r"\w+")
LEAK = "doc_id long, item_id long, score double, start_word int, end_word int"


def words_of(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def align(item: list[int], passage: list[int]) -> tuple[int, int, int]:
    """Best local alignment: score, and where it starts and ends in the passage. Id 0 equals nothing."""
    m = len(passage)
    score, begin = [0] * (m + 1), list(range(m + 1))
    best = (0, 0, 0)
    for w in item:
        diagonal, diagonal_begin, left, left_begin = 0, 0, 0, 0
        for j in range(1, m + 1):
            s, b = diagonal + (2 if w == passage[j - 1] else -1), diagonal_begin
            diagonal, diagonal_begin = score[j], begin[j]
            if diagonal - 1 > s:
                s, b = diagonal - 1, diagonal_begin
            if left - 1 > s:
                s, b = left - 1, left_begin
            if s <= 0:
                s, b = 0, j
            score[j], begin[j] = left, left_begin = s, b
            if s > best[0]:
                best = (s, b, j)
    return best


class Items:
    """A slice of the benchmark: its words, the seeds of each item, and the search of one document."""

    def __init__(self, rows: list[tuple[int | None, str]], n: int):
        self.n, self.names, self.items = n, [], []
        self.ids: dict[str, int] = {}
        for item_id, text in rows:
            words = words_of(text or "")
            if len(words) >= n:
                self.names.append(item_id)
                self.items.append([self.ids.setdefault(w, len(self.ids) + 1) for w in words])
        self.base = len(self.ids) + 1
        places = defaultdict(list)
        for i, item in enumerate(self.items):
            for k in range(len(item) - n + 1):
                places[self.code(item[k : k + n])].append((i, k))
        self.codes = np.array(sorted(places), np.uint64)
        self.places = [places[int(c)] for c in self.codes]

    def code(self, gram: list[int]) -> int:
        out = 0
        for w in gram:
            out = (out * self.base + w) % 2**64
        return out

    def hits(self, words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Word ids of a document, and the places and seed numbers of the seeds in it."""
        get = self.ids.get
        ids = [get(w, 0) for w in words]
        a = np.array(ids, np.uint64)
        m = len(a) - self.n + 1
        if m < 1 or not len(self.codes):
            return ids, np.empty(0, np.int64), np.empty(0, np.int64)
        known = np.ones(m, bool)
        code = np.zeros(m, np.uint64)
        for k in range(self.n):
            known &= a[k : k + m] > 0
            code = code * np.uint64(self.base) + a[k : k + m]
        at = np.flatnonzero(known)
        seed = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
        same = self.codes[seed] == code[at]
        return ids, at[same], seed[same]

    def leaks(self, words: list[str], least: float) -> Iterator[tuple]:
        """(item_id, score, start, end) of each item with an alignment of at least ``least``, or of ENOUGH words: the best one."""
        ids, at, seed = self.hits(words)
        starts = defaultdict(set)
        for p, s in zip(at.tolist(), seed.tolist()):
            for i, k in self.places[s]:
                starts[i].add(p - k)
        seen = set(ids) if starts else ()
        for i, begins in starts.items():
            item, best, size = self.items[i], (0, 0, 0), len(self.items[i])
            least_score = min(least * 2 * size, 2 * ENOUGH)
            if 2 * sum(w in seen for w in item) < least_score:
                continue
            far = max(0, int(2 * size - least_score))
            begins, runs = sorted(begins), []
            for b in begins:
                if runs and b - runs[-1][1] <= size // 2:
                    runs[-1][1] = b
                else:
                    runs.append([b, b])
            for lo, hi in runs:
                lo = max(0, lo - far)
                passage = ids[lo : hi + size + far]
                near = set(passage)
                if 2 * sum(w in near for w in item) < least_score:
                    continue
                s, b, e = align(item, passage)
                if s > best[0]:
                    best = (s, lo + b, lo + e)
            if best[0] >= least_score:
                yield self.names[i], best[0] / (2 * size), best[1], best[2]


def _slices(benchmark: DataFrame, n: int, most: int) -> Iterator[Items]:
    """Each slice of the benchmark."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.octet_length("text") >= 2 * n - 1)  # shorter ones don't have n words
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-size // most)
    for k in range(count):
        part = rows if count == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        yield Items([(r["item_id"], r["text"]) for r in part.orderBy("item_id", "text").collect()], n)


def leaks(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, least: float = LEAST, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): the best alignment of each document with each item it leaks."""
    out = docs.sparkSession.createDataFrame([], LEAK)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    for items in _slices(benchmark, n, most):

        def fn(batches, items=items):
            for b in batches:
                rows = [(d, *x) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text")) for x in items.leaks(words_of(t.as_py() or ""), least)]
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["doc_id", "item_id", "score", "start_word", "end_word"])

        out = out.unionByName(texts.mapInArrow(fn, LEAK))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = NGRAM, least: float = LEAST, most: int = MOST_BYTES) -> DataFrame:
    """docs without those that leak an item; columns and types stay."""
    for items in _slices(benchmark, n, most):
        docs = filtered(docs, "text", lambda items=items: lambda texts: [next(items.leaks(words_of(t), least), None) is None for t in texts])
    return docs
