"""Interaction audit of corpus filters by truth-table survival words.

A document that fails the filters in a mask survives a subset of filters if mask and subset share no bit. Its
survival word has one bit for each of the 32 subsets of the five filters. Positional popcounts of the words, by
part and label, count the survivors of every subset: words are added bit by bit with carry-save adders, three words
to a sum and a carry, so that whole columns of words are counted at once. Every figure of every order of the
filters is then a difference of survivor counts.

The filters: A, too few words; B, too few distinct words; C, too many capitals; D, marks of code or tables; E, the text
of a document with a smaller doc_id (equal SHA-256 and length stand for equal texts). Null text: empty. Null source: the
part ''. A null doc_id has no smaller and is smaller than none. Rows that repeat an id are documents of their own; of
rows with the smallest id of a text none fails E. A document is good (toxic) if any of its label rows says 1. An empty
table has no parts and gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.llm.common import join_hot, saved

FILTERS = "ABCDE"
SUBSETS = 2 ** len(FILTERS)
ALL = SUBSETS - 1
DUPLICATE = 1 << FILTERS.index("E")
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
MARKS = b"#$%&*|"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 2
#: Survival word of each mask of failed filters: bit s is set if the subset s fails none.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not mask & s) for mask in range(SUBSETS)], np.uint32)
NARROW = "doc_id long, part string, mask int, text_key binary"


def failures(text: str) -> int:
    """Filters A to D that a text fails, as bits."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # at exactly the white space x20, x09-x0D
    mask = len(words) < LEAST_WORDS
    mask |= (100 * len(set(words)) < LEAST_DISTINCT * len(words)) << 1
    mask |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > MOST_CAPITALS * len(text)) << 2
    return int(mask | (len(raw.translate(None, MARKS)) < len(raw)) << 3)


def text_key(text: str) -> bytes:
    raw = text.encode("utf-8", "surrogatepass")
    return hashlib.sha256(raw).digest() + len(raw).to_bytes(8, "big")


def read_texts(docs: DataFrame) -> DataFrame:
    """One narrow row for each document: its part, the filters A to D that it fails, and the key of its text."""
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.col("text").cast("string").alias("text"))

    def fn(batches):
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array([failures(t) for t in texts], pa.int32()), pa.array([text_key(t) for t in texts], pa.binary())], names=["doc_id", "part", "mask", "text_key"])

    return docs.mapInArrow(fn, NARROW)


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic, n): n documents of one id, part and label that fail exactly the filters of a mask; n is 1 unless ids repeat.

    Texts stay where they are; rows are counted by (doc_id, part, mask) before they meet the labels, so neither a text nor an
    id that a third of all rows share becomes one task.
    """
    rows = saved(read_texts(docs), "filtered")
    firsts = saved(rows.groupBy("text_key").agg(F.min("doc_id").alias("first"), F.count("*").alias("times")).where("times > 1"), "repeated")
    alone = rows.join(firsts.select("text_key"), "text_key", "left_anti").select("doc_id", "part", "mask")
    later = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    shared = join_hot(rows, firsts, "text_key", "times").select("doc_id", "part", F.when(later, F.col("mask").bitwiseOR(F.lit(DUPLICATE))).otherwise(F.col("mask")).alias("mask"))
    counted = alone.unionByName(shared).groupBy("doc_id", "part", "mask").agg(F.count("*").alias("n"))
    says = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").groupBy("doc_id").agg(says("quality"), says("toxic"))
    none = F.lit(False)
    return counted.join(labels, "doc_id", "left").select("part", "mask", F.coalesce("quality", none).alias("good"), F.coalesce("toxic", none).alias("toxic"), "n")


def positional_popcount(words: np.ndarray, times: np.ndarray) -> list[int]:
    """How often each of the 32 bits is set in ``words``, the i-th word counting times[i] times.

    A word that counts 2^j times enters at level j. At each level three words give a sum word, which stays, and
    a carry word, which goes up, until two are left.
    """
    counts = [0] * 32
    carried = np.zeros(0, np.uint32)
    level = 0
    while len(carried) or (len(times) and int(times.max()) >> level):
        w = np.concatenate([carried, words[(times >> level) & 1 == 1]])
        carries = []
        while len(w) > 2:
            third = len(w) // 3
            a, b, c, rest = w[:third], w[third : 2 * third], w[2 * third : 3 * third], w[3 * third :]
            half = a ^ b
            carries.append((a & b) | (c & half))
            w = np.concatenate([half ^ c, rest])
        for word in w.tolist():
            for bit in range(32):
                counts[bit] += (word >> bit & 1) << level
        carried = np.concatenate(carries) if carries else np.zeros(0, np.uint32)
        level += 1
    return counts


CLASSES = ("every", "good", "toxic")


def survivors(counted: DataFrame) -> DataFrame:
    """(part, every, good, toxic): for each part and label, the documents that survive each subset, an array of 32 counts."""

    def fn(batches):
        for b in batches:
            words, times = WORDS[b.column("mask").to_numpy()], b.column("n").to_numpy()
            of = {"every": np.ones(len(words), bool), "good": b.column("good").to_numpy(zero_copy_only=False), "toxic": b.column("toxic").to_numpy(zero_copy_only=False)}
            codes = b.column("part").dictionary_encode()
            own = codes.indices.to_numpy()
            order = np.argsort(own, kind="stable")
            ends = np.searchsorted(own[order], np.arange(len(codes.dictionary) + 1))
            for i, part in enumerate(codes.dictionary.to_pylist()):
                at = order[ends[i] : ends[i + 1]]
                got = [positional_popcount(words[at[of[c][at]]], times[at[of[c][at]]]) for c in CLASSES]
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.string()), *(pa.array([g], pa.list_(pa.int64())) for g in got)], names=["part", *CLASSES])

    parts = counted.select("part", "mask", "n", "good", "toxic").mapInArrow(fn, "part string, " + ", ".join(f"{c} array<long>" for c in CLASSES))
    sums = [F.sum(F.col(c)[s]).alias(f"{c}{s}") for c in CLASSES for s in range(SUBSETS)]
    wide = parts.groupBy("part").agg(*sums)
    return wide.select("part", *(F.array(*(f"{c}{s}" for s in range(SUBSETS))).alias(c) for c in CLASSES))


def steps(spark) -> DataFrame:
    """All orders of the filters, step by step (600 rows): the filter's bit and the subset applied before."""
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[f] for f in order), 0
        for i, f in enumerate(order):
            rows.append((name, i + 1, 1 << f, before))
            before |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, bit int, before int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """What each filter does at each step of each order, in every part."""
    at = lambda c, s: F.element_at(c, s + 1)  # noqa: E731  (element_at counts from 1)
    count = survivors(masks(docs, labels))
    bit, before = F.col("bit"), F.col("before")
    after = before.bitwiseOR(bit)
    failing = at("every", F.lit(0)) - at("every", bit)
    lost = lambda c: at(c, before) - at(c, after)
    others = F.lit(ALL).bitwiseXOR(bit)
    n = len(FILTERS)
    # orders in which just the filters of s come before f: |s|! (4 - |s|)!
    shares = [F.when(bit == 1 << f, sum((F.lit(factorial(bin(s).count("1")) * factorial(n - 1 - bin(s).count("1"))) * (at("every", F.lit(s)) - at("every", F.lit(s | 1 << f))) for s in range(SUBSETS) if not s >> f & 1), F.lit(0))) for f in range(n)]
    counted = count.select("*", F.explode(F.array(*(F.struct(F.lit(o).alias("filter_order")) for o in ("".join(p) for p in permutations(FILTERS))))).alias("o"))
    rows = counted.join(F.broadcast(steps(docs.sparkSession)), F.col("o.filter_order") == F.col("filter_order"))
    long = lambda x, name: x.cast("long").alias(name)
    return rows.select(
        "part",
        "filter_order",
        "step",
        long(at("every", after), "kept"),
        long(lost("every"), "removed"),
        long(failing - lost("every"), "redundant"),
        long(at("every", others) - at("every", F.lit(ALL)), "unique_fails"),
        long(lost("good"), "good_lost"),
        long(lost("toxic"), "toxic_lost"),
        long(F.coalesce(*shares), "shapley"),
    )
