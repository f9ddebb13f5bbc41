"""Lempel-Ziv phrase fingerprints.

A text is read as words with the white space behind them. It is parsed as LZ78 does: the next phrase is the
longest phrase known so far plus one more word, and joins the dictionary. The hashes of its phrases make a
set; a fingerprint is the set's minimum under each of ``SLOTS`` hash functions, 16 bits each, in hex. The
share of equal slots estimates the Jaccard similarity of two phrase sets, which is high where one text helps
to compress the other. Equal texts have equal fingerprints.

Null text: empty; an empty text has the fingerprint of the empty set, alike to itself alone. The document after
the last one is the first. Rows that repeat a doc_id are ordered by text; null ids come first. Extra columns
are ignored; an empty table gives no rows; a single document is its own next.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lixora.llm.common import GOLD, WordHashes, mixed, partitions_for, saved

SLOTS = 128
#: Documents in one range of ids, on average; only the first row of a range travels twice. Quantiles that reach the driver;
#: beyond, the ids between two of them are cut into ranges of equal width, as many as their count asks for.
RANGE, MOST_CUTS = 1_500, 20_000
#: First ids of ranges that are broadcast (16 bytes each); more are joined by a shuffle.
MOST_BROADCAST = 1_000_000
#: Tasks that ranges are dealt to at most; a task streams its ranges.
MOST_TASKS = 100_000
SYMBOLS = re.compile(r"\S+\s*|\s+")
SCALE = np.random.default_rng(20).integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFT = np.random.default_rng(21).integers(0, 2**63, SLOTS, dtype=np.uint64)
MASK = 2**64 - 1


def phrase_hashes(symbols: list[int]) -> np.ndarray:
    """Hashes of the LZ78 phrases of a sequence of symbols: a phrase is (hash of the phrase before, symbol)."""
    known: set[int] = set()
    add = known.add
    node = 0
    for s in symbols:
        node = (node * 0x9E3779B97F4A7C15 + s) & MASK
        if node not in known:
            add(node)
            node = 0
    if node:
        add(node ^ 1)  # the text ended inside a known phrase
    return np.fromiter(known, np.uint64, len(known))


def slots(phrases: np.ndarray) -> np.ndarray:
    if not len(phrases):
        return np.zeros(SLOTS, np.uint16)
    least = np.full(SLOTS, MASK, np.uint64)
    h = mixed(phrases)
    for at in range(0, len(h), 2048):  # blocks that stay in the cache
        np.minimum(least, (h[at : at + 2048, None] * SCALE + SHIFT).min(axis=0), out=least)
    return (mixed(least * GOLD) >> np.uint64(48)).astype(">u2")


def fingerprint(text: str, words_of: WordHashes) -> np.ndarray:
    return slots(phrase_hashes([words_of[w] for w in SYMBOLS.findall(text)]))


def edited(text: str, after: str) -> str:
    """text with its last half replaced by the start of the next document."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _parts(docs: DataFrame, size: int, most_cuts: int) -> DataFrame:
    """docs with cut and part: ranges of ids in order, of about ``size`` rows each, however many that makes."""
    ranges = max(1, docs.count() // size)
    cut = min(ranges, most_cuts)
    cuts = docs.select("place").approxQuantile("place", [i / cut for i in range(1, cut)], 0.2 / cut) if cut > 1 else []
    cutter = Bucketizer(splits=[-math.inf, *sorted({*cuts, -math.ulp(0.0)}), math.inf], inputCol="place", outputCol="cut")
    placed = cutter.transform(docs).withColumn("cut", F.col("cut").cast("long"))
    if ranges <= most_cuts:
        return placed.withColumn("part", F.col("cut"))
    about = saved(placed.groupBy("cut").agg(F.min("place").alias("low"), F.max("place").alias("high"), F.greatest(F.lit(1), F.floor(F.count("*") / size)).alias("ranges")), "cuts")
    within = F.floor((F.col("place") - F.col("low")) / (F.col("high") - F.col("low") + 1) * F.col("ranges"))
    placed = placed.join(F.broadcast(about), "cut")  # a row for each cut
    return placed.withColumn("part", F.shiftleft("cut", 32) + F.least(within, F.col("ranges") - 1)).drop("low", "high", "ranges")


def _before(starts: DataFrame) -> DataFrame:
    """(start, before): the first id of each range but the first, and the range before. starts(cut, part, start)."""
    in_cut = F.lag("part").over(Window.partitionBy("cut").orderBy("part"))
    lasts = [(r["cut"], r["last"]) for r in starts.groupBy("cut").agg(F.max("part").alias("last")).orderBy("cut").collect()]  # a row for each cut
    ahead = starts.sparkSession.createDataFrame([(c, last) for (c, _), (_, last) in zip(lasts[1:], lasts)], "cut long, last long")
    rows = starts.withColumn("near", in_cut).join(F.broadcast(ahead), "cut", "left")
    return rows.select("start", F.coalesce("near", "last").alias("before")).where("before is not null")


def fingerprints(docs: DataFrame, size: int = RANGE, most_cuts: int = MOST_CUTS) -> DataFrame:
    """Fingerprint of each text and of its edited form, and how near it is to that and to the next document.

    Ids are cut into ranges; a range's first document is also sent to the range before, so each range is one ordered
    stream and no more than two documents are held at a time. The last document's next is the first.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spark = docs.sparkSession
    rank = F.coalesce("doc_id", F.lit(-(2**63)))
    docs = docs.withColumn("place", rank.cast("double"))
    if docs.isEmpty():
        return spark.createDataFrame([], SCHEMA)
    placed = _parts(docs, size, most_cuts)
    starts = saved(placed.groupBy("cut", "part").agg(F.min(rank).alias("start")), "starts")
    first, last = starts.agg(F.min("start"), F.max("part")).first()
    heads = saved(_before(starts).unionByName(spark.createDataFrame([(first, last)], "start long, before long")), "heads")
    count = heads.count()
    heads = F.broadcast(heads) if count <= MOST_BROADCAST else heads
    again = placed.join(heads, rank == F.col("start")).select("doc_id", "text", F.col("before").alias("part"), F.lit(True).alias("after"))
    rows = placed.select("doc_id", "text", "part", F.lit(False).alias("after")).unionByName(again)
    rows = rows.repartition(max(partitions_for(spark), min(count // 3, MOST_TASKS)), "part").sortWithinPartitions("part", "after", "doc_id", "text")
    schema = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])

    def fn(batches):
        words_of = WordHashes()
        part = doc = own = None
        done = False
        for b in batches:
            out = []
            for i in range(b.num_rows):
                p, after = b.column("part")[i].as_py(), b.column("after")[i].as_py()
                if p == part and done:
                    continue  # other rows with the first id of the next range
                text, doc_id = b.column("text")[i].as_py(), b.column("doc_id")[i].as_py()
                print_ = fingerprint(text, words_of)
                if p == part:
                    changed = edited(doc[1], text)
                    other = fingerprint(changed, words_of)
                    out.append((doc[0], len(doc[1]), hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest(), own.astype(">u2").tobytes().hex(), other.astype(">u2").tobytes().hex(), likeness(own, other), likeness(own, print_)))
                part, doc, own, done = p, (doc_id, text), print_, after
            if out:
                yield pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*out))), schema=schema)

    return rows.mapInArrow(fn, SCHEMA)
