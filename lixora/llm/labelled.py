"""A bounded, repeatable sample of labelled documents as features, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labelled (or unlabelled) documents that a model is fitted on at most.
MOST_TRAINING = 12_000


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """At most ``most`` rows of (doc_id, ...), those whose ids hash lowest."""
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def features(docs: DataFrame, chosen: DataFrame, of_text: Callable[[str], np.ndarray], columns: list[str]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Columns of ``chosen`` and a feature array of each chosen document's whole text, in order of doc_id.

    chosen is a bounded sample (see MOST_TRAINING; 16 bytes a row), so it is broadcast; the texts stay put, and
    what reaches the driver are the features of the sample. Of a doc_id with several texts, that of the smallest hash
    is read; the sample so bounds rows, whatever ids repeat.
    """
    dtype = of_text("").dtype
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    one = docs.select("doc_id", "text_key").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *columns).agg(F.min("text_key").alias("text_key"))

    def fn(batches):
        for b in batches:
            got = [of_text(t.as_py() or "").tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ["doc_id", *columns]), pa.array(got, pa.binary())], names=["doc_id", *columns, "features"])

    texts = docs.join(F.broadcast(one), ["doc_id", "text_key"]).select("doc_id", *columns, "text")
    schema = ", ".join(["doc_id long", *(f"{c} int" for c in columns), "features binary"])
    rows = texts.mapInArrow(fn, schema).dropDuplicates(["doc_id"]).toArrow().sort_by([("doc_id", "ascending")])
    return {c: rows.column(c).to_numpy() for c in columns}, [np.frombuffer(x.as_py(), dtype) for x in rows.column("features")]


def split_text_scores(docs: DataFrame, score: Callable[[], Callable[[list[str]], np.ndarray]], held_out, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row. score() runs once a task and gives texts -> scores."""

    def fn(batches):
        scores = score()
        for b in batches:
            got = scores([t.as_py() or "" for t in b.column("text")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(got, pa.float64()), pa.array((got >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(fn, "doc_id long, held_out boolean, score double, predicted int")
