"""Columns of any name pass through the filtering stages; archives don't share folders."""

import pytest
from pyspark.sql import functions as F

from lixora.llm import decontamination, ngram_join, secrets, toxicity, warc

TEXT = "the quick brown fox jumps over the lazy dog near the old river bank"
ODD = ["a.b", "x`y", "a b", "c0", "doc", "spans", "label.text"]


def odd_docs(spark):
    rows = [(1, TEXT), (2, TEXT), (3, "password = abcdef123456ABC and more"), (4, None), (5, "plain clean words of no meaning at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in ODD]).repartition(2)


def stages(spark):
    labels = spark.createDataFrame([(5, 0), (3, 1)], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, TEXT)], "item_id long, text string")
    return {
        "toxic": lambda d: toxicity.reject_toxic(d, labels, threshold=2.0),
        "copies": ngram_join.one_of_each,
        "leaks": lambda d: decontamination.decontaminate(d, bench),
        "secrets": secrets.redact,
    }


def test_columns_of_odd_names_stay(spark):
    docs = odd_docs(spark)
    left = {"toxic": {1, 2, 3, 4, 5}, "copies": {1, 3, 4, 5}, "leaks": {3, 4, 5}, "secrets": {1, 2, 3, 4, 5}}
    for name, stage in stages(spark).items():
        got = stage(docs)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema], name
        rows = got.collect()
        assert {r["doc_id"] for r in rows} == left[name], name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in ODD), name


def test_columns_of_one_name_are_refused(spark):
    docs = odd_docs(spark).select("doc_id", "text", F.lit(1).alias("twice"), F.lit(2).alias("Twice"))
    for name, stage in stages(spark).items():
        with pytest.raises(ValueError, match="columns of one name: twice"):
            stage(docs).collect()


def test_archives_spare_foreign_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], "page_id long, url string, html string")
    (tmp_path / "kept").mkdir()
    (tmp_path / "kept" / "notes.txt").write_text("mine")
    with pytest.raises(ValueError, match="isn't empty"):
        warc.write_archives(pages, f"file://{tmp_path}/kept")
    assert (tmp_path / "kept" / "notes.txt").read_text() == "mine"
    (tmp_path / "empty").mkdir()
    warc.write_archives(pages, f"file://{tmp_path}/empty")
    assert warc.captures(spark, f"file://{tmp_path}/empty").count() == 1
    with pytest.raises(ValueError, match="isn't empty"):
        warc.write_archives(pages, f"file://{tmp_path}/empty")
