"""The pipeline on a small table, stage by stage, against plain Python."""

import corpus_pipeline
from lixora.llm import queries
from lixora.llm.common import table
from tests.llm.test_small_cases import jaccard_brute

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "benchmark_decontamination", "secret_scans", "best_fit_packing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    clean = corpus_pipeline.reject_toxic(spark, docs, SF).cache()
    assert clean.columns == columns and 0 < clean.count() <= docs.count()
    rows = [(r["doc_id"], r["text"]) for r in clean.collect()]
    one = corpus_pipeline.drop_near_copies(spark, clean, SF).cache()
    assert sorted(r["doc_id"] for r in one.collect()) == sorted({c for _, _, c in jaccard_brute(rows, 5, 80, 100)})
    left = corpus_pipeline.drop_benchmark_leaks(spark, one, SF).cache()
    items = [" ".join(r["text"].split()) for r in table(spark, SF, "benchmark").collect()]
    whole = {r["doc_id"] for r in one.collect() if any(i in " ".join(r["text"].split()) for i in items)}
    assert whole and not whole & {r["doc_id"] for r in left.collect()}
    blank = corpus_pipeline.blank_secrets(spark, left, SF)
    assert blank.columns == columns and blank.count() == left.count()
    packed = corpus_pipeline.pack_sequences(spark, blank, SF)
    assert packed.select("doc_id").distinct().count() == left.count()


def test_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {q.split("_")[0] for q in queries.QUERIES}


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated ids and rows, empty and long texts, columns with clashing names; then no rows."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, doc string, _cuts string, node long, found int, first_id long"
    long = " ".join(f"word{i % 977}x{i % 13}" for i in range(30_000))
    copy = " ".join(f"same{i}" for i in range(60))
    item = " ".join(f"item{i}" for i in range(20))
    texts = [(1, None), (2, ""), (3, "plain text"), (3, "plain text"), (3, "other text with the same id"), (None, "no id here"), (None, None), (4, long), (5, copy), (6, copy + " end"), (7, f"before {item} after"), (8, "token=abcdefghijklmnop123 x"), (9, " \n\t ")]
    rows = [(i, t, None, "s", None if t is None else len(t), "d", "c", 1, 2, 3) for i, t in texts]
    for name, keep in (("some", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(keep, schema).repartition(3).write.parquet(f"{at}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (3, None, 0), (None, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None), (None, "a")], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
        docs = table(spark, at, "documents")
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, at).cache()
            assert [(f.name, f.dataType) for f in docs.schema] == [(f.name, f.dataType) for f in table(spark, at, "documents").schema]
        got = sorted(((r["doc_id"], r["text"], r["n_chars"]) for r in docs.collect()), key=repr)
        want = {(i, t, None if t is None else len(t)) for i, t in texts if i not in (6, 7, 8)} | {(8, "[SECRET] x", 10)}
        assert got == (sorted(want, key=repr) if keep else [])
        packed = corpus_pipeline.run(spark, at).collect()
        assert len({(r["doc_id"], r["ids_crc32"]) for r in packed if r["piece"] == 0}) == (len(want) if keep else 0)
