"""Classes of many blocks in the n-gram Jaccard join: a set that goes to many groups is sent on bit by bit."""

from itertools import islice

import pyarrow as pa

from lixora.llm import ngram_join

SCHEMA = pa.schema([("part", pa.int64()), ("group", pa.int64()), ("node", pa.int64()), ("label", pa.int64()), ("hashes", pa.binary())])


def test_batches_are_bounded_by_bytes():
    """A set of 1 MB in a million groups would be a terabyte at once."""
    made = []

    def rows():
        for g in range(1_000_000):
            made.append(g)
            yield g, g, 1, 1, bytes(1_000_000)

    few = list(islice(ngram_join.in_batches(rows(), SCHEMA, 8_000_000), 3))
    assert [b.num_rows for b in few] == [8, 8, 8] and max(b.nbytes for b in few) < 9_000_000 and len(made) == 24
    narrow = list(ngram_join.in_batches(((g, g, 1, 1, b"x") for g in range(1_000)), SCHEMA, 10_000))
    assert sum(b.num_rows for b in narrow) == 1_000 and len(narrow) > 9
    assert list(ngram_join.in_batches(iter(()), SCHEMA, 10)) == []


def test_links_are_the_same_in_small_batches(spark, monkeypatch):
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:50], *(f"x{d}y{j}" for j in range(d % 5))]) for d in range(40)] + [" ".join(f"own{d}z{j}" for j in range(30)) for d in range(10)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    found = lambda: sorted(map(tuple, ngram_join.jaccard_components(docs).collect()))
    whole = found()
    monkeypatch.setattr(ngram_join, "BATCH_BYTES", 500)
    monkeypatch.setattr(ngram_join, "MOST_SETS", 4)
    assert found() == whole and len({c for _, _, c, _ in whole}) == 11
