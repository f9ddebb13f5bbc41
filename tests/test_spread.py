"""Tables in one piece whose rows make much work."""

from lixora.operators import shared
from lixora.plans import manifests as plans
from lixora.plans.sboms import FOREIGN_SPDX, foreign
from lixora.sources import manifests


def tasks(df):
    return df.rdd.getNumPartitions()


def test_rows_of_one_piece_are_spread(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "A_TASK", 20)
    assert tasks(shared.spread(spark.range(0, 100, 1, 1))) == 6
    assert tasks(plans.files(spark, sf, "a", "'x'")) > 4
    assert tasks(plans.files_of(spark, sf, {"a": ["'x'"]})) > 4
    assert tasks(foreign(spark, sf, FOREIGN_SPDX)[0]) > 4
    monkeypatch.setattr(shared, "MOST_TASKS", 3)
    assert tasks(shared.spread(spark.range(0, 100, 1, 1))) == 3


def test_lock_files_are_parsed_once(spark):
    lock = '[[package]]\nname = "own"\nversion = "1"\ndependencies = ["a"]\n[[package]]\nname = "a"\nversion = "2"\nsource = "registry"\n'
    files = spark.createDataFrame([(1, "Cargo.lock", lock)], "root long, path string, content string")
    made = manifests.cargo_graph(files)
    assert [tuple(r) for r in made.select("src", "dst").collect()] == [("own@1", "a@2")]
    assert "Arrow" not in made._jdf.queryExecution().executedPlan().toString()
