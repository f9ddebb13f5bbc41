"""Sinks that keep each batch once, timers, and inventories that are kept from scan to scan."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lixora.streaming import changes, inventory


def stream_of(spark, path, *parts):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "event_id long, ts timestamp, root_id long").coalesce(1).write.parquet(f"{path}/{i}")
    return spark.readStream.schema("event_id long, ts timestamp, root_id long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_windows_outlive_batches_and_end_by_timers(spark, tmp_path):
    parts = [[(0, at(0), 1), (1, at(2), 1), (2, at(3), 2)], [(3, at(4.9), 1), (4, at(5), 1), (5, at(9), 2)], [(6, at(100), 3)], [(7, at(200), 1), (8, at(201), 1), (9, at(1), 2)]]
    q = changes.debounce(stream_of(spark, str(tmp_path / "in"), *parts), ms=5_000, watermark="10 seconds")
    run = q.writeStream.format("memory").queryName("opened").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("opened").collect()) == [0, 2, 4, 5, 6, 7]  # 9 is too late
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 4  # ends and timers of roots 1 and 3; that of root 2 is gone


@pytest.mark.parametrize("isolate", [False, True])
def test_each_batch_is_kept_once(spark, tmp_path, isolate):
    parts = [[(i, at(i), i % 3) for i in range(k, k + 10)] for k in (0, 10, 20)]
    stream, seen, path = stream_of(spark, str(tmp_path / "in"), *parts), [], f"{tmp_path}/kept"

    def scan(batch):
        seen.append(sorted(r["event_id"] for r in batch.collect()))
        broken = len(seen) == 2
        return batch.select("event_id").where(F.when(F.lit(broken) & (F.col("event_id") == 15), F.raise_error(F.lit("lost")).cast("boolean")).otherwise(True))

    def run():
        stream.writeStream.foreachBatch(changes.scan_into(path, scan, isolate)).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(ValueError):
        changes.scanned(spark, path)
    if isolate:
        run()
        assert sorted(r["event_id"] for r in changes.scanned(spark, path).collect()) == [*range(10), *range(20, 30)]
        assert [(r["epoch"], r["rows"], bool(r["error"])) for r in changes.ledger(spark, path).orderBy("epoch").collect()] == [(0, 10, False), (1, 0, True), (2, 10, False)]
        return
    with pytest.raises(StreamingQueryException):
        run()
    assert sorted(r["event_id"] for r in changes.scanned(spark, path).collect()) == list(range(10))
    run()
    assert sorted(r["event_id"] for r in changes.scanned(spark, path).collect()) == list(range(30))
    assert seen[1] == seen[2] and len(seen) == 4
    changes.scan_into(path, scan)(spark.createDataFrame(parts[0], "event_id long, ts timestamp, root_id long"), 0)  # comes again: no second time
    assert changes.scanned(spark, path).count() == 30 and len(seen) == 4


def test_a_kept_inventory_equals_a_full_scan(spark, tmp_path):
    import random

    rnd = random.Random(4)
    path, world = f"{tmp_path}/inv", {r: {rnd.randint(0, 30) for _ in range(5)} for r in range(40)}
    rows = lambda roots: spark.createDataFrame([(r, p, "x") for r in roots for p in world[r]], "root long, pkg long, `a.b` string")
    schema = rows(range(40)).schema
    assert inventory.inventory(spark, path, schema).count() == 0
    inventory.merge_changes(path, 0, rows(range(40)).select("root"), rows(range(40)))
    for number in (1, 2, 3):
        changed = rnd.sample(range(45), 3)
        for attempt in range(2):  # the second one replaces the first
            for r in changed:
                world[r] = {rnd.randint(0, 30) for _ in range(rnd.choice([0, 5]))}
            inventory.merge_changes(path, number, spark.createDataFrame([(r,) for r in changed], "root long"), rows(changed))
        assert {(r["root"], r["pkg"]) for r in inventory.inventory(spark, path).collect()} == {(r, p) for r in world for p in world[r]}
    touched = {r[0] for r in spark.createDataFrame([(r,) for r in changed], "root long").select(inventory.bucket_of(F.col("root"))).collect()}
    read = [f for f in inventory.inventory(spark, path).inputFiles() if "number=3" in f]
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in read} <= touched and len(touched) <= 3
