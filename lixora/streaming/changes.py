"""File changes and SBOM documents as streams. Every function takes a batch or a streaming DataFrame unless it says."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lixora.operators import sbom
from lixora.operators.shared import shared_path
from lixora.sources.files import LOCKS, PRUNED, in_any, language_of, name_of

#: Runs of events without a gap that one fold takes.
RUNS = 1_000
TRIGGER = "root_id long, opened_at timestamp, event_id long"


def relevant_changes(events: DataFrame) -> DataFrame:
    """Changes of manifests and lock files outside pruned directories."""
    path = F.col("path")
    return events.where(~in_any(path, PRUNED) & (language_of(path).isNotNull() | name_of(path).isin(LOCKS)))


def windows_of(rows: pd.DataFrame, ms: int, end=None) -> tuple[list[tuple], object]:
    """(opened_at, event_id) of each window: the first event opens it, those within ms are swallowed."""
    out = []
    for ts, event_id in rows.sort_values(["ts", "event_id"])[["ts", "event_id"]].itertuples(index=False):
        if end is None or ts >= end:
            out.append((ts, event_id))
            end = ts + pd.Timedelta(milliseconds=ms)
    return out, end


def debounce(events: DataFrame, ms: int = 500, watermark: str = "10 seconds") -> DataFrame:
    """(root_id, opened_at, event_id): one trigger per fixed window of ms, opened by the first event of a root.

    Streams keep the end of the open window per root as state, which goes when event time has passed it by the
    watermark (a timer; the session's state store becomes RocksDB); events later than the watermark are dropped. A batch is folded in order of time, per root and stretch of
    runs without a gap of ms: a fold holds as many events as a root has without such a gap.
    """
    schema = TRIGGER

    if not events.isStreaming:
        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            opened, _ = windows_of(pdf, ms)
            return pd.DataFrame({"root_id": pdf["root_id"].iloc[0], "opened_at": [o for o, _ in opened], "event_id": [i for _, i in opened]})

        events = events.select("root_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
        in_order = Window.partitionBy("root_id").orderBy("ts", "event_id")
        # an event at least ms after the one before opens a window for sure, so runs between such gaps fold apart
        gap = F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(in_order) >= ms * 1000
        runs = events.withColumn("run", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(in_order))
        return runs.groupBy("root_id", F.floor(F.col("run") / RUNS)).applyInPandas(fold, schema)

    with_timers(events.sparkSession)
    late = events.select("root_id", F.col("ts").cast("timestamp").alias("ts"), "event_id").withWatermark("ts", watermark)
    return late.groupBy("root_id").transformWithStateInPandas(OpenWindow(ms), outputStructType=T._parse_datatype_string(schema), outputMode="append", timeMode="eventTime")


STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_timers(spark: SparkSession) -> None:
    """State with timers lives in RocksDB: a session that names no other store is told so."""
    if not spark.conf.get(STORE).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(STORE, ROCKS)


class OpenWindow(StatefulProcessor):
    """Per root, the end of the window that is open; a timer drops it when event time has passed that."""

    def __init__(self, ms: int):
        self.ms = ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.end = handle.getValueState("end", "end_us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.end.get()
        end = pd.Timestamp(held[0], unit="us") if held is not None else None
        opened, last = windows_of(pd.concat(list(rows)), self.ms, end)
        if opened:
            if end is not None:
                self.handle.deleteTimer(timer_ms(end))
            self.end.update((int(last.value // 1_000),))
            self.handle.registerTimer(timer_ms(last))
        yield pd.DataFrame({"root_id": pd.Series([key[0]] * len(opened), dtype="int64"), "opened_at": pd.Series([o for o, _ in opened], dtype="datetime64[ns]"), "event_id": pd.Series([i for _, i in opened], dtype="int64")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.end.get()
        if held is not None and timer_ms(pd.Timestamp(held[0], unit="us")) <= expiredTimerInfo.getExpiryTimeInMs():
            self.end.clear()
        yield pd.DataFrame({"root_id": pd.Series(dtype="int64"), "opened_at": pd.Series(dtype="datetime64[ns]"), "event_id": pd.Series(dtype="int64")})

    def close(self) -> None:
        pass


def timer_ms(end: pd.Timestamp) -> int:
    """The first whole millisecond at which a window is over."""
    return -(-end.value // 1_000_000)


def continuous_scan(triggers: DataFrame, scan: Callable[[DataFrame], None], checkpoint: str, failed: Callable[[int, Exception], None] | None = None):
    """Start a query that calls scan(roots) for the roots of each micro-batch; a failing batch is reported, the stream goes on."""

    def one(batch: DataFrame, epoch: int) -> None:
        try:
            scan(batch.select("root_id").distinct())
        except Exception as e:
            if failed is None:
                raise
            failed(epoch, e)

    return triggers.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()


LEDGER = "epoch long, rows long, error string"


def scan_into(path: str, scan: Callable[[DataFrame], DataFrame], isolate: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch that keeps scan(batch) of each micro-batch under path, each once.

    What a batch gives is written to a folder of its epoch, in place of what an attempt before may have left there,
    and then entered in a ledger. An epoch of the ledger isn't run again, and rows of an epoch that isn't in it aren't read
    (``scanned``), so a batch that broke off anywhere and comes again counts once. A scan that fails ends the stream, which may
    be started again; with ``isolate`` it is entered with its error and no rows, and the stream goes on.
    """

    def one(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        if epoch in epochs(spark, path):
            return
        error = None
        batch.persist()
        try:
            scan(batch).write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        except Exception as e:
            if not isolate:
                raise
            error = f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}"
        finally:
            batch.unpersist()
        count = 0 if error else spark.read.parquet(f"{path}/rows/epoch={epoch}").count()
        spark.createDataFrame([(epoch, count, error)], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/entry={epoch}")

    return one


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """(epoch, rows, error) of every finished batch under path."""
    try:
        return spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{path}/ledger")
    except AnalysisException:  # no batch has finished
        return spark.createDataFrame([], LEDGER)


def epochs(spark: SparkSession, path: str) -> set[int]:
    """Finished batches; one number a batch."""
    return {r["epoch"] for r in ledger(spark, path).select("epoch").collect()}


def scanned(spark: SparkSession, path: str) -> DataFrame:
    """What finished batches have kept under path, with their epoch; only their folders are read."""
    kept = [r["epoch"] for r in ledger(spark, path).where("error is null").collect()]
    if not kept:
        raise ValueError(f"no batch has finished under {path}")
    return spark.read.option("basePath", f"{path}/rows").parquet(*[f"{path}/rows/epoch={e}" for e in sorted(kept)])


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what its source holds now and give what it has written, as a table in the shared folder."""
    spark = stream.sparkSession
    at = shared_path(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, gap: str | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Events per kind in tumbling windows, sliding ones (slide), or sessions per kind (gap)."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    w = F.session_window("ts", gap) if gap else F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.groupBy(w.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def ingest_sbom_stream(docs: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Components of documents (doc_id, json, ts), each document hash and position once within the watermark."""
    keyed = docs.withColumn("doc_hash", F.sha2("json", 256)).withWatermark("ts", watermark)
    first = keyed.dropDuplicatesWithinWatermark(["doc_hash"]) if docs.isStreaming else keyed.withColumn("_n", F.row_number().over(Window.partitionBy("doc_hash").orderBy("ts", "doc_id"))).where("_n = 1").drop("_n")
    return sbom.ingest_sboms(first)
