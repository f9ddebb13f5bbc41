"""An inventory of findings that is kept from scan to scan: only what changed is read and written again.

Findings lie in buckets of their root. A change of some roots rewrites their buckets: rows of other roots are carried
over, those of the changed roots come from the new scan, and what that doesn't find is gone. Each change writes folders of
its own and enters them in a ledger at the end, so a change that breaks off leaves the inventory as it was and may be made
again under its number.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lixora.operators.shared import quoted, small

BUCKETS = 64
LEDGER = "number long, bucket int, rows long"


def bucket_of(root: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(root.cast("string")), F.lit(buckets)).cast("int")


def _newest(spark: SparkSession, path: str, before: int | None = None) -> dict[int, tuple[int, int]]:
    """bucket -> (number of the change that wrote it last, its rows); at most one entry a bucket reaches the driver."""
    try:
        entries = spark.read.schema(LEDGER).option("recursiveFileLookup", True).parquet(f"{path}/ledger")
    except AnalysisException:  # nothing has been kept yet
        return {}
    if before is not None:
        entries = entries.where(F.col("number") < before)
    newest = entries.groupBy("bucket").agg(F.max_by(F.struct("number", "rows"), "number").alias("x"))
    return {r["bucket"]: (r["x"]["number"], r["x"]["rows"]) for r in newest.collect()}


def _read(spark: SparkSession, path: str, of: dict[int, tuple[int, int]]) -> DataFrame | None:
    folders = [f"{path}/rows/number={n}/bucket={b}" for b, (n, rows) in sorted(of.items()) if rows]
    return spark.read.parquet(*folders) if folders else None


def merge_changes(path: str, number: int, roots: DataFrame, findings: DataFrame, key: str = "root", buckets: int = BUCKETS) -> None:
    """Put findings in place of all that the inventory under path holds of ``roots`` (one column, named key).

    number: of the change, larger than those before; the same number again replaces the change. findings of other roots
    are an error of the caller and left out. The count of buckets is that of the first change.
    """
    spark = roots.sparkSession
    roots = roots.select(F.col(quoted(key)).alias(key)).distinct()
    touched = sorted(r[0] for r in roots.select(bucket_of(F.col(quoted(key)), buckets)).distinct().collect())
    if not touched:
        return
    known = _newest(spark, path, number)
    changed = small(roots)
    rows = findings.join(changed, key, "left_semi")
    old = _read(spark, path, {b: known[b] for b in touched if b in known})
    if old is not None:
        rows = rows.unionByName(old.select(*[quoted(c) for c in findings.columns]).join(changed, key, "left_anti").select(*[F.col(quoted(c)) for c in findings.columns]))
    at = f"{path}/rows/number={number}"
    dealt = rows.withColumn("bucket", bucket_of(F.col(quoted(key)), buckets))
    dealt.repartition(max(len(touched), int(spark.conf.get("spark.sql.shuffle.partitions"))), key).write.mode("overwrite").partitionBy("bucket").parquet(at)
    held = {r["bucket"]: r["count"] for r in spark.read.schema(dealt.schema).parquet(at).groupBy("bucket").count().collect()}
    spark.createDataFrame([(number, b, held.get(b, 0)) for b in touched], LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{path}/ledger/entry={number}")


def inventory(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The findings that are kept under path; schema: of an inventory that may still be empty."""
    rows = _read(spark, path, _newest(spark, path))
    if rows is None:
        if schema is None:
            raise ValueError(f"nothing is kept under {path}")
        return spark.createDataFrame([], schema)
    return rows
