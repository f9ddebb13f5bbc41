"""Places in an order of a whole table, without a window that one task must hold."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.operators.shared import quoted, shared_path

#: monotonically_increasing_id counts a partition's rows in its lower bits.
BITS = 33


def ranked(df: DataFrame, *order: Column, name: str = "place") -> DataFrame:
    """df with the place (from 1) of each row in an order; rows that are equal in it get places next to each other.

    Rows are cut into ranges of the order, and sorted and numbered within them; the ranges are counted, and a row's place
    is its number plus the counts of the ranges before. A number drawn for each row comes last in the order, so that
    many equal rows make several ranges. The sorted table is written once; one row for each range reaches the
    driver.
    """
    spark = df.sparkSession
    own, drawn, at, part = [F.col(quoted(c)) for c in df.columns], f"_d{uuid.uuid4().hex}", f"_a{uuid.uuid4().hex}", f"_p{uuid.uuid4().hex}"
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(*own, F.monotonically_increasing_id().alias(drawn))
    sorted_ = rows.repartitionByRange(ranges, *order, F.col(drawn)).sortWithinPartitions(*order, F.col(drawn))
    path = shared_path(spark, "ranked")
    sorted_.select(*own, F.monotonically_increasing_id().alias(at)).write.parquet(path)
    table = spark.read.parquet(path).withColumn(part, F.shiftright(at, BITS))
    counts = sorted((r[part], r["count"]) for r in table.groupBy(part).count().collect())
    before, total = [], 0
    for number, count in counts:
        before.append((number, total))
        total += count
    starts = spark.createDataFrame(before, f"{part} long, _before long")
    place = F.col("_before") + F.col(at).bitwiseAND(F.lit((1 << BITS) - 1)) + 1
    return table.join(F.broadcast(starts), part).select(*own, place.alias(name))  # one row a range is broadcast
