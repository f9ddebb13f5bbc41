"""Line-oriented files: numbered lines, carried sections, deb822 records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, line) of each line; pos from 0."""
    return files.select(*keys, F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line"))


def carry_forward(rows: DataFrame, keys: list[str], order: str, value: Column, name: str) -> DataFrame:
    """The last non-null value up to each row, per keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def deb822(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, stanza, pos, name, value): the fields of each stanza in order, repeated names kept.

    Lines that begin with # are comments; a line that begins with a blank goes on with the field above, a lone
    dot there is an empty line; blank lines end a stanza.
    """
    lines = numbered_lines(files, keys).where(~F.startswith("line", F.lit("#")))
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blank = F.trim("line") == ""
    goes_on = F.col("line").rlike(r"^[ \t]") & ~blank
    opens = F.col("line").rlike(r"^[^\s:]+:")
    rows = lines.withColumns({"stanza": F.sum(blank.cast("int")).over(w), "field": F.sum((opens & ~goes_on).cast("int")).over(w)}).where(~blank & (goes_on | opens) & (F.col("field") > 0))
    text = F.when(goes_on, F.when(F.trim("line") == ".", "").otherwise(F.trim("line"))).otherwise(F.trim(F.regexp_replace("line", "^[^:]*:", "")))
    rows = rows.select(*keys, "stanza", "field", "pos", F.when(opens & ~goes_on, F.regexp_extract("line", "^([^:]+):", 1)).alias("name"), text.alias("text"))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    fields = rows.groupBy(*keys, "stanza", "field").agg(F.min("pos").alias("pos"), F.max("name").alias("name"), F.array_join(F.transform(parts, lambda p: p["text"]), "\n").alias("value"))
    return fields.select(*keys, "stanza", "pos", "name", F.regexp_replace("value", "^\n", "").alias("value"))


def field(fields: DataFrame, keys: list[str], *names: str) -> DataFrame:
    """One row per stanza with the first value of each named field (any case)."""
    first = [F.min_by("value", F.when(F.lower("name") == n.lower(), F.col("pos"))).alias(n) for n in names]
    return fields.groupBy(*keys, "stanza").agg(*first)
