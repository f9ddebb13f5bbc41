"""Pieces that several operators share: tables cut from their lineage, and broadcasts of a checked size."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a reference or verdict table that are broadcast at most.
MOST_BROADCAST = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a local session without one gets its own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        at = tempfile.mkdtemp(prefix="lixora-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's part of the shared folder."""
    return f"{shared_folder(spark)}/lixora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the session's shared folder."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the session's shared folder: smaller than a checkpoint, and of a size that is known."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """table, to be broadcast if it has no more than ``most`` rows; else never, whatever Spark takes its size for. Give a
    table that is cheap to count."""
    return F.broadcast(table) if table.count() <= most else large(table)


def large(table: DataFrame) -> DataFrame:
    """table, never broadcast by the join that comes next: it grows with the input, and Spark takes tables that were exploded,
    grouped or cut from their lineage for far smaller than they are."""
    return table.hint("merge")


#: Rows that a task gets at most, of a narrow table whose rows make much work, and tasks at most.
A_TASK, MOST_TASKS = 2_000, 2_000


def spread(table: DataFrame) -> DataFrame:
    """table in as many tasks as its rows call for: a compact file is read by one or two, however much is made of its rows.
    Give a table that is narrow and cheap to count."""
    return table.repartition(min(table.count() // A_TASK + 1, MOST_TASKS))


#: A key that more than this share of the rows asks for is hot; there are at most as many as its inverse.
HOT = 1 / 1_000


def look_up(df: DataFrame, keys: list[Column], answers: DataFrame, asks: Column, most: int | None = None) -> DataFrame:
    """df with column _answer: that of ``answers`` for the rows that ask and whose keys have one, else null.

    answers(k0, k1, ..., times, answer) is a written table with one row per key; times: how many rows ask for it. Up to
    ``most`` answers (MOST_BROADCAST by default) are broadcast: df is read once and not shuffled. Beyond, only rows that ask for
    a key without much demand are shuffled; answers of hot keys are broadcast, and rows that ask nothing stay where they
    are. df is read twice then.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    table = answers.select(*[F.col(f"k{i}").alias(n) for i, n in enumerate(names)], F.col("answer").alias("_answer"), F.col("times").alias("_times"))
    rows = df.withColumns({f"_asked{n}": F.when(asks, k) for n, k in zip(names, keys)})
    same = lambda: [F.col(f"_asked{n}") == F.col(n) for n in names]
    total, count = table.agg(F.sum("_times"), F.count("*")).first()
    if count <= (MOST_BROADCAST if most is None else most):
        return rows.join(F.broadcast(table), same(), "left").select(*_own(df), "_answer")
    hot = table.where(F.col("_times") > total * HOT)
    busy = rows.join(F.broadcast(hot), same(), "left")
    whole = F.lit(True)
    for n in names:
        whole = whole & F.col(f"_asked{n}").isNotNull()
    stays = busy.where(F.col("_answer").isNotNull() | ~whole).select(*_own(df), "_answer")
    rest = rows.where(whole).join(F.broadcast(hot.drop("_answer", "_times")), same(), "left_anti").join(large(table.where(F.col("_times") <= total * HOT)), same(), "left")
    return stays.unionByName(rest.select(*_own(df), "_answer"))


def _own(df: DataFrame) -> list[Column]:
    return [F.col(quoted(c)) for c in df.columns]


def quoted(name: str) -> str:
    """A column's name as it must be written where dots mean fields."""
    return "`" + name.replace("`", "``") + "`"
