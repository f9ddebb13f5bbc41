"""Pieces that several operators share: shared-folder tables, text tables, word hashes, components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word hashes that one Python worker remembers before it starts afresh.
WORDS_KEPT = 400_000
GOLD = np.uint64(0x9E3779B97F4A7C15)
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset and Spark is local, a folder of our own."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="lixora-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's part of the shared folder."""
    return f"{shared_folder(spark)}/lixora/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder: lineage ends here, and lost executors cost nothing before it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_struct(df: DataFrame) -> Column:
    """A whole row as one struct, whatever its columns are called; two of one name are refused with a message."""
    low = [c.lower() for c in df.columns]
    if twice := sorted({c for c in low if low.count(c) > 1}):
        raise ValueError(f"columns of one name: {', '.join(twice)}; rename them first")
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def filtered(df: DataFrame, column: str, keep: Callable[[], Callable[[list[str]], list[bool]]]) -> DataFrame:
    """Rows of df whose text in ``column`` is kept (null: empty); columns, their names and types stay.

    keep() runs once a task and gives texts -> booleans. Columns travel under numbers, so any names do.
    """
    as_struct(df)  # refuses columns of one name
    at = [c.lower() for c in df.columns].index(column.lower())
    numbered = df.toDF(*[f"c{i}" for i in range(len(df.columns))])

    def fn(batches):
        kept = keep()
        for b in batches:
            yield b.filter(pa.array(kept([t.as_py() or "" for t in b.column(at)]), pa.bool_()))

    return numbered.mapInArrow(fn, numbered.schema).toDF(*df.columns)


def join_hot(rows: DataFrame, per_key: DataFrame, key: str, times: str) -> DataFrame:
    """rows joined with per_key, which has one row of each key and says how often it occurs in rows (``times``).

    Keys that hold more than a thousandth of all rows, so at most 1,000 keys, are broadcast: no task gets a hot key.
    Both sides are read twice; give tables.
    """
    total = per_key.agg(F.sum(times)).first()[0] or 0
    hot = F.broadcast(per_key.where(F.col(times) * 1000 > total))
    rest = rows.join(hot.select(key), key, "left_anti").join(per_key.where(F.col(times) * 1000 <= total), key)
    return rows.join(hot, key).unionByName(rest)


def partitions_for(spark: SparkSession, least: int = 8) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo folds: decides which labels may be learnt from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


class WordHashes(dict):
    """64-bit hash of each word (bytes or str) met so far; bounded."""

    def __missing__(self, word):
        if len(self) >= WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (overflow wraps)."""
    h = (h ^ (h >> np.uint64(30))) * MIX_A
    h = (h ^ (h >> np.uint64(27))) * MIX_B
    return h ^ (h >> np.uint64(31))


def find(parent: dict, x):
    """Root of x, halving the path on the way."""
    while (p := parent.setdefault(x, x)) != x:
        parent[x] = x = parent.setdefault(p, p)
    return x


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; component is the smallest node it reaches.

    Every node hooks itself to its smallest smaller neighbour, chains are halved until each node points
    at a root, edges are rewritten to roots, and so on until no edge is left. A node with very many edges
    costs one pre-aggregated minimum; nothing is gathered by node.
    """
    spark = edges.sparkSession
    left = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    left = saved(left, "edges")
    whole = None
    for _ in range(most_rounds):
        if left.isEmpty():
            break
        hooks = left.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        roots = left.select(F.col("b").alias("node")).distinct().join(hooks, "node", "left_anti").select("node", F.col("node").alias("up"))
        tree = saved(hooks.unionByName(roots), "tree")
        while True:
            up = tree.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            jumped = saved(tree.join(up, "up").select("node", F.col("higher").alias("up"), (F.col("higher") != F.col("up")).alias("moved")), "tree")
            tree = jumped.select("node", "up")
            if jumped.where("moved").isEmpty():
                break
        side = lambda c: tree.select(F.col("node").alias(c), F.col("up").alias(f"{c}_up"))
        joined = left.join(side("a"), "a").join(side("b"), "b").where("a_up <> b_up")
        left = saved(joined.select(F.greatest("a_up", "b_up").alias("a"), F.least("a_up", "b_up").alias("b")).distinct(), "edges")
        if whole is None:
            whole = tree
        else:
            above = tree.select(F.col("node").alias("up"), F.col("up").alias("higher"))
            whole = saved(whole.join(above, "up", "left").select("node", F.coalesce("higher", "up").alias("up")), "tree")
    else:
        raise RuntimeError(f"edges are left after {most_rounds} rounds")
    if whole is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).limit(0)
    return whole.select("node", F.col("up").alias("component"))
