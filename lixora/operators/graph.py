"""Dependency graphs: bounded closures, roots, attribution."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lixora.operators.shared import small, written

MOST_DEPTH = 100
#: Packages that one row of a source's closure holds at most.
A_ROW = 10_000
#: Direct packages of a project beyond which its closure isn't left to one task.
BUSY = 50_000


def transitive_closure(direct: DataFrame, edges: DataFrame, last_depth: int = 10) -> DataFrame:
    """(project_id, pkg_id, depth): packages within last_depth edges of the direct ones (depth 0), at least depth.

    edges(src, dst); see ``budgeted_closure``.
    """
    if not 0 <= last_depth <= MOST_DEPTH:
        raise ValueError(f"last_depth is from 0 to {MOST_DEPTH}")
    return budgeted_closure(direct.select("project_id", "pkg_id", F.lit(last_depth).alias("budget")), edges)


def budgeted_closure(direct: DataFrame, edges: DataFrame) -> DataFrame:
    """(project_id, pkg_id, depth): packages within ``budget`` edges of each direct one (project_id, pkg_id, budget).

    The closure of each direct package is found once, with the largest budget that any project gives it; a project's
    is the least depth over its direct packages, within its own budgets. A frontier's rows carry what is left of their
    budget and go no further without; every round joins the newest packages with edges and drops those seen before, so
    cycles end; each round is written out, so none is computed twice. Only edges of a counted size are broadcast. Closures
    meet their projects as lists of at most A_ROW packages, and are taken apart where a project's lists lie together:
    that is less to shuffle than their packages one by one. Projects with more than BUSY direct packages are taken apart
    before.
    """
    spark = direct.sparkSession
    direct = written(direct.groupBy("project_id", "pkg_id").agg(F.max("budget").alias("budget")), "direct")
    step = small(written(edges.select(F.col("src").alias("pkg_id"), "dst").distinct(), "edges"))
    newest = written(direct.groupBy(F.col("pkg_id").alias("source")).agg(F.max("budget").alias("left")).where("left >= 0").select("source", F.col("source").alias("pkg_id"), F.lit(0).alias("depth"), "left"), "closure")
    seen = newest
    for depth in range(1, MOST_DEPTH + 1):
        reached = newest.where("left > 0").hint("merge").join(step, "pkg_id").groupBy("source", F.col("dst").alias("pkg_id")).agg(F.max(F.col("left") - 1).alias("left"))
        newest = written(reached.join(seen.select("source", "pkg_id").hint("merge"), ["source", "pkg_id"], "left_anti").select("source", "pkg_id", F.lit(depth).alias("depth"), "left"), "closure")
        if newest.isEmpty():
            break
        seen = seen.unionByName(newest)
    by_depth = Window.partitionBy("source").orderBy("depth")
    lists = seen.withColumn("at", F.floor((F.row_number().over(by_depth) - 1) / A_ROW)).groupBy("source", "at").agg(F.collect_list(F.struct("pkg_id", "depth")).alias("found"))
    busy = written(direct.groupBy("project_id").count().where(F.col("count") > BUSY).select("project_id"), "busy")

    def found(direct: DataFrame, together: bool) -> DataFrame:
        mine = direct.withColumnRenamed("pkg_id", "source").hint("merge").join(lists.hint("merge"), "source").select("project_id", F.filter("found", lambda x: x["depth"] <= F.col("budget")).alias("found"))
        mine = mine.select("project_id", F.col("found.pkg_id").alias("pkgs"), F.col("found.depth").alias("depths")).where(F.size("pkgs") > 0)
        mine = mine.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "project_id") if together else mine
        return mine.select("project_id", "depths", F.posexplode("pkgs").alias("at", "pkg_id")).groupBy("project_id", "pkg_id").agg(F.min(F.get("depths", F.col("at"))).alias("depth"))

    if busy.isEmpty():
        return found(direct, True)
    return found(direct.join(F.broadcast(busy), "project_id", "left_anti"), True).unionByName(found(direct.join(F.broadcast(busy), "project_id", "left_semi"), False))


#: How deep each ecosystem's dependencies of dependencies are followed, the direct ones being at depth 0:
#: npm to 14 always; below or up to the option for others; a lock file's to its end.
NPM_DEPTH = 14


def depth_budget(ecosystem: Column, max_depth: int) -> Column:
    """Edges that may be followed from a direct dependency."""
    if not 1 <= max_depth <= MOST_DEPTH:
        raise ValueError(f"max_depth is from 1 to {MOST_DEPTH}")
    return F.when(ecosystem == "npm", NPM_DEPTH).when(ecosystem == "pypi", max_depth - 1).when(ecosystem == "golang", max(0, max_depth - 2)).when(ecosystem.isin("maven", "conan", "generic"), max_depth).otherwise(MOST_DEPTH)


def depth_histogram(closure: DataFrame) -> DataFrame:
    """Packages per depth."""
    return closure.groupBy("depth").agg(F.count("*").alias("n"))


def graph_roots(edges: DataFrame) -> DataFrame:
    """Sources that are no destination."""
    return edges.select(F.col("src").alias("node")).distinct().hint("merge").join(edges.select(F.col("dst").alias("node")).hint("merge"), "node", "left_anti")


def attribute_workspaces(direct: DataFrame, edges: DataFrame, last_depth: int = 10, label: Callable[[Column], Column] = lambda c: c, among: bool = True) -> DataFrame:
    """(pkg_id, members): the sorted members whose closure has a package. direct(member, pkg_id); label: what a member is
    called; among: members are packages themselves, and left out (else a package may have the id of a member)."""
    owned = transitive_closure(direct.withColumnRenamed("member", "project_id"), edges, last_depth)
    if among:
        owned = owned.join(direct.select(F.col("member").alias("pkg_id")).distinct().hint("merge"), "pkg_id", "left_anti")
    owned = owned.select("pkg_id", label(F.col("project_id").cast("string")).alias("member"))
    return owned.groupBy("pkg_id").agg(F.array_join(F.array_sort(F.collect_set("member")), ",").alias("members"))


def dotnet_closure(project_refs: DataFrame, package_refs: DataFrame, last_depth: int = 10) -> DataFrame:
    """(project_id, pkg_id): packages of a project and of all projects it refers to. project_refs(src, dst), package_refs(project, pkg_id)."""
    own = package_refs.select(F.col("project").alias("project_id"), F.col("project").alias("pkg_id")).unionByName(project_refs.select(F.col("src").alias("project_id"), F.col("src").alias("pkg_id"))).distinct()
    reach = transitive_closure(own, project_refs, last_depth).select("project_id", F.col("pkg_id").alias("project"))
    return reach.join(package_refs, "project").select("project_id", "pkg_id").distinct()
