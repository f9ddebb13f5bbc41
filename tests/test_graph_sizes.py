"""Graphs where ids meet, where no package has another above it, and where tables are larger than they look."""

from pyspark.sql import functions as F

from lixora.operators import graph, shared
from lixora.plans.identity import set_02


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_a_package_may_have_the_id_of_a_member(spark):
    direct = spark.createDataFrame([(7, 1), (7, 7), (8, 7)], "member long, pkg_id long")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert rows(graph.attribute_workspaces(direct, edges, 2, among=False), "pkg_id", "members") == [(1, "7"), (2, "7"), (7, "7,8")]
    assert rows(graph.attribute_workspaces(direct, edges, 2), "pkg_id", "members") == [(1, "7"), (2, "7")]


def test_roots_grow_with_the_projects(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    assert set_02(spark, "/root/testdata/sf0.001").count() >= lines.select("l_orderkey").distinct().count()


def test_tables_of_many_rows_are_not_broadcast(spark):
    many = spark.range(10)
    plan = spark.range(5).join(shared.small(many, most=3), "id")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan
    assert "Broadcast" in spark.range(5).join(shared.small(many, most=30), "id")._jdf.queryExecution().executedPlan().toString()


def test_closures_broadcast_no_tables_that_were_not_counted(spark, monkeypatch):
    monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    monkeypatch.setattr(graph.small, "__defaults__", (0,))
    direct = spark.createDataFrame([(1, 1)], "project_id long, pkg_id long")
    made = graph.transitive_closure(direct, spark.createDataFrame([(1, 2), (2, 1), (2, 3)], "src long, dst long"), 5)
    assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString()
    assert rows(made, "project_id", "pkg_id", "depth") == [(1, 1, 0), (1, 2, 1), (1, 3, 2)]


def test_closures_of_busy_projects_and_of_many_rows_a_source(spark, monkeypatch):
    edges = spark.range(40).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    direct = spark.range(30).select((F.col("id") % 3).alias("project_id"), F.col("id").alias("pkg_id")).where("project_id <> 1 or pkg_id = 1")
    plain = rows(graph.transitive_closure(direct, edges, 6), "project_id", "pkg_id", "depth")
    monkeypatch.setattr(graph, "A_ROW", 2)
    monkeypatch.setattr(graph, "BUSY", 5)
    assert rows(graph.transitive_closure(direct, edges, 6), "project_id", "pkg_id", "depth") == plain
    assert (1, 7, 6) in plain and (0, 33, 6) in plain and (0, 34, 6) not in plain


def test_closures_shuffle_lists_instead_of_their_packages(spark):
    direct = spark.createDataFrame([(1, 1)], "project_id long, pkg_id long")
    plan = graph.transitive_closure(direct, spark.createDataFrame([(1, 2)], "src long, dst long"), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate") < plan.index("Exchange hashpartitioning(project_id")
