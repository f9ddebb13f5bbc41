"""Scans of many projects: what grows with them is never broadcast."""

import re

from pyspark.sql import functions as F

from lixora.operators import evidence, osdb, project_scan, report, resolve, scan, shared
from lixora.operators.config import ComplianceConfig
from lixora.sources import ignore, manifests

FILES = [
    ("package.json", '{"dependencies": {"a": "^1", "gone": "1"}}'), ("node_modules/a/package.json", '{"name": "a", "version": "1", "license": "ISC"}'), ("LICENSE", "MIT License"), ("src/x.rs", "// SPDX-License-Identifier: ISC"), ("vendor/k/COPYING", "ISC License"), (".gitignore", "*.tmp"), ("src/y.tmp", ""),
    ("Cargo.lock", '[[package]]\nname = "own"\nversion = "1"\ndependencies = ["c"]\n[[package]]\nname = "c"\nversion = "2"\nsource = "registry"\n'),
]


def corpus(spark):
    each = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(c).alias("content")) for p, c in FILES])
    return spark.range(3).select(F.col("id").alias("root"), F.explode(each).alias("f")).select("root", "f.*")


def broadcasts(df):
    """What a plan broadcasts."""
    return re.findall(r"- BroadcastExchange[^\n]*\n[^\n]*", df._jdf.queryExecution().executedPlan().toString())


def test_scans_broadcast_no_tables_that_were_not_counted(spark, monkeypatch):
    """Spark takes all tables here for small, so it broadcasts what isn't counted or told not to be."""
    plans, cut = [], shared.cut

    def seen(df):
        plans.append(df)
        return cut(df)

    for module in (evidence, project_scan, resolve, ignore):
        monkeypatch.setattr(module, "cut", seen)
    monkeypatch.setattr(ignore, "small", lambda table: shared.large(table))
    monkeypatch.setattr(shared, "MOST_BROADCAST", 0)
    snapshot = spark.createDataFrame([("npm", "a", "1", "MIT"), ("npm", "gone", "1", "MIT")], "ecosystem string, name string, version string, license string")
    definitions = spark.createDataFrame([("crate/cratesio/-/c/2", "ISC")], "coordinate string, declared string")
    edges = spark.createDataFrame([("npm", "a", "1", "deep", "1")], "ecosystem string, name string, version string, needs_name string, needs_version string")
    found = project_scan.scan_with_settings(corpus(spark), '[[dependencies.ignore]]\nname = "gone"\n', snapshot=snapshot, definitions=definitions, edges=edges)
    rows = sorted((r["source"], r["name"], r["license"], r["members"]) for r in found.where("root = 0").collect())
    assert rows == [("manifest", "a", "ISC", None), ("manifest", "c", "ISC", "own@1"), ("manifest", "deep", None, None), ("own-source", "src/x.rs", "ISC", None), ("unmanaged", "src", "ISC", None), ("vendored", "vendor/k", "ISC", None)]
    # verdicts, the matrix and ignored names are small by nature; keys of much demand are a thousand at most
    growing = [b for df in [*plans, found] for b in broadcasts(df) if re.search(r"\b(root|path|dir|member|coordinate)#", b)]
    assert not growing, "\n".join(growing)


def test_tables_beside_a_corpus_are_not_broadcast(spark):
    files = corpus(spark)
    kinds = ["root", "path"]
    for df in (osdb.installed_artifacts(files), osdb.copyright_license(files, kinds), scan.vendor_root(files.select("root", F.lit("vendor/k").alias("dir"))), scan.topmost(files.select("root", F.lit("vendor/k").alias("dir")).distinct()), manifests.cargo_graph(files)):
        assert not broadcasts(df)
    asked = files.select("root", F.lit("npm").alias("ecosystem"), F.lit("a").alias("name"), F.lit("1").alias("version"), F.lit(None).cast("string").alias("license"))
    assert resolve.resolve_from_registry(asked, asked.withColumn("license", F.lit("MIT")).drop("root")).where("license = 'MIT'").count() == asked.count()


def test_ignored_names_are_broadcast(spark):
    """A name that every project has must not gather in one task."""
    rows = corpus(spark).select("root", F.lit("gone").alias("name"), F.lit("1").alias("version"))
    left = report.drop_ignored_deps(rows, spark.createDataFrame([("gone", "")], "name string, version string"))
    assert broadcasts(left) and left.isEmpty()
