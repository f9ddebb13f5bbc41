"""Representative inputs derived from the given tables (see FIXTURES.md).

The derivations are plain SQL that Spark and DuckDB read alike; {part}, {orders}, ... stand for the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ECOSYSTEMS = ["cargo", "npm", "golang", "pypi", "maven", "gem", "nuget", "cran", "conan", "deb", "rpm", "apk", "generic"]
POOL = [
    "MIT", "Apache-2.0", "BSD-3-Clause", "ISC", "GPL-3.0-only", "GPL-2.0-or-later", "LGPL-2.1", "AGPL-3.0", "MPL-2.0", "MIT OR Apache-2.0",
    "MIT AND GPL-3.0-only", "(MIT OR GPL-2.0-only) AND BSD-3-Clause", "GPL-2.0-only WITH Classpath-exception-2.0", None, "NOASSERTION", "Unknown", "No License",
    "The Apache Software License, Version 2.0", "CC-BY-SA-4.0", "Unlicense",
]
PROJECTS = ["MIT", "Apache-2.0", "GPL-3.0", "GPL-2.0", "AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "BSD-3-Clause", "BSD-2-Clause", "ISC", "0BSD", "Unlicense", "WTFPL", None]


def pick(values: list[str | None], number: str) -> str:
    """CASE that picks by number modulo the length."""
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values) if v is not None)
    return f"CASE {number} % {len(values)} {arms} END"


_BASE, _BRAND = "replace(p_name, ' ', '-') || '-' || p_partkey", "lower(replace(p_brand, '#', ''))"
_ECO = pick(ECOSYSTEMS, "p_partkey")

PACKAGES = f"""SELECT p_partkey AS pkg_id, {_ECO} AS ecosystem,
  CASE {_ECO} WHEN 'npm' THEN '@' || {_BRAND} || '/' || {_BASE} WHEN 'golang' THEN 'example.com/' || {_BRAND} || '/' || {_BASE}
    WHEN 'maven' THEN 'com.' || {_BRAND} || ':' || {_BASE} WHEN 'deb' THEN 'debian/' || {_BASE} WHEN 'rpm' THEN 'fedora/' || {_BASE}
    WHEN 'apk' THEN 'alpine/' || {_BASE} ELSE {_BASE} END AS name,
  CAST(p_size AS VARCHAR(20)) || '.' || CAST(p_partkey % 10 AS VARCHAR(20)) || '.' || CAST(p_partkey % 7 AS VARCHAR(20)) AS version,
  {pick(POOL, "p_partkey")} AS license FROM {{part}}"""
PROJECTS_SQL = f"SELECT o_orderkey AS project_id, {pick(PROJECTS, 'o_orderkey')} AS project_license FROM {{orders}}"
DEPS = "SELECT DISTINCT l_orderkey AS project_id, l_partkey AS pkg_id FROM {lineitem}"
EDGES = """SELECT DISTINCT src, dst FROM (
  SELECT p_partkey AS src, (7 * p_partkey + 3) % (SELECT count(*) FROM {part}) AS dst FROM {part} WHERE p_partkey % 4 <> 0
  UNION ALL SELECT p_partkey, (3 * p_partkey + 1) % (SELECT count(*) FROM {part}) FROM {part} WHERE p_partkey % 4 <> 0) e"""
FILES = """SELECT source AS root, CASE doc_id % 6 WHEN 0 THEN 'vendor/lib' WHEN 1 THEN 'third_party/kit' WHEN 2 THEN 'node_modules/dep' ELSE 'src/mod' END
  || (doc_id % 10) || '/' || CASE WHEN doc_id % 7 = 0 THEN 'LICENSE' ELSE 'f' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.rs' WHEN 2 THEN '.c' ELSE '.txt' END END AS path,
  doc_id, text AS content FROM {documents}"""
SOURCES = """SELECT root, path, doc_id, CASE doc_id % 9 WHEN 1 THEN '/* SPDX-License-Identifier: GPL-3.0-only */' || chr(10) || content
  WHEN 3 THEN '# SPDX-License-Identifier: some prose here' || chr(10) || '# SPDX-License-Identifier: (MIT OR Apache-2.0)' || chr(10) || content
  WHEN 5 THEN '# This file is under the terms of the GNU' || chr(10) || '# Lesser General Public License, either version 3, or' || chr(10) || '# (at your option) any later version.' || chr(10) || content
  ELSE content END AS content FROM (""" + FILES + """) f"""
#: One row per manifest-like path: (root, path).
PATHS = """SELECT 'r' || (p_partkey % 4) AS root, CASE p_partkey % 8 WHEN 0 THEN 'node_modules/a/' WHEN 1 THEN '' WHEN 2 THEN 'app/' WHEN 3 THEN 'lib/core/' WHEN 4 THEN 'vendor/z/' WHEN 5 THEN 'Third_Party/k' || (p_partkey % 3) || '/' WHEN 6 THEN 'a/.venv/' ELSE 'deep/er/down/' END
  || CASE p_partkey % 11 WHEN 0 THEN 'Cargo.toml' WHEN 1 THEN 'package.json' WHEN 2 THEN 'go.mod' WHEN 3 THEN 'Cargo.lock' WHEN 4 THEN 'main.rs' WHEN 5 THEN 'x.csproj' WHEN 6 THEN 'requirements.txt' WHEN 7 THEN 'README.md' WHEN 8 THEN '.hidden.py' WHEN 9 THEN 'yarn.lock' ELSE 'LICENSE' END AS path FROM {part}"""
CHANGES = """SELECT event_id, ts, user_id AS root_id, CASE event_type WHEN 'click' THEN 'package.json' WHEN 'view' THEN 'src/main.rs'
  WHEN 'error' THEN 'node_modules/x/package.json' ELSE 'Cargo.lock' END AS path FROM {events}"""

SQL = {"fx_packages": PACKAGES, "fx_projects": PROJECTS_SQL, "fx_deps": DEPS, "fx_edges": EDGES, "fx_files": FILES, "fx_changes": CHANGES, "fx_src": SOURCES, "fx_paths": PATHS}
TABLES = ["part", "orders", "lineitem", "documents", "events"]


def duck(*views: str) -> str:
    """WITH clause that defines the views for DuckDB."""
    return "WITH " + ", ".join(f"{v} AS ({SQL[v].format(**{t: t for t in TABLES})})" for v in views)


def fixture(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """One of the views as a DataFrame."""
    used = [t for t in TABLES if f"{{{t}}}" in SQL[view]]
    return spark.sql(SQL[view], **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used})


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dependency lines with package and project licence: (project_id, project_license, pkg_id, ecosystem, name, version, license)."""
    deps, packages, projects = (fixture(spark, sf_dir, v) for v in ("fx_deps", "fx_packages", "fx_projects"))
    return deps.join(packages, "pkg_id").join(projects, "project_id").select("project_id", "project_license", "pkg_id", "ecosystem", "name", "version", "license")
