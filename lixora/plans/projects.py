"""Whole scans: every package of the fixture is written as a small project, and all of them are scanned."""

from __future__ import annotations

from pyspark.sql import functions as F

from lixora.operators import project_scan, sbom
from lixora.operators.config import ComplianceConfig
from lixora.plans.judging import CODE, JUDGED, UNRESOLVED, pool
from lixora.plans.manifests import files_of, q
from lixora.plans.registry import query
from lixora.plans.sboms import LOWER, ROWS, SPDXED, STATED, mixed

MIT_TEXT, APACHE_TEXT = "MIT License Permission is hereby granted, free of charge", "Apache License Version 2.0, January 2004"
FILES = {
    "package.json": ["'{\"name\": \"own\", \"license\": \"ISC\", \"dependencies\": {\"lib' || pkg_id || '\": \"^' || version || '\", \"other\": \"1.0.0\", \"gone\": \"2.0.0\"}}'"],
    "Cargo.lock": [q("[[package]]"), q('name = "crate"'), q('version = "0.1.0"'), q('source = "registry"')],
    "node_modules/lib/package.json": ["'{\"name\": \"lib' || pkg_id || '\", \"version\": \"' || version || '\"' || CASE WHEN license IS NULL THEN '' ELSE ', \"license\": \"' || license || '\"' END || '}'"],
    "LICENSE": [f"CASE pkg_id % 3 WHEN 0 THEN {q(MIT_TEXT)} WHEN 1 THEN {q(APACHE_TEXT)} ELSE 'nothing known' END"],
    "src/a.rs": ["CASE WHEN pkg_id % 4 = 0 THEN '// SPDX-License-Identifier: GPL-3.0-only' ELSE '// code' END"],
    "vendor/dep/COPYING": [f"CASE WHEN pkg_id % 5 = 0 THEN {q(APACHE_TEXT)} ELSE 'unclear' END"],
    "vendor/crate/x.c": [q("int x;")],
}

#: Findings of the projects, one SELECT for each source.
PL = "CASE pkg_id % 3 WHEN 0 THEN 'MIT' WHEN 1 THEN 'Apache-2.0' ELSE 'ISC' END"
LOCAL = "CASE WHEN upper(trim(license)) IN ('UNLICENSED', 'NONE', 'NOASSERTION') THEN NULL ELSE license END"
DEPS = f"""SELECT pkg_id AS root, 'manifest' AS source, 'lib' || pkg_id AS name, version, {{local}} AS license FROM fx_packages
  UNION ALL SELECT pkg_id, 'manifest', 'other', '1.0.0', 'GPL-3.0-only' FROM fx_packages UNION ALL SELECT pkg_id, 'manifest', 'gone', '2.0.0', {{gone}} FROM fx_packages UNION ALL SELECT pkg_id, 'manifest', 'crate', '0.1.0', NULL FROM fx_packages
  UNION ALL SELECT pkg_id, 'own-source', 'src/a.rs', '', 'GPL-3.0-only' FROM fx_packages WHERE pkg_id % 4 = 0"""
VENDORED = " UNION ALL SELECT pkg_id, 'vendored', 'vendor/dep', '', CASE WHEN pkg_id % 5 = 0 THEN 'Apache-2.0' END FROM fx_packages UNION ALL SELECT pkg_id, 'unmanaged', 'src', '', 'GPL-3.0-only' FROM fx_packages WHERE pkg_id % 4 = 0"
ALL = f"""f AS ({{rows}}), j AS (SELECT f.*, {PL.replace('pkg_id', 'root')} AS project_license FROM f)
SELECT j.root, j.source, j.name, j.version, j.license, j.project_license, CASE WHEN j.source = 'vendored' AND j.license IS NULL THEN true WHEN j.license = 'No License' THEN true WHEN j.license IS NULL THEN false ELSE own.free = 0 END AS is_restrictive,
  {CODE['osi'].format(x='own.osi')} AS osi_status, {CODE['compat'].format(x='pair.compat')} AS compatibility
FROM j LEFT JOIN own ON own.license = j.license LEFT JOIN pair ON pair.license = j.license AND pair.project_license = j.project_license"""
RESOLVED = DEPS.format(local=f"CASE WHEN {UNRESOLVED} OR {LOCAL} IS NULL THEN 'Apache-2.0' ELSE license END", gone="'MIT'")


def project_findings(spark, sf_dir, **options):
    files = files_of(spark, sf_dir, FILES)
    snapshot = pool(spark, sf_dir).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("lib"), "pkg_id").alias("name"), "version", F.lit("Apache-2.0").alias("license"))
    more = [("npm", "other", "1.0.0", "GPL-3.0-only"), ("npm", "gone", "latest", "Unknown"), ("cargo", "crate", "9.9.9", "MIT")]
    snapshot = snapshot.unionByName(spark.createDataFrame(more, snapshot.schema))
    definitions = spark.createDataFrame([("npm/npmjs/-/gone/2.0.0", "MIT")], "coordinate string, declared string")
    return project_scan.scan_projects(files, ComplianceConfig.default(spark), snapshot, definitions, **options)


COLUMNS = ["root", "source", "name", "version", "license", "project_license", "is_restrictive", "osi_status", "compatibility"]


@query("scan_01_projects", f"{JUDGED}, {ALL.format(rows=RESOLVED + VENDORED)}")
def scan_01(spark, sf_dir):
    return project_findings(spark, sf_dir).select(*COLUMNS)


@query("scan_02_options", f"{JUDGED}, {ALL.format(rows=DEPS.format(local=q('Apache-2.0'), gone='NULL'))}")
def scan_02(spark, sf_dir):
    """Without installed copies, vendored code and definitions."""
    return project_findings(spark, sf_dir, no_local=True, no_vendor_scan=True, no_clearlydefined=True).select(*COLUMNS)


@query("scan_03_language", f"{JUDGED}, {ALL.format(rows='SELECT * FROM (' + DEPS.format(local=q('x'), gone='NULL') + VENDORED + ') r WHERE source <> ' + q('manifest') + ' OR name = ' + q('crate'))}")
def scan_03(spark, sf_dir):
    """Packages of one language alone, asked for by another name of it."""
    return project_findings(spark, sf_dir, language="rs").select(*COLUMNS)


GATE = "SELECT root, bool_or(is_restrictive) AS has_restrictive, bool_or(compatibility = 'Incompatible') AS has_incompatible, NOT {failed} AS passed FROM s GROUP BY 1"


@query("scan_04_gate", f"{JUDGED}, s AS (WITH {ALL.format(rows=RESOLVED + VENDORED)}) {GATE.format(failed='bool_or(is_restrictive)')}")
def scan_04(spark, sf_dir):
    """A gate that only restrictive findings close."""
    return project_scan.scan_gate(project_findings(spark, sf_dir), fail_on_incompatible=False)


INGESTED = f"i AS (SELECT doc_id, pos, ecosystem, {LOWER} AS name, version, pkg_id, CASE WHEN doc_id % 2 = 0 THEN {SPDXED} ELSE {STATED} END AS stated, CASE WHEN doc_id % 2 = 0 THEN 'spdx' ELSE 'cyclonedx' END AS format FROM r)"
TAKEN = f"t AS (SELECT *, CASE WHEN {UNRESOLVED.replace('license', 'stated').replace('no stated', 'no license')} AND pkg_id % 2 = 0 THEN 'GPL-3.0-only' ELSE stated END AS license FROM i)"


@query("jsn_03_judged", f"{JUDGED}, {ROWS}, {INGESTED}, {TAKEN} SELECT t.doc_id, t.pos, t.format, t.ecosystem, t.name, t.version, t.license, CASE WHEN t.license = 'No License' THEN true WHEN t.license IS NULL THEN false ELSE own.free = 0 END AS is_restrictive, {CODE['osi'].format(x='own.osi')} AS osi_status, {CODE['compat'].format(x='pair.compat')} AS compatibility FROM t LEFT JOIN own ON own.license = t.license LEFT JOIN pair ON pair.license = t.license AND pair.project_license = 'MIT'")
def jsn_03_judged(spark, sf_dir):
    """Documents of both formats, resolved from a snapshot and judged against a MIT project."""
    docs = mixed(spark, sf_dir)
    snapshot = sbom.ingest_sboms(docs.limit(0)).select("ecosystem", "name", "version", "license").unionByName(known_names(spark, sf_dir))
    return sbom.judge_sboms(docs, ComplianceConfig.default(spark), snapshot, project_license="MIT").select("doc_id", "pos", "format", "ecosystem", "name", "version", "license", "is_restrictive", "osi_status", "compatibility")


def known_names(spark, sf_dir):
    """A registry snapshot of every other package, under the names that documents give."""
    lower = F.when(F.col("ecosystem").isin("npm", "golang", "deb", "rpm", "apk"), F.lower("name")).when(F.col("ecosystem") == "pypi", F.regexp_replace(F.lower("name"), "[-_.]+", "-")).otherwise(F.col("name"))
    return pool(spark, sf_dir).where("pkg_id % 2 = 0").select("ecosystem", lower.alias("name"), "version", F.lit("GPL-3.0-only").alias("license"))


HOUSE = {
    "package.json": ["'{\"name\": \"own\", \"dependencies\": {\"lib' || pkg_id || '\": \"^' || version || '\", \"gone\": \"2.0.0\"}}'"],
    "Cargo.lock": [q("[[package]]"), q('name = "own"'), q('version = "0.1.0"'), q('dependencies = ["crate"]'), q("[[package]]"), q('name = "crate"'), q('version = "0.1.0"'), q('source = "registry"')],
    "go.mod": [q("module x"), q("require example.com/m v1.0.0")],
    "LICENSE": [q(MIT_TEXT)],
    ".gitignore": [q("gen/"), q("*.c"), "CASE WHEN pkg_id % 2 = 0 THEN '!kept.c' ELSE '' END"],
    "src/gen/b.rs": [q("// SPDX-License-Identifier: GPL-3.0-only")],
    "src/x/gone.c": [q("// SPDX-License-Identifier: GPL-3.0-only")],
    "src/y/kept.c": [q("// SPDX-License-Identifier: ISC")],
    "vendor/house/COPYING": ["'House Licence of ' || pkg_id"],
    "vendor/c/x.c": [q("int x;")],
}
SETTINGS = """
strict = false
[licenses]
restrictive = ["House"]
ignore = ["Zlib"]
[dependencies]
max_depth = 4
[[dependencies.ignore]]
name = "gone"
"""
_HOUSE = [
    ("manifest", "'lib' || pkg_id", "version", "NULL", "0", "NULL", "true"), ("manifest", "'deep1'", "'1'", "NULL", "1", "NULL", "true"), ("manifest", "'deep2'", "'1'", "'MIT'", "2", "NULL", "true"),
    ("manifest", "'crate'", "'0.1.0'", "NULL", "0", "'own@0.1.0'", "true"), ("manifest", "'example.com/m'", "'v1.0.0'", "NULL", "0", "NULL", "true"), ("manifest", "'n'", "'1'", "NULL", "1", "NULL", "true"), ("manifest", "'o'", "'1'", "NULL", "2", "NULL", "true"),
    ("vendored", "'vendor/house'", "''", "'LicenseRef-House'", "NULL", "NULL", "true"), ("own-source", "'src/y/kept.c'", "''", "'ISC'", "NULL", "NULL", "pkg_id % 2 = 0"), ("unmanaged", "'src/y'", "''", "'ISC'", "NULL", "NULL", "pkg_id % 2 = 0"),
]
HOUSE_SQL = " UNION ALL ".join(f"SELECT pkg_id AS root, '{s}' AS source, {n} AS name, {v} AS version, {lic} AS license, {d}::INTEGER AS depth, {m} AS members, {lic} IS NOT NULL AND contains({lic}, 'House') AS is_restrictive FROM fx_packages WHERE {w}" for s, n, v, lic, d, m, w in _HOUSE)


@query("scan_05_settings", f"{JUDGED} {HOUSE_SQL}")
def scan_05(spark, sf_dir):
    """Under a file of settings: ignore files, user licence rules, ignored dependencies, dependencies of dependencies, workspace members."""
    libs = pool(spark, sf_dir).select(F.lit("npm").alias("ecosystem"), F.concat(F.lit("lib"), "pkg_id").alias("name"), "version", F.lit("deep1").alias("needs_name"), F.lit("1").alias("needs_version"))
    more = [("npm", "deep1", "1", "deep2", "1"), ("npm", "deep2", "1", "deep1", "1"), ("golang", "example.com/m", "v1.0.0", "n", "1"), ("golang", "n", "1", "o", "1"), ("golang", "o", "1", "p", "1")]
    edges = libs.unionByName(spark.createDataFrame(more, libs.schema))
    snapshot = spark.createDataFrame([("npm", "deep2", "1", "MIT")], "ecosystem string, name string, version string, license string")
    cfg = ComplianceConfig.default(spark, custom=[("LicenseRef-House", ["House Licence"], None)])
    found = project_scan.scan_with_settings(files_of(spark, sf_dir, HOUSE), SETTINGS, cfg=cfg, snapshot=snapshot, edges=edges)
    return found.select("root", "source", "name", "version", "license", "depth", "members", "is_restrictive")
