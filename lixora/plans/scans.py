"""Queries over file corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from lixora.functions import licenses as L
from lixora.operators import judge, scan
from lixora.operators.config import ComplianceConfig
from lixora.plans.judging import CODE, JUDGED, TEXT_SQL, pool
from lixora.plans.registry import query
from lixora.sources import files as S
from lixora.sources.fixtures import duck, fixture, pick
from lixora.sources.ignore import not_ignored

SRC, PATHS, FILES = duck("fx_src"), duck("fx_paths"), duck("fx_files")
DIR = "CASE WHEN contains(path, '/') THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END"
NAME = "regexp_extract(path, '[^/]*$')"
LANG = f"CASE {NAME} WHEN 'Cargo.toml' THEN 'rust' WHEN 'package.json' THEN 'node' WHEN 'go.mod' THEN 'go' WHEN 'requirements.txt' THEN 'python' WHEN 'x.csproj' THEN 'dotnet' END"
DETECT = TEXT_SQL.replace("text,", "content,")
IS_SOURCE = "regexp_matches(path, '\\.(py|rs|c)$')"
TAG = "CASE doc_id % 9 WHEN 1 THEN 'GPL-3.0-only' WHEN 3 THEN '(MIT OR Apache-2.0)' END"
BANNER = "CASE doc_id % 9 WHEN 5 THEN 'LGPL-3.0-or-later' END"


def src(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_src")


def paths(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_paths")


@query("src_01_corpus", FILES + "SELECT root, path, doc_id, length(content) AS chars FROM fx_files")
def src_01(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_files").select("root", "path", "doc_id", F.char_length("content").cast("long").alias("chars"))


@query("src_02_descriptors", PATHS + f"SELECT DISTINCT root, path, CASE WHEN {NAME} IN ('Cargo.lock', 'yarn.lock') THEN 'lock' ELSE 'manifest' END AS kind FROM fx_paths WHERE ({NAME} IN ('Cargo.lock', 'yarn.lock') OR {LANG} IS NOT NULL) AND NOT regexp_matches(path, '(^|/)(node_modules|\\.git|target|vendor|\\.venv|venv)/')")
def src_02(spark, sf_dir):
    return S.discover_descriptors(paths(spark, sf_dir))


@query("src_03_project_roots", PATHS + f"SELECT root, {DIR} AS dir, {LANG} AS language, min(path) AS file FROM fx_paths WHERE {LANG} IS NOT NULL GROUP BY 1, 2, 3")
def src_03(spark, sf_dir):
    return S.project_roots(paths(spark, sf_dir))


#: A run with tables of its own, made from the packages: each wins over the default one.
OWN_TABLES = f"""bad AS (SELECT DISTINCT license AS pattern FROM fx_packages WHERE ecosystem = 'cargo' AND license IS NOT NULL), allowed AS (SELECT DISTINCT license AS dep FROM fx_packages WHERE ecosystem = 'golang' AND license IS NOT NULL),
open AS (SELECT DISTINCT license AS id FROM fx_packages WHERE ecosystem = 'pypi' AND license IS NOT NULL), leaf3 AS (SELECT leaf, CASE WHEN EXISTS (SELECT 1 FROM bad WHERE contains(leaf, pattern)) THEN 0 ELSE 2 END AS free,
  CASE WHEN norm IN (SELECT id FROM open) OR leaf IN (SELECT id FROM open) THEN 2 ELSE osi END AS osi, CASE WHEN norm IN (SELECT dep FROM allowed) THEN 2 ELSE 0 END AS mit FROM leaf2),
own3 AS (SELECT license, max(free) AS free, max(osi) AS osi, max(mit) AS mit FROM (SELECT license, clause, min(free) AS free, min(osi) AS osi, min(mit) AS mit FROM dnf JOIN leaf3 USING (leaf) GROUP BY 1, 2) c GROUP BY 1)"""


@query("src_15_reference_tables", f"{JUDGED}, {OWN_TABLES}, p AS (SELECT DISTINCT license, CASE WHEN pkg_id % 2 = 0 THEN 'MIT License' ELSE 'ISC' END AS project_license FROM fx_packages) SELECT p.license, p.project_license, CASE WHEN p.license = 'No License' THEN true WHEN p.license IS NULL THEN false ELSE free = 0 END AS is_restrictive, {CODE['osi'].format(x='osi')} AS osi_status, CASE WHEN p.license IS NULL OR p.project_license = 'ISC' THEN 'Unknown' WHEN mit = 2 THEN 'Compatible' ELSE 'Incompatible' END AS compatibility FROM p LEFT JOIN own3 USING (license)")
def src_15(spark, sf_dir):
    """Verdicts by explicit tables: restrictive patterns, a matrix that knows one project licence, OSI ids."""
    p = pool(spark, sf_dir)
    of = lambda eco, name: p.where((F.col("ecosystem") == eco) & F.col("license").isNotNull()).select(F.col("license").alias(name)).distinct()
    matrix = of("golang", "dep_license").select(F.lit("MIT").alias("project_license"), "dep_license")
    cfg = ComplianceConfig.from_tables(spark, restrictive=of("cargo", "pattern"), matrix=matrix, osi=of("pypi", "spdx_id"))
    rows = p.select("license", F.when(F.col("pkg_id") % 2 == 0, "MIT License").otherwise("ISC").alias("project_license")).distinct()
    return judge.judge(rows, cfg).select("license", "project_license", "is_restrictive", "osi_status", "compatibility")


@query("fil_08_paths", PATHS + "SELECT path, regexp_matches(lower(path), '\\.(rs|py|json)$') AND NOT path LIKE '%json' AS source, regexp_matches(path, '(^|/)node_modules/') AS skipped, regexp_matches(lower(path), '(^|/)(vendor|third_party)/') AS vendored, regexp_matches(path, '(^|/)\\.') AS hidden FROM fx_paths")
def fil_08(spark, sf_dir):
    p = F.col("path")
    return paths(spark, sf_dir).select("path", S.is_source_path(p).alias("source"), S.in_any(p, ["node_modules"]).alias("skipped"), S.in_vendor_dir(p).alias("vendored"), S.is_hidden(p).alias("hidden"))


#: Ignore files of every root: at the top and in lib.
IGNORES = {".gitignore": "# made\ndeep/er/\n!deep/er/down/main.rs\n/app/*\n!/app/go.mod\nrequirements.txt\n", "lib/.gitignore": "!requirements.txt\ncore/*.toml\n"}
IGNORED = f"path LIKE 'deep/er/%' OR (path LIKE 'app/%' AND path <> 'app/go.mod') OR ({NAME} = 'requirements.txt' AND NOT path LIKE 'lib/%') OR regexp_matches(path, '^lib/core/[^/]*\\.toml$')"


@query("fil_08_ignore_files", PATHS + f"SELECT DISTINCT root, path FROM fx_paths WHERE NOT ({IGNORED}) UNION ALL SELECT DISTINCT root, f FROM fx_paths, (VALUES ('.gitignore'), ('lib/.gitignore')) i(f)")
def fil_08_ignores(spark, sf_dir):
    """What ignore files leave of each root: nested files, rules that take back, directories that stay closed."""
    p = paths(spark, sf_dir).distinct().withColumn("content", F.lit(""))
    more = p.select("root").distinct().select("root", F.explode(F.array(*[F.struct(F.lit(k).alias("path"), F.lit(v).alias("content")) for k, v in IGNORES.items()])).alias("f")).select("root", "f.*")
    return not_ignored(p.unionByName(more)).select("root", "path")


@query("srt_03_header_lines", FILES + "SELECT doc_id, len(list_slice(string_split(content, chr(10)), 1, 30)) AS lines, list_slice(string_split(content, chr(10)), 1, 30)[-1] AS last_line FROM fx_files")
def srt_03(spark, sf_dir):
    head = S.header_lines(F.col("content"))
    return fixture(spark, sf_dir, "fx_files").select("doc_id", F.size(head).cast("long").alias("lines"), F.element_at(head, -1).alias("last_line"))


#: Licence files of all names in twenty directories a source, most of which say nothing.
RANKED = ["LICENSE", "LICENSE.txt", "LICENSE.md", "license", "COPYING", "COPYING.md", "copyright", "OFL.txt", "OFL-1.1.txt"]
OTHERS = ["LICENSE-MIT", "Licence.txt", "copying.lesser", "LICENSE.py", "README"]
LICENSED = ["MIT License", "Apache License, Version 2.0", "ISC License", "Mozilla Public License Version 2.0"]
EVIDENCE = f"""SELECT source AS root, 'd' || (doc_id % 20) || '/' || {pick(RANKED + OTHERS, "(doc_id // 20)").replace("//", "{div}")} AS path, CASE WHEN doc_id % 3 = 0 THEN {pick(LICENSED, "(doc_id // 60)").replace("//", "{div}")} ELSE 'says nothing' END AS content"""
RANK = "CASE " + NAME + " " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(RANKED)) + " END"
EV = f"WITH e AS ({EVIDENCE.format(div='//')} FROM documents), r AS (SELECT root, regexp_replace(path, '/[^/]*$', '') AS dir, path, {RANK} AS rank, content FROM e)"


def evidence(spark, sf_dir):
    return spark.sql(EVIDENCE.format(div="div") + " FROM {documents}", documents=spark.read.parquet(f"{sf_dir}/documents.parquet"))


@query("win_01_dir_license", EV + f", s AS (SELECT root, dir, rank, path, CASE WHEN path LIKE '%OFL%' THEN 'OFL-1.1' ELSE {DETECT} END AS said FROM r WHERE rank IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY root, dir ORDER BY rank, path, said) AS n FROM s WHERE said IS NOT NULL) SELECT root, dir, said AS license FROM n WHERE n = 1")
def win_01(spark, sf_dir):
    return scan.dir_license(evidence(spark, sf_dir))


@query("win_02_dir_header", SRC + f", r AS (SELECT root, {DIR} AS dir, path, {TAG} AS license, row_number() OVER (PARTITION BY root, {DIR} ORDER BY path) AS n FROM fx_src WHERE {IS_SOURCE}) SELECT root, dir, arg_min(license, path) AS license FROM r WHERE n <= 50 AND license IS NOT NULL GROUP BY 1, 2")
def win_02(spark, sf_dir):
    f = src(spark, sf_dir)
    own = f.select("root", S.dir_of(F.col("path")).alias("dir")).distinct()
    return scan.dir_header_license(f).join(own, ["root", "dir"], "left_semi")


@query("win_03_dir_text", EV + f", t AS (SELECT root, dir, path, coalesce(rank, 9) AS rank FROM r WHERE rank IS NOT NULL OR (regexp_matches(upper({NAME}), '^(LICENSE|LICENCE|COPYING)') AND NOT path LIKE '%.py')), n AS (SELECT *, row_number() OVER (PARTITION BY root, dir ORDER BY rank, path) AS n FROM t) SELECT root, dir, path FROM n WHERE n = 1")
def win_03(spark, sf_dir):
    return scan.dir_license_text(evidence(spark, sf_dir))


@query("win_04_carry_forward", FILES + "SELECT root, path AS section, count(*) AS lines, sum(length(line))::BIGINT AS chars, max(line) AS last_line FROM (SELECT root, path, unnest(string_split(content, chr(10))) AS line FROM fx_files) x GROUP BY 1, 2")
def win_04(spark, sf_dir):
    """Each line of every file under the heading of its file, carried down from the first line."""
    from lixora.sources.lines import carry_forward, numbered_lines

    rows = fixture(spark, sf_dir, "fx_files").select("root", "path", "doc_id", F.concat(F.lit("== "), "path", F.lit("\n"), "content").alias("content"))
    lines = numbered_lines(rows, ["root", "doc_id"])
    section = F.when((F.col("pos") == 0) & F.col("line").startswith("== "), F.substring("line", 4, 10_000))
    carried = carry_forward(lines, ["root", "doc_id"], "pos", section, "section").where("pos > 0")
    return carried.groupBy("root", "section").agg(F.count("*").alias("lines"), F.sum(F.char_length("line")).alias("chars"), F.max("line").alias("last_line"))


@query("txt_03_spdx_header", SRC + f"SELECT doc_id, {TAG} AS license FROM fx_src")
def txt_03(spark, sf_dir):
    return src(spark, sf_dir).select("doc_id", L.spdx_header(F.col("content")).alias("license"))


@query("txt_04_gnu_banner", SRC + f"SELECT doc_id, {BANNER} AS license FROM fx_src")
def txt_04(spark, sf_dir):
    return src(spark, sf_dir).select("doc_id", L.gnu_banner(F.col("content")).alias("license"))


@query("txt_05_own_source", SRC + f"SELECT root, path, coalesce({TAG}, {BANNER}) AS license FROM fx_src WHERE {IS_SOURCE} AND NOT regexp_matches(path, '^(node_modules|third_party)/') AND NOT regexp_matches(path, '(^|/)vendor/') AND coalesce({TAG}, {BANNER}) IS NOT NULL AND NOT (root LIKE '%1' AND doc_id % 9 = 1) AND NOT contains(coalesce({TAG}, {BANNER}), 'Apache')")
def txt_05(spark, sf_dir):
    f = src(spark, sf_dir)
    projects = f.select("root", F.when(F.col("root").endswith("1"), "GPL-3.0-only").otherwise("MIT").alias("project_license")).distinct()
    return scan.scan_own_source(f, projects, ["Apache"]).select("root", "path", "license")


@query("txt_06_vendored", SRC + f", d AS (SELECT DISTINCT root, {DIR} AS dir FROM fx_src WHERE NOT path LIKE 'node_modules/%'), f1 AS (SELECT root, {DIR} AS dir, min({DETECT}) AS l FROM fx_src WHERE {NAME} = 'LICENSE' GROUP BY 1, 2), r AS (SELECT root, {DIR} AS dir, path, {TAG} AS license, row_number() OVER (PARTITION BY root, {DIR} ORDER BY path) AS n FROM fx_src WHERE {IS_SOURCE}), f2 AS (SELECT root, dir, arg_min(license, path) AS l FROM r WHERE n <= 50 AND license IS NOT NULL GROUP BY 1, 2), x AS (SELECT d.root, d.dir, coalesce(f1.l, f2.l) AS license, NOT starts_with(d.dir, 'src') AS v FROM d LEFT JOIN f1 USING (root, dir) LEFT JOIN f2 USING (root, dir)) SELECT root, dir, license, CASE WHEN v THEN 'vendored' ELSE 'unmanaged' END AS marker, license IS NULL AS unlicensed FROM x WHERE (v AND dir <> 'vendor/lib6') OR (NOT v AND license IS NOT NULL AND license <> 'GPL-3.0-only')")
def txt_06(spark, sf_dir):
    f = src(spark, sf_dir)
    projects = f.select("root", F.lit("gpl-3.0-ONLY").alias("project_license")).distinct()
    deps = f.select("root", F.lit("cargo").alias("ecosystem"), F.lit("LIB6").alias("name")).distinct()
    return scan.scan_vendored(f, deps, projects, f.limit(0).select("root", S.dir_of(F.col("path")).alias("dir")))


@query("jon_17_evidence", SRC + f", d AS (SELECT DISTINCT root, {DIR} AS dir FROM fx_src WHERE NOT path LIKE 'node_modules/%'), f1 AS (SELECT root, {DIR} AS dir, min({DETECT}) AS l FROM fx_src WHERE {NAME} = 'LICENSE' GROUP BY 1, 2) SELECT root, dir, f1.l AS license, NOT starts_with(dir, 'src') AS vendored FROM d LEFT JOIN f1 USING (root, dir) WHERE NOT starts_with(dir, 'src') OR (f1.l IS NOT NULL AND f1.l <> 'MIT' AND dir <> 'src/mod3')")
def jon_17(spark, sf_dir):
    f = src(spark, sf_dir)
    projects = f.select("root", F.lit("mit").alias("project_license")).distinct()
    manifests = f.select("root", F.lit("src/mod3").alias("dir")).distinct()
    return scan.dir_evidence(scan.dir_license(f), f, projects, manifests)


@query("jon_09_known_vendored", SRC + f", d AS (SELECT DISTINCT root, {DIR} AS dir FROM fx_src) SELECT root, dir, {NAME.replace('path', 'dir')} AS name FROM d WHERE {NAME.replace('path', 'dir')} NOT IN ('lib0', 'kit1')")
def jon_09(spark, sf_dir):
    f = src(spark, sf_dir)
    cands = f.select("root", S.dir_of(F.col("path")).alias("dir")).distinct().withColumn("name", S.name_of(F.col("dir")))
    deps = f.select("root", F.explode(F.array(F.struct(F.lit("cargo").alias("ecosystem"), F.lit("LIB0").alias("name")), F.struct(F.lit("nuget").alias("ecosystem"), F.lit("Kit1").alias("name")))).alias("d")).select("root", "d.*").distinct()
    return scan.drop_known_vendored(cands, deps)


DIRS = "dirs AS (SELECT DISTINCT root, dir FROM (SELECT root, 'vendor/a' || (doc_id % 3) || '/b' || (doc_id % 2) AS dir FROM documents_ UNION ALL SELECT root, 'src/x' || (doc_id % 4) FROM documents_ UNION ALL SELECT root, 'lib/External/p/q/r/s/t' FROM documents_ UNION ALL SELECT root, 'vendor/a0' FROM documents_ WHERE doc_id % 2 = 0) u)".replace("documents_", "fx_files")


def dirs(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_files")
    n = F.col("doc_id")
    parts = [
        f.select("root", F.concat(F.lit("vendor/a"), n % 3, F.lit("/b"), n % 2).alias("dir")),
        f.select("root", F.concat(F.lit("src/x"), n % 4).alias("dir")),
        f.select("root", F.lit("lib/External/p/q/r/s/t").alias("dir")),
        f.where("doc_id % 2 = 0").select("root", F.lit("vendor/a0").alias("dir")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


@query("jon_10_vendor_root", f"{FILES}, {DIRS} SELECT root, dir, 'vendor' AS vendor FROM dirs WHERE starts_with(dir, 'vendor/')")
def jon_10(spark, sf_dir):
    return scan.vendor_root(dirs(spark, sf_dir))


@query("jon_11_topmost", f"{FILES}, {DIRS} SELECT root, dir FROM dirs d WHERE NOT EXISTS (SELECT 1 FROM dirs o WHERE o.root = d.root AND starts_with(d.dir, o.dir || '/'))")
def jon_11(spark, sf_dir):
    return scan.topmost(dirs(spark, sf_dir))


@query("txt_07_project_license", FILES + f", t AS (SELECT root, min({DETECT}) AS l FROM fx_files WHERE doc_id % 7 = 0 GROUP BY 1), r AS (SELECT DISTINCT root FROM fx_files) SELECT root, coalesce(l, CASE root WHEN 'src1' THEN 'ISC' WHEN 'src2' THEN 'Zlib' WHEN 'src3' THEN 'BSD-3-Clause' END) AS license FROM r LEFT JOIN t USING (root) WHERE l IS NOT NULL OR root IN ('src1', 'src2', 'src3')")
def txt_07(spark, sf_dir):
    f = fixture(spark, sf_dir, "fx_files")
    top = f.where("doc_id % 7 = 0").select("root", F.lit("LICENSE").alias("path"), "content")
    more = [("src1", "package.json", '{"license": "ISC"}'), ("src1", "Cargo.toml", '[package]\nlicense = "MIT"'), ("src2", "Cargo.toml", '[package]\nlicense = "Zlib"\n'), ("src3", "pyproject.toml", '[tool.x]\nlicense = "not"\n[project]\nlicense = {text = "BSD-3-Clause"}')]
    return scan.project_license(top.unionByName(spark.createDataFrame(more, "root string, path string, content string"))).where("license is not null")
