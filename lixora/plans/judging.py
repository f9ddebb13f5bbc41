"""Queries of judgement and reports over the dependency fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lixora.functions import licenses as L
from lixora.functions.expressions import expr_leaves, fold_expr, parse_expr
from lixora.functions.ids import semver_key
from lixora.operators import config, judge, report
from lixora.operators.config import COMPATIBLE, OSI, RESTRICTIVE, ComplianceConfig
from lixora.operators.rank import ranked
from lixora.operators.shared import cut
from lixora.plans.registry import query
from lixora.sources.fixtures import POOL, duck, findings, fixture


def lit(values):
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def norm_sql(x: str) -> str:
    """The alias rules as DuckDB reads them."""
    u = f"upper(trim({x}))"
    has = lambda *ps: "(" + " AND ".join(f"contains({u}, '{p}')" for p in ps) + ")"
    return f"""CASE WHEN {u} IN ('MIT','MIT LICENSE') THEN 'MIT' WHEN {u} IN ('ISC','ISC LICENSE') THEN 'ISC'
  WHEN {u} IN ('0BSD','BSD-ZERO-CLAUSE','BSD ZERO CLAUSE') THEN '0BSD' WHEN {u} IN ('UNLICENSE','THE UNLICENSE') THEN 'Unlicense'
  WHEN {u} IN ('WTFPL','DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE') THEN 'WTFPL' WHEN {u} IN ('ZLIB','ZLIB LICENSE') THEN 'Zlib'
  WHEN {u} IN ('CC0','CC0-1.0','CC0 1.0','CREATIVE COMMONS ZERO') THEN 'CC0-1.0' WHEN {has('APACHE', '2')} THEN 'Apache-2.0'
  WHEN {has('AGPL', '3')} OR {has('AFFERO', 'GPL', '3')} THEN 'AGPL-3.0' WHEN {has('GPL', '3')} AND NOT {has('LGPL')} THEN 'GPL-3.0'
  WHEN {has('GPL', '2')} AND NOT {has('LGPL')} THEN 'GPL-2.0' WHEN {has('LGPL', '3')} THEN 'LGPL-3.0' WHEN {has('LGPL', '2')} THEN 'LGPL-2.1'
  WHEN {has('MPL', '2.0')} THEN 'MPL-2.0' WHEN {has('BSD', '3')} OR {has('BSD', 'THREE')} THEN 'BSD-3-Clause'
  WHEN {has('BSD', '2')} OR {has('BSD', 'TWO')} THEN 'BSD-2-Clause' ELSE {x} END"""


#: Alternatives of each compound of the pool, each a set of ids.
DNF = {
    "MIT OR Apache-2.0": [["MIT"], ["Apache-2.0"]],
    "MIT AND GPL-3.0-only": [["MIT", "GPL-3.0-only"]],
    "(MIT OR GPL-2.0-only) AND BSD-3-Clause": [["MIT", "BSD-3-Clause"], ["GPL-2.0-only", "BSD-3-Clause"]],
    "GPL-2.0-only WITH Classpath-exception-2.0": [["GPL-2.0-only"]],
}
DNF_ROWS = ", ".join(f"('{p}', {k}, '{leaf}')" for p in POOL if p for k, clause in enumerate(DNF.get(p, [[p]])) for leaf in clause)
MATRIX = ", ".join(f"('{p}', '{d}')" for p, allowed in COMPATIBLE.items() for d in allowed)
RESTRICTED = " OR ".join(f"contains(leaf, '{r}')" for r in RESTRICTIVE)
CODE = {"compat": "CASE {x} WHEN 2 THEN 'Compatible' WHEN 0 THEN 'Incompatible' ELSE 'Unknown' END", "osi": "CASE {x} WHEN 2 THEN 'Approved' WHEN 0 THEN 'NotApproved' ELSE 'Unknown' END"}

VERDICTS = f"""dnf(license, clause, leaf) AS (VALUES {DNF_ROWS}), matrix(project_license, dep) AS (VALUES {MATRIX}),
leaf1 AS (SELECT DISTINCT leaf, {norm_sql('leaf')} AS norm, CASE WHEN {RESTRICTED} THEN 0 ELSE 2 END AS free FROM dnf),
leaf2 AS (SELECT leaf, norm, free, CASE WHEN norm IN ({lit(OSI)}) THEN 2 WHEN norm = 'No License' THEN 0 ELSE 1 END AS osi FROM leaf1),
own AS (SELECT license, max(free) AS free, max(osi) AS osi FROM (SELECT license, clause, min(free) AS free, min(osi) AS osi FROM dnf JOIN leaf2 USING (leaf) GROUP BY 1, 2) c GROUP BY 1),
pl AS (SELECT DISTINCT project_license FROM fx_projects WHERE project_license IS NOT NULL),
pair AS (SELECT license, project_license, max(v) AS compat FROM (SELECT license, clause, pl.project_license, min(CASE WHEN m.dep IS NULL THEN 0 ELSE 2 END) AS v
  FROM dnf JOIN leaf2 USING (leaf) CROSS JOIN pl LEFT JOIN matrix m ON m.project_license = pl.project_license AND m.dep = leaf2.norm GROUP BY 1, 2, 3) c GROUP BY 1, 2),
judged AS (SELECT d.project_id, pr.project_license, p.pkg_id, p.ecosystem, p.name, p.version, p.license,
    CASE WHEN p.license = 'No License' THEN true WHEN p.license IS NULL THEN false ELSE own.free = 0 END AS is_restrictive,
    {CODE['osi'].format(x='own.osi')} AS osi_status, {CODE['compat'].format(x='pair.compat')} AS compatibility
  FROM fx_deps d JOIN fx_packages p USING (pkg_id) JOIN fx_projects pr USING (project_id) LEFT JOIN own ON own.license = p.license
  LEFT JOIN pair ON pair.license = p.license AND pair.project_license = pr.project_license)"""
JUDGED = f"{duck('fx_packages', 'fx_projects', 'fx_deps')}, {VERDICTS} "
UNRESOLVED = "(license IS NULL OR trim(license) = '' OR lower(trim(license)) IN ('unknown', 'no license') OR starts_with(lower(trim(license)), 'unknown ('))"
BUCKET = f"CASE WHEN is_restrictive THEN 'restrictive' WHEN {UNRESOLVED} THEN 'unresolved' ELSE 'permissive' END"
ROW = "project_id, pkg_id, name, version, license, is_restrictive, osi_status, compatibility"
COLS = ROW.split(", ")
PACKS = duck("fx_packages")


def judged(spark, sf_dir):
    return judge.judge(findings(spark, sf_dir), ComplianceConfig.default(spark), licenses=pool(spark, sf_dir))


def pool(spark, sf_dir):
    return fixture(spark, sf_dir, "fx_packages")


@query("agg_01_license_summary", JUDGED + "SELECT coalesce(license, 'No License') AS license, count(*) AS n FROM judged WHERE NOT is_restrictive GROUP BY 1")
def agg_01(spark, sf_dir):
    return report.license_summary(judged(spark, sf_dir))


@query("agg_02_tally", JUDGED + f"SELECT project_license, sum(({BUCKET} = 'permissive')::BIGINT)::BIGINT AS permissive, sum(({BUCKET} = 'restrictive')::BIGINT)::BIGINT AS restrictive, sum(({BUCKET} = 'unresolved')::BIGINT)::BIGINT AS unresolved, count(*) AS total FROM judged GROUP BY 1")
def agg_02(spark, sf_dir):
    return report.tally(judged(spark, sf_dir), ["project_license"])


@query("agg_03_compat_counts", JUDGED + "SELECT count(*) FILTER (project_license IS NOT NULL AND compatibility = 'Compatible') AS compatible, count(*) FILTER (project_license IS NOT NULL AND compatibility = 'Incompatible') AS incompatible, count(*) FILTER (project_license IS NOT NULL AND compatibility = 'Unknown') AS \"unknown\" FROM judged")
def agg_03(spark, sf_dir):
    return report.compat_counts(judged(spark, sf_dir))


@query("agg_04_gate", JUDGED + "SELECT project_id, bool_or(is_restrictive) AS has_restrictive, bool_or(compatibility = 'Incompatible') AS has_incompatible, NOT (bool_or(is_restrictive) OR bool_or(compatibility = 'Incompatible')) AS passed FROM judged GROUP BY 1")
def agg_04(spark, sf_dir):
    return report.gate(judged(spark, sf_dir))


@query("agg_05_gist", JUDGED + "SELECT count(*) AS total, count(*) FILTER (is_restrictive) AS restrictive, count(*) FILTER (compatibility = 'Incompatible') AS incompatible, CASE WHEN count(*) FILTER (is_restrictive OR compatibility = 'Incompatible') > 0 THEN 'NEEDS ATTENTION' ELSE 'ALL GOOD' END AS verdict FROM judged")
def agg_05(spark, sf_dir):
    return report.gist(judged(spark, sf_dir))


@query("agg_06_workspace_breakdown", PACKS + "SELECT member, count(*) AS n FROM (SELECT unnest(['m' || (pkg_id % 5), 'w' || (pkg_id % 3)]) AS member FROM fx_packages) x GROUP BY 1")
def agg_06(spark, sf_dir):
    label = F.concat(F.lit("m"), F.col("pkg_id") % 5, F.lit(", w"), F.col("pkg_id") % 3)
    return report.workspace_breakdown(pool(spark, sf_dir).withColumn("sub_project", label))


@query("agg_13_rollup", JUDGED + f"SELECT ecosystem, bucket, compatibility, grouping(ecosystem, bucket, compatibility) AS level, count(*) AS n FROM (SELECT *, {BUCKET} AS bucket FROM judged) j GROUP BY CUBE (ecosystem, bucket, compatibility)")
def agg_13(spark, sf_dir):
    return report.rollup_report(judged(spark, sf_dir))


@query("fil_01_ignored_licenses", PACKS + "SELECT pkg_id, license FROM fx_packages WHERE license IS NULL OR NOT (contains(license, 'GPL') OR contains(license, 'Apache'))")
def fil_01(spark, sf_dir):
    return report.drop_ignored_licenses(pool(spark, sf_dir), ["GPL", "Apache"]).select("pkg_id", "license")


@query("fil_02_ignored_deps", PACKS + ", i AS (SELECT name, CASE WHEN pkg_id % 2 = 0 THEN '' ELSE version || CASE WHEN pkg_id % 3 = 0 THEN 'x' ELSE '' END END AS v FROM fx_packages WHERE pkg_id % 5 = 0) SELECT pkg_id FROM fx_packages p WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.name = p.name AND (i.v = '' OR i.v = p.version))")
def fil_02(spark, sf_dir):
    p = pool(spark, sf_dir)
    v = F.when(F.col("pkg_id") % 2 == 0, "").otherwise(F.concat("version", F.when(F.col("pkg_id") % 3 == 0, "x").otherwise("")))
    ignored = p.where("pkg_id % 5 = 0").select("name", v.alias("version"))
    return report.drop_ignored_deps(p, ignored).select("pkg_id")


@query("fil_03_risk_filter", JUDGED + f"SELECT {ROW} FROM judged WHERE is_restrictive OR compatibility = 'Incompatible'")
def fil_03(spark, sf_dir):
    return report.risk_filter(judged(spark, sf_dir), restrictive=True, incompatible=True).select(*COLS)


@query("fil_04_osi_filter", JUDGED + f"SELECT {ROW} FROM judged WHERE osi_status = 'NotApproved'")
def fil_04(spark, sf_dir):
    return report.osi_filter(judged(spark, sf_dir), "not-approved").select(*COLS)


@query("fil_05_facets", JUDGED + f"SELECT {ROW} FROM judged WHERE is_restrictive AND compatibility IN ('Incompatible', 'Unknown') AND osi_status IN ('Approved', 'Unknown')")
def fil_05(spark, sf_dir):
    facets = {"is_restrictive": [True], "compatibility": ["Incompatible", "Unknown"], "osi_status": ["Approved", "Unknown"]}
    return report.facet_filter(judged(spark, sf_dir), facets).select(*COLS)


@query("fil_06_unresolved", PACKS + f"SELECT pkg_id, {UNRESOLVED} AS unresolved FROM fx_packages")
def fil_06(spark, sf_dir):
    return pool(spark, sf_dir).select("pkg_id", L.is_unresolved(F.col("license")).alias("unresolved"))


@query("fil_07_stated", PACKS + "SELECT pkg_id, coalesce(upper(trim(license)) NOT IN ('', 'NOASSERTION', 'NONE'), false) AS stated FROM fx_packages")
def fil_07(spark, sf_dir):
    return pool(spark, sf_dir).select("pkg_id", L.is_stated(F.col("license")).alias("stated"))


POSTFIX = {
    "MIT OR Apache-2.0": "MIT Apache-2.0 OR",
    "MIT AND GPL-3.0-only": "MIT GPL-3.0-only AND",
    "(MIT OR GPL-2.0-only) AND BSD-3-Clause": "MIT GPL-2.0-only OR BSD-3-Clause AND",
    "GPL-2.0-only WITH Classpath-exception-2.0": "GPL-2.0-only",
}
POSTFIX_CASE = "CASE license " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in POSTFIX.items()) + " ELSE license END"


@query("exp_01_parse", PACKS + f"SELECT DISTINCT license, {POSTFIX_CASE} AS postfix FROM fx_packages WHERE license IS NOT NULL")
def exp_01(spark, sf_dir):
    return parse_expr(pool(spark, sf_dir)).select("license", F.array_join("rpn", " ").alias("postfix"))


@query("exp_02_leaves", PACKS + f", dnf(license, clause, leaf) AS (VALUES {DNF_ROWS}) SELECT DISTINCT license, leaf FROM dnf WHERE license IN (SELECT license FROM fx_packages)")
def exp_02(spark, sf_dir):
    return expr_leaves(parse_expr(pool(spark, sf_dir)))


@query("exp_03_fold", JUDGED + f"SELECT license, {CODE['osi'].format(x='osi')} AS osi_status, free = 2 AS free FROM own WHERE license IN (SELECT license FROM fx_packages)")
def exp_03(spark, sf_dir):
    cfg = ComplianceConfig.default(spark)
    parsed = parse_expr(pool(spark, sf_dir))
    leaves = judge.osi_status(judge.leaf_restrictive(expr_leaves(parsed).select("leaf").distinct(), cfg), cfg.osi)
    folded = fold_expr(parsed, leaves.select("leaf", (~F.col("restrictive")).alias("free"), "approved"), ["free", "approved"])
    return folded.select("license", judge.as_osi(F.col("approved")).alias("osi_status"), "free")


@query("exp_04_shapes", PACKS + "SELECT DISTINCT license, (contains(license, ' OR ') OR contains(license, ' AND ') OR contains(license, ' WITH ') OR contains(license, '(')) AS compound, regexp_full_match(license, '[A-Za-z0-9.+_-]+') AS bare, (contains(license, ' OR ') OR contains(license, ' AND ') OR contains(license, ' WITH ') OR contains(license, '(')) AND len(list_filter(string_split(translate(license, '()', '  '), ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[A-Za-z0-9.+_-]+'))) = 0 AS expression FROM fx_packages WHERE license IS NOT NULL")
def exp_04(spark, sf_dir):
    x = F.col("license")
    return pool(spark, sf_dir).where("license is not null").select("license", L.is_compound(x).alias("compound"), L.is_license_id(x).alias("bare"), L.is_expression(x).alias("expression")).distinct()


def seed_registry(spark):
    """Three registry entries, for tests and queries only."""
    rows = [("GPL-2.0", "GNU General Public License v2.0", [], ["disclose-source", "same-license"], []), ("LGPL-2.1", "GNU Lesser General Public License v2.1", [], ["same-license"], []), ("MPL-2.0", "Mozilla Public License 2.0", [], ["include-copyright"], [])]
    return spark.createDataFrame(rows, config.REGISTRY)


REG = ", reg(id, bad, shared) AS (VALUES ('GPL-2.0', true, true), ('LGPL-2.1', false, true), ('MPL-2.0', false, false)), l AS (SELECT DISTINCT leaf FROM leaf2 WHERE leaf IN (SELECT d.leaf FROM dnf d JOIN fx_packages p ON p.license = d.license)), b AS (SELECT leaf, CASE WHEN leaf LIKE '%-only' THEN left(leaf, length(leaf) - 5) WHEN leaf LIKE '%-or-later' THEN left(leaf, length(leaf) - 9) ELSE leaf END AS base FROM l)"


@query("exp_05_leaf_restrictive", JUDGED + REG + f"SELECT b.leaf, coalesce(e.bad OR e.shared, g.bad OR g.shared, {RESTRICTED.replace('leaf', 'b.leaf')} OR contains(b.leaf, 'Unknown')) AS restrictive FROM b LEFT JOIN reg e ON e.id = b.leaf LEFT JOIN reg g ON g.id = b.base")
def exp_05(spark, sf_dir):
    cfg = ComplianceConfig.from_tables(spark, registry=seed_registry(spark))
    return judge.leaf_restrictive(expr_leaves(parse_expr(pool(spark, sf_dir))).select("leaf").distinct(), cfg, strict=True)


@query("exp_06_classify", JUDGED + "SELECT DISTINCT license, is_restrictive, osi_status FROM judged")
def exp_06(spark, sf_dir):
    return judge.classify(findings(spark, sf_dir), ComplianceConfig.default(spark), licenses=pool(spark, sf_dir)).select("license", "is_restrictive", "osi_status").distinct()


@query("exp_07_annotate", JUDGED + f"SELECT {ROW} FROM judged")
def exp_07(spark, sf_dir):
    return judged(spark, sf_dir).select(*COLS)


@query("jon_01_registry", JUDGED + REG + "SELECT b.leaf, coalesce(e.id, g.id) IS NOT NULL AS found FROM b LEFT JOIN reg e ON e.id = b.leaf LEFT JOIN reg g ON g.id = b.base")
def jon_01(spark, sf_dir):
    leaves = expr_leaves(parse_expr(pool(spark, sf_dir))).select("leaf").distinct()
    return judge.join_registry(leaves, seed_registry(spark)).select("leaf", F.col("conditions").isNotNull().alias("found"))


@query("jon_02_compatibility", JUDGED + ", l AS (SELECT DISTINCT leaf, norm, j.project_license FROM judged j JOIN dnf USING (license) JOIN leaf2 USING (leaf) WHERE j.project_license IS NOT NULL) SELECT leaf, l.project_license, m.dep IS NOT NULL AS compatible FROM l LEFT JOIN matrix m ON m.project_license = l.project_license AND m.dep = l.norm")
def jon_02(spark, sf_dir):
    """Every id that occurs with a project licence, by the matrix."""
    pairs = findings(spark, sf_dir).select("license", "project_license").where("license is not null and project_license is not null").distinct()
    leaves = expr_leaves(parse_expr(pool(spark, sf_dir))).join(pairs, "license").select("leaf", "project_license").distinct()
    return judge.judge_compat(leaves, ComplianceConfig.default(spark).matrix)


@query("jon_03_osi", JUDGED + "SELECT leaf, osi = 2 AS approved FROM leaf2 WHERE osi <> 1 AND leaf IN (SELECT d.leaf FROM dnf d JOIN fx_packages p ON p.license = d.license)")
def jon_03(spark, sf_dir):
    leaves = expr_leaves(parse_expr(pool(spark, sf_dir))).select("leaf").distinct()
    return judge.osi_status(leaves, ComplianceConfig.default(spark).osi).where("approved is not null")


@query("nrm_01_aliases", PACKS + f"SELECT DISTINCT license, {norm_sql('license')} AS id FROM fx_packages")
def nrm_01(spark, sf_dir):
    return pool(spark, sf_dir).select("license", L.normalize_license_id(F.col("license")).alias("id")).distinct()


FIND = PACKS + "SELECT CAST(NULL AS VARCHAR) AS project_id, name, version, license, ecosystem"


@query("srt_01_sort", JUDGED + f"SELECT {ROW}, row_number() OVER (ORDER BY compatibility DESC, name, version, project_id) AS place FROM judged")
def srt_01(spark, sf_dir):
    """All findings with their places by verdict."""
    return report.place_findings(judged(spark, sf_dir), "compatibility", ascending=False, ties=("project_id",)).select(*COLS, "place")


NUMBERS = ", ".join(f"CAST(split_part(version, '.', {i}) AS INT) {{way}}" for i in (1, 2, 3))
PLACED = " UNION ALL ".join(f"SELECT '{c}' AS sorted_by, {a} AS ascending, pkg_id, row_number() OVER (ORDER BY {NUMBERS.format(way=w) if c == 'version' else f'{c} {w}'}, name, version, pkg_id) AS place FROM p" for c in report.SORTABLE for a, w in (("true", "ASC NULLS FIRST"), ("false", "DESC NULLS LAST")))
_OWN = f"SELECT pkg_id, name, version, license, CASE WHEN license = 'No License' THEN true WHEN license IS NULL THEN false ELSE own.free = 0 END AS is_restrictive, {CODE['osi'].format(x='own.osi')} AS osi_status, {CODE['compat'].format(x='pair.compat')} AS compatibility FROM fx_packages LEFT JOIN own USING (license) LEFT JOIN pair ON pair.license = fx_packages.license AND pair.project_license = 'MIT'"


@query("srt_01_places", f"{JUDGED}, p AS ({_OWN.replace('SELECT pkg_id, name, version, license', 'SELECT pkg_id, name, version, fx_packages.license')}) {PLACED}")
def srt_01_places(spark, sf_dir):
    """The place of every package by each of the six columns, both ways."""
    p = cut(judge.judge(pool(spark, sf_dir).withColumn("project_license", F.lit("MIT")), ComplianceConfig.default(spark)))
    out = None
    for column in report.SORTABLE:
        for ascending in (True, False):
            rows = report.place_findings(p, column, ascending, ties=("pkg_id",)).select(F.lit(column).alias("sorted_by"), F.lit(ascending).alias("ascending"), "pkg_id", "place")
            out = rows if out is None else out.unionByName(rows)
    return out


@query("srt_02_semver", PACKS + "SELECT pkg_id, row_number() OVER (ORDER BY CAST(split_part(version, '.', 1) AS INT), CAST(split_part(version, '.', 2) AS INT), CAST(split_part(version, '.', 3) AS INT), pkg_id) AS place FROM fx_packages")
def srt_02(spark, sf_dir):
    return ranked(pool(spark, sf_dir), semver_key(F.col("version")), F.col("pkg_id")).select("pkg_id", "place")


@query("set_01_inventory", PACKS + "SELECT name, version, 'manifest' AS source FROM fx_packages WHERE pkg_id % 3 = 0 UNION ALL SELECT name, version, 'sbom' FROM fx_packages WHERE pkg_id % 3 = 1 UNION ALL SELECT name, version, 'filesystem' FROM fx_packages WHERE pkg_id % 2 = 0")
def set_01(spark, sf_dir):
    p = pool(spark, sf_dir)
    parts = [report.as_findings(p.where(w), s) for w, s in (("pkg_id % 3 = 0", "manifest"), ("pkg_id % 3 = 1", "sbom"), ("pkg_id % 2 = 0", "filesystem"))]
    return report.inventory(*parts).select("name", "version", "source")


@query("set_03_config_validation", PACKS + ", r AS (SELECT license AS pattern FROM fx_packages WHERE pkg_id % 3 = 0 AND license IS NOT NULL), i AS (SELECT license AS pattern FROM fx_packages WHERE pkg_id % 7 = 0 AND license IS NOT NULL) SELECT pattern, 'overlap' AS problem, CAST(NULL AS BIGINT) AS times FROM (SELECT pattern FROM r INTERSECT SELECT pattern FROM i) x UNION ALL SELECT pattern, 'duplicate', count(*) FROM r GROUP BY 1 HAVING count(*) > 1")
def set_03(spark, sf_dir):
    p = pool(spark, sf_dir).where("license is not null").withColumnRenamed("license", "pattern")
    r, i = p.where("pkg_id % 3 = 0"), p.where("pkg_id % 7 = 0")
    both = config.overlap(r, i).select("pattern", F.lit("overlap").alias("problem"), F.lit(None).cast("long").alias("times"))
    return both.unionByName(config.duplicates(r).select("pattern", F.lit("duplicate").alias("problem"), "times"))


@query("set_04_difference", PACKS + ", o AS (SELECT * FROM fx_packages WHERE pkg_id % 10 <> 0), n AS (SELECT pkg_id, CASE WHEN pkg_id % 6 = 0 THEN 'MIT' ELSE license END AS license FROM fx_packages WHERE pkg_id % 10 <> 1) SELECT coalesce(o.pkg_id, n.pkg_id) AS pkg_id, o.license AS old_license, n.license AS new_license, CASE WHEN o.pkg_id IS NULL THEN 'added' WHEN n.pkg_id IS NULL THEN 'removed' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.pkg_id = n.pkg_id WHERE o.pkg_id IS NULL OR n.pkg_id IS NULL OR o.license IS DISTINCT FROM n.license")
def set_04(spark, sf_dir):
    p = pool(spark, sf_dir)
    new = p.where("pkg_id % 10 <> 1").withColumn("license", F.when(F.col("pkg_id") % 6 == 0, "MIT").otherwise(F.col("license")))
    return report.diff_findings(p.where("pkg_id % 10 <> 0"), new, ["pkg_id"])


@query("prj_02_verbose_view", JUDGED + "SELECT name, version, coalesce(license, 'No License') AS license, is_restrictive, osi_status, compatibility FROM judged")
def prj_02(spark, sf_dir):
    return report.verbose_view(judged(spark, sf_dir), project_known=True, sub_projects=False)


TEXT_SQL = """CASE WHEN contains(text, 'GNU AFFERO GENERAL PUBLIC LICENSE') AND contains(text, 'Version 3') THEN 'AGPL-3.0'
 WHEN contains(text, 'GNU LESSER GENERAL PUBLIC LICENSE') AND contains(text, 'Version 3') THEN 'LGPL-3.0' WHEN contains(text, 'GNU LESSER GENERAL PUBLIC LICENSE') AND contains(text, 'Version 2.1') THEN 'LGPL-2.1'
 WHEN contains(text, 'GNU GENERAL PUBLIC LICENSE') AND contains(text, 'Version 3') THEN 'GPL-3.0' WHEN contains(text, 'GNU GENERAL PUBLIC LICENSE') AND contains(text, 'Version 2') THEN 'GPL-2.0'
 WHEN contains(text, 'Apache License') AND contains(text, 'Version 2.0') THEN 'Apache-2.0' WHEN contains(text, 'Mozilla Public License') AND contains(text, 'Version 2.0') THEN 'MPL-2.0'
 WHEN contains(text, 'BSD') AND contains(text, 'Redistribution and use') AND contains(text, 'Neither the name') THEN 'BSD-3-Clause' WHEN contains(text, 'BSD') AND contains(text, 'Redistribution and use') THEN 'BSD-2-Clause'
 WHEN contains(text, 'SIL OPEN FONT LICENSE') OR contains(text, 'This Font Software is licensed under the SIL Open Font License') THEN 'OFL-1.1'
 WHEN contains(text, 'MIT License') OR (contains(text, 'Permission is hereby granted, free of charge') AND contains(text, 'associated documentation files')) THEN 'MIT'
 WHEN contains(text, 'ISC License') THEN 'ISC' WHEN contains(text, 'This is free and unencumbered software released into the public domain') OR contains(text, 'unlicense.org') THEN 'Unlicense' END"""


@query("txt_01_detect_license", f"SELECT doc_id, {TEXT_SQL} AS license FROM documents")
def txt_01(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", L.detect_license(F.col("text")).alias("license"))


USER_RULES = [("GPL-3.0", ["GNU General Public License", "version 3"]), ("CC-BY-NC-4.0", ["CC BY-NC 4.0"])]


@query("txt_02_user_rules", f"SELECT license, count(*) AS n FROM (SELECT CASE WHEN contains(text, 'GNU General Public License') AND contains(text, 'version 3') THEN 'GPL-3.0' WHEN contains(text, 'CC BY-NC 4.0') THEN 'CC-BY-NC-4.0' ELSE {TEXT_SQL} END AS license FROM documents) x GROUP BY 1")
def txt_02(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(L.detect_with_rules(F.col("text"), USER_RULES).alias("license")).agg(F.count("*").alias("n"))
