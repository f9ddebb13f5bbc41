"""Queries over SBOM documents made from the dependency fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from lixora.functions import licenses as L
from lixora.operators import sbom
from lixora.operators.shared import shared_path, spread, written
from lixora.plans.identity import COORD
from lixora.plans.judging import PACKS, pool
from lixora.plans.registry import query
from lixora.sources.fixtures import duck, findings, fixture

CREATED = "2024-01-01T00:00:00Z"
REL = duck("fx_packages", "fx_projects", "fx_deps")
LOWER = "CASE WHEN ecosystem IN ('npm', 'golang', 'deb', 'rpm', 'apk') THEN lower(name) WHEN ecosystem = 'pypi' THEN regexp_replace(lower(name), '[-_.]+', '-', 'g') ELSE name END"
STATED = "CASE WHEN license IS NULL OR upper(trim(license)) IN ('', 'NOASSERTION', 'NONE') THEN NULL ELSE license END"
SPDXED = "CASE WHEN license = 'The Apache Software License, Version 2.0' THEN NULL ELSE " + STATED + " END"
ROWS = "r AS (SELECT d.project_id AS doc_id, p.*, row_number() OVER (PARTITION BY d.project_id ORDER BY ecosystem, name, version) - 1 AS pos FROM fx_deps d JOIN fx_packages p USING (pkg_id))"


def spdx_docs(spark, sf_dir):
    return sbom.to_spdx(findings(spark, sf_dir), CREATED)


def cyclonedx_docs(spark, sf_dir):
    return sbom.to_cyclonedx(findings(spark, sf_dir), CREATED)


def mixed(spark, sf_dir):
    """A document of each project, in one format or the other by its number, and texts that are no such documents."""
    rows = findings(spark, sf_dir)
    spdx, cyclonedx = sbom.to_spdx(rows.where("project_id % 2 = 0"), CREATED), sbom.to_cyclonedx(rows.where("project_id % 2 = 1"), CREATED)
    other = fixture(spark, sf_dir, "fx_packages").select((-F.col("pkg_id") - 1).alias("doc_id"), F.when(F.col("pkg_id") % 2 == 0, '{"a": 1}').otherwise("not json").alias("json"))
    return spdx.unionByName(cyclonedx).unionByName(other)


@query("src_08_sbom_formats", REL + " SELECT DISTINCT project_id AS doc_id, CASE WHEN project_id % 2 = 0 THEN 'spdx' ELSE 'cyclonedx' END AS format FROM fx_deps UNION ALL SELECT -pkg_id - 1, NULL FROM fx_packages")
def src_08(spark, sf_dir):
    return sbom.read_sboms(mixed(spark, sf_dir)).select("doc_id", "format")


@query("jsn_01_spdx_components", f"{REL}, {ROWS} SELECT doc_id, pos, ecosystem, {LOWER} AS name, version, {SPDXED} AS license FROM r")
def jsn_01(spark, sf_dir):
    return sbom.spdx_components(spdx_docs(spark, sf_dir))


@query("jsn_02_cyclonedx_components", f"{REL}, {ROWS} SELECT doc_id, pos, ecosystem, {LOWER} AS name, version, {STATED} AS license FROM r")
def jsn_02(spark, sf_dir):
    return sbom.cyclonedx_components(cyclonedx_docs(spark, sf_dir))


@query("jsn_03_ingest", f"{REL}, {ROWS} SELECT doc_id, pos, ecosystem, {LOWER} AS name, version, CASE WHEN doc_id % 2 = 0 THEN {SPDXED} ELSE {STATED} END AS license, CASE WHEN doc_id % 2 = 0 THEN 'spdx' ELSE 'cyclonedx' END AS format FROM r")
def jsn_03(spark, sf_dir):
    return sbom.ingest_sboms(mixed(spark, sf_dir))


@query("snk_05_spdx", f"{REL}, {ROWS} SELECT doc_id, 'SPDX-2.3' AS version, 'https://spdx.example/project-' || doc_id AS namespace, '{CREATED}' AS created, pos, name, version AS package_version, coalesce({SPDXED}, 'NOASSERTION') AS declared, 'NOASSERTION' AS concluded, {COORD} || '@' || version AS purl, true AS described FROM r")
def snk_05(spark, sf_dir):
    """The documents, taken apart again: a row for every package in its place."""
    kind = "struct<spdxVersion:string,documentNamespace:string,creationInfo:struct<created:string>,packages:array<struct<SPDXID:string,name:string,versionInfo:string,licenseDeclared:string,licenseConcluded:string,externalRefs:array<struct<referenceType:string,referenceLocator:string>>>>,relationships:array<struct<relationshipType:string,relatedSpdxElement:string>>>"
    d = spdx_docs(spark, sf_dir).select("doc_id", F.from_json("json", kind).alias("d"))
    rows = d.select("doc_id", "d.spdxVersion", "d.documentNamespace", "d.creationInfo.created", F.posexplode(F.arrays_zip("d.packages", "d.relationships")).alias("pos", "x"))
    p = F.col("x.packages")
    described = (F.col("x.relationships.relationshipType") == "DESCRIBES") & (F.col("x.relationships.relatedSpdxElement") == p["SPDXID"]) & p["SPDXID"].startswith("SPDXRef-Package-")
    url = F.get(p["externalRefs"], F.lit(0))["referenceLocator"]
    return rows.select("doc_id", F.col("spdxVersion").alias("version"), F.col("documentNamespace").alias("namespace"), "created", F.col("pos").cast("long").alias("pos"), p["name"].alias("name"), p["versionInfo"].alias("package_version"), p["licenseDeclared"].alias("declared"), p["licenseConcluded"].alias("concluded"), url.alias("purl"), described.alias("described"))


FREE = "license = 'The Apache Software License, Version 2.0'"


@query("snk_06_cyclonedx", f"{REL}, {ROWS} SELECT doc_id, 'CycloneDX 1.5' AS format, '{CREATED}' AS created, pos, 'library' AS type, name, version, {COORD} || '@' || version AS purl, CASE WHEN NOT {FREE} AND NOT contains(license, ' ') THEN {STATED} END AS id, CASE WHEN {FREE} THEN license END AS free_name, CASE WHEN NOT {FREE} AND contains(license, ' ') THEN {STATED} END AS expression FROM r")
def snk_06(spark, sf_dir):
    """The documents, taken apart again: a row for every component in its place."""
    kind = "struct<bomFormat:string,specVersion:string,metadata:struct<timestamp:string>,components:array<struct<type:string,name:string,version:string,purl:string,licenses:array<struct<license:struct<id:string,name:string>,expression:string>>>>>"
    d = cyclonedx_docs(spark, sf_dir).select("doc_id", F.from_json("json", kind).alias("d"))
    rows = d.select("doc_id", F.concat_ws(" ", "d.bomFormat", "d.specVersion").alias("format"), F.col("d.metadata.timestamp").alias("created"), F.posexplode("d.components").alias("pos", "c"))
    said = F.get("c.licenses", F.lit(0))
    return rows.select("doc_id", "format", "created", F.col("pos").cast("long").alias("pos"), "c.type", "c.name", "c.version", "c.purl", said["license"]["id"].alias("id"), said["license"]["name"].alias("free_name"), said["expression"].alias("expression"))


@query("snk_07_enriched", f"{REL}, {ROWS} SELECT doc_id, pos, coalesce({SPDXED}, CASE WHEN pos % 2 = 0 THEN 'ISC' ELSE 'Some Licence' END) AS license FROM r")
def snk_07(spark, sf_dir):
    docs = written(spdx_docs(spark, sf_dir), "documents")  # read three times
    answers = sbom.spdx_components(docs).select("doc_id", "pos", F.when(F.col("pos") % 2 == 0, "ISC").otherwise("Some Licence").alias("license"))
    return sbom.spdx_components(sbom.enrich_sbom(docs, answers)).select("doc_id", "pos", "license")


REFS = "CASE pkg_id % 3 WHEN 0 THEN 'LicenseRef-1 AND MIT' WHEN 1 THEN 'LicenseRef-11' ELSE 'MIT' END"


@query("jon_15_license_refs", PACKS + " SELECT pkg_id, CASE pkg_id % 3 WHEN 0 THEN 'One AND MIT' WHEN 1 THEN 'Apache-2.0' ELSE 'MIT' END AS license FROM fx_packages")
def jon_15(spark, sf_dir):
    refs = F.array(*[F.struct(F.lit(i).alias("licenseId"), F.lit(n).alias("name"), F.lit(t).alias("extractedText")) for i, n, t in (("LicenseRef-1", "One", "x"), ("LicenseRef-11", "Eleven", "Apache License, Version 2.0"))])
    return pool(spark, sf_dir).select("pkg_id", sbom.expand_license_refs(F.expr(REFS), refs).alias("license"))


RAW = "CASE pkg_id % 7 WHEN 0 THEN 'MIT / Apache-2.0' WHEN 1 THEN 'GPL (see file)' WHEN 2 THEN 'a  b' WHEN 3 THEN 'Proprietary' WHEN 4 THEN 'BSD{3}' WHEN 5 THEN 'A--B' ELSE 'MIT/ISC' END"


@query("nrm_05_spdx_expression", PACKS + " SELECT pkg_id, CASE pkg_id % 7 WHEN 0 THEN 'MIT OR Apache-2.0' WHEN 1 THEN 'GPL (see file)' WHEN 6 THEN 'MIT OR ISC' ELSE 'NOASSERTION' END AS license FROM fx_packages")
def nrm_05(spark, sf_dir):
    return pool(spark, sf_dir).select("pkg_id", L.to_spdx_expression(F.expr(RAW)).alias("license"))


@query("nrm_06_sanitised", PACKS + " SELECT pkg_id, name AS spdx_name, version AS spdx_version, CASE pkg_id % 7 WHEN 0 THEN 'MIT OR Apache-2.0' WHEN 1 THEN 'GPL (see file)' WHEN 6 THEN 'MIT OR ISC' ELSE 'NOASSERTION' END AS spdx_license, CASE WHEN pkg_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN pkg_id % 7 = 1 THEN 0 ELSE 1 END AS fixes FROM fx_packages")
def nrm_06(spark, sf_dir):
    p = pool(spark, sf_dir).withColumns({"license": F.expr(RAW), "name": F.when(F.col("pkg_id") % 2 == 0, F.concat("name", F.lit('"\t'))).otherwise(F.col("name"))})
    return sbom.sanitize_spdx(p).select("pkg_id", "spdx_name", "spdx_version", "spdx_license", "fixes")


@query("nrm_07_license_refs", PACKS + " SELECT DISTINCT license, CASE license WHEN 'No License' THEN 'LicenseRef-No-License' WHEN 'The Apache Software License, Version 2.0' THEN 'LicenseRef-The-Apache-Software-License-Version-2.0' END AS ref FROM fx_packages WHERE license IS NOT NULL")
def nrm_07(spark, sf_dir):
    return pool(spark, sf_dir).where("license is not null").select("license", L.license_ref(F.col("license")).alias("ref")).distinct()


BAD_SPDX = """CASE pkg_id % 5 WHEN 0 THEN '{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"","documentNamespace":"urn:x","creationInfo":{},"packages":[]}'
  WHEN 1 THEN '[1]' WHEN 2 THEN '{"spdxVersion":"2.3","SPDXID":"x","name":"n","documentNamespace":"","creationInfo":{},"packages":[{"SPDXID":"a"},{"SPDXID":"SPDXRef-b","downloadLocation":"x","filesAnalyzed":false}]}'
  WHEN 3 THEN '{"spdxVersion":"SPDX-2.1","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"n","documentNamespace":"https://x","creationInfo":{},"packages":[{"name":"a"}]}' ELSE 'broken' END"""
SPDX_FOUND = """VALUES (0, 'error', 'name', 'empty'), (0, 'warning', 'documentNamespace', 'not a URL'), (0, 'warning', 'packages', 'empty'), (1, 'error', 'document', 'not a JSON object'), (4, 'error', 'document', 'not a JSON object'),
  (2, 'error', 'dataLicense', 'missing'), (2, 'warning', 'spdxVersion', 'no SPDX- prefix'), (2, 'info', 'spdxVersion', 'neither 2.2 nor 2.3'), (2, 'error', 'documentNamespace', 'empty'), (2, 'warning', 'packages[0].SPDXID', 'no SPDXRef- prefix'), (2, 'error', 'packages[0].downloadLocation', 'missing'), (2, 'info', 'packages[0].filesAnalyzed', 'missing'),
  (3, 'info', 'spdxVersion', 'neither 2.2 nor 2.3'), (3, 'error', 'packages[0].SPDXID', 'missing'), (3, 'error', 'packages[0].downloadLocation', 'missing'), (3, 'info', 'packages[0].filesAnalyzed', 'missing')"""


def bad_docs(spark, sf_dir, texts):
    return pool(spark, sf_dir).select(F.col("pkg_id").alias("doc_id"), F.expr(texts).alias("json"))


@query("val_01_spdx", PACKS + f", f(k, severity, field, message) AS ({SPDX_FOUND}) SELECT pkg_id AS doc_id, severity, field, message FROM fx_packages JOIN f ON k = pkg_id % 5")
def val_01(spark, sf_dir):
    return sbom.validate_spdx(bad_docs(spark, sf_dir, BAD_SPDX))


BAD_CYCLONE = """CASE pkg_id % 4 WHEN 0 THEN '{"bomFormat":"CycloneDX","specVersion":"1.9","components":[],"metadata":{"timestamp":"never","tools":[{"vendor":"x"}]}}' WHEN 1 THEN '"x"'
  WHEN 2 THEN '{"bomFormat":"Other","components":[{"type":"gadget","version":"","licenses":[{}]},{"name":"x"}],"metadata":{"timestamp":"2024-01-01T00:00:00Z","tools":{"components":[]}}}' ELSE '{"specVersion":"1.5"}' END"""
CYCLONE_FOUND = """VALUES (0, 'warning', 'specVersion', 'unknown version'), (0, 'info', 'components', 'empty'), (0, 'warning', 'metadata.timestamp', 'not a timestamp'), (0, 'warning', 'metadata.tools', 'tool without a name'), (1, 'error', 'document', 'not a JSON object'),
  (2, 'error', 'specVersion', 'missing'), (2, 'error', 'bomFormat', 'not CycloneDX'), (2, 'warning', 'components[0].type', 'unknown type'), (2, 'warning', 'components[0].version', 'empty'), (2, 'warning', 'components[0].licenses', 'neither license nor expression'), (2, 'error', 'components[1].type', 'missing'), (3, 'error', 'bomFormat', 'missing')"""


@query("val_02_cyclonedx", PACKS + f", f(k, severity, field, message) AS ({CYCLONE_FOUND}) SELECT pkg_id AS doc_id, severity, field, message FROM fx_packages JOIN f ON k = pkg_id % 4")
def val_02(spark, sf_dir):
    return sbom.validate_cyclonedx(bad_docs(spark, sf_dir, BAD_CYCLONE))


SUMS = "count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS infos, count(*) FILTER (severity = 'error') = 0 AS is_valid"


@query("agg_11_validation", PACKS + f", f(k, severity, field, message) AS ({SPDX_FOUND}) SELECT pkg_id AS doc_id, {SUMS} FROM fx_packages LEFT JOIN f ON k = pkg_id % 5 GROUP BY 1")
def agg_11(spark, sf_dir):
    docs = bad_docs(spark, sf_dir, BAD_SPDX)
    return sbom.validation_summary(docs, sbom.validate_spdx(docs))


@query("snk_10_validation_report", PACKS + f", f(k, severity, field, message) AS ({SPDX_FOUND}) SELECT pkg_id AS doc_id, count(f.k) AS issues, count(*) FILTER (severity = 'error') = 0 AS is_valid FROM fx_packages LEFT JOIN f ON k = pkg_id % 5 GROUP BY 1")
def snk_10(spark, sf_dir):
    docs = bad_docs(spark, sf_dir, BAD_SPDX)
    r = sbom.validation_report(docs, sbom.validate_spdx(docs))
    return r.select("doc_id", F.size(F.from_json(F.get_json_object("report", "$.issues"), "array<string>")).cast("long").alias("issues"), F.get_json_object("report", "$.is_valid").cast("boolean").alias("is_valid"))


#: Documents as other tools write them: numbers, nulls, texts, lists and nameless entries among the packages, fields of other types.
FOREIGN_SPDX = """concat('{"SPDXID":"SPDXRef-DOCUMENT","hasExtractedLicensingInfos":[4,{"licenseId":"LicenseRef-', pkg_id, '","extractedText":"Mozilla Public License, Version 2.0"},{"licenseId":"LicenseRef-x","name":"ISC"},{"name":"lost"}],"packages":[7,null,{"name":" ', name,
  ' ","versionInfo":"', version, '","licenseConcluded":5,"licenseDeclared":"LicenseRef-', pkg_id, ' OR LicenseRef-x"},"text",{"versionInfo":"1"},{"name":"","licenseDeclared":"MIT"},[1],{"name":8},{"name":"u","versionInfo":2,"externalRefs":[3,{"referenceType":"other"},{"referenceType":"PURL","referenceLocator":"pkg:cargo/u', pkg_id, '@3"}]}]}')"""
FOREIGN_CYCLONE = """concat('{"specVersion":"1.4","components":[null,{"type":"library","version":"1"},{"name":"', name, '","version":"', version, '","licenses":[1,{"license":{"id":7,"name":"MIT"}},{"license":null},{"expression":"ISC OR 0BSD"}]},3,{"name":"u","purl":"pkg:cargo/u', pkg_id, '@3","licenses":{"license":"MIT"}}]}')"""


def foreign(spark, sf_dir, *texts):
    p = spread(pool(spark, sf_dir))
    return [p.select((F.col("pkg_id") * len(texts) + i).alias("doc_id"), F.expr(t).alias("json")) for i, t in enumerate(texts)]


@query(
    "jsn_01_foreign_entries",
    PACKS + """ SELECT pkg_id AS doc_id, 2 AS pos, 'generic' AS ecosystem, name, version, 'MPL-2.0 OR ISC' AS license FROM fx_packages
    UNION ALL SELECT pkg_id, 8, 'cargo', 'u' || pkg_id, '3', NULL FROM fx_packages""",
)
def jsn_01_foreign(spark, sf_dir):
    return sbom.spdx_components(foreign(spark, sf_dir, FOREIGN_SPDX)[0])


@query(
    "jsn_02_foreign_entries",
    PACKS + """ SELECT pkg_id AS doc_id, 2 AS pos, 'generic' AS ecosystem, name, version, 'MIT AND (ISC OR 0BSD)' AS license FROM fx_packages
    UNION ALL SELECT pkg_id, 4, 'cargo', 'u' || pkg_id, '3', NULL FROM fx_packages""",
)
def jsn_02_foreign(spark, sf_dir):
    return sbom.cyclonedx_components(foreign(spark, sf_dir, FOREIGN_CYCLONE)[0])


FOREIGN_FOUND = """VALUES (0, 'error', 'spdxVersion', 'missing'), (0, 'error', 'dataLicense', 'missing'), (0, 'error', 'name', 'missing'), (0, 'error', 'documentNamespace', 'missing'), (0, 'error', 'creationInfo', 'missing'),
  (1, 'error', 'bomFormat', 'missing'), (1, 'error', 'components[2].type', 'missing'), (1, 'error', 'components[4].type', 'missing')"""
IN_PACKAGES = "UNION ALL SELECT k.k, k.severity, 'packages[' || i || '].' || k.field, 'missing' FROM (VALUES (0, 'error', 'SPDXID'), (0, 'error', 'downloadLocation'), (0, 'info', 'filesAnalyzed')) k(k, severity, field), (VALUES (2), (4), (5), (7), (8)) i(i)"


@query("val_03_foreign_documents", PACKS + f", f(k, severity, field, message) AS ({FOREIGN_FOUND} {IN_PACKAGES}) SELECT 2 * pkg_id + k AS doc_id, severity, field, message FROM fx_packages, f")
def val_03(spark, sf_dir):
    """What is wrong with the sound entries of such documents, in both formats."""
    spdx, cyclonedx = foreign(spark, sf_dir, FOREIGN_SPDX, FOREIGN_CYCLONE)
    return sbom.validate_spdx(spdx).unionByName(sbom.validate_cyclonedx(cyclonedx))


ANSWERS = ["MIT", "MIT OR ISC", "The \"Odd\" Licence, v2", "unknown"]


@query(
    "snk_07_written_back",
    PACKS + """ SELECT 2 * pkg_id AS doc_id, 9 AS entries, true AS same_rest, CASE pkg_id % 4 WHEN 0 THEN '"MIT"' WHEN 1 THEN '"MIT OR ISC"' WHEN 2 THEN '"LicenseRef-The-Odd-Licence-v2"' END AS written,
      CASE pkg_id % 4 WHEN 2 THEN '{"extractedText":"The \\"Odd\\" Licence, v2","licenseId":"LicenseRef-The-Odd-Licence-v2","name":"The \\"Odd\\" Licence, v2"}' END AS info FROM fx_packages
    UNION ALL SELECT 2 * pkg_id + 1, 5, true, CASE pkg_id % 4 WHEN 0 THEN '[{"license":{"id":"MIT"}}]' WHEN 1 THEN '[{"expression":"MIT OR ISC"}]' WHEN 2 THEN '[{"license":{"name":"The \\"Odd\\" Licence, v2"}}]' ELSE '{"license":"MIT"}' END, NULL FROM fx_packages""",
)
def snk_07_back(spark, sf_dir):
    """Both formats written back by position: what the open entry says now, and whether all other entries are as they were."""
    spdx, cyclonedx = foreign(spark, sf_dir, FOREIGN_SPDX, FOREIGN_CYCLONE)
    docs = spdx.unionByName(cyclonedx)
    answer = F.element_at(F.array(*map(F.lit, ANSWERS)), F.floor(F.col("doc_id") / 2).cast("int") % 4 + 1)
    answers = sbom.ingest_sboms(docs).where("license is null").select("doc_id", "pos", answer.alias("license"))
    both = docs.select("doc_id", F.parse_json("json").alias("old")).join(sbom.enrich_sbom(docs, answers).select("doc_id", F.parse_json("json").alias("new")), "doc_id")
    listed = lambda v, k: F.try_variant_get(v, f"$.{k}", "array<variant>")
    entries = lambda v: F.coalesce(listed(v, "packages"), listed(v, "components"))
    last = F.get(entries(F.col("new")), F.size(entries(F.col("new"))) - 1)
    rest = lambda v: F.transform(F.slice(entries(v), 1, F.size(entries(v)) - 1), lambda x: F.to_json(x))
    written = F.coalesce(*[F.to_json(F.try_variant_get(last, f"$.{k}", "variant")) for k in ("licenseConcluded", "licenses")])
    infos = listed(F.col("new"), "hasExtractedLicensingInfos")
    return both.select("doc_id", F.size(entries(F.col("new"))).alias("entries"), (rest(F.col("old")) == rest(F.col("new"))).alias("same_rest"), written.alias("written"), F.to_json(F.get(infos, F.lit(4))).alias("info"))


#: All projects as twenty large fleets, a package for each project that needs it.
FLEETS = "r AS (SELECT d.project_id % 20 AS doc_id, p.*, row_number() OVER (PARTITION BY d.project_id % 20 ORDER BY ecosystem, name, version) - 1 AS pos FROM fx_deps d JOIN fx_packages p USING (pkg_id))"


@query("snk_05_written_files", f"{REL}, {FLEETS} SELECT doc_id, pos, 'spdx' AS format, ecosystem, {LOWER} AS name, version, {SPDXED} AS license FROM r UNION ALL SELECT doc_id, pos, 'cyclonedx', ecosystem, {LOWER}, version, {STATED} FROM r")
def snk_05_files(spark, sf_dir):
    """Documents of both formats written part by part, one file each, and read back."""
    rows = findings(spark, sf_dir).withColumn("project_id", F.col("project_id") % 20)
    out = None
    for name, parts in (("spdx", sbom.spdx_parts(rows, CREATED)), ("cyclonedx", sbom.cyclonedx_parts(rows, CREATED))):
        path = shared_path(spark, name)
        sbom.write_documents(parts, path)
        back = sbom.read_parts(spark, path, name).withColumn("format", F.lit(name))
        out = back if out is None else out.unionByName(back)
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
