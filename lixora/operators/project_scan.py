"""A whole scan of many projects: manifests, installed copies, own sources, vendored code, resolution, verdicts, gate.

The texts of a corpus are read once: ``corpus_evidence`` writes out what they say, and everything else works on that.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lixora.operators import graph, scan
from lixora.operators.config import ComplianceConfig, settings
from lixora.operators.evidence import corpus_evidence
from lixora.operators.judge import judge
from lixora.operators.osdb import installed_artifacts
from lixora.operators.report import drop_ignored_deps, drop_ignored_licenses, gate
from lixora.operators.resolve import coalesce_sources, resolve_from_definitions, resolve_from_registry
from lixora.operators.shared import cut, large
from lixora.sources.files import LANGUAGE_ALIASES, dir_of, language_of, name_of
from lixora.sources.ignore import IGNORE_FILE, ignored_paths
from lixora.sources.manifests import cargo_graph, cargo_members, exploded_deps

#: The ecosystem of each kind of manifest; kinds left out here name projects, not packages.
ECOSYSTEM = {
    "package.json": "npm", "package-lock.json": "npm", "yarn.lock": "npm", "pnpm-lock": "npm", "ls.json": "npm", "Pipfile.lock": "pypi", "requirements": "pypi", "uv.lock": "pypi", "pyproject": "pypi", "renv.lock": "cran", "DESCRIPTION": "cran",
    "packages.lock.json": "nuget", "project.assets.json": "nuget", "csproj": "nuget", "pom.xml": "maven", "gradle": "maven", "go.mod": "golang", "Gemfile": "gem", "Gemfile.lock": "gem", "Cargo.lock": "cargo", "Cargo.toml": "cargo",
    "conanfile": "conan", "conanfile.py": "conan", "vcpkg.json": "generic", "cmake": "generic", "Makefile": "generic", "configure": "generic", "pkg-config": "generic", "bazel": "generic", "WORKSPACE": "generic", "control": "deb",
}
LANGUAGE = {"npm": "node", "pypi": "python", "cran": "r", "nuget": "dotnet", "maven": "java", "golang": "go", "gem": "ruby", "cargo": "rust", "conan": "cpp", "deb": "c"}
FOUND = ["root", "source", "ecosystem", "name", "version", "license", "depth"]
EDGES = ["ecosystem", "name", "version", "needs_name", "needs_version"]


def manifest_deps(evidence: DataFrame, language: str | None = None) -> DataFrame:
    """(root, ecosystem, name, version): the packages that manifests and lock files outside pruned directories name. A
    package without a version goes if another row of it has one."""
    kinds = list(ECOSYSTEM)
    if language:
        asked = LANGUAGE_ALIASES.get(language.lower(), language.lower())
        kinds = [k for k in kinds if LANGUAGE.get(ECOSYSTEM[k], "generic") == asked]
    rows = exploded_deps(evidence.where(F.col("kind").isin(kinds)))
    table = F.create_map(*[F.lit(x) for kv in ECOSYSTEM.items() for x in kv])
    rows = rows.select("root", F.element_at(table, F.col("kind")).alias("ecosystem"), "name", "version")
    versions = rows.groupBy("root", "ecosystem", "name").agg(F.collect_set("version").alias("v"))
    stated = F.filter("v", lambda x: x != "")
    return versions.select("root", "ecosystem", "name", F.explode(F.when(F.size(stated) > 0, stated).otherwise(F.col("v"))).alias("version"))


def _node(ecosystem: str, name: str, version: str):
    return F.struct(F.col(ecosystem).alias("ecosystem"), F.col(name).alias("name"), F.col(version).alias("version"))


def with_transitive(deps: DataFrame, edges: DataFrame, max_depth: int) -> DataFrame:
    """deps(root, ecosystem, name, version) with depth 0, and what they need by edges(EDGES), as deep as the rule of each
    ecosystem goes (``depth_budget``). Versions must be equal; a package at several depths has the least one."""
    step = edges.select(_node("ecosystem", "name", "version").alias("src"), _node("ecosystem", "needs_name", "needs_version").alias("dst"))
    direct = deps.select(F.col("root").alias("project_id"), _node("ecosystem", "name", "version").alias("pkg_id"), graph.depth_budget(F.col("ecosystem"), max_depth).alias("budget"))
    reached = graph.budgeted_closure(direct, step)
    return reached.select(F.col("project_id").alias("root"), "pkg_id.ecosystem", "pkg_id.name", "pkg_id.version", "depth")


def workspace_members(evidence: DataFrame, max_depth: int = graph.MOST_DEPTH) -> DataFrame:
    """(root, ecosystem, name, version, members): the members of Cargo workspaces that need a package, sorted, by the lock
    files of each root."""
    # a lock's packages are told apart by its root and path
    node = lambda c: F.to_json(F.struct("root", "path", F.col(c).alias("node")))
    members, edges = cargo_members(evidence), cargo_graph(evidence)
    direct = members.select(node("member").alias("member"), node("member").alias("pkg_id"))
    made = graph.attribute_workspaces(direct, edges.select(node("src").alias("src"), node("dst").alias("dst")), max_depth, label=lambda c: F.get_json_object(c, "$.node"))
    at = F.get_json_object("pkg_id", "$.node")
    root_type = evidence.schema["root"].dataType
    rows = made.select(F.get_json_object("pkg_id", "$.root").cast(root_type).alias("root"), F.lit("cargo").alias("ecosystem"), F.regexp_replace(at, "@[^@]*$", "").alias("name"), F.substring_index(at, "@", -1).alias("version"), F.split("members", ",").alias("members"))
    return rows.groupBy("root", "ecosystem", "name", "version").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("members")))), ",").alias("members"))


def scan_projects(
    files: DataFrame,
    cfg: ComplianceConfig,
    snapshot: DataFrame | None = None,
    definitions: DataFrame | None = None,
    project_licenses: DataFrame | None = None,
    language: str | None = None,
    no_local: bool = False,
    no_vendor_scan: bool = False,
    no_clearlydefined: bool = False,
    strict: bool = False,
    edges: DataFrame | None = None,
    max_depth: int = 10,
    ignored_deps: DataFrame | None = None,
    follow_ignore: bool = True,
) -> DataFrame:
    """Findings of all projects (root) in a file corpus (root, path, content), judged.

    A dependency's licence comes from its installed copy (not with no_local), else the registry snapshot, else the
    definitions (not with no_clearlydefined). With edges(EDGES), what dependencies need is found, too, to ``max_depth``.
    Own sources and vendored code are findings of their own (vendored not with no_vendor_scan), but for what the corpus's
    ignore files leave out (unless not follow_ignore); code without any licence is restrictive. project_licenses(root,
    license) win over what a project's files say. Licence texts are read by the user rules of cfg first.
    ignored_deps(name, version) are no findings. Columns: FOUND, members (of a workspace), project_license,
    is_restrictive, osi_status, compatibility.
    """
    rules = [(i, markers) for i, markers, _ in cfg.custom]
    evidence = corpus_evidence(files, rules)
    detected = scan.project_license(evidence)
    if project_licenses is not None:
        detected = coalesce_sources(["root"], project_licenses, detected)
    projects = cut(detected.select("root", F.col("license").alias("project_license")))
    deps = manifest_deps(evidence, language).withColumn("depth", F.lit(0))
    deps = cut(deps if edges is None else with_transitive(deps, edges, max_depth))
    rows = deps.withColumn("license", F.lit(None).cast("string"))
    if not no_local:
        local = cut(installed_artifacts(evidence).where("license is not null"))
        exact = local.groupBy("root", "ecosystem", "name", "version").agg(F.min("license").alias("of_version"))
        other = local.groupBy("root", "ecosystem", "name").agg(F.min("license").alias("of_name"))
        rows = deps.join(large(exact), ["root", "ecosystem", "name", "version"], "left").join(large(other), ["root", "ecosystem", "name"], "left")
        rows = rows.withColumn("license", F.coalesce("of_version", "of_name")).drop("of_version", "of_name")
    if snapshot is not None:
        rows = resolve_from_registry(rows, snapshot)
    if definitions is not None and not no_clearlydefined:
        rows = resolve_from_definitions(rows, definitions)
    facts = evidence.select("root", "path", "said", "tag", "banner")
    if follow_ignore:
        listed = cut(evidence.where(name_of(F.col("path")) == IGNORE_FILE).select("root", dir_of(F.col("path")).alias("dir"), "rules"))
        if not listed.isEmpty():
            facts = cut(facts.join(large(ignored_paths(facts, listed)), ["root", "path"], "left_anti"))
    none, flat = F.lit(""), F.lit(None).cast("int")
    found = rows.select("root", F.lit("manifest").alias("source"), "ecosystem", "name", "version", "license", "depth")
    own = scan.scan_own_source(facts, projects, []).select("root", F.lit("own-source").alias("source"), F.lit("generic").alias("ecosystem"), F.col("path").alias("name"), none.alias("version"), "license", flat.alias("depth"))
    found = found.unionByName(own)
    if not no_vendor_scan:
        manifests = facts.where(language_of(F.col("path")).isNotNull()).select("root", dir_of(F.col("path")).alias("dir"))
        vendored = scan.scan_vendored(facts, deps, projects, manifests)
        found = found.unionByName(vendored.select("root", F.col("marker").alias("source"), F.lit("generic").alias("ecosystem"), F.col("dir").alias("name"), none.alias("version"), "license", flat.alias("depth")))
    found = drop_ignored_licenses(found, cfg.ignore) if cfg.ignore else found
    found = cut(found if ignored_deps is None else drop_ignored_deps(found, ignored_deps))
    if evidence.where("kind = 'Cargo.lock'").isEmpty():
        found = found.withColumn("members", F.lit(None).cast("string"))
    else:
        found = found.join(large(workspace_members(evidence)), ["root", "ecosystem", "name", "version"], "left").select(*FOUND, "members")
    judged = judge(found.join(large(projects), "root", "left"), cfg, strict, licenses=found)
    unlicensed = F.col("source").isin("vendored", "unmanaged") & F.col("license").isNull()
    return judged.withColumn("is_restrictive", F.col("is_restrictive") | unlicensed)


def scan_with_settings(files: DataFrame, file: str | None = None, environment: Mapping[str, str] | None = None, cfg: ComplianceConfig | None = None, **inputs) -> DataFrame:
    """``scan_projects`` under the options of ``settings``: environment over file (TOML text) over defaults. Lists of
    cfg that an option names are replaced by the option's."""
    spark, said = files.sparkSession, settings(file, environment)
    cfg = cfg or ComplianceConfig.default(spark)
    cfg = ComplianceConfig(cfg.registry, cfg.matrix, cfg.osi, said["licenses.restrictive"], said["licenses.ignore"], cfg.custom)
    ignored = [(d["name"], d.get("version", "")) for d in said["dependencies.ignore"]]
    if ignored and "ignored_deps" not in inputs:
        inputs["ignored_deps"] = spark.createDataFrame(ignored, "name string, version string")
    return scan_projects(files, cfg, **{"strict": said["strict"], "max_depth": said["dependencies.max_depth"]} | inputs)


def scan_gate(findings: DataFrame, fail_on_restrictive: bool = True, fail_on_incompatible: bool = True) -> DataFrame:
    """(root, has_restrictive, has_incompatible, passed) of each project that has findings."""
    return gate(findings.withColumnRenamed("root", "project_id"), fail_on_restrictive, fail_on_incompatible).withColumnRenamed("project_id", "root")
