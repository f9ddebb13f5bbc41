"""Licence evidence in file trees: directories, headers, vendored copies, own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lixora.functions.ids import coordinates
from lixora.functions.licenses import detect_license, gnu_banner, spdx_header
from lixora.operators.report import drop_ignored_licenses
from lixora.operators.shared import cut, large
from lixora.sources.files import OWN_SKIPPED, VENDOR_DIRS, VENDOR_SKIPPED, dir_of, in_any, in_vendor_dir, is_hidden, is_source_path, name_of

#: Licence file names by priority; the last two say OFL-1.1 by themselves.
LICENSE_FILES = ["LICENSE", "LICENSE.txt", "LICENSE.md", "license", "COPYING", "COPYING.md", "copyright", "OFL.txt", "OFL-1.1.txt"]
MOST_FILES, MOST_DEPTH, VENDOR_DEPTH = 50, 3, 4


def file_rank(path: Column) -> Column:
    table = F.create_map(*[x for i, n in enumerate(LICENSE_FILES) for x in (F.lit(n), F.lit(i))])
    return F.element_at(table, name_of(path))


def file_facts(files: DataFrame) -> DataFrame:
    """(root, path, said, tag, banner) of every file: what a licence file says, the SPDX header and the GNU banner of a
    source file. The texts are read once for it, and what is written out is narrow."""
    path, source = F.col("path"), is_source_path(F.col("path"))
    said = F.when(name_of(path).isin(LICENSE_FILES[-2:]), "OFL-1.1").otherwise(detect_license(F.col("content")))
    head = F.array_join(F.slice(F.split("content", r"\r?\n"), 1, 30), "\n")
    facts = [F.when(file_rank(path).isNotNull(), said).alias("said"), F.when(source, spdx_header(F.col("content"))).alias("tag"), F.when(source, gnu_banner(head)).alias("banner")]
    return cut(files.select("root", "path", *facts))


def dir_license(files: DataFrame) -> DataFrame:
    """(root, dir, license): what the first licence file that says something says. files may be ``file_facts``."""
    said = F.when(name_of(F.col("path")).isin(LICENSE_FILES[-2:]), "OFL-1.1").otherwise(detect_license(F.col("content"))) if "content" in files.columns else F.col("said")
    rows = files.select("root", dir_of(F.col("path")).alias("dir"), file_rank(F.col("path")).alias("rank"), "path", said.alias("license")).where("rank is not null and license is not null")
    return rows.groupBy("root", "dir").agg(F.min_by("license", F.struct("rank", "path", "license")).alias("license"))


def dir_header_license(files: DataFrame, tag: Column | None = None) -> DataFrame:
    """(root, dir, license): the first valid header among the first 50 source files up to three levels down.

    Every directory above a source file has a row, whether it holds files itself or not. Paths are ordered name by name;
    hidden names below a directory don't count.
    """
    header = spdx_header(F.col("content")) if tag is None else tag
    rows = files.where(is_source_path(F.col("path"))).select("root", F.split("path", "/").alias("names"), header.alias("license"))
    rows = rows.withColumn("depth", F.explode(F.sequence(F.lit(1), F.least(F.lit(MOST_DEPTH), F.size("names")))))
    rows = rows.where(~F.exists(F.slice("names", -F.col("depth"), F.col("depth")), lambda s: s.startswith(".")))
    rows = rows.select("root", F.array_join(F.slice("names", F.lit(1), F.size("names") - F.col("depth")), "/").alias("dir"), "names", "license")
    first = F.row_number().over(Window.partitionBy("root", "dir").orderBy("names"))
    rows = rows.withColumn("n", first).where(F.col("n") <= MOST_FILES).where("license is not null")
    return rows.groupBy("root", "dir").agg(F.min_by("license", "names").alias("license"))


def dir_license_text(files: DataFrame) -> DataFrame:
    """(root, dir, path): a directory's licence text, canonical names first, then LICENSE*, LICENCE*, COPYING* that aren't code."""
    name = name_of(F.col("path"))
    variant = F.upper(name).rlike("^(?:LICENSE|LICENCE|COPYING)") & ~is_source_path(F.col("path"))
    rank = F.coalesce(file_rank(F.col("path")), F.when(variant, len(LICENSE_FILES)))
    rows = files.select("root", dir_of(F.col("path")).alias("dir"), "path", rank.alias("rank")).where("rank is not null")
    return rows.groupBy("root", "dir").agg(F.min_by("path", F.struct("rank", "path")).alias("path"))


def ancestors(path: Column) -> Column:
    """A directory's proper ancestors, outermost first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def topmost(dirs: DataFrame) -> DataFrame:
    """(root, dir) rows without those below another row."""
    above = dirs.select("root", F.col("dir").alias("below"), F.explode(F.when(F.contains("dir", F.lit("/")), ancestors(F.col("dir")))).alias("dir"))
    covered = above.join(large(dirs.select("root", "dir")), ["root", "dir"], "left_semi").select("root", F.col("below").alias("dir")).distinct()
    return dirs.join(large(covered), ["root", "dir"], "left_anti")


def vendor_root(dirs: DataFrame) -> DataFrame:
    """(root, dir, vendor): the nearest enclosing vendor directory within depth 4, by an equi-join on ancestors."""
    vendors = dirs.where(in_vendor_dir(F.concat("dir", F.lit("/x")))).select("root", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("dir", "/"))), lambda n: F.array_join(F.slice(F.split("dir", "/"), 1, n), "/"))).alias("vendor")).distinct()
    vendors = vendors.where(in_vendor_dir(F.concat(name_of(F.col("vendor")), F.lit("/x"))))
    up = dirs.select("root", "dir", F.explode(F.concat(ancestors(F.col("dir")), F.array("dir"))).alias("vendor")).distinct()
    deep = F.size(F.split("dir", "/")) - F.size(F.split("vendor", "/"))
    near = up.join(large(vendors), ["root", "vendor"]).where(deep <= VENDOR_DEPTH)
    return near.groupBy("root", "dir").agg(F.max_by("vendor", F.length("vendor")).alias("vendor"))


def drop_known_vendored(candidates: DataFrame, deps: DataFrame) -> DataFrame:
    """Vendored names (root, dir, name) that no dependency has, in any ecosystem of the project, whatever the case."""
    play = deps.select(F.col("root"), "ecosystem").distinct()
    known = deps.select("root", F.lower(coordinates(F.col("ecosystem"), F.col("name"))).alias("purl")).distinct()
    asked = candidates.join(large(play), "root").withColumn("purl", F.lower(coordinates(F.col("ecosystem"), F.col("name"))))
    dropped = asked.join(large(known), ["root", "purl"], "left_semi").select("root", "dir", "name").distinct()
    return candidates.join(large(dropped), ["root", "dir", "name"], "left_anti")


def dir_evidence(licensed: DataFrame, files: DataFrame, projects: DataFrame, manifest_dirs: DataFrame) -> DataFrame:
    """(root, dir, license, vendored): outside vendor directories only licensed ones without a manifest and with another
    licence than the project's (root, project_license); inside, directories that have a licence or files of their own.
    A vendor directory itself only contains packages."""
    dirs = files.where(~is_hidden(F.col("path")) & ~in_any(F.col("path"), VENDOR_SKIPPED)).select("root", dir_of(F.col("path")).alias("dir")).distinct()
    below = F.concat("dir", F.lit("/x"))
    rows = dirs.withColumn("own", F.lit(True)).join(licensed, ["root", "dir"], "full").withColumn("vendored", in_vendor_dir(below))
    way = F.col("vendored") & ~is_hidden(F.col("dir")) & ~in_any(below, VENDOR_SKIPPED)
    rows = rows.where((F.col("own") | way) & ~F.lower(name_of(F.col("dir"))).isin(VENDOR_DIRS)).drop("own")
    managed = manifest_dirs.select("root", "dir").distinct().withColumn("managed", F.lit(True))
    asked = projects.select(F.col("root").alias("project"), "project_license")
    rows = rows.join(large(managed), ["root", "dir"], "left").join(large(asked), (F.col("root") == F.col("project")) & ~F.col("vendored"), "left")
    outside = "license is not null and dir <> '' and managed is null and (project_license is null or lower(license) <> lower(project_license))"
    return rows.where(f"vendored or ({outside})").select("root", "dir", "license", "vendored")


def scan_own_source(files: DataFrame, projects: DataFrame, ignore: list[str]) -> DataFrame:
    """(root, path, license): licences that own source files state, other than the project's, not ignored. files may
    be ``file_facts``."""
    path = F.col("path")
    rows = files.where(is_source_path(path) & ~in_any(path, OWN_SKIPPED) & ~is_hidden(path))
    head = F.array_join(F.slice(F.split("content", r"\r?\n"), 1, 30), "\n") if "content" in files.columns else None
    stated = F.coalesce("tag", "banner") if head is None else F.coalesce(spdx_header(F.col("content")), gnu_banner(head))
    rows = rows.select("root", "path", stated.alias("license")).where("license is not null")
    rows = rows.join(large(projects), "root", "left").where("project_license is null or lower(license) <> lower(project_license)").drop("project_license")
    return drop_ignored_licenses(rows, ignore)


def scan_vendored(files: DataFrame, deps: DataFrame, projects: DataFrame, manifest_dirs: DataFrame) -> DataFrame:
    """(root, dir, license, marker): topmost vendored or unmanaged directories that no dependency explains. No licence:
    restrictive. files may be ``file_facts``."""
    from lixora.operators.resolve import coalesce_sources

    files = file_facts(files) if "content" in files.columns else files
    licensed = coalesce_sources(["root", "dir"], dir_license(files), dir_header_license(files, F.col("tag")))
    found = dir_evidence(licensed, files, projects, manifest_dirs)
    named = found.withColumn("name", name_of(F.col("dir")))
    left = topmost(drop_known_vendored(named, deps))
    return left.select("root", "dir", "license", F.when(F.col("vendored"), "vendored").otherwise("unmanaged").alias("marker"), F.col("license").isNull().alias("unlicensed"))


def project_license(files: DataFrame) -> DataFrame:
    """(root, license): of the root directory's licence file, else package.json, Cargo.toml, pyproject.toml. files may be
    ``corpus_evidence``; else they are read once for it."""
    from lixora.operators.evidence import corpus_evidence

    top = files.where(~F.contains("path", F.lit("/")))
    top = corpus_evidence(top) if "content" in files.columns else top
    order = F.when(file_rank(F.col("path")).isNotNull(), file_rank(F.col("path"))).otherwise(F.expr("100 + array_position(array('package.json', 'Cargo.toml', 'pyproject.toml'), path)"))
    rows = top.select("root", "path", order.cast("int").alias("rank"), F.when(file_rank(F.col("path")).isNotNull(), F.col("said")).otherwise(F.col("stated")).alias("license"))
    return rows.groupBy("root").agg(F.min_by("license", F.when(F.col("license").isNotNull(), F.struct("rank", "path", "license"))).alias("license"))
