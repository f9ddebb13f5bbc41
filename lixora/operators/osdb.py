"""Installed packages of operating systems, and artifacts installed beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.functions.licenses import classifier_license, detect_license, is_compound, normalize_debian, normalize_rpm
from lixora.operators.shared import large
from lixora.sources.lines import carry_forward, deb822, field, numbered_lines

APK_DB, DPKG_DB = r"(?:^|/)lib/apk/db/installed$", r"(?:^|/)var/lib/dpkg/status$"
OS_RELEASE = ["etc/os-release", "usr/lib/os-release"]
#: Rpm entries that are no packages.
PSEUDO = ["gpg-pubkey"]
MOST_LICENSE_NAME = 100


def apk_packages(files: DataFrame) -> DataFrame:
    """(root, name, version, license) of apk databases: records of K:value lines, cut at blank lines."""
    records = files.where(F.col("path").rlike(APK_DB)).select("root", F.posexplode(F.split("content", r"\n[ \t]*\n")).alias("rec", "text"))
    value = lambda k: F.nullif(F.trim(F.try_element_at(F.regexp_extract_all("text", F.lit(f"(?m)^{k}:(.*)$"), F.lit(1)), F.lit(-1))), F.lit(""))
    rows = records.where(F.col("text").rlike("(?m)^P:")).select("root", value("P").alias("name"), value("V").alias("version"), value("L").alias("license"))
    return rows.where("name is not null")


def dpkg_packages(files: DataFrame) -> DataFrame:
    """(root, name, version, source) of installed packages, one per name and version."""
    fields = deb822(files.where(F.col("path").rlike(DPKG_DB)), ["root"])
    rows = field(fields, ["root"], "Package", "Status", "Version", "Source")
    rows = rows.where(F.try_element_at(F.split(F.trim("Status"), r"\s+"), F.lit(-1)) == "installed").where("Package is not null")
    source = F.nullif(F.trim(F.regexp_replace("Source", r"\(.*$", "")), F.lit(""))
    rows = rows.select("root", F.col("Package").alias("name"), F.coalesce("Version", F.lit("")).alias("version"), source.alias("source"), "stanza")
    return rows.groupBy("root", "name", "version").agg(F.min_by("source", "stanza").alias("source"))


def owned_paths(files: DataFrame) -> DataFrame:
    """(root, path) that OS packages own: dpkg .list files, F: and R: lines of apk databases."""
    lists = numbered_lines(files.where(F.col("path").rlike(r"(?:^|/)var/lib/dpkg/info/[^/]+\.list$")), ["root", "path"])
    dpkg = lists.where(F.trim("line") != "").select("root", F.regexp_replace(F.trim("line"), "^/", "").alias("path"))
    lines = numbered_lines(files.where(F.col("path").rlike(APK_DB)), ["root", "path"])
    in_dir = carry_forward(lines, ["root", "path"], "pos", F.when(F.startswith("line", F.lit("F:")), F.substring("line", 3, 10_000)), "dir")
    apk = in_dir.where(F.startswith("line", F.lit("R:"))).select("root", F.concat_ws("/", F.nullif("dir", F.lit("")), F.substring("line", 3, 10_000)).alias("path"))
    return dpkg.unionByName(apk).distinct()


def rpm_owned(rows: DataFrame) -> DataFrame:
    """(root, path) of exported rpm triples: base names, directory names, and the index of each base's directory."""
    each = rows.select("root", F.explode(F.arrays_zip("base_names", "dir_indexes")).alias("z"), "dir_names")
    return each.select("root", F.regexp_replace(F.concat(F.get("dir_names", F.col("z.dir_indexes")), F.col("z.base_names")), "^/", "").alias("path")).distinct()


def distro_namespace(files: DataFrame) -> DataFrame:
    """(root, namespace): ID of the first os-release that has one."""
    rank = F.when(F.col("path") == OS_RELEASE[0], 0).when(F.col("path") == OS_RELEASE[1], 1)
    id_ = F.lower(F.trim(F.translate(F.regexp_extract("content", r"(?m)^ID=(.*)$", 1), "\"'", "")))
    rows = files.select("root", rank.alias("rank"), F.nullif(id_, F.lit("")).alias("id")).where("rank is not null and id is not null")
    return rows.groupBy("root").agg(F.min_by("id", "rank").alias("namespace"))


def rpm_packages(rows: DataFrame) -> DataFrame:
    """name, version text and SPDX licence of exported rpm headers (name, version, release, epoch, license)."""
    base = F.concat_ws("-", "version", F.nullif("release", F.lit("")))
    full = F.when(F.coalesce("epoch", F.lit(0)) != 0, F.concat(F.col("epoch").cast("string"), F.lit(":"), base)).otherwise(base)
    return rows.where(~F.col("name").isin(PSEUDO)).select(*[c for c in rows.columns if c not in ("version", "release", "epoch", "license")], full.alias("version"), normalize_rpm(F.col("license")).alias("license"))


def copyright_license(files: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, license): of a machine-readable copyright file the licence of Files: *, else the first; else by text."""
    fields = deb822(files, keys)
    stanzas = field(fields, keys, "Format", "Files", "License")
    first_line = F.trim(F.substring_index("License", "\n", 1))
    picked = stanzas.groupBy(*keys).agg(
        F.min_by("Format", "stanza").alias("format"),
        F.min_by(first_line, F.when((F.trim("Files") == "*") & (first_line != ""), F.col("stanza"))).alias("all"),
        F.min_by(first_line, F.when(first_line != "", F.col("stanza"))).alias("any"),
    )
    said = F.when(F.col("format").contains("copyright-format") | F.col("format").contains("dep5"), normalize_debian(F.coalesce("all", "any")))
    return files.join(large(picked), keys, "left").select(*keys, F.coalesce(said, detect_license(F.col("content"))).alias("license"))


def dpkg_licenses(packages: DataFrame, copyrights: DataFrame) -> DataFrame:
    """packages with license: of their own copyright file, else of the source package's. copyrights(root, name, license)."""
    own = copyrights.select("root", "name", F.col("license").alias("own"))
    of_source = copyrights.select("root", F.col("name").alias("source"), F.col("license").alias("theirs"))
    return packages.join(large(own), ["root", "name"], "left").join(large(of_source), ["root", "source"], "left").withColumn("license", F.coalesce("own", "theirs")).drop("own", "theirs")


def node_license(manifest: Column) -> Column:
    """Licence of package.json: text, an object's type, or the licenses list joined by OR."""
    said = lambda c: F.when(~F.upper(F.trim(c)).isin("", "UNLICENSED", "NONE", "NOASSERTION"), F.trim(c))
    v = F.get_json_object(manifest, "$.license")
    one = F.when(v.startswith("{"), said(F.get_json_object(manifest, "$.license.type"))).otherwise(said(v))
    items = F.from_json(F.get_json_object(manifest, "$.licenses"), "array<string>")
    each = F.filter(F.transform(items, lambda x: F.when(x.startswith("{"), F.get_json_object(x, "$.type")).otherwise(x)), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return F.coalesce(one, F.nullif(F.array_join(each, " OR "), F.lit("")))


def python_license(rows: DataFrame) -> DataFrame:
    """rows (expression, stated, classifiers, shipped) with license, by what says most."""
    stated = F.when(~F.lower(F.trim("stated")).isin("", "unknown"), F.trim("stated"))
    name = F.when(~F.contains(stated, F.lit("\n")) & (F.length(stated) <= MOST_LICENSE_NAME), stated)
    named = F.get(F.filter(F.transform("classifiers", lambda c: F.when(F.trim(c).startswith("License :: "), classifier_license(F.trim(c)))), lambda x: x.isNotNull()), F.lit(0))
    first = F.coalesce(F.nullif(F.trim("expression"), F.lit("")), F.when(is_compound(name), name), named, detect_license(name), F.col("shipped"), name, detect_license(stated))
    return rows.withColumn("license", first)


def installed_artifacts(files: DataFrame) -> DataFrame:
    """(root, path, ecosystem, name, version, license) of node and Python packages, told by where their metadata lies.
    files may be ``corpus_evidence``."""
    if "text" not in files.columns:
        files = files.select("root", "path", F.col("content").alias("text"), F.when(F.col("path").rlike(r"\.dist-info/"), detect_license(F.col("content"))).alias("said"))
    node = files.where(F.col("path").rlike(r"(?:^|/)node_modules/(?:@[^/]+/)?[^/]+/package\.json$"))
    node = node.select("root", "path", F.lit("npm").alias("ecosystem"), F.get_json_object("text", "$.name").alias("name"), F.coalesce(F.get_json_object("text", "$.version"), F.lit("")).alias("version"), node_license(F.col("text")).alias("license"))
    meta = files.where(F.col("path").rlike(r"[^/]+\.(?:dist-info/METADATA|egg-info/PKG-INFO)$"))
    fields = deb822(meta.select("root", "path", F.regexp_extract("text", r"(?s)^(.*?)(?:\n[ \t]*\n|\z)", 1).alias("content")), ["root", "path"]).where("stanza = 0")
    first = field(fields, ["root", "path"], "Name", "Version", "License", "License-Expression")
    classified = fields.where("lower(name) = 'classifier'").groupBy("root", "path").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "value"))), lambda s: s["value"]).alias("classifiers"))
    shipped = files.where(F.col("path").rlike(r"\.dist-info/(?:licenses/)?LICEN[SC]E[^/]*$")).select("root", F.regexp_replace("path", r"/(?:licenses/)?[^/]+$", "/METADATA").alias("path"), F.col("said").alias("shipped")).groupBy("root", "path").agg(F.max("shipped").alias("shipped"))
    rows = first.join(large(classified), ["root", "path"], "left").join(large(shipped), ["root", "path"], "left").withColumnsRenamed({"License-Expression": "expression", "License": "stated"})
    python = python_license(rows).select("root", "path", F.lit("pypi").alias("ecosystem"), F.col("Name").alias("name"), F.coalesce("Version", F.lit("")).alias("version"), "license")
    return node.unionByName(python).where("name is not null and trim(name) <> ''")


def drop_owned(artifacts: DataFrame, owned: DataFrame) -> DataFrame:
    """Artifacts whose metadata no OS package owns."""
    return artifacts.join(large(owned.select("root", "path").distinct()), ["root", "path"], "left_anti")


def dedupe_artifacts(artifacts: DataFrame) -> DataFrame:
    """One row per root, ecosystem, name and version: that of the first path."""
    rest = [c for c in artifacts.columns if c not in ("root", "ecosystem", "name", "version")]
    return artifacts.groupBy("root", "ecosystem", "name", "version").agg(F.min_by(F.struct(*rest), "path").alias("r")).select("root", "ecosystem", "name", "version", "r.*")


