"""File corpora as tables of (root, path, content)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Descriptor names by language, lock files, and directories that are never entered.
MANIFESTS = {
    "Cargo.toml": "rust", "package.json": "node", "go.mod": "go", "go.work": "go", "pom.xml": "java", "build.gradle": "java", "build.gradle.kts": "java",
    "vcpkg.json": "cpp", "conanfile.txt": "cpp", "conanfile.py": "cpp", "CMakeLists.txt": "cpp", "MODULE.bazel": "cpp", "configure.ac": "c", "configure.in": "c", "Makefile": "c",
    "Gemfile": "ruby", "Gemfile.lock": "ruby", "requirements.txt": "python", "Pipfile.lock": "python", "pip_freeze.txt": "python", "pyproject.toml": "python", "DESCRIPTION": "r", "renv.lock": "r",
}
DOTNET = [".csproj", ".fsproj", ".vbproj", ".slnx"]
LOCKS = ["Cargo.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "go.sum", "go.work.sum", "uv.lock", "packages.lock.json"]
PRUNED = ["node_modules", ".git", "target", "vendor", ".venv", "venv"]
LANGUAGE_ALIASES = {"javascript": "node", "js": "node", "golang": "go", "py": "python", "rs": "rust", "c++": "cpp", "csharp": "dotnet", "c#": "dotnet", "rb": "ruby"}
#: Path rules of the scans.
SOURCE_EXTENSIONS = ["rs", "js", "jsx", "ts", "tsx", "mjs", "cjs", "py", "go", "rb", "java", "kt", "kts", "c", "h", "cc", "cpp", "cxx", "hpp", "hh", "cs", "php", "swift", "scala", "r"]
VENDOR_DIRS = ["vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "externals", "extern", "deps"]
VENDOR_SKIPPED = ["node_modules", "target", "venv", ".venv", "__pycache__", "site-packages", "bower_components", "Pods", "dist", "build", "out", "bin", "obj"]
OWN_SKIPPED = ["node_modules", "target", "vendor", "third_party", "venv", ".venv", "__pycache__", "site-packages", "bower_components", "Pods", "dist", "build"]


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(path, content) of every file under a path; the glob is applied before anything is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return df.select("path", F.col("content").cast("string").alias("content"))


def name_of(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_of(path: Column) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def segments(path: Column) -> Column:
    """Directory names of a path."""
    parts = F.split(path, "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def in_any(path: Column, names: list[str], lower: bool = False) -> Column:
    """Whether a path goes through a directory of one of the names."""
    return F.exists(segments(F.lower(path) if lower else path), lambda s: s.isin(names))


def is_source_path(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(?:" + "|".join(map(re.escape, SOURCE_EXTENSIONS)) + ")$")


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


def in_vendor_dir(path: Column) -> Column:
    return in_any(path, VENDOR_DIRS, lower=True)


def language_of(path: Column) -> Column:
    """Language of a manifest, else null."""
    table = F.create_map(*[F.lit(x) for kv in MANIFESTS.items() for x in kv])
    return F.coalesce(F.element_at(table, name_of(path)), F.when(path.rlike(r"\.(?:csproj|fsproj|vbproj|slnx)$"), "dotnet"))


def discover_descriptors(files: DataFrame) -> DataFrame:
    """(root, path, kind) of manifests and lock files outside pruned directories."""
    kind = F.when(name_of(F.col("path")).isin(LOCKS), "lock").when(language_of(F.col("path")).isNotNull(), "manifest")
    return files.where(~in_any(F.col("path"), PRUNED)).select("root", "path", kind.alias("kind")).where("kind is not null").distinct()


def project_roots(files: DataFrame, language: str | None = None) -> DataFrame:
    """(root, dir, language, file): one row per directory and language, with its first manifest."""
    rows = files.select("root", dir_of(F.col("path")).alias("dir"), language_of(F.col("path")).alias("language"), "path").where("language is not null")
    if language:
        rows = rows.where(F.col("language") == LANGUAGE_ALIASES.get(language.lower(), language.lower()))
    return rows.groupBy("root", "dir", "language").agg(F.min("path").alias("file"))


def header_lines(content: Column, lines: int = 30) -> Column:
    return F.slice(F.split(content, r"\r?\n"), 1, lines)
