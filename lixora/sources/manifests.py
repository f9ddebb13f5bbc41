"""Dependencies in manifests and lock files: (root, path, name, version, kind). Files are (root, path, content).

Every format is a column expression over one file's text that gives an array of (name, version); TOML files are turned
to JSON first, in Arrow batches. A file is sent to its format by its name, so a corpus is read once, whatever it holds, and nothing is shuffled but the rows that
repeat within a file's result (they are dropped inside the row).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.functions.ids import clean_version
from lixora.operators.shared import large, written
from lixora.sources.files import dir_of, name_of
from lixora.sources.toml import toml_json

NODE_SECTIONS = ["dependencies", "devDependencies", "peerDependencies", "optionalDependencies"]
NONE = "array<struct<name:string,version:string>>"


def dep(name: Column, version: Column | None = None) -> Column:
    return F.struct(F.trim(name).alias("name"), F.coalesce(F.trim(version) if version is not None else F.lit(""), F.lit("")).alias("version"))


def each(text: Column, pattern: str, make) -> Column:
    """make(match) of every match of a pattern."""
    return F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), make)


def found(text: Column, pattern: str, name: int = 1, version: int = 2, clean: str | None = None) -> Column:
    """Names and versions by two groups of a pattern; group 0 stands for no version."""

    def make(m: Column) -> Column:
        v = F.regexp_extract(m, pattern, version) if version else F.lit("")
        return dep(F.regexp_extract(m, pattern, name), clean_version(v, F.lit(clean)) if clean else v)

    return each(text, pattern, make)


def let(value: Column, body) -> Column:
    """body(value), with value worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def entries(text: Column, path: str, value: str) -> Column:
    """Entries (key, value) of a JSON object at a path; none if it isn't there."""
    return F.coalesce(F.map_entries(F.from_json(F.get_json_object(text, path), f"map<string, {value}>")), F.array().cast(f"array<struct<key:string,value:{_type(value)}>>"))


def _type(value: str) -> str:
    return value.replace(": ", ":").replace(", ", ",")


def package_json(text: Column) -> Column:
    return F.concat(*[F.transform(entries(text, f"$.{s}", "string"), lambda e: dep(e["key"], clean_version(e["value"], F.lit("npm")))) for s in NODE_SECTIONS])


def package_lock(text: Column) -> Column:
    """Names come from the node_modules/ key."""
    packages = F.filter(entries(text, "$.packages", "struct<version: string>"), lambda e: e["key"] != "")
    return F.transform(packages, lambda e: dep(F.regexp_replace(e["key"], "^.*node_modules/", ""), e["value"]["version"]))


def pipfile_lock(text: Column) -> Column:
    both = F.concat(entries(text, "$.default", "struct<version: string>"), entries(text, "$.develop", "struct<version: string>"))
    return F.transform(both, lambda e: dep(e["key"], F.regexp_replace(e["value"]["version"], "^=+", "")))


def renv_lock(text: Column) -> Column:
    packages = entries(text, "$.Packages", "struct<Package: string, Version: string>")
    return F.transform(packages, lambda e: dep(F.coalesce(e["value"]["Package"], e["key"]), e["value"]["Version"]))


def packages_lock_json(text: Column) -> Column:
    per_framework = entries(text, "$.dependencies", "map<string, struct<resolved: string>>")
    return F.flatten(F.transform(per_framework, lambda f: F.transform(F.map_entries(f["value"]), lambda e: dep(e["key"], e["value"]["resolved"]))))


def vcpkg_json(text: Column) -> Column:
    def make(d: Column) -> Column:
        is_object = F.startswith(d, F.lit("{"))
        return dep(F.when(is_object, F.get_json_object(d, "$.name")).otherwise(d), F.when(is_object, F.get_json_object(d, "$['version>=']")))

    return F.transform(F.from_json(F.get_json_object(text, "$.dependencies"), "array<string>"), make)


def ls_json(text: Column, depth: int = 15) -> Column:
    """Nested trees that package managers list: dependencies within dependencies, at most ``depth`` levels."""
    shape = "struct<version: string, dependencies: string>"
    level = entries(text, "$.dependencies", shape)
    out = level
    for _ in range(depth - 1):
        below = F.transform(level, lambda e: F.coalesce(F.map_entries(F.from_json(e["value"]["dependencies"], f"map<string, {shape}>")), F.array().cast(f"array<struct<key:string,value:{_type(shape)}>>")))
        level = F.flatten(below)
        out = F.concat(out, level)
    return F.transform(out, lambda e: dep(e["key"], e["value"]["version"]))


def assets_json(text: Column) -> Column:
    """Packages of project.assets.json, transitive ones too; projects aren't packages."""
    packages = F.filter(entries(text, "$.libraries", "struct<type: string>"), lambda e: e["value"]["type"] == "package")
    return F.transform(packages, lambda e: dep(F.substring_index(e["key"], "/", 1), F.substring_index(e["key"], "/", -1)))


def tag(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, f"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def without_comments(text: Column) -> Column:
    return F.regexp_replace(text, "(?s)<!--.*?(?:-->|\\z)", "")


def plain_xml(text: Column) -> Column:
    """The five named entities decoded."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def filled(text: Column, values: Column, shape: str) -> Column:
    """Placeholders (group 1 of shape is the name) replaced by the last value of that name, longest placeholder first.

    values: array of struct(k, v). A placeholder without a value stays.
    """
    asked = F.array_sort(F.transform(F.array_distinct(F.regexp_extract_all(text, F.lit(shape), F.lit(0))), lambda m: F.named_struct(F.lit("n"), -F.length(m), F.lit("m"), m)))

    def put(done: Column, x: Column) -> Column:
        known = F.filter(values, lambda p: p["k"] == F.regexp_extract(x["m"], shape, 1))
        return let(known, lambda k: F.when(F.size(k) > 0, F.replace(done, x["m"], F.get(k, F.size(k) - 1)["v"])).otherwise(done))

    return F.when(F.contains(text, F.lit("$")), F.aggregate(asked, text, put)).otherwise(text)


MAVEN = r"\$\{([^}]+)\}"
#: Parts of a pom whose groupId or version isn't the pom's own.
INNER = "parent|dependencies|dependencyManagement|build|profiles|properties|licenses|modules|reporting|repositories|pluginRepositories|distributionManagement"


def pom_properties(bare: Column) -> Column:
    """array of struct(k, v): a pom's properties, and project.groupId and so on, the parent's where it has none."""
    shape = r"<([A-Za-z0-9_.-]+)>([^<]*)</\1>"
    block = F.array_join(F.regexp_extract_all(bare, F.lit("(?s)<properties>(.*?)</properties>"), F.lit(1)), "")
    stated = each(block, shape, lambda m: F.named_struct(F.lit("k"), F.regexp_extract(m, shape, 1), F.lit("v"), F.trim(plain_xml(F.regexp_extract(m, shape, 2)))))
    heads = F.array(F.regexp_extract(bare, "(?s)<parent>(.*?)</parent>", 1), F.regexp_replace(bare, rf"(?s)<({INNER})>.*?</\1>", ""))

    def of(known: Column, heads: Column) -> Column:
        up, own = F.get(heads, F.lit(0)), F.get(heads, F.lit(1))
        group, version = (F.coalesce(tag(own, k), tag(up, k)) for k in ("groupId", "version"))
        built_in = {"groupId": group, "artifactId": tag(own, "artifactId"), "version": version, "parent.groupId": tag(up, "groupId"), "parent.artifactId": tag(up, "artifactId"), "parent.version": tag(up, "version")}
        pairs = F.array(*[F.named_struct(F.lit("k"), F.lit(f"project.{k}"), F.lit("v"), filled(v, known, MAVEN)) for k, v in built_in.items()])
        return F.concat(known, F.filter(pairs, lambda x: x["v"].isNotNull() & ~F.contains(x["v"], F.lit("${"))))

    return let(stated, lambda known: let(heads, lambda h: of(known, h)))


def pom_parts(text: Column, transitive: bool = False) -> Column:
    """array of struct(name, version) of a pom: comments left out, properties filled in; no version: that of
    dependencyManagement, else null.

    Test scope goes. ``transitive`` is for a pom seen from elsewhere: provided, system and optional dependencies and
    versions with unknown properties go, too.
    """
    block = "(?s)<dependency>(.*?)</dependency>"
    blocks = lambda x: F.regexp_extract_all(x, F.lit(block), F.lit(1))
    named = lambda b, values: F.concat(filled(plain_xml(tag(b, "groupId")), values, MAVEN), F.lit(":"), filled(plain_xml(tag(b, "artifactId")), values, MAVEN))
    version = lambda b, values: filled(plain_xml(tag(b, "version")), values, MAVEN)

    def managed(bare: Column, values: Column) -> Column:
        inside = F.array_join(F.regexp_extract_all(bare, F.lit("(?s)<dependencyManagement>(.*?)</dependencyManagement>"), F.lit(1)), "")
        pairs = F.transform(blocks(inside), lambda b: F.named_struct(F.lit("k"), named(b, values), F.lit("v"), version(b, values)))
        return F.filter(pairs, lambda m: m["v"].isNotNull())

    def counts(b: Column) -> Column:
        scope, optional = F.lower(F.coalesce(tag(b, "scope"), F.lit("compile"))), F.lower(F.coalesce(tag(b, "optional"), F.lit("false")))
        return ~scope.isin("test", "provided", "system") & (optional != "true") if transitive else scope != "test"

    def parts(bare: Column, values: Column, known: Column) -> Column:
        own = F.regexp_replace(bare, "(?s)<dependencyManagement>.*?</dependencyManagement>", "")
        stated = F.transform(F.filter(blocks(own), counts), lambda b: F.named_struct(F.lit("name"), named(b, values), F.lit("version"), version(b, values)))
        same = lambda d: F.filter(known, lambda m: m["k"] == d["name"])
        latest = lambda d: let(same(d), lambda x: F.get(x, F.size(x) - 1)["v"])
        return F.transform(F.filter(stated, lambda d: d["name"].isNotNull()), lambda d: F.named_struct(F.lit("name"), d["name"], F.lit("version"), F.coalesce(d["version"], latest(d))))

    out = let(without_comments(text), lambda bare: let(pom_properties(bare), lambda values: let(managed(bare, values), lambda known: parts(bare, values, known))))
    return F.filter(out, lambda d: ~F.contains(F.coalesce(d["version"], F.lit("")), F.lit("${"))) if transitive else out


def pom_dependencies(files: DataFrame, transitive: bool = False) -> DataFrame:
    """(root, path, name, version, kind) of poms, see ``pom_parts``. No version: null."""
    rows = files.where(name_of(F.col("path")).endswith("pom.xml")).select("root", "path", F.explode(pom_parts(F.col("content"), transitive)).alias("d"))
    return rows.select("root", "path", "d.name", "d.version", F.lit("pom.xml").alias("kind"))


def pom_facts(files: DataFrame) -> DataFrame:
    """(root, path, license, parent) of poms; parent as group:artifact:version."""
    bare = without_comments(F.col("content"))
    license_ = plain_xml(tag(F.regexp_extract(bare, "(?s)<licenses>(.*?)</licenses>", 1), "name"))
    up = F.regexp_extract(bare, "(?s)<parent>(.*?)</parent>", 1)
    parent = F.when(up != "", F.concat_ws(":", tag(up, "groupId"), tag(up, "artifactId"), tag(up, "version")))
    return files.where(name_of(F.col("path")).endswith("pom.xml")).select("root", "path", license_.alias("license"), parent.alias("parent"))


def pom(text: Column) -> Column:
    return F.transform(pom_parts(text), lambda d: dep(d["name"], F.coalesce(d["version"], F.lit("RELEASE"))))


def csproj(text: Column) -> Column:
    return each(without_comments(text), r"<PackageReference\s+([^>]*)", lambda m: dep(F.regexp_extract(m, 'Include="([^"]+)"', 1), F.regexp_extract(m, 'Version="([^"]+)"', 1)))


def slnx(text: Column) -> Column:
    """The projects of a solution."""
    shape = r'<Project\s+Path="([^"]+)"'
    return each(text, shape, lambda m: dep(F.replace(F.regexp_extract(m, shape, 1), F.lit("\\"), F.lit("/"))))


def project_references(files: DataFrame) -> DataFrame:
    """(root, src, dst): paths of projects that refer to others, relative paths resolved. Files outside the root go."""
    shape = r'<ProjectReference\s[^>]*?Include="([^"]+)"'
    rows = files.where(F.col("path").rlike(r"\.(?:cs|fs|vb)proj$")).select("root", F.col("path").alias("src"), F.explode(F.regexp_extract_all("content", F.lit(shape), F.lit(1))).alias("to"))
    whole = F.concat_ws("/", F.nullif(dir_of(F.col("src")), F.lit("")), F.replace(F.col("to"), F.lit("\\"), F.lit("/")))
    parts = F.filter(F.split(whole, "/"), lambda p: ~p.isin("", "."))
    up = lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when((F.size(a) > 0) & (F.element_at(a, -1) != ".."), F.slice(a, 1, F.size(a) - 1)).otherwise(F.concat(a, F.array(p)))
    dst = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), up), "/")
    return rows.select("root", "src", dst.alias("dst")).where("not startswith(dst, '..')").distinct()


def nuspec_license(content: Column) -> Column:
    """struct(kind, value): expression or file, else what a licence URL suggests."""
    shape = r"<license([^>]*)>([^<]+)</license>"
    attrs, value = F.regexp_extract(content, shape, 1), F.trim(F.regexp_extract(content, shape, 2))
    url = F.trim(F.regexp_extract(content, r"<licenseUrl>([^<]+)</licenseUrl>", 1))
    guess = F.when(F.contains(url, F.lit("MIT")), "MIT").when(F.contains(url, F.lit("Apache")), "Apache-2.0").when(F.contains(url, F.lit("BSD")), "BSD").when(F.contains(url, F.lit("GPL")), "GPL").otherwise(url)
    as_ = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.alias("value"))
    return F.when((value != "") & F.contains(attrs, F.lit('type="file"')), as_("file", value)).when(value != "", as_("expression", value)).when(url != "", as_("expression", guess))


REQUIREMENT = r"^([^\s>=<!~()\[;]+)(?:\[[^\]]*\])?\s*(.*)$"


def requirement(t: Column) -> Column:
    version = F.regexp_replace(F.regexp_extract(F.substring_index(t, ";", 1), REQUIREMENT, 2), r"[()\s]", "")
    return dep(F.regexp_extract(F.substring_index(t, ";", 1), REQUIREMENT, 1), clean_version(version, F.lit("pypi")))


def requirements(text: Column) -> Column:
    bare = F.transform(lines(text), lambda x: F.trim(F.regexp_replace(F.substring_index(x, ";", 1), r"(?:^|\s)#.*$", "")))
    return F.transform(F.filter(bare, lambda t: (t != "") & ~F.startswith(t, F.lit("-"))), requirement)


def go_mod(text: Column) -> Column:
    """Of require lines and require blocks; other blocks (replace, exclude) aren't dependencies."""
    bare = F.regexp_replace(text, r"(?m)//.*$", "")
    inside = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?ms)^require\s*\(\s*$(.*?)^\s*\)"), F.lit(1)), "\n")
    lone = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*require\s+(\S+[ \t]+v\S+)"), F.lit(1)), "\n")
    shape = r"(?m)^[ \t]*([\w./~-]+)[ \t]+(v\d\S*)[ \t]*$"
    return F.filter(found(F.concat_ws("\n", inside, lone), shape), lambda d: ~d["name"].isin("go", "toolchain"))


def go_work(text: Column) -> Column:
    """The member directories that a workspace uses."""
    bare = F.regexp_replace(text, r"(?m)//.*$", "")
    inside = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?ms)^use\s*\(\s*$(.*?)^\s*\)"), F.lit(1)), "\n")
    lone = F.array_join(F.regexp_extract_all(bare, F.lit(r"(?m)^\s*use[ \t]+([^\s(]+)"), F.lit(1)), "\n")
    return found(F.concat_ws("\n", inside, lone), r"(?m)^[ \t]*(\S+)[ \t]*$", 1, 0)


def gemfile_lock(text: Column) -> Column:
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"(?m)^ *specs:[ \t]*\r?\n((?:    .*(?:\n|\z))*)"), F.lit(1)), "\n")
    return found(inside, r"(?m)^    ([A-Za-z0-9._-]+) \(([^)]+)\)\r?$", clean="gem")


def gemfile(text: Column) -> Column:
    return found(text, r"""(?m)^\s*gem\s+['"]([^'"]+)['"](?:\s*,\s*['"]([^'"]+)['"])?""", clean="gem")


#: The configurations whose entries are dependencies of a Gradle build.
GRADLE = "implementation|api|compileOnly|runtimeOnly|annotationProcessor|compile"
#: Strings, which are kept, and comments, which aren't.
GRADLE_COMMENTS = r"""(?s)("(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|//[^\n]*|/\*.*?(?:\*/|\z)"""
GRADLE_VARIABLE = r"\$\{?([A-Za-z_][A-Za-z0-9_.]*)\}?"


def gradle(text: Column) -> Column:
    """Coordinates 'group:name:version' and calls with group, name and version, with or without parentheses; comments
    count for nothing. No version: RELEASE.

    Versions may hold $x or ${x}: x is looked for in assignments of the file (``gradle_properties`` joins those of
    gradle.properties).
    """
    assigned = r"""(?m)^\s*(?:def\s+|val\s+|ext\.)?(\w+)\s*=\s*['"]([^'"]+)['"]"""
    shape = rf"""(?m)^\s*(?:{GRADLE})\s*\(?\s*['"]([^'"\n]+)['"]"""
    call = rf"""(?m)(?<![\w.])(?:{GRADLE})\s*\(?\s*(?:(?:group|name|version)\s*[:=]\s*['"][^'"\n]*['"]\s*,?\s*)+"""
    said = lambda m, k: F.trim(F.regexp_extract(m, rf"""(?<![\w.]){k}\s*[:=]\s*['"]([^'"\n]*)['"]""", 1))
    listed = lambda m: F.transform(F.split(F.regexp_extract(m, shape, 1), ":"), lambda x: F.trim(x))

    def all_of(bare: Column, values: Column) -> Column:
        def of(c: Column) -> Column:
            version = F.coalesce(F.nullif(F.get(c, F.lit(2)), F.lit("")), F.lit("RELEASE"))
            good = (F.get(c, F.lit(0)) != "") & (F.get(c, F.lit(1)) != "")
            return F.named_struct(F.lit("name"), F.when(good, F.concat(F.get(c, F.lit(0)), F.lit(":"), F.get(c, F.lit(1)))), F.lit("version"), filled(version, values, GRADLE_VARIABLE))

        calls = each(bare, call, lambda m: F.array(*[said(m, k) for k in ("group", "name", "version")]))
        return F.filter(F.transform(F.concat(each(bare, shape, listed), calls), of), lambda d: d["name"].isNotNull())

    values = lambda bare: each(bare, assigned, lambda m: F.named_struct(F.lit("k"), F.regexp_extract(m, assigned, 1), F.lit("v"), F.regexp_extract(m, assigned, 2)))
    return let(F.regexp_replace(text, GRADLE_COMMENTS, "$1"), lambda bare: let(values(bare), lambda known: all_of(bare, known)))


def gradle_properties(files: DataFrame, deps: DataFrame) -> DataFrame:
    """deps with $x and ${x} in versions of Gradle builds replaced from the gradle.properties of the same directory."""
    shape = r"(?m)^[ \t]*([^#!\s=:][^\s=:]*)[ \t]*[=:][ \t]*(\S[^\r\n]*)"
    pairs = each(F.col("content"), shape, lambda m: F.named_struct(F.lit("k"), F.regexp_extract(m, shape, 1), F.lit("v"), F.trim(F.regexp_extract(m, shape, 2))))
    known = files.where(name_of(F.col("path")) == "gradle.properties").select("root", dir_of(F.col("path")).alias("dir"), pairs.alias("pairs"))
    known = known.groupBy("root", "dir").agg(F.flatten(F.sort_array(F.collect_list("pairs"))).alias("pairs"))
    asks = (F.col("kind") == "gradle") & F.contains("version", F.lit("$"))
    joined = deps.withColumn("dir", F.when(asks, dir_of(F.col("path")))).withColumn("asks", F.when(asks, F.col("root")))
    joined = joined.join(known.withColumnRenamed("root", "asks"), ["asks", "dir"], "left")
    version = F.when(F.col("pairs").isNotNull(), filled(F.col("version"), F.col("pairs"), GRADLE_VARIABLE)).otherwise(F.col("version"))
    return joined.select("root", "path", "name", version.alias("version"), "kind")


def cmake(text: Column) -> Column:
    return found(text, r"(?i)find_package\s*\(\s*([A-Za-z0-9_+-]+)(?:\s+(\d[\w.]*))?")


def conanfile(text: Column) -> Column:
    inside = F.array_join(F.regexp_extract_all(text, F.lit(r"(?ms)^[ \t]*\[requires\][ \t]*$(.*?)(?=^[ \t]*\[\w+\][ \t]*$|\z)"), F.lit(1)), "\n")
    return found(inside, r"(?m)^[ \t]*([^\s/#]+)/(\S+)", clean="conan")


def conanfile_py(text: Column) -> Column:
    """References in requires = ... and self.requires(...)."""
    shape = r"""['"]([A-Za-z0-9_+.-]+)/([^'"@#]+)[^'"]*['"]"""
    calls = F.regexp_extract_all(text, F.lit(rf"(?:self\.requires|self\.tool_requires)\(\s*{shape}"), F.lit(0))
    fields = F.regexp_extract_all(text, F.lit(r"(?ms)^\s*requires\s*=\s*(\(.*?\)|\[.*?\]|[^\n]*(?:,\s*\n[^\n]*)*)"), F.lit(1))
    return found(F.array_join(F.concat(calls, fields), "\n"), shape, clean="conan")


def description(text: Column) -> Column:
    """Depends, Imports and LinkingTo of R packages; R itself isn't one."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^(?:Depends|Imports|LinkingTo):(.*?)(?=^\S|\z)"), F.lit(1))
    parts = F.filter(F.split(F.array_join(blocks, ","), ","), lambda p: ~p.rlike(r"^\s*R\s*(?:\(|$)"))
    return F.transform(parts, lambda p: dep(F.regexp_extract(p, r"([A-Za-z][A-Za-z0-9.]*)", 1), F.regexp_replace(F.regexp_extract(p, r"\(([^)]*)\)", 1), r"^[><=\s]+", "")))


def yarn_lock(text: Column) -> Column:
    """The name ends at the last @ that isn't the first character."""
    shape = r"(?m)^\"?(@?[^@#\s\",][^@\",\n]*)@[^\n]*:\r?\n(?:  (?!version:? )[^\n]*\n)*  version:? \"?([^\"\s]*)\"?"
    return found(text, shape)


def pnpm_lock(text: Column) -> Column:
    return found(F.regexp_extract(text, r"(?s)\npackages:(.*)$", 1), r"(?m)^  '?/?(@?[^@'\s()]+)@([^:'()\s]+)")


def makefile(text: Column) -> Column:
    return found(text, r"(?<=\s)-l([A-Za-z0-9_+.-]+)".replace(r"(?<=\s)", r"\s"), 1, 0)


def configure_ac(text: Column) -> Column:
    return found(text, r"PKG_CHECK_MODULES\(\s*\[?\w+\]?\s*,\s*\[?\s*([A-Za-z0-9_.+-]+)(?:\s*>=\s*([\w.]+))?")


def pkg_config(text: Column) -> Column:
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^Requires(?:\.private)?:(.*)$"), F.lit(1))
    parts = F.flatten(F.transform(blocks, lambda b: F.split(F.trim(b), r"\s*,\s*|(?<=[\w.])\s+(?=[A-Za-z])")))
    return F.transform(parts, lambda p: dep(F.regexp_extract(p, r"^([A-Za-z0-9_.+-]+)", 1), F.regexp_extract(p, r"[><=]+\s*(\S+)", 1)))


def bazel(text: Column) -> Column:
    return found(text, r"""bazel_dep\(\s*name\s*=\s*"([^"]+)"\s*,\s*version\s*=\s*"([^"]+)\"""")


def bazel_workspace(text: Column) -> Column:
    """Names of http_archive and git_repository rules; the version is the tag, else what a number in the prefix says."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?ms)^(?:http_archive|git_repository)\((.*?)^\)"), F.lit(1))
    said = lambda b, k: F.regexp_extract(b, rf'(?m)^\s*{k}\s*=\s*"([^"]+)"', 1)
    version = lambda b: F.coalesce(F.nullif(F.regexp_replace(said(b, "tag"), "^v", ""), F.lit("")), F.regexp_extract(said(b, "strip_prefix"), r"-v?(\d[\w.]*)$", 1))
    return F.transform(blocks, lambda b: dep(said(b, "name"), version(b)))


def debian_depends(text: Column) -> Column:
    """First alternative of each dependency of a control file."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?m)^Depends:(.*(?:\n[ \t].*)*)"), F.lit(1))
    parts = F.transform(F.split(F.array_join(blocks, ","), ","), lambda p: F.regexp_replace(F.substring_index(p, "|", 1), r"^\s+|\s+$", ""))
    return F.transform(parts, lambda p: dep(F.regexp_replace(F.regexp_extract(p, r"^(\S+)", 1), ":.*$", ""), F.regexp_extract(p, r"\([><=]+\s*([^)]+)\)", 1)))


LOCKED = "array<struct<name: string, version: string, source: string, dependencies: array<string>>>"


def locked(doc: Column) -> Column:
    """The [[package]] tables of a lock file."""
    return F.from_json(F.get_json_object(doc, "$.package"), LOCKED)


def uv_lock(doc: Column) -> Column:
    return F.transform(locked(doc), lambda p: dep(p["name"], p["version"]))


def cargo_lock(doc: Column) -> Column:
    """Packages with a source; those without are members of the workspace."""
    return F.transform(F.filter(locked(doc), lambda p: p["source"].isNotNull()), lambda p: dep(p["name"], p["version"]))


CARGO_TABLES = ["dependencies", "dev-dependencies", "build-dependencies"]


def cargo_toml(doc: Column) -> Column:
    """Dependencies of all kinds, of targets and of the workspace, too; a renamed one has the name of its package. No
    version (a path, a git address, the workspace's): empty."""

    def make(e: Column) -> Column:
        is_table = F.startswith(e["value"], F.lit("{"))
        said = lambda k: F.when(is_table, F.get_json_object(e["value"], f"$.{k}"))
        version = F.when(is_table, said("version")).when(~e["value"].isin("true", "false"), e["value"])
        return dep(F.coalesce(said("package"), e["key"]), clean_version(F.coalesce(version, F.lit("")), F.lit("npm")))

    tables = [entries(doc, f"$['{t}']", "string") for t in CARGO_TABLES] + [entries(doc, "$.workspace.dependencies", "string")]
    of_targets = F.flatten(F.transform(entries(doc, "$.target", "string"), lambda t: F.concat(*[entries(t["value"], f"$['{k}']", "string") for k in CARGO_TABLES])))
    return F.transform(F.concat(*tables, of_targets), make)


def pyproject(doc: Column) -> Column:
    """The dependencies of [project]; entries that are no texts are passed over."""
    listed = F.try_variant_get(F.try_parse_json(doc), "$.project.dependencies", "array<variant>")
    texts = F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.trim(F.try_variant_get(x, "$", "string")))
    return F.transform(F.filter(texts, lambda x: x.rlike("^[A-Za-z0-9]")), requirement)


def toml_license(files: DataFrame) -> DataFrame:
    """(root, path, license) that Cargo.toml and pyproject.toml state."""
    rows = files.where(name_of(F.col("path")).isin("Cargo.toml", "pyproject.toml")).select("root", "path", toml_json("content").alias("doc"))
    text = lambda c: F.when(~F.startswith(c, F.lit("{")), c)
    said = F.coalesce(*[text(F.get_json_object("doc", f"$.{k}")) for k in ("package.license", "project.license", "project.license.text")])
    return rows.select("root", "path", F.nullif(F.trim(said), F.lit("")).alias("license"))


def cargo_locks(files: DataFrame) -> DataFrame:
    """(root, path, nodes): the packages of every Cargo.lock. files may be ``corpus_evidence``, or such a table."""
    if "nodes" in files.columns:
        return files
    if "text" in files.columns:
        return files.where("kind = 'Cargo.lock'").select("root", "path", locked(F.col("text")).alias("nodes"))
    return files.where(name_of(F.col("path")) == "Cargo.lock").select("root", "path", toml_json("content").alias("doc")).select("root", "path", locked(F.col("doc")).alias("nodes"))


def cargo_graph(files: DataFrame) -> DataFrame:
    """(root, path, src, dst): edges of Cargo.lock as name@version; an entry without a version means the only one of
    its name. Members of the workspace are those without a source. Files are parsed once: their packages are written."""
    rows = cargo_locks(files if {"text", "nodes"} & set(files.columns) else written(cargo_locks(files), "locks")).select("root", "path", F.explode("nodes").alias("n"))
    versions = rows.groupBy("root", "path", F.col("n.name").alias("name")).agg(F.min("n.version").alias("only"))
    asks = rows.select("root", "path", F.concat_ws("@", "n.name", "n.version").alias("src"), F.explode("n.dependencies").alias("ask"))
    asks = asks.select("root", "path", "src", F.get(F.split("ask", " "), F.lit(0)).alias("name"), F.get(F.split("ask", " "), F.lit(1)).alias("version"))
    known = asks.join(large(versions), ["root", "path", "name"], "left")
    return known.select("root", "path", "src", F.concat_ws("@", "name", F.coalesce("version", "only")).alias("dst")).distinct()


def cargo_members(files: DataFrame) -> DataFrame:
    """(root, path, member): the packages of Cargo.lock without a source, as name@version."""
    rows = cargo_locks(files).select("root", "path", F.explode("nodes").alias("n"))
    return rows.where("n.source is null").select("root", "path", F.concat_ws("@", "n.name", "n.version").alias("member"))


def go_graph(files: DataFrame) -> DataFrame:
    """(root, path, src, dst): edges of a printed module graph (go.graph: two modules a line), go and toolchain left out."""
    shape = r"(?m)^(\S+) (\S+)$"
    rows = files.where(name_of(F.col("path")) == "go.graph").select("root", "path", F.explode(F.regexp_extract_all("content", F.lit(shape), F.lit(0))).alias("m"))
    rows = rows.select("root", "path", F.regexp_extract("m", shape, 1).alias("src"), F.regexp_extract("m", shape, 2).alias("dst"))
    return rows.where("not (src rlike '^(go|toolchain)@' or dst rlike '^(go|toolchain)@')").distinct()


#: Kind -> names of its files, and the expression. A name that begins with a dot is an ending.
JSON_SOURCES = {
    "package.json": (["package.json"], package_json), "package-lock.json": (["package-lock.json"], package_lock), "Pipfile.lock": (["Pipfile.lock"], pipfile_lock), "renv.lock": (["renv.lock"], renv_lock),
    "packages.lock.json": (["packages.lock.json"], packages_lock_json), "project.assets.json": (["project.assets.json"], assets_json), "vcpkg.json": (["vcpkg.json"], vcpkg_json), "ls.json": (["ls.json"], ls_json),
}
XML_SOURCES = {"pom.xml": (["pom.xml", ".pom.xml"], pom), "csproj": ([".csproj", ".fsproj", ".vbproj"], csproj), "slnx": ([".slnx"], slnx)}
LINE_SOURCES = {
    "requirements": (["requirements.txt", "pip_freeze.txt"], requirements), "go.mod": (["go.mod"], go_mod), "go.work": (["go.work"], go_work), "Gemfile": (["Gemfile"], gemfile), "Gemfile.lock": (["Gemfile.lock"], gemfile_lock),
    "gradle": (["build.gradle", "build.gradle.kts"], gradle), "cmake": (["CMakeLists.txt"], cmake), "conanfile": (["conanfile.txt"], conanfile), "conanfile.py": (["conanfile.py"], conanfile_py), "DESCRIPTION": (["DESCRIPTION"], description),
    "yarn.lock": (["yarn.lock"], yarn_lock), "pnpm-lock": (["pnpm-lock.yaml"], pnpm_lock), "Makefile": (["Makefile"], makefile), "configure": (["configure.ac", "configure.in"], configure_ac), "pkg-config": ([".pc"], pkg_config),
    "bazel": (["MODULE.bazel"], bazel), "WORKSPACE": (["WORKSPACE", "WORKSPACE.bazel"], bazel_workspace), "control": (["control"], debian_depends),
}
TOML_SOURCES = {"uv.lock": (["uv.lock"], uv_lock), "pyproject": (["pyproject.toml"], pyproject), "Cargo.lock": (["Cargo.lock"], cargo_lock), "Cargo.toml": (["Cargo.toml"], cargo_toml)}
SOURCES = JSON_SOURCES | XML_SOURCES | LINE_SOURCES | TOML_SOURCES


def kind_of(path: Column, sources: dict = SOURCES) -> Column:
    """The kind of a file by its name, else null."""
    named = {n: k for k, (names, _) in sources.items() for n in names if not n.startswith(".")}
    out = F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), name_of(path)) if named else F.lit(None).cast("string")
    for kind, (names, _) in sources.items():
        for n in names:
            if n.startswith("."):
                out = F.coalesce(out, F.when(F.endswith(path, F.lit(n)), kind))
    return out


def parsed_deps(kind: Column, text: Column, sources: dict = SOURCES) -> Column:
    """array of struct(name, version): what a file of a kind names, each once. TOML files come as JSON."""
    parsed = F.lit(None).cast(NONE)
    for name, (_, of_text) in reversed(sources.items()):
        parsed = F.when(kind == name, F.array_distinct(of_text(text)).cast(NONE)).otherwise(parsed)
    return parsed


def deps_of(files: DataFrame, sources: dict = SOURCES) -> DataFrame:
    """(root, path, name, version, kind): the dependencies of every file of a known kind, each once a file."""
    rows = files.select("root", "path", "content", kind_of(F.col("path"), sources).alias("kind")).where("kind is not null")
    if tomls := [k for k in sources if k in TOML_SOURCES]:
        is_toml = F.col("kind").isin(tomls)
        rows = rows.withColumn("content", F.when(is_toml, toml_json(F.when(is_toml, F.col("content")))).otherwise(F.col("content")))
    return exploded_deps(rows.select("root", "path", "kind", parsed_deps(F.col("kind"), F.col("content"), sources).alias("deps")))


def exploded_deps(rows: DataFrame) -> DataFrame:
    """(root, path, name, version, kind) of rows (root, path, kind, deps)."""
    rows = rows.select("root", "path", "kind", F.explode("deps").alias("d"))
    return rows.select("root", "path", F.col("d.name").alias("name"), F.col("d.version").alias("version"), "kind").where("name <> ''")


def deps_from_json(files: DataFrame, depth: int = 15) -> DataFrame:
    return deps_of(files, JSON_SOURCES | {"ls.json": (["ls.json"], lambda text: ls_json(text, depth))})


def deps_from_xml(files: DataFrame) -> DataFrame:
    return deps_of(files, XML_SOURCES)


def deps_from_lines(files: DataFrame) -> DataFrame:
    return gradle_properties(files, deps_of(files, LINE_SOURCES))


def deps_from_toml(files: DataFrame) -> DataFrame:
    return deps_of(files, TOML_SOURCES)
