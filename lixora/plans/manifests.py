"""Queries over manifests, lock files and OS inventories, each package of the fixture written as one file."""

from __future__ import annotations

from pyspark.sql import functions as F

from lixora.functions import licenses as L
from lixora.operators import graph, osdb
from lixora.operators.shared import spread, written
from lixora.plans.judging import PACKS, pool
from lixora.plans.registry import query
from lixora.sources import lines, manifests

NL = "chr(10)"


def files(spark, sf_dir, path: str, *content: str):
    """One file per package: a path, and lines given as SQL over its row."""
    return spread(pool(spark, sf_dir)).select(F.col("pkg_id").alias("root"), F.lit(path).alias("path"), F.expr(f" || {NL} || ".join(content)).alias("content"))


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BASE = "'lib' || pkg_id"
TWO = "SELECT pkg_id AS root, {a} AS name, {av} AS version, '{k}' AS kind FROM fx_packages UNION ALL SELECT pkg_id, {b}, {bv}, '{k}' FROM fx_packages"


def two(kind, a=BASE, av="version", b="'other'", bv="'1.0.0'"):
    return TWO.format(k=kind, a=a, av=av, b=b, bv=bv)


JSON_FILES = {
    "package.json": ["""'{"name": "x", "dependencies": {"lib' || pkg_id || '": "^' || version || '"}, "devDependencies": {"other": "~1.0.0"}}'"""],
    "package-lock.json": ["""'{"packages": {"": {"version": "9"}, "node_modules/lib' || pkg_id || '": {"version": "' || version || '"}, "node_modules/a/node_modules/other": {"version": "1.0.0"}}}'"""],
    "Pipfile.lock": ["""'{"_meta": {}, "default": {"lib' || pkg_id || '": {"version": "==' || version || '"}}, "develop": {"other": {"version": "==1.0.0"}}}'"""],
    "renv.lock": ["""'{"Packages": {"x": {"Package": "lib' || pkg_id || '", "Version": "' || version || '"}, "other": {"Version": "1.0.0"}}}'"""],
    "packages.lock.json": ["""'{"dependencies": {"net8.0": {"lib' || pkg_id || '": {"resolved": "' || version || '"}}, "net7.0": {"other": {"resolved": "1.0.0"}}}}'"""],
    "project.assets.json": ["""'{"libraries": {"lib' || pkg_id || '/' || version || '": {"type": "package"}, "other/1.0.0": {"type": "package"}, "own/1.0.0": {"type": "project"}}}'"""],
    "vcpkg.json": ["""'{"dependencies": [{"name": "lib' || pkg_id || '", "version>=": "' || version || '"}, {"name": "other", "version>=": "1.0.0"}]}'"""],
    "ls.json": ["""'{"dependencies": {"a": {"version": "0", "dependencies": {"lib' || pkg_id || '": {"version": "' || version || '", "dependencies": {"other": {"version": "1.0.0"}}}}}}}'"""],
}
JSON_SQL = " UNION ALL ".join(two(k) for k in JSON_FILES) + " UNION ALL SELECT pkg_id, 'a', '0', 'ls.json' FROM fx_packages"


def files_of(spark, sf_dir, table):
    """Every package writes one file of each kind: the packages are read once."""
    each = [F.struct(F.lit(path).alias("path"), F.expr(f" || {NL} || ".join(content)).alias("content")) for path, content in table.items()]
    return spread(pool(spark, sf_dir)).select(F.col("pkg_id").alias("root"), F.explode(F.array(*each)).alias("f")).select("root", "f.*")


def all_of(spark, sf_dir, table, make):
    return make(files_of(spark, sf_dir, {f"app/{path}": content for path, content in table.items()})).drop("path")


@query("src_04_json_manifests", f"{PACKS} {JSON_SQL}")
def src_04(spark, sf_dir):
    return all_of(spark, sf_dir, JSON_FILES, lambda f: manifests.deps_from_json(f, depth=4))


POM = [
    "'<project>' || CASE WHEN pkg_id % 3 = 0 THEN '' ELSE '<parent><groupId>org.p</groupId><artifactId>p' || pkg_id || '</artifactId><version>' || version || '</version></parent>' END",
    "CASE WHEN license IS NULL THEN '' ELSE '<licenses><license><name>' || license || '</name></license><license><name>second</name></license></licenses>' END",
    q("<dependencyManagement><dependencies><dependency><groupId>m</groupId><artifactId>managed</artifactId></dependency></dependencies></dependencyManagement>"),
    "'<dependency><groupId>g</groupId> <artifactId>lib' || pkg_id || '</artifactId><version>' || version || '</version></dependency>'",
    q("<dependency><groupId>g</groupId><artifactId>t</artifactId><scope>test</scope></dependency><dependency><groupId>g</groupId><artifactId>other</artifactId></dependency></project>"),
]
XML_FILES = {
    "pom.xml": POM,
    "x.csproj": ["'<PackageReference Include=\"lib' || pkg_id || '\" Version=\"' || version || '\" /><PackageReference Include=\"other\" Version=\"1.0.0\"/>'"],
    "all.slnx": ["'<Solution><Project Path=\"src\\lib' || pkg_id || '.csproj\" /></Solution>'"],
}
XML_SQL = two("pom.xml", a="'g:lib' || pkg_id", b="'g:other'", bv="'RELEASE'") + " UNION ALL " + two("csproj") + " UNION ALL SELECT pkg_id, 'src/lib' || pkg_id || '.csproj', '', 'slnx' FROM fx_packages"


@query("src_05_xml_manifests", f"{PACKS} {XML_SQL}")
def src_05(spark, sf_dir):
    table = XML_FILES | {"all.slnx": ["'<Solution><Project Path=\"src' || chr(92) || 'lib' || pkg_id || '.csproj\" /></Solution>'"]}
    return all_of(spark, sf_dir, table, manifests.deps_from_xml)


RICH_POM = [
    "'<project><parent><groupId>org.up</groupId><artifactId>up</artifactId><version>' || version || '</version></parent><artifactId>own</artifactId>'",
    "'<properties><lib.version>' || version || '</lib.version> <!-- <lib.version>0</lib.version> --><who>g &amp; h</who></properties>'",
    q("<dependencyManagement><dependencies><dependency><groupId>${project.groupId}</groupId><artifactId>kit</artifactId><version>${lib.version}</version></dependency></dependencies></dependencyManagement>"),
    "'<dependencies><!-- <dependency><groupId>x</groupId><artifactId>gone</artifactId></dependency> --><dependency><groupId>g</groupId><artifactId>lib' || pkg_id || '</artifactId><version>${lib.version}</version></dependency>'",
    q("<dependency><groupId>org.up</groupId><artifactId>kit</artifactId></dependency><dependency><groupId>${project.groupId}</groupId><artifactId>own-api</artifactId><version>${project.version}</version></dependency>"),
    q("<dependency><groupId>${who}</groupId><artifactId>odd</artifactId><version>${lost}-1</version><optional>true</optional></dependency><dependency><groupId>g</groupId><artifactId>given</artifactId><scope>provided</scope></dependency></dependencies></project>"),
]
RICH_POM = [x.replace("${", "$' || '{") for x in RICH_POM]  # else SQL would fill them in
_ALWAYS = [("'g:lib' || pkg_id", "version"), ("'org.up:kit'", "version"), ("'org.up:own-api'", "version")]
_OWN = [("'g & h:odd'", "'${lost}-1'"), ("'g:given'", "NULL")]
RICH_SQL = " UNION ALL ".join(f"SELECT pkg_id AS root, {n} AS name, {v} AS version, '{seen}' AS seen FROM fx_packages" for seen, rows in (("own", _ALWAYS + _OWN), ("elsewhere", _ALWAYS)) for n, v in rows)


@query("src_05_pom_properties", f"{PACKS} {RICH_SQL}")
def src_05d(spark, sf_dir):
    """Properties, managed versions, inherited coordinates, comments and entities; the pom's own view and that from elsewhere."""
    rich = files(spark, sf_dir, "app/pom.xml", *RICH_POM)
    views = [manifests.pom_dependencies(rich, transitive=t).select("root", "name", "version", F.lit(seen).alias("seen")) for t, seen in ((False, "own"), (True, "elsewhere"))]
    return views[0].unionByName(views[1])


RICH_GRADLE = {
    "build.gradle": [
        """'def libVersion = "' || version || '" // implementation ''g:not:1'''""", q("/* implementation 'g:not:2'"), q("   api 'g:not:3' */"), """'  implementation group: ''g'', name: ''lib' || pkg_id || ''', version: "$libVersion"'""",
        q('  implementation(group = "g", name = "call", version = "1.$minor")'), q("  annotationProcessor('g:processor:1.0:classifier') // why"), q("  api 'g:free'"), q('  compileOnly("g:url:http://x")'), q("  testImplementation group: 'g', name: 'not', version: '4'"),
    ],
    "gradle.properties": ["'minor=' || version"],
}
RICH_GRADLE_SQL = " UNION ALL ".join(f"SELECT pkg_id AS root, {n} AS name, {v} AS version FROM fx_packages" for n, v in (("'g:lib' || pkg_id", "version"), ("'g:call'", "'1.' || version"), ("'g:processor'", "'1.0'"), ("'g:free'", "'RELEASE'"), ("'g:url'", "'http'")))


@query("src_06_gradle_calls", f"{PACKS} {RICH_GRADLE_SQL}")
def src_06b(spark, sf_dir):
    """Named calls, coordinates without a version or with a classifier, comments, variables within versions."""
    return all_of(spark, sf_dir, RICH_GRADLE, manifests.deps_from_lines).drop("kind")


#: Every seventh file isn't TOML.
BROKEN = "CASE WHEN pkg_id % 7 = 0 THEN '[project' ELSE '' END"
RICH_TOML = {
    "pyproject.toml": [
        q("# dependencies = ['not']"), q("[build-system]"), q("requires = ['not']"), q("[project]"), q('name = "x" # [tool]'), """'license = { text = "' || coalesce(license, 'none') || '" }'""",
        """'dependencies = ["lib' || pkg_id || '[socks,tls]>=' || version || ' ; python_version > ''3''", # a comment, ]'""", q("""  'other==1.0.0', \"\"\"third~=2.0\"\"\","""), q("  'bare', 7]"), q("[tool.x]"), q("dependencies = ['not']"),
        q("[project.optional-dependencies]"), q("more = ['not']"), BROKEN,
    ],
    "Cargo.toml": [
        q("[package]"), q("name = 'own'"), "CASE WHEN license IS NULL THEN '' ELSE 'license = ''' || license || '''' END", q("[dependencies]"), """'"lib' || pkg_id || '" = { features = ["a]", "b}"], version = ''^' || version || ''' }'""",
        q("other.version = '1.0.0' # why"), q("third = { git = 'https://x#y' }"), q("""[target."cfg(a = 'b')".dev-dependencies]"""), q("bare = '2'"), q("[package.metadata.dependencies]"), q("not = '1'"), BROKEN,
    ],
}
RICH_TOML_SQL = " UNION ALL ".join(f"SELECT pkg_id AS root, {n} AS name, {v} AS version, '{k}' AS kind FROM fx_packages" for k, n, v in (("pyproject", "'lib' || pkg_id", "version"), ("pyproject", "'other'", "'1.0.0'"), ("pyproject", "'third'", "'2.0'"), ("pyproject", "'bare'", "''"), ("Cargo.toml", "'lib' || pkg_id", "version"), ("Cargo.toml", "'other'", "'1.0.0'"), ("Cargo.toml", "'third'", "''"), ("Cargo.toml", "'bare'", "'2'")))


@query("src_07_toml_shapes", f"{PACKS} SELECT * FROM ({RICH_TOML_SQL}) r WHERE root % 7 <> 0")
def src_07d(spark, sf_dir):
    """Extras, quotes of all kinds, comments, brackets in strings, dotted and quoted keys, tables of targets and tools."""
    return all_of(spark, sf_dir, RICH_TOML, manifests.deps_from_toml)


@query("src_07_license_fields", PACKS + " SELECT pkg_id AS root, 'pyproject.toml' AS file, CASE WHEN pkg_id % 7 <> 0 THEN coalesce(license, 'none') END AS license FROM fx_packages UNION ALL SELECT pkg_id, 'Cargo.toml', CASE WHEN pkg_id % 7 <> 0 THEN license END FROM fx_packages")
def src_07e(spark, sf_dir):
    return all_of(spark, sf_dir, RICH_TOML, lambda f: manifests.toml_license(f).withColumn("file", F.substring_index("path", "/", -1)))


REFERENCES = ["'<ProjectReference Include=\"..' || chr(92) || 'lib' || (pkg_id % 50) || chr(92) || 'x.csproj\" />'", "'<ProjectReference Include=\"./sub/../y' || pkg_id || '.csproj\" /><ProjectReference Include=\"../../../out.csproj\" />'"]


@query("src_05_project_references", PACKS + " SELECT pkg_id AS root, 'src/app/a.csproj' AS src, 'src/lib' || (pkg_id % 50) || '/x.csproj' AS dst FROM fx_packages UNION ALL SELECT pkg_id, 'src/app/a.csproj', 'src/app/y' || pkg_id || '.csproj' FROM fx_packages")
def src_05c(spark, sf_dir):
    return manifests.project_references(files(spark, sf_dir, "src/app/a.csproj", *REFERENCES))


@query("src_05_pom_facts", PACKS + " SELECT pkg_id AS root, license, CASE WHEN pkg_id % 3 <> 0 THEN 'org.p:p' || pkg_id || ':' || version END AS parent FROM fx_packages")
def src_05b(spark, sf_dir):
    return manifests.pom_facts(files(spark, sf_dir, "pom.xml", *POM)).drop("path")


LINE_FILES = {
    "requirements.txt": [q("# a comment"), "'lib' || pkg_id || '>=' || version || ',<99 ; python_version > \"3\"'", q("-r more.txt"), q("other[extra]==1.0.0  # why")],
    "go.mod": [q("module x"), q("go 1.21"), q("require ("), "'  example.com/lib' || pkg_id || ' v' || version || ' // indirect'", q(")"), q("require example.com/other v1.0.0"), q("replace ("), q("  a.b/c v0.0.1"), q(")")],
    "Gemfile.lock": [q("GEM"), q("  specs:"), "'    lib' || pkg_id || ' (' || version || '-x86_64-linux)'", q("      dep (~> 2)"), q("    other (1.0.0)"), q(""), q("PLATFORMS"), q("    not (3)")],
    "Gemfile": ["'gem ''lib' || pkg_id || ''', ''~> ' || version || ''''", q('gem "other", "1.0.0"')],
    "go.work": [q("go 1.21"), q("use ("), "'  ./mod' || pkg_id || ' // a member'", q(")"), q("use ./tools"), q("replace a => ./b")],
    "build.gradle": ["'def kitVersion = \"' || version || '\"'", "'  implementation ''g:lib' || pkg_id || ':' || version || ''''", q('  api("g:other:1.0.0")'), q("  testImplementation 'g:t:1'"), q('  api "g:kit:$kitVersion"'), "'  api \"g:far:$' || '{farVersion}\"'", q('  api "g:lost:$lost"')],
    "gradle.properties": [q("# a comment"), "'farVersion = ' || version || '-far'"],
    "CMakeLists.txt": ["'find_package(lib' || pkg_id || ' ' || version || ' REQUIRED)'", q("FIND_PACKAGE( other 1.0.0 )")],
    "conanfile.txt": [q("[requires]"), "'lib' || pkg_id || '/' || version || '@user/stable'", q("other/1.0.0"), q("[generators]"), q("cmake/x")],
    "conanfile.py": [q("from conan import ConanFile"), q("class X(ConanFile):"), "'    requires = \"lib' || pkg_id || '/' || version || '@user/stable\", \"other/1.0.0\"'", q("    def requirements(self):"), q('        self.requires("third/2.0")')],
    "WORKSPACE": [q("http_archive("), "'    name = \"lib' || pkg_id || '\",'", "'    strip_prefix = \"lib-' || version || '\",'", q(")"), q("git_repository("), q('    name = "other",'), q('    tag = "v1.0.0",'), q(")")],
    "DESCRIPTION": [q("Package: x"), "'Imports: lib' || pkg_id || ' (>= ' || version || '),'", q("    other (>= 1.0.0)"), q("Depends: R (>= 4.0)"), q("Suggests: not")],
    "yarn.lock": [q("# yarn lockfile v1"), "'lib' || pkg_id || '@^1.0.0, lib' || pkg_id || '@^2:'", "'  version \"' || version || '\"'", q('"other@npm:^1":'), q("  version: 1.0.0")],
    "pnpm-lock.yaml": [q("lockfileVersion: 6"), q("packages:"), "'  /lib' || pkg_id || '@' || version || ':'", q("    resolution: {}"), q("  other@1.0.0(peer@2):")],
    "Makefile": ["'LIBS = -llib' || pkg_id || ' -lother'"],
    "configure.ac": ["'PKG_CHECK_MODULES([A], [lib' || pkg_id || ' >= ' || version || '])'", q("PKG_CHECK_MODULES(B, other >= 1.0.0)")],
    "x.pc": ["'Requires: lib' || pkg_id || ' >= ' || version || ', other = 1.0.0'"],
    "MODULE.bazel": ["'bazel_dep(name = \"lib' || pkg_id || '\", version = \"' || version || '\")'", q('bazel_dep(name = "other", version = "1.0.0")')],
    "control": [q("Package: x"), "'Depends: lib' || pkg_id || ' (>= ' || version || ') | alt,'", q(" other:any (= 1.0.0)"), q("Section: y")],
}
LINE_SQL = " UNION ALL ".join([
    two("requirements"), two("go.mod", a="'example.com/lib' || pkg_id", av="'v' || version", b="'example.com/other'", bv="'v1.0.0'"), two("Gemfile.lock"), two("Gemfile"), two("gradle", a="'g:lib' || pkg_id", b="'g:other'"),
    two("cmake"), two("conanfile"), two("DESCRIPTION"), two("yarn.lock"), two("pnpm-lock"), two("Makefile", av="''", bv="''"), two("configure"), two("pkg-config"), two("bazel"), two("control"),
    two("go.work", a="'./mod' || pkg_id", av="''", b="'./tools'", bv="''"), two("gradle", a="'g:kit'", b="'g:far'", bv="version || '-far'"), "SELECT pkg_id, 'g:lost', '$lost', 'gradle' FROM fx_packages",
    two("conanfile.py"), "SELECT pkg_id, 'third', '2.0', 'conanfile.py' FROM fx_packages", two("WORKSPACE"),
])


@query("src_06_line_manifests", f"{PACKS} {LINE_SQL}")
def src_06(spark, sf_dir):
    return all_of(spark, sf_dir, LINE_FILES, manifests.deps_from_lines)


TOML_FILES = {
    "uv.lock": [q("version = 1"), q("[[package]]"), "'name = \"lib' || pkg_id || '\"'", "'version = \"' || version || '\"'", q("[[package]]"), q('name = "other"'), q('version = "1.0.0"')],
    "pyproject.toml": [q("[project]"), q('license = {text = "MIT"}'), q("dependencies = ["), "'  \"lib' || pkg_id || '>=' || version || '\",'", q('  "other==1.0.0; python_version > \'3\'",'), q("]"), q("[tool.x]")],
}


TOML_FILES |= {
    "Cargo.lock": [q("version = 3"), q("[[package]]"), q('name = "own"'), q('version = "0.1.0"'), q("dependencies = ["), "' \"lib' || pkg_id || ' ' || version || '\",'", q(' "other",'), q("]"), q("[[package]]"), "'name = \"lib' || pkg_id || '\"'", "'version = \"' || version || '\"'", q('source = "registry"'), q("dependencies = ["), q(' "other 1.0.0 (registry)",'), q("]"), q("[[package]]"), q('name = "other"'), q('version = "1.0.0"'), q('source = "registry"')],
    "Cargo.toml": ["'[package]'", q('name = "own"'), "CASE WHEN license IS NULL THEN '' ELSE 'license = \"' || license || '\"' END", q("[dependencies]"), "'lib' || pkg_id || ' = \"^' || version || '\"'", q('short = { package = "other", version = "1.0.0", features = ["a"] }'), q('near = { path = "../near" }'), q("[dev-dependencies.tool]"), q('version = "2"'), q("[target.'cfg(unix)'.dependencies]"), q('libc = "0.2"'), q("[features]"), q('default = "x"')],
}
CARGO = "SELECT pkg_id, 'near', '', 'Cargo.toml' FROM fx_packages UNION ALL SELECT pkg_id, 'tool', '2', 'Cargo.toml' FROM fx_packages UNION ALL SELECT pkg_id, 'libc', '0.2', 'Cargo.toml' FROM fx_packages"


@query("src_07_toml_manifests", f"{PACKS} {two('uv.lock')} UNION ALL {two('pyproject')} UNION ALL {two('Cargo.lock')} UNION ALL {two('Cargo.toml')} UNION ALL {CARGO}")
def src_07(spark, sf_dir):
    return all_of(spark, sf_dir, TOML_FILES, manifests.deps_from_toml)


@query("src_07_toml_licenses", PACKS + " SELECT pkg_id AS root, 'pyproject.toml' AS file, 'MIT' AS license FROM fx_packages UNION ALL SELECT pkg_id, 'Cargo.toml', license FROM fx_packages")
def src_07b(spark, sf_dir):
    table = {n: TOML_FILES[n] for n in ("pyproject.toml", "Cargo.toml", "uv.lock")}
    return all_of(spark, sf_dir, table, lambda f: manifests.toml_license(f).withColumn("file", F.substring_index("path", "/", -1)))


OWN = "SELECT pkg_id AS root, 'own@0.1.0' AS src, 'lib' || pkg_id || '@' || version AS dst FROM fx_packages UNION ALL SELECT pkg_id, 'own@0.1.0', 'other@1.0.0' FROM fx_packages UNION ALL SELECT pkg_id, 'lib' || pkg_id || '@' || version, 'other@1.0.0' FROM fx_packages"


@query("src_07_cargo_graph", f"{PACKS} {OWN}")
def src_07c(spark, sf_dir):
    return all_of(spark, sf_dir, {"Cargo.lock": TOML_FILES["Cargo.lock"]}, manifests.cargo_graph)


@query("jon_14_cargo_members", PACKS + " SELECT pkg_id AS root, 'other@1.0.0' AS pkg_id, 'own@0.1.0' AS members FROM fx_packages UNION ALL SELECT pkg_id, 'lib' || pkg_id || '@' || version, 'own@0.1.0' FROM fx_packages")
def jon_14b(spark, sf_dir):
    """Cargo workspaces end to end: members and edges of every lock file, closures, attribution."""
    locks = written(manifests.cargo_locks(files(spark, sf_dir, "Cargo.lock", *TOML_FILES["Cargo.lock"])), "locks")
    node = lambda c: F.concat_ws("|", "root", c)
    members = manifests.cargo_members(locks).select(node("member").alias("member"), node("member").alias("pkg_id"))
    edges = manifests.cargo_graph(locks).select(node("src").alias("src"), node("dst").alias("dst"))
    made = graph.attribute_workspaces(members, edges, 3)
    bare = lambda c: F.regexp_replace(c, r"(^|,)[^|,]*\|", "$1")
    return made.select(F.substring_index("pkg_id", "|", 1).cast("long").alias("root"), bare("pkg_id").alias("pkg_id"), bare("members").alias("members"))


GO_GRAPH = [q("example.com/own go@1.21"), "'example.com/own example.com/lib' || pkg_id || '@v' || version", "'example.com/lib' || pkg_id || '@v' || version || ' example.com/other@v1.0.0'", q("example.com/other@v1.0.0 example.com/last@v0.1.0")]


@query("gra_01_go_depths", PACKS + " SELECT pkg_id AS root, 'example.com/lib' || pkg_id || '@v' || version AS module, 1 AS depth FROM fx_packages UNION ALL SELECT pkg_id, 'example.com/other@v1.0.0', 2 FROM fx_packages UNION ALL SELECT pkg_id, 'example.com/last@v0.1.0', 3 FROM fx_packages")
def gra_01b(spark, sf_dir):
    """Modules of a printed module graph with their least depth below the main module."""
    edges = manifests.go_graph(files(spark, sf_dir, "go.graph", *GO_GRAPH)).select("root", F.concat_ws("|", "root", "src").alias("src"), F.concat_ws("|", "root", "dst").alias("dst"))
    main = graph.graph_roots(edges).select(F.substring_index("node", "|", 1).cast("long").alias("project_id"), F.col("node").alias("pkg_id"))
    made = graph.transitive_closure(main, edges, 5).where("depth > 0")
    return made.select(F.col("project_id").alias("root"), F.substring_index("pkg_id", "|", -1).alias("module"), "depth")


NUSPEC = "CASE pkg_id % 5 WHEN 0 THEN '<license type=\"expression\">MIT</license>' WHEN 1 THEN '<license type=\"file\">LICENSE.md</license>' WHEN 2 THEN '<licenseUrl>https://x/Apache</licenseUrl>' WHEN 3 THEN '<licenseUrl>https://x/own</licenseUrl>' ELSE '<id>x</id>' END"


@query("txt_12_nuspec", PACKS + " SELECT pkg_id, CASE pkg_id % 5 WHEN 1 THEN 'file' WHEN 4 THEN NULL ELSE 'expression' END AS kind, CASE pkg_id % 5 WHEN 0 THEN 'MIT' WHEN 1 THEN 'LICENSE.md' WHEN 2 THEN 'Apache-2.0' WHEN 3 THEN 'https://x/own' END AS value FROM fx_packages")
def txt_12(spark, sf_dir):
    return pool(spark, sf_dir).select("pkg_id", manifests.nuspec_license(F.expr(NUSPEC)).alias("x")).select("pkg_id", "x.*")


APK = ["'C:Q1'", "'P:lib' || pkg_id", "'V:' || version", "CASE WHEN pkg_id % 3 = 0 THEN 'A:x' ELSE 'L:MIT' END", q("F:usr/bin"), "'R:tool' || pkg_id", q("F:etc"), q("R:conf"), q(""), q("P:other"), q("V:1.0.0"), q("L:ISC"), q("")]


@query("src_09_apk", PACKS + " SELECT pkg_id AS root, 'lib' || pkg_id AS name, version, CASE WHEN pkg_id % 3 <> 0 THEN 'MIT' END AS license FROM fx_packages UNION ALL SELECT pkg_id, 'other', '1.0.0', 'ISC' FROM fx_packages")
def src_09(spark, sf_dir):
    return osdb.apk_packages(files(spark, sf_dir, "lib/apk/db/installed", *APK))


DPKG = [
    "'Package: lib' || pkg_id", "CASE WHEN pkg_id % 4 = 0 THEN 'Status: deinstall ok config-files' ELSE 'Status: install ok installed' END", "'Version: ' || version", "'Source: src' || (pkg_id % 5) || ' (2.0)'", q("Description: a"), q(" long text"), q(" ."), q(" more"), q(""),
    q("# a comment"), "'Package: lib' || pkg_id", q("Status: install ok installed"), "'Version: ' || version", q(""), q("Package: other"), q("Status: install ok installed"), q("Version: 1.0.0"),
]


@query("src_10_dpkg", PACKS + " SELECT pkg_id AS root, 'lib' || pkg_id AS name, version, CASE WHEN pkg_id % 4 <> 0 THEN 'src' || (pkg_id % 5) END AS source FROM fx_packages UNION ALL SELECT pkg_id, 'other', '1.0.0', NULL FROM fx_packages")
def src_10(spark, sf_dir):
    return osdb.dpkg_packages(files(spark, sf_dir, "var/lib/dpkg/status", *DPKG))


@query("txt_08_deb822", PACKS + " SELECT pkg_id AS root, 0 AS stanza, 'Description' AS name, 'a' || chr(10) || 'long text' || chr(10) || chr(10) || 'more' AS value FROM fx_packages UNION ALL SELECT pkg_id, 1, 'Package', 'lib' || pkg_id FROM fx_packages UNION ALL SELECT pkg_id, 0, 'Package', 'lib' || pkg_id FROM fx_packages UNION ALL SELECT pkg_id, 2, 'Package', 'other' FROM fx_packages")
def txt_08(spark, sf_dir):
    return lines.deb822(files(spark, sf_dir, "var/lib/dpkg/status", *DPKG), ["root"]).where("name in ('Package', 'Description')").drop("pos")


@query("src_11_owned", PACKS + " SELECT pkg_id AS root, 'usr/bin/tool' || pkg_id AS path FROM fx_packages UNION ALL SELECT pkg_id, 'etc/conf' FROM fx_packages UNION ALL SELECT pkg_id, 'usr/lib/x' || pkg_id FROM fx_packages UNION ALL SELECT pkg_id, 'opt/r' FROM fx_packages")
def src_11(spark, sf_dir):
    apk = files(spark, sf_dir, "lib/apk/db/installed", *APK)
    lists = files(spark, sf_dir, "var/lib/dpkg/info/a.list", "'/usr/lib/x' || pkg_id", q(""))
    triples = pool(spark, sf_dir).select(F.col("pkg_id").alias("root"), F.array(F.lit("r")).alias("base_names"), F.array(F.lit(1)).alias("dir_indexes"), F.array(F.lit("/usr/"), F.lit("/opt/")).alias("dir_names"))
    return osdb.owned_paths(apk.unionByName(lists)).unionByName(osdb.rpm_owned(triples))


@query("src_12_distro", PACKS + " SELECT pkg_id AS root, CASE WHEN pkg_id % 2 = 0 THEN 'debian' ELSE 'alpine' END AS namespace FROM fx_packages")
def src_12(spark, sf_dir):
    a = files(spark, sf_dir, "etc/os-release", q("NAME=x"), "CASE WHEN pkg_id % 2 = 0 THEN 'ID=\"Debian\"' ELSE 'ID=' END")
    return osdb.distro_namespace(a.unionByName(files(spark, sf_dir, "usr/lib/os-release", q("ID=alpine"))))


META = [q("Metadata-Version: 2.1"), "'Name: lib' || pkg_id", "'Version: ' || version", "CASE pkg_id % 4 WHEN 0 THEN 'License-Expression: MIT OR ISC' WHEN 1 THEN 'License: MIT License' WHEN 2 THEN 'License: UNKNOWN' ELSE 'License: My Own' END", q("Classifier: Topic :: X"), "CASE WHEN pkg_id % 4 IN (0, 2) THEN 'Classifier: License :: OSI Approved :: Apache Software License' ELSE 'Classifier: License :: OSI Approved :: BSD License' END", q(""), q("Name: body")]
NODE = ["'{\"name\": \"@s/lib' || pkg_id || '\", \"version\": \"' || version || '\", ' || CASE pkg_id % 4 WHEN 0 THEN '\"license\": \"MIT\"' WHEN 1 THEN '\"license\": {\"type\": \"ISC\"}' WHEN 2 THEN '\"licenses\": [{\"type\": \"MIT\"}, {\"type\": \"Zlib\"}]' ELSE '\"license\": \"UNLICENSED\"' END || '}'"]
NODE_CASE = "CASE pkg_id % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'ISC' WHEN 2 THEN 'MIT OR Zlib' END"
PY_CASE = "CASE pkg_id % 4 WHEN 0 THEN 'MIT OR ISC' WHEN 1 THEN 'MIT' WHEN 2 THEN 'Apache-2.0' ELSE 'My Own' END"


def artifacts(spark, sf_dir):
    node = files(spark, sf_dir, "app/node_modules/@s/lib/package.json", *NODE)
    inner = files(spark, sf_dir, "app/node_modules/@s/lib/src/package.json", *NODE)
    copy = files(spark, sf_dir, "z/node_modules/lib/package.json", *NODE)
    python = files(spark, sf_dir, "usr/lib/python3/site-packages/lib.dist-info/METADATA", *META)
    return osdb.installed_artifacts(node.unionByName(inner).unionByName(python).unionByName(copy))


ART = f"a AS (SELECT pkg_id AS root, 'app/node_modules/@s/lib/package.json' AS path, 'npm' AS ecosystem, '@s/lib' || pkg_id AS name, version, {NODE_CASE} AS license FROM fx_packages UNION ALL SELECT pkg_id, 'z/node_modules/lib/package.json', 'npm', '@s/lib' || pkg_id, version, {NODE_CASE} FROM fx_packages UNION ALL SELECT pkg_id, 'usr/lib/python3/site-packages/lib.dist-info/METADATA', 'pypi', 'lib' || pkg_id, version, {PY_CASE} FROM fx_packages)"


@query("src_13_artifacts", f"{PACKS}, {ART} SELECT * FROM a")
def src_13(spark, sf_dir):
    return artifacts(spark, sf_dir)


@query("txt_10_python_license", f"{PACKS} SELECT pkg_id AS root, {PY_CASE} AS license FROM fx_packages")
def txt_10(spark, sf_dir):
    return artifacts(spark, sf_dir).where("ecosystem = 'pypi'").select("root", "license")


@query("txt_11_node_license", f"{PACKS} SELECT pkg_id AS root, {NODE_CASE} AS license FROM fx_packages")
def txt_11(spark, sf_dir):
    return files(spark, sf_dir, "package.json", *NODE).select("root", osdb.node_license(F.col("content")).alias("license"))


@query("agg_07_deduped_artifacts", f"{PACKS}, {ART} SELECT root, ecosystem, name, min(path) AS path FROM a GROUP BY 1, 2, 3")
def agg_07(spark, sf_dir):
    return osdb.dedupe_artifacts(artifacts(spark, sf_dir)).select("root", "ecosystem", "name", "path")


@query("jon_08_owned_dropped", f"{PACKS}, {ART} SELECT root, path FROM a WHERE NOT (ecosystem = 'pypi' AND root % 3 = 0)")
def jon_08(spark, sf_dir):
    owned = pool(spark, sf_dir).where("pkg_id % 3 = 0").select(F.col("pkg_id").alias("root"), F.lit("usr/lib/python3/site-packages/lib.dist-info/METADATA").alias("path"))
    return osdb.drop_owned(artifacts(spark, sf_dir), owned).select("root", "path")


RPM = "CASE pkg_id % 6 WHEN 0 THEN 'GPLv2+' WHEN 1 THEN 'ASL 2.0 and (MIT or GPLv3)' WHEN 2 THEN 'GPL+' WHEN 3 THEN 'BSD' WHEN 4 THEN 'MIT or zlib' ELSE 'unknown' END"
RPM_SPDX = "CASE pkg_id % 6 WHEN 0 THEN 'GPL-2.0-or-later' WHEN 1 THEN 'Apache-2.0 AND (MIT OR GPL-3.0-only)' WHEN 2 THEN 'GPL-1.0-or-later' WHEN 3 THEN 'BSD' WHEN 4 THEN 'MIT OR Zlib' END"


@query("src_14_rpm", PACKS + f" SELECT name, CASE WHEN pkg_id % 3 = 0 THEN '2:' ELSE '' END || version || CASE WHEN pkg_id % 2 = 0 THEN '-1.fc40' ELSE '' END AS version, {RPM_SPDX} AS license FROM fx_packages WHERE pkg_id % 10 <> 0")
def src_14(spark, sf_dir):
    n = F.col("pkg_id")
    rows = pool(spark, sf_dir).select(F.when(n % 10 == 0, "gpg-pubkey").otherwise(F.col("name")).alias("name"), "version", F.when(n % 2 == 0, "1.fc40").otherwise("").alias("release"), F.when(n % 3 == 0, 2).alias("epoch"), F.expr(RPM).alias("license"))
    return osdb.rpm_packages(rows)


@query("nrm_03_rpm", f"{PACKS} SELECT DISTINCT {RPM} AS given, {RPM_SPDX} AS license FROM fx_packages")
def nrm_03(spark, sf_dir):
    return pool(spark, sf_dir).select(F.expr(RPM).alias("given"), L.normalize_rpm(F.expr(RPM)).alias("license")).distinct()


DEB = "CASE pkg_id % 6 WHEN 0 THEN 'GPL-2+' WHEN 1 THEN 'Expat or GPL-3 and BSD-3-clause' WHEN 2 THEN 'LGPL-2.1' WHEN 3 THEN 'custom' WHEN 4 THEN 'GPL' ELSE '' END"
DEB_SPDX = "CASE pkg_id % 6 WHEN 0 THEN 'GPL-2.0-or-later' WHEN 1 THEN 'MIT OR GPL-3.0-only AND BSD-3-Clause' WHEN 2 THEN 'LGPL-2.1-only' WHEN 3 THEN 'custom' WHEN 4 THEN 'GPL' END"


@query("nrm_02_debian", f"{PACKS} SELECT DISTINCT {DEB} AS given, {DEB_SPDX} AS license FROM fx_packages")
def nrm_02(spark, sf_dir):
    return pool(spark, sf_dir).select(F.expr(DEB).alias("given"), L.normalize_debian(F.expr(DEB)).alias("license")).distinct()


#: Names with parentheses in each other, around parts of a name, and one too many.
NESTED = "CASE pkg_id % 5 WHEN 0 THEN '{a} or ({b} and (lib' || pkg_id || ' or {c}))' WHEN 1 THEN '(({a} or lib' || pkg_id || ') and {b}) and {c}' WHEN 2 THEN 'lib' || pkg_id || ' (3 clause) or {a}' WHEN 3 THEN '({a} or lib' || pkg_id || ' and {b}' ELSE '({c})' END"
NESTED_SPDX = "CASE pkg_id % 5 WHEN 0 THEN '{a} OR ({b} AND (lib' || pkg_id || ' OR {c}))' WHEN 1 THEN '(({a} OR lib' || pkg_id || ') AND {b}) AND {c}' WHEN 2 THEN 'lib' || pkg_id || ' (3 clause) OR {a}' WHEN 3 THEN '({x} or lib' || pkg_id || ' and {y}' ELSE '{z}' END"
RPM_IN, DEB_IN = {"a": "GPLv2+", "b": "ASL 2.0", "c": "zlib"}, {"a": "GPL-2+", "b": "Expat", "c": "Zlib"}


@query("nrm_03_nested", f"{PACKS} SELECT pkg_id, {NESTED_SPDX.format(a='GPL-2.0-or-later', b='Apache-2.0', c='Zlib', x='GPLv2+', y='ASL 2.0', z='Zlib')} AS license FROM fx_packages")
def nrm_03_nested(spark, sf_dir):
    return pool(spark, sf_dir).select("pkg_id", L.normalize_rpm(F.expr(NESTED.format(**RPM_IN))).alias("license"))


@query("nrm_02_nested", f"{PACKS} SELECT pkg_id, {NESTED_SPDX.format(a='GPL-2.0-or-later', b='MIT', c='Zlib', x='GPL-2+', y='Expat', z='(Zlib)')} AS license FROM fx_packages")
def nrm_02_nested(spark, sf_dir):
    return pool(spark, sf_dir).select("pkg_id", L.normalize_debian(F.expr(NESTED.format(**DEB_IN))).alias("license"))


HEADERS = "CASE pkg_id % 4 WHEN 0 THEN 'MIT OR (Apache-2.0 AND (BSD-2-Clause OR X' || pkg_id || '))' WHEN 1 THEN '((X' || pkg_id || '))' WHEN 2 THEN '((MIT AND OR ISC))' ELSE 'MIT) OR (ISC' END"


@query("txt_03_nested_headers", f"{PACKS} SELECT pkg_id, CASE WHEN pkg_id % 4 < 2 THEN {HEADERS} ELSE 'ISC WITH Y' END AS license FROM fx_packages")
def txt_03_nested(spark, sf_dir):
    """Headers with nested parentheses; where those aren't well formed, the next header counts."""
    lines = F.concat(F.lit("/*\n * SPDX-License-Identifier: "), F.expr(HEADERS), F.lit("\n * SPDX-License-Identifier: ISC WITH Y */\ncode"))
    return pool(spark, sf_dir).select("pkg_id", L.spdx_header(lines).alias("license"))


CLASSES = "CASE pkg_id % 4 WHEN 0 THEN 'License :: OSI Approved :: MIT License' WHEN 1 THEN 'License :: OSI Approved :: BSD License' WHEN 2 THEN 'License :: OSI Approved :: GNU Affero General Public License v3' ELSE 'License :: Public Domain' END"


@query("nrm_04_classifiers", f"{PACKS} SELECT DISTINCT {CLASSES} AS given, CASE pkg_id % 4 WHEN 0 THEN 'MIT' WHEN 2 THEN 'AGPL-3.0-only' END AS license FROM fx_packages")
def nrm_04(spark, sf_dir):
    return pool(spark, sf_dir).select(F.expr(CLASSES).alias("given"), L.classifier_license(F.expr(CLASSES)).alias("license")).distinct()


DEP5 = ["CASE WHEN pkg_id % 3 = 0 THEN 'Some text' ELSE 'Format: https://x/copyright-format/1.0/' END", q(""), q("Files: debian/*"), q("License: ISC"), q(""), "CASE WHEN pkg_id % 3 = 1 THEN 'Files: *' ELSE 'Files: x' END", q("License: GPL-2+"), q(" see Apache License, Version 2.0")]


@query("txt_09_copyright", PACKS + " SELECT pkg_id AS root, CASE pkg_id % 3 WHEN 0 THEN 'Apache-2.0' WHEN 1 THEN 'GPL-2.0-or-later' ELSE 'ISC' END AS license FROM fx_packages")
def txt_09(spark, sf_dir):
    return osdb.copyright_license(files(spark, sf_dir, "usr/share/doc/x/copyright", *DEP5), ["root"])


@query("jon_07_dpkg_licenses", PACKS + " SELECT pkg_id AS root, CASE WHEN pkg_id % 2 = 0 THEN 'own' WHEN pkg_id % 3 = 0 THEN 'theirs' END AS license FROM fx_packages")
def jon_07(spark, sf_dir):
    p = pool(spark, sf_dir)
    packs = p.select(F.col("pkg_id").alias("root"), F.lit("bin").alias("name"), F.lit("src").alias("source"))
    some = lambda w, n, v: p.where(w).select(F.col("pkg_id").alias("root"), F.lit(n).alias("name"), F.lit(v).alias("license"))
    return osdb.dpkg_licenses(packs, some("pkg_id % 2 = 0", "bin", "own").unionByName(some("pkg_id % 3 = 0", "src", "theirs"))).select("root", "license")
