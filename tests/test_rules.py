"""Truth tables of rules, and batch against stream."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from lixora.functions import ids, licenses, register
from lixora.functions.expressions import fold, postfix
from lixora.operators import config, graph, judge, report, sbom, scan
from lixora.operators.config import ComplianceConfig
from lixora.sources import files, manifests
from lixora.streaming import changes


def one(spark, values, expression, column="x"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {column} string").select("i", expression(F.col(column)).alias("y")).orderBy("i").collect()
    return [r["y"] for r in rows]


@pytest.mark.parametrize(
    "text,lenient,strict",
    [
        ("MIT OR Apache-2.0 AND ISC", "MIT Apache-2.0 ISC AND OR", True),
        ("(MIT OR X) AND (Y WITH z)", "MIT X OR Y AND", True),
        ("MIT OR", None, False),
        ("MIT or later", "MIT", False),
        ("(MIT AND ISC", "MIT ISC AND", True),
        ("MIT)", "MIT", False),
        ("(A B) AND C", "A", False),
        ("GPL WITH AND X", "GPL X AND", True),
        ("", None, False),
    ],
)
def test_postfix(text, lenient, strict):
    assert postfix(text) == (lenient.split() if lenient else [text])
    assert (postfix(text, strict=True) is not None) == strict


def test_fold_is_three_valued(spark):
    values = [True, False, None]
    rows = [(i, [(None, a), (None, b), (op, None)]) for i, (a, b, op) in enumerate(itertools.product(values, values, ["AND", "OR"]))]
    df = spark.createDataFrame(rows, "i int, s array<struct<op:string,value:boolean>>").select("i", fold(F.col("s")).alias("y"))
    got = {r["i"]: r["y"] for r in df.collect()}
    rank = {False: 0, None: 1, True: 2}
    for i, (a, b, op) in enumerate(itertools.product(values, values, ["AND", "OR"])):
        want = (min if op == "AND" else max)(rank[a], rank[b])
        assert rank[got[i]] == want


def test_strict_verdicts(spark):
    rows = [(None, "MIT"), ("No License", "MIT"), ("Unknown", "MIT"), ("MIT", None), ("MIT", "Odd"), ("LGPL-2.1-only", "MIT")]
    df = spark.createDataFrame(rows, "license string, project_license string")
    registry = spark.createDataFrame([("LGPL-2.1", "x", [], ["same-license"], [])], "spdx_id string, title string, permissions array<string>, conditions array<string>, limitations array<string>")
    cfg = ComplianceConfig.default(spark, registry=registry)
    got = {(r["license"], r["project_license"]): (r["is_restrictive"], r["compatibility"]) for r in judge.annotate(judge.classify(df, cfg, strict=True), cfg, strict=True).collect()}
    assert got == {(None, "MIT"): (True, "Incompatible"), ("No License", "MIT"): (True, "Incompatible"), ("Unknown", "MIT"): (True, "Incompatible"), ("MIT", None): (False, "Unknown"), ("MIT", "Odd"): (False, "Incompatible"), ("LGPL-2.1-only", "MIT"): (True, "Incompatible")}


def test_custom_rule_wins(spark):
    cfg = ComplianceConfig.default(spark, custom=[("GPL-3.0", [], False), ("Mine", [], True)])
    df = spark.createDataFrame([("GPL-3.0",), ("Mine",)], "license string")
    assert {r["license"]: r["is_restrictive"] for r in judge.classify(df, cfg).collect()} == {"GPL-3.0": False, "Mine": True}


def test_purls_round_trip(spark):
    rows = [("npm", "@Scope/pkg", "1.0"), ("maven", "g.h:art", "2"), ("golang", "ex.com/a/b/c", "v1"), ("pypi", "My_Pkg.x", ""), ("deb", "debian/lib~x", "1:2+b"), ("generic", "a b/c*", "~1"), ("cargo", "é", "1"), ("npm", " ", "1")]
    df = spark.createDataFrame(rows, "e string, n string, v string").withColumn("p", ids.purl(F.col("e"), F.col("n"), F.col("v")))
    got = [tuple(r) for r in df.select("p", ids.parse_purl(F.col("p")).alias("x")).select("p", "x.*").collect()]
    assert got[0] == ("pkg:npm/%40scope/pkg@1.0", "npm", "@scope/pkg", "1.0") and got[1] == ("pkg:maven/g.h/art@2", "maven", "g.h:art", "2")
    assert got[2][0] == "pkg:golang/ex.com/a/b/c@v1" and got[3] == ("pkg:pypi/my-pkg-x", "pypi", "my-pkg-x", "")
    assert got[4] == ("pkg:deb/debian/lib~x@1%3A2%2Bb", "deb", "debian/lib~x", "1:2+b") and got[5][0] == "pkg:generic/a%20b%2Fc%2A@~1"
    assert got[6][1:] == ("cargo", "é", "1") and got[7][0] is None
    assert one(spark, ["pkg:x/y@1", "nope", "pkg:npm/", "PKG://gem/a%zz"], lambda c: ids.parse_purl(c)["name"]) == ["y", None, None, "a%zz"]


def test_text_rules(spark):
    banner = "// This program is free: under the terms of the GNU\n//  General Public License version 2.1 of it"
    assert one(spark, [banner, "GNU General Public License", None], licenses.gnu_banner) == ["GPL-2.1-only", None, None]
    assert one(spark, ["<!-- SPDX-License-Identifier: MIT -->", "SPDX-License-Identifier: not an id", "\n" * 40 + "SPDX-License-Identifier: MIT"], licenses.spdx_header) == ["MIT", None, None]
    assert one(spark, ["BSD Redistribution and use", "mit license", "Version 2.0 of the Apache License"], licenses.detect_license) == ["BSD-2-Clause", None, "Apache-2.0"]
    assert one(spark, ["AGPLv3", "gpl 2", "the mit licence", "LGPL v2"], licenses.normalize_license_id) == ["AGPL-3.0", "GPL-2.0", "the mit licence", "LGPL-2.1"]


def test_semver_order(spark):
    names = ["1.0.0", "v1.0.0-alpha.2", "1.0.0-alpha.10", "1.0.0-beta", "0.9.9", "10.0.0", "2.0.0", "main", "dev"]
    df = spark.createDataFrame([(n,) for n in names], "v string").orderBy(ids.semver_key(F.col("v")))
    assert [r["v"] for r in df.collect()] == ["0.9.9", "v1.0.0-alpha.2", "1.0.0-alpha.10", "1.0.0-beta", "1.0.0", "2.0.0", "10.0.0", "dev", "main"]


def test_closure_ends_on_cycles(spark):
    direct = spark.createDataFrame([(1, 0)], "project_id long, pkg_id long")
    edges = spark.createDataFrame([(i, (i + 1) % 5) for i in range(5)], "src long, dst long")
    got = {r["pkg_id"]: r["depth"] for r in graph.transitive_closure(direct, edges, 50).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4}


def test_stated_sboms_stay_as_they_are(spark):
    text = '{ "spdxVersion": "SPDX-2.3", "packages": [ {"name": "a", "licenseDeclared": "MIT"} ], "custom": 1.50 }'
    open_ = '{"spdxVersion":"SPDX-2.3","custom":1.50,"packages":[{"name":"a","licenseConcluded":"NOASSERTION","x":[1]},{"name":"b"}]}'
    docs = spark.createDataFrame([(1, text), (2, open_)], "doc_id long, json string")
    answers = spark.createDataFrame([(1, 0, "ISC"), (2, 0, 'Odd "one"'), (2, 1, "MIT")], "doc_id long, pos int, license string")
    got = {r["doc_id"]: r["json"] for r in sbom.enrich_sbom(docs, answers).collect()}
    assert got[1] == text
    new = json.loads(got[2])
    assert new["packages"][0] == {"licenseConcluded": "LicenseRef-Odd-one", "name": "a", "x": [1]} and new["packages"][1]["licenseConcluded"] == "MIT"
    assert new["hasExtractedLicensingInfos"] == [{"licenseId": "LicenseRef-Odd-one", "name": 'Odd "one"', "extractedText": 'Odd "one"'}]


def test_one_bad_entry_costs_only_itself(spark):
    texts = [
        '{"spdxVersion":"SPDX-2.3","packages":[7,{"name":"b"},null],"hasExtractedLicensingInfos":[]}',
        '{"bomFormat":"CycloneDX","components":[{"version":"1"},{"name":"c","licenses":[]}]}',
        '{"spdxVersion":"SPDX-2.3","packages":{"name":"no list"}}',
        '{"spdxVersion":"SPDX-2.3","packages":[]}',
        "[]",
        "no json",
        None,
        "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, json string")
    rows = sorted((r["doc_id"], r["pos"], r["name"]) for r in sbom.ingest_sboms(docs).collect())
    assert rows == [(0, 1, "b"), (1, 1, "c")]
    answers = spark.createDataFrame([(0, 1, "Free text"), (1, 1, "MIT"), (0, 0, "MIT"), (5, 0, "MIT")], "doc_id long, pos int, license string")
    got = {r["doc_id"]: r["json"] for r in sbom.enrich_sbom(docs, answers).collect()}
    assert json.loads(got[0])["packages"] == [7, {"licenseConcluded": "LicenseRef-Free-text", "name": "b"}, None]
    assert json.loads(got[0])["hasExtractedLicensingInfos"] == [{"licenseId": "LicenseRef-Free-text", "name": "Free text", "extractedText": "Free text"}]
    assert json.loads(got[1])["components"] == [{"version": "1"}, {"name": "c", "licenses": [{"license": {"id": "MIT"}}]}]
    assert [got[i] for i in range(2, 8)] == texts[2:]


def test_versions_and_stamps(spark):
    spdx = ['{"spdxVersion":"SPDX-2.3.1"}', '{"spdxVersion":"2.3"}', '{"spdxVersion":"SPDX-3.0","name":null}', '{"spdxVersion":5}']
    docs = spark.createDataFrame(list(enumerate(spdx)), "doc_id long, json string")
    found = {(r["doc_id"], r["severity"], r["message"]) for r in sbom.validate_spdx(docs).where("field = 'spdxVersion'").collect()}
    assert found == {(1, "warning", "no SPDX- prefix"), (1, "info", "neither 2.2 nor 2.3"), (2, "info", "neither 2.2 nor 2.3")}
    assert not sbom.validate_spdx(docs).where("doc_id = 2 and field = 'name'").count()
    stamps = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00.5+02:00", "2024-01-01", "2024-13-01T00:00:00Z", ""]
    docs = spark.createDataFrame([(i, f'{{"metadata":{{"timestamp":"{t}"}}}}') for i, t in enumerate(stamps)], "doc_id long, json string")
    assert sorted(r["doc_id"] for r in sbom.validate_cyclonedx(docs).where("field = 'metadata.timestamp'").collect()) == [2, 3, 4]


def events(spark):
    rows = [(i, f"2024-01-01 00:00:{s:06.3f}", r, p) for i, (s, r, p) in enumerate([(0, 1, "package.json"), (0.3, 1, "go.mod"), (0.6, 1, "Cargo.lock"), (0.7, 2, "src/x.rs"), (1.2, 2, "pom.xml"), (1.65, 2, "pom.xml"), (2, 1, "node_modules/a/package.json"), (3, 1, "package.json")])]
    return spark.createDataFrame(rows, "event_id long, t string, root_id long, path string").select("event_id", F.to_timestamp("t").alias("ts"), "root_id", "path")


def test_debounce_stream_is_the_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(src)
    batch = sorted(r["event_id"] for r in changes.debounce(changes.relevant_changes(events(spark))).collect())
    assert batch == [0, 2, 4, 7]
    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    q = changes.debounce(changes.relevant_changes(stream)).writeStream.format("memory").queryName("fired").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("fired").collect()) == batch


def test_continuous_scan_goes_on_after_a_failure(spark, tmp_path):
    src = str(tmp_path / "in")
    events(spark).coalesce(1).write.parquet(src)
    seen, failed = [], []

    def scan(roots):
        seen.extend(sorted(r["root_id"] for r in roots.collect()))
        raise RuntimeError("scan")

    stream = spark.readStream.schema(events(spark).schema).parquet(src)
    q = changes.continuous_scan(changes.relevant_changes(stream), scan, str(tmp_path / "c"), lambda e, x: failed.append(str(x)))
    q.processAllAvailable()
    q.stop()
    assert seen == [1, 2] and failed == ["scan"]


def test_windowed_counts_stream_and_sessions(spark, tmp_path):
    rows = events(spark).withColumn("kind", F.lit("k"))
    assert [r["n"] for r in changes.windowed_counts(rows, "1 second").orderBy("start").collect()] == [4, 2, 1, 1]
    assert changes.windowed_counts(rows, "", gap="500 milliseconds").count() == 2
    assert changes.windowed_counts(rows, "2 seconds", slide="1 second").agg(F.sum("n")).first()[0] == 16


def test_sql_functions_are_registered(spark):
    register.register(spark)
    row = spark.sql("SELECT normalize_license_id('Apache 2') a, detect_license('MIT License') b, is_unresolved('unknown (x)') c, size(parse_expr('A OR B')) d").first()
    assert tuple(row) == ("Apache-2.0", "MIT", True, 3)


def test_headers_count_up_to_three_levels_down(spark):
    said = {
        "vendor/foo/Cargo.toml": None, "vendor/foo/src/lib.rs": "MIT",
        "vendor/three/x.txt": None, "vendor/three/a/b/c.rs": "ISC", "vendor/four/x.txt": None, "vendor/four/a/b/c/d.rs": "ISC",
        "vendor/hidden/x.txt": None, "vendor/hidden/.gen/y.rs": "ISC", "vendor/hidden/.y.rs": "ISC",
        "vendor/order/x.txt": None, "vendor/order/a.rs": "ISC", "vendor/order/a-b/y.rs": "Zlib", "vendor/order/a/z.rs": "MIT",
        "vendor/many/x.txt": None, **{f"vendor/many/a/f{i:02}.rs": None for i in range(50)}, "vendor/many/b.rs": "MIT",
        "vendor/way/inner/x.c": "Zlib", "vendor/modules.txt": None, "vendor/node_modules/p/x.js": "MIT",
        "app/x.txt": None, "app/y/z.rs": "GPL-3.0-only", "own/x.txt": None, "own/y/z.rs": "Apache-2.0",
    }
    files = spark.createDataFrame([("r", p, f"// SPDX-License-Identifier: {x}\n" if x else "text") for p, x in said.items()], "root string, path string, content string").repartition(3)
    headers = {r["dir"]: r["license"] for r in scan.dir_header_license(files).collect()}
    assert (headers["vendor/foo"], headers["vendor/foo/src"], headers["vendor/three"], headers["vendor/order"]) == ("MIT", "MIT", "ISC", "MIT")
    assert not {"vendor/four", "vendor/hidden", "vendor/many"} & set(headers) and headers[""] == "GPL-3.0-only"
    none = files.limit(0).select("root", F.col("path").alias("dir"))
    deps = files.limit(0).select("root", F.col("path").alias("ecosystem"), F.col("path").alias("name"))
    projects = spark.createDataFrame([("r", "Apache-2.0")], "root string, project_license string")
    found = {r["dir"]: (r["license"], r["marker"], r["unlicensed"]) for r in scan.scan_vendored(files, deps, projects, none).collect()}
    licensed = {"vendor/foo": "MIT", "vendor/three": "ISC", "vendor/order": "MIT", "vendor/way": "Zlib"}
    assert found == {**{d: (x, "vendored", False) for d, x in licensed.items()}, **{d: (None, "vendored", True) for d in ("vendor/four", "vendor/hidden", "vendor/many")}, "app": ("GPL-3.0-only", "unmanaged", False)}


def test_settings_by_precedence():
    file = '[licenses]\nrestrictive = ["A"]\nignore = ["B"]\n[dependencies]\nmax_depth = 3\n'
    got = config.settings(file, {"LIXORA_LICENSES_RESTRICTIVE": '["X", "Y"]', "LIXORA_STRICT": "TRUE", "OTHER_STRICT": "0"})
    assert got == {"licenses.restrictive": ["X", "Y"], "licenses.ignore": ["B"], "dependencies.ignore": [], "dependencies.max_depth": 3, "strict": True}
    assert config.settings()["licenses.restrictive"] == config.RESTRICTIVE and config.settings()["dependencies.max_depth"] == 10
    assert config.settings("", {"LIXORA_LICENSES_IGNORE": " a , b,"})["licenses.ignore"] == ["a", "b"]
    for bad in ("0", "101"):
        with pytest.raises(ValueError):
            config.settings("", {"LIXORA_DEPENDENCIES_MAX_DEPTH": bad})


def test_depth_limits(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)] + [(12, 0)], "src int, dst int")
    direct = spark.createDataFrame([(1, 0), (2, 5), (2, 6), (1, 0)], "project_id int, pkg_id int")
    got = {(r["project_id"], r["pkg_id"]): r["depth"] for r in graph.transitive_closure(direct, edges, 100).collect()}
    assert got == {(1, i): i for i in range(13)} | {(2, i): min((i - d) % 13 for d in (5, 6)) for i in range(13)}
    assert graph.transitive_closure(direct, edges, 0).count() == 3
    for bad in (-1, 101):
        with pytest.raises(ValueError):
            graph.transitive_closure(direct, edges, bad)


def test_gate_options(spark):
    rows = spark.createDataFrame([(1, True, "Compatible"), (2, False, "Incompatible"), (3, False, "Unknown")], "project_id int, is_restrictive boolean, compatibility string")
    passed = lambda **o: {r["project_id"] for r in report.gate(rows, **o).where("passed").collect()}
    assert passed() == {3} and passed(on_restrictive=False) == {1, 3} and passed(on_incompatible=False) == {2, 3} and passed(on_restrictive=False, on_incompatible=False) == {1, 2, 3}


def test_language_aliases(spark):
    rows = spark.createDataFrame([("r", "a/Cargo.toml"), ("r", "go.mod"), ("r", "go.work"), ("r", "x.csproj")], "root string, path string")
    of = lambda name: [r["dir"] for r in files.project_roots(rows, name).collect()]
    assert of("RS") == of("rust") == ["a"] and of("golang") == [""] and of("C#") == [""] and of("python") == []


def deps(spark, path, content):
    rows = spark.createDataFrame([("r", path, content)], "root string, path string, content string")
    return {(r["name"], r["version"]) for r in manifests.deps_of(rows).collect()}


@pytest.mark.parametrize(
    "path,content,want",
    [
        ("Cargo.toml", '[dependencies]\nserde = { version = "1.0", features = ["derive"] }\nown = { workspace = true }\n"odd-name" = "^2"\n[build-dependencies]\ncc = "1"\n[workspace.dependencies]\nrand = "0.8"\n[profile.release]\nlto = "x"\n', {("serde", "1.0"), ("own", ""), ("odd-name", "2"), ("cc", "1"), ("rand", "0.8")}),
        ("a/Cargo.lock", '[[package]]\nname = "own"\nversion = "0.1.0"\n\n[[package]]\nname = "libc"\nversion = "0.2.1"\nsource = "registry+x"\n', {("libc", "0.2.1")}),
        ("go.mod", "module x\n\nrequire a.b/c v1.2.3 // indirect\nrequire (\n\td.e/f/v2 v2.0.0-2020\n)\nexclude (\n\tg.h/i v1.0.0\n)\n", {("a.b/c", "v1.2.3"), ("d.e/f/v2", "v2.0.0-2020")}),
        ("go.work", "go 1.22\nuse ./one\nuse (\n\t./two // here\n)\n", {("./one", ""), ("./two", "")}),
        ("conanfile.py", 'class A:\n    requires = [\n        "zlib/1.3",\n        "fmt/10.0@x/y",\n    ]\n    def requirements(self):\n        self.requires("boost/1.80#rev")\n', {("zlib", "1.3"), ("fmt", "10.0"), ("boost", "1.80")}),
        ("WORKSPACE", 'http_archive(\n    name = "abseil",\n    strip_prefix = "abseil-cpp-20230802.0",\n)\nlocal_repository(\n    name = "no",\n)\n', {("abseil", "20230802.0")}),
        ("Gemfile.lock", "GEM\n  specs:\n    a (1.0)\n      b (~> 2)\n    b (2.1)\n\nPLATFORMS\n  ruby\n", {("a", "1.0"), ("b", "2.1")}),
        ("yarn.lock", '"@s/a@^1", "@s/a@^2":\n  version "2.0.0"\n  resolved "x"\n\nb@^1:\n  resolution: "y"\n  version: 1.1.0\n', {("@s/a", "2.0.0"), ("b", "1.1.0")}),
        ("build.gradle", "ext.v = '3.1'\nimplementation \"g:a:${v}\"\napi 'g:b:$w'\n", {("g:a", "3.1"), ("g:b", "$w")}),
        ("package.json", '{"dependencies": {"a": "~1.0.0"}, "peerDependencies": {"a": "1.0.0", "b": ">=2"}}', {("a", "1.0.0"), ("b", "2")}),
        ("package.json", "not json", set()),
        ("pyproject.toml", '[project]\ndependencies = ["requests[socks]>=2.0", "flask==1.0"]\n', {("requests", "2.0"), ("flask", "1.0")}),
        ("pyproject.toml", "[project]\nname = 'x'\n[tool.x]\ndependencies = ['no']\n", set()),
        ("pyproject.toml", "[project]\ndependencies = 'no list'\n", set()),
        ("Cargo.toml", "dependencies = 3\n", set()),
        ("Cargo.lock", "package = 3\n", set()),
        ("pom.xml", "<project><!-- <dependency><groupId>a</groupId><artifactId>b</artifactId></dependency> --><dependency><groupId>c</groupId><artifactId>d</artifactId><version>${v}</version></dependency><properties><v>1</v><v>2</v></properties></project>", {("c:d", "2")}),
        ("pom.xml", "<dependency><artifactId>no group</artifactId></dependency><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>", {("g:a", "RELEASE")}),
        ("build.gradle.kts", 'implementation(group = "g", name = "a", version = "1")\nimplementation(\n  "g:b:2"\n)\nimplementation("only")\nval u = "// no comment"\nruntimeOnly("g:c")\n', {("g:a", "1"), ("g:b", "2"), ("g:c", "RELEASE")}),
        ("Makefile", None, set()),
    ],
)
def test_manifest_shapes(spark, path, content, want):
    assert deps(spark, path, content) == want


def test_project_references_resolve(spark):
    text = '<ProjectReference Include="..\\core\\core.csproj" /><ProjectReference Include="..\\..\\..\\out.csproj" />'
    rows = spark.createDataFrame([("r", "src/app/app.csproj", text), ("r", "app.csproj", '<ProjectReference Include="./lib/x.fsproj"/>')], "root string, path string, content string")
    assert {(r["src"], r["dst"]) for r in manifests.project_references(rows).collect()} == {("src/app/app.csproj", "src/core/core.csproj"), ("app.csproj", "lib/x.fsproj")}


def test_debounce_in_one_fold_or_many(spark, monkeypatch):
    import random

    rnd = random.Random(5)
    events = [(i, rnd.choice([1, 2]), rnd.randint(0, 400) / 10) for i in range(300)]
    df = spark.createDataFrame(events, "event_id long, root_id long, at double").select("event_id", "root_id", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts"))
    want = set()
    for root in (1, 2):
        end = -1.0
        for at, i in sorted((at, i) for i, r, at in events if r == root):
            if at >= end:
                want.add((root, i))
                end = at + 0.5
    for runs in (1_000, 1):
        monkeypatch.setattr(changes, "RUNS", runs)
        assert {(r["root_id"], r["event_id"]) for r in changes.debounce(df, 500).collect()} == want


@pytest.mark.parametrize("most", [None, 0])
def test_resolution_spreads_rows(spark, monkeypatch, most):
    """One popular package and many rows that need nothing: no task holds more than twice the mean."""
    from lixora.operators import resolve, shared

    if most is not None:
        monkeypatch.setattr(shared, "MOST_BROADCAST", most)
    name = F.when(F.col("id") % 50 != 0, "popular").otherwise(F.concat(F.lit("p"), F.col("id")))
    license_ = F.when((F.col("id") % 5 != 0), "MIT")
    df = spark.range(0, 20_000, 1, 8).select("id", F.lit("cargo").alias("ecosystem"), name.alias("name"), F.lit("1.0.0").alias("version"), license_.alias("license"), F.lit("x").alias("times"), F.lit("y").alias("a.b"))
    snapshot = df.select("ecosystem", "name", F.lit("latest").alias("version"), F.lit("ISC").alias("license")).where("name = 'popular' or id % 100 = 0").drop("id").distinct()
    definitions = spark.createDataFrame([("crate/cratesio/-/p50/1.0.0", "Zlib"), ("crate/cratesio/-/popular/1.0.0", "0BSD"), ("crate/cratesio/-/p100/1.0.0", "NONE")], "coordinate string, declared string")
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for got, want in ((resolve.resolve_from_registry(df, snapshot), {i: "MIT" if i % 5 else ("ISC" if i % 50 or i % 100 == 0 else None) for i in range(20_000)}), (resolve.resolve_from_definitions(df, definitions), {i: "MIT" if i % 5 else "0BSD" if i % 50 else "Zlib" if i == 50 else None for i in range(20_000)})):
            assert got.columns == df.columns
            rows = got.withColumn("task", F.spark_partition_id()).collect()
            assert {r["id"]: r["license"] for r in rows} == want and len(rows) == 20_000
            sizes = [sum(1 for _ in g) for _, g in itertools.groupby(sorted(r["task"] for r in rows))]
            assert max(sizes) <= 2 * 20_000 / 8
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)


def test_judging_leaves_other_columns_alone(spark):
    extra = ["allowed", "free", "approved", "project", "known", "leaf", "dep", "times", "answer", "k0", "x.y"]
    rows = spark.createDataFrame([("MIT", "GPL-3.0", *extra), ("GPL-3.0-only", "MIT", *extra), (None, None, *extra)], ["license", "project_license", *extra])
    cfg = ComplianceConfig.default(spark)
    for fn, new in ((judge.judge, ["is_restrictive", "osi_status", "compatibility"]), (judge.classify, ["is_restrictive", "osi_status"]), (judge.annotate, ["compatibility"])):
        got = fn(rows, cfg)
        assert set(got.columns) == {*rows.columns, *new}
        assert all(r[c] == c for r in got.collect() for c in extra)


@pytest.mark.parametrize("busy", [200_000, 7])
def test_licences_as_of_their_time(spark, busy):
    import datetime as dt
    import random

    from lixora.operators import resolve

    rnd = random.Random(9)
    day = lambda x: dt.datetime(2024, 1, 1) + dt.timedelta(days=x)
    rows = [(i, rnd.choice(["a", "a", "a", "b", "c", None]), rnd.choice([day(rnd.randint(0, 160) / 4), None]), rnd.choice([None, "", "MIT"]), "x") for i in range(400)]
    snaps = [(rnd.choice("ab"), day(rnd.randint(-40, 160) / 4), rnd.choice(["L1", "L2", "L3", None, "unknown"])) for _ in range(60)]
    snaps += [("a", snaps[0][1], "L0"), ("c", day(0), "L9")]
    df = spark.createDataFrame(rows, "id int, k string, seen timestamp_ntz, license string, `d.e` string")
    s = spark.createDataFrame(snaps, "k string, fetched_at timestamp_ntz, license string")
    got = resolve.resolve_as_of(df, s, ["k"], "seen", days=5, busy=busy)
    assert got.columns == df.columns

    def answer(k, seen, license_):
        if license_ == "MIT" or k is None or seen is None:
            return license_
        known = [(at, x) for p, at, x in snaps if p == k and at <= seen and x not in (None, "unknown")]
        at, x = max(known, default=(None, None))
        return x if at and seen - at < dt.timedelta(days=5) else license_

    assert {r["id"]: r["license"] for r in got.collect()} == {i: answer(k, t, x) for i, k, t, x, _ in rows}
    assert resolve.resolve_as_of(df.limit(0), s, ["k"], "seen").count() == 0 and resolve.resolve_as_of(df, s.limit(0), ["k"], "seen").count() == 400


def test_budgets_differ_by_package(spark):
    direct = spark.createDataFrame([(1, 0, 2), (1, 5, 0), (2, 0, 1), (2, 7, 100), (3, 0, -1)], "project_id long, pkg_id long, budget int")
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)] + [(9, 0)], "src long, dst long")
    got = {(r["project_id"], r["pkg_id"]): r["depth"] for r in graph.budgeted_closure(direct, edges).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (1, 5): 0, (2, 0): 0, (2, 1): 1} | {(2, (7 + d) % 10): d for d in range(3)} | {(2, p): (p + 3) % 10 for p in range(2, 7)}
    rules = spark.createDataFrame([(e,) for e in ("npm", "pypi", "golang", "maven", "cargo")], "e string").select("e", graph.depth_budget(F.col("e"), 1).alias("d"))
    assert {r["e"]: r["d"] for r in rules.collect()} == {"npm": 14, "pypi": 0, "golang": 0, "maven": 1, "cargo": 100}
    with pytest.raises(ValueError):
        graph.depth_budget(F.col("e"), 0)


def test_texts_are_read_once_by_a_scan(spark, tmp_path):
    """Whatever a scan looks for, the files are scanned once for what their texts say."""
    from lixora.operators import project_scan

    rows = [("r", "package.json", '{"dependencies": {"a": "1"}}'), ("r", "LICENSE", "MIT License"), ("r", "src/x.rs", "// SPDX-License-Identifier: ISC"), ("r", "vendor/k/COPYING", "ISC License"), ("r", ".gitignore", "*.tmp")]
    spark.createDataFrame(rows, "root string, path string, content string").write.parquet(str(tmp_path / "corpus"))
    files_ = spark.read.parquet(str(tmp_path / "corpus"))
    found = project_scan.scan_projects(files_, ComplianceConfig.default(spark))
    assert sorted((r["source"], r["name"], r["license"], r["depth"]) for r in found.collect()) == [("manifest", "a", None, 0), ("own-source", "src/x.rs", "ISC", None), ("unmanaged", "src", "ISC", None), ("vendored", "vendor/k", "ISC", None)]
    plan = found._jdf.queryExecution().toString()
    assert "content" not in plan and "corpus" not in plan


def test_nested_names_of_distributions(spark):
    rpm = {
        "GPLv2+ or (Artistic and MIT)": "GPL-2.0-or-later OR (Artistic AND MIT)",
        "(GPLv2+ or LGPLv3+) and GPLv3+": "(GPL-2.0-or-later OR LGPL-3.0-or-later) AND GPL-3.0-or-later",
        "GPLv2+ and LGPLv2+ or MIT": "GPL-2.0-or-later AND (LGPL-2.0-or-later OR MIT)",
        "MIT and ((ASL 2.0 or (GPLv2 and zlib)) and MPLv2.0)": "MIT AND ((Apache-2.0 OR (GPL-2.0-only AND Zlib)) AND MPL-2.0)",
        "((MIT))": "((MIT))",
        "(MIT": "(MIT",
        "MIT) and (BSD": "MIT) and (BSD",
        "BSD (3 clause) and MIT": "BSD (3 clause) AND MIT",
        "GPL-2.0-or-later AND (MIT WITH X)": "GPL-2.0-or-later AND (MIT WITH X)",
        "MIT and unknown": "MIT",
        "unknown and Unknown": None,
        "": None,
        "()": None,
        "(((a or b) and c) or d)": "(((a OR b) AND c) OR d)",
        "MIT and (ASL 2.0 or MIT) or zlib": "MIT AND ((Apache-2.0 OR MIT) OR Zlib)",
    }
    assert one(spark, list(rpm), licenses.normalize_rpm) == list(rpm.values())
    debian = {
        "Expat or (GPL-2+ and (BSD-3-clause or LGPL-2.1))": "MIT OR (GPL-2.0-or-later AND (BSD-3-Clause OR LGPL-2.1-only))",
        "(GPL-2+ or Artistic) and Expat": "(GPL-2.0-or-later OR Artistic-1.0) AND MIT",
        "GPL-2+ (with exception)": "GPL-2+ (with exception)",
        "unknown": None,
        "a or (b": "a or (b",
    }
    assert one(spark, list(debian), licenses.normalize_debian) == list(debian.values())


def test_well_formed_is_what_the_strict_parser_takes(spark):
    import random

    rnd = random.Random(3)
    texts = [" ".join(rnd.choices(["MIT", "ISC", "AND", "OR", "WITH", "(", ")"], k=rnd.randint(1, 9))) for _ in range(600)]
    texts += ["MIT OR (Apache-2.0 AND (BSD-2-Clause OR ISC))", "((MIT))", "(MIT", "MIT)", "", " ", "MIT WITH", "(A) WITH B AND C", "A B", "(((((A) OR B) AND C)))"]
    assert one(spark, texts, licenses.is_well_formed) == [postfix(t, strict=True) is not None for t in texts]
    head = "// SPDX-License-Identifier: (a OR (b AND (c OR d)))\n"
    assert one(spark, [head, "# SPDX-License-Identifier: ((MIT)) */"], licenses.spdx_header) == ["(a OR (b AND (c OR d)))", "((MIT))"]


def test_places_over_even_ranges(spark):
    """Equal rows, nulls and other columns' names; no task holds more than a few times the mean."""
    import random

    from lixora.operators.rank import ranked

    rnd = random.Random(2)
    rows = [(i, rnd.choice([None, 7, 7, 7, 7, rnd.randint(0, 99)]), "p") for i in range(20_000)]
    df = spark.createDataFrame(rows, "id int, v int, `place.x` string").repartition(4)
    got = ranked(df, F.col("v").desc(), F.col("id")).withColumn("task", F.spark_partition_id())
    assert got.drop("task").columns == ["id", "v", "place.x", "place"]
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    taken = got.collect()
    assert [r["id"] for r in sorted(taken, key=lambda r: r["place"])] == [r[0] for r in want]
    equal = ranked(df, F.col("v")).collect()
    assert sorted(r["place"] for r in equal) == list(range(1, 20_001))
    assert [r["v"] for r in sorted(equal, key=lambda r: r["place"]) if r["v"] is not None] == sorted(r[1] for r in rows if r[1] is not None)
    assert ranked(df.limit(0), F.col("v")).count() == 0
    sizes = [sum(1 for _ in g) for _, g in itertools.groupby(sorted(r["place"] * 4 // 20_001 for r in equal))]
    assert len(sizes) == 4


def test_documents_in_parts_are_those_in_rows(spark, tmp_path):
    rows = spark.range(3_000).select((F.col("id") % 2).alias("project_id"), F.lit("cargo").alias("ecosystem"), F.concat(F.lit("p\""), F.floor(F.col("id") / 3)).alias("name"), F.lit("1").alias("version"), F.when(F.col("id") % 3 == 0, "MIT").alias("license"))
    for name, parts, whole in (("s", sbom.spdx_parts(rows, "2024"), sbom.to_spdx(rows, "2024")), ("c", sbom.cyclonedx_parts(rows, "2024"), sbom.to_cyclonedx(rows, "2024"))):
        path = str(tmp_path / name)
        sbom.write_documents(parts, path)
        assert max(len(r["text"]) for r in parts.collect()) < 600
        got = {r["doc_id"]: json.loads(r["json"]) for r in sbom.read_documents(spark, path).collect()}
        want = {r["doc_id"]: json.loads(r["json"]) for r in whole.collect()}
        key = "packages" if name == "s" else "components"
        assert got.keys() == want.keys() == {0, 1} and all(len(got[i][key]) == 1_500 for i in got)
        tidy = lambda d: {k: sorted(map(str, v)) if k == key else v for k, v in d.items()}
        assert {i: tidy(d) for i, d in got.items()} == {i: tidy(d) for i, d in want.items()}
        assert [x["name"] for x in got[0][key]] == [x["name"] for x in want[0][key]]


def test_long_lists_of_patterns(spark):
    few, many = ["GPL", "x y"], ["GPL", "x y", *(f"pattern {i}" for i in range(5_000))]
    texts = ["AGPL-3.0", "MIT", "pattern 4999 here", "", None, "a x y b"]
    assert one(spark, texts, lambda c: licenses.any_in(c, few)) == [True, False, False, False, None, True]
    assert one(spark, texts, lambda c: licenses.any_in(c, many)) == [True, False, True, False, None, True]
    rows = spark.createDataFrame([("MIT", "MIT"), ("pattern 7", "MIT")], "license string, project_license string")
    got = judge.classify(rows, ComplianceConfig.default(spark, restrictive=many)).collect()
    assert sorted((r["license"], r["is_restrictive"]) for r in got) == [("MIT", False), ("pattern 7", True)]
