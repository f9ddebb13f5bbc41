"""SBOM documents of many projects, and of projects with many packages."""

from lixora.operators import sbom

ROWS = "project_id long, ecosystem string, name string, version string, license string"


def packages(spark):
    return spark.createDataFrame([(1, "npm", "@s/a", "1", "MIT"), (1, "generic", "b c", "", None), (2, "odd", "x", "3", "a  b")], ROWS)


def test_documents_are_dealt_to_tasks_before_entries_are_made(spark):
    for make in (sbom.to_spdx, sbom.to_cyclonedx):
        plan = make(packages(spark), "2024-01-01T00:00:00Z")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "REPARTITION_BY_NUM" in plan


def test_addresses_stand_where_there_are_any(spark):
    json = {r.doc_id: r.json for r in sbom.to_spdx(packages(spark), "2024-01-01T00:00:00Z").collect()}
    assert '"referenceLocator":"pkg:npm/%40s/a@1"' in json[1] and json[1].count("externalRefs") == 2
    assert "externalRefs" not in json[2]


def test_written_documents_are_compressed_and_read_line_by_line(spark, tmp_path):
    import glob
    import json as plain

    at = str(tmp_path / "docs")
    sbom.write_documents(sbom.spdx_parts(packages(spark), "2024-01-01T00:00:00Z"), at)
    files = glob.glob(f"{at}/*/*")
    assert len(files) == 2 and all(f.endswith(".gz") for f in files)
    whole = sbom.read_documents(spark, at)
    assert sorted(len(plain.loads(r.json)["packages"]) for r in whole.collect()) == [1, 2]
    back = sbom.read_parts(spark, at, "spdx")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sbom.spdx_components(whole).collect()))
    assert sorted((r.doc_id, r.pos, r.name) for r in back.collect()) == [(1, 0, "b c"), (1, 1, "@s/a"), (2, 0, "x")]


def test_entries_are_parsed_once(spark, tmp_path, monkeypatch):
    """A filter on a field must not read the entry again, and lines of relationships aren't parsed."""
    at, seen, written = str(tmp_path / "docs"), [], sbom.written
    sbom.write_documents(sbom.spdx_parts(packages(spark), "2024-01-01T00:00:00Z"), at)
    monkeypatch.setattr(sbom, "written", lambda df, name: seen.append(df) or written(df, name))
    assert sbom.read_parts(spark, at, "spdx").count() == 3
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (*seen, sbom.spdx_components(sbom.read_documents(spark, at)), sbom.cyclonedx_components(sbom.read_documents(spark, at)))]
    assert len(plans) == 3 and "spdxElementId" in plans[0]
    for plan in plans:
        assert sum("variant_get" in line or "parseJson" in line for line in plan.splitlines() if "Filter" in line) == 0
        assert plan.count("parseJson") == 1


def test_enriched_documents_are_shuffled_once(spark):
    """Answers meet their document as a list; the entries aren't taken apart and put together again."""
    import json as plain

    names = ["a", None, "b", "c", "d"]
    packs = [{"name": n, "licenseDeclared": "MIT" if n == "c" else "NOASSERTION"} for n in names]
    docs = spark.createDataFrame([(i, plain.dumps({"spdxVersion": "SPDX-2.3", "packages": packs})) for i in range(2)] + [(2, "no json")], "doc_id long, json string")
    answers = spark.createDataFrame([(0, 0, "ISC"), (0, 3, "Zlib"), (0, 4, "Odd One"), (0, 4, "Odd One"), (1, 9, "ISC"), (0, 1, "0BSD")], "doc_id long, pos int, license string")
    made = sbom.enrich_sbom(docs, answers)
    got = {r.doc_id: r.json for r in made.collect()}
    first = plain.loads(got[0])
    assert [p.get("licenseConcluded") for p in first["packages"]] == ["ISC", None, None, None, "LicenseRef-Odd-One"] and [p["name"] for p in first["packages"]] == names
    assert [i["name"] for i in first["hasExtractedLicensingInfos"]] == ["Odd One"]
    assert {i: got[i] for i in (1, 2)} == {r.doc_id: r.json for r in docs.where("doc_id > 0").collect()}
    plan = made._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert "BroadcastExchange" not in plan
    assert plan.count("SortMergeJoin") == 2
    assert plan.count("Generate posexplode") == 1
