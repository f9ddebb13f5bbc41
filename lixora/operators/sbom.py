"""SBOM documents: detection, extraction, validation, emission and enrichment.

A table of documents is (doc_id, json). A document is one row, its packages are exploded with their position. Documents
come from elsewhere, so each entry is read as a variant by itself, and each field by its own type. An object that
holds a key twice is no readable JSON unless spark.sql.variant.allowDuplicateKeys is on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lixora.functions.ids import parse_purl, purl
from lixora.functions.licenses import detect_license, is_expression, is_license_id, is_stated, is_unresolved, license_ref, to_spdx_expression
from lixora.operators.config import ComplianceConfig
from lixora.operators.judge import judge
from lixora.operators.resolve import resolve_from_definitions, resolve_from_registry
from lixora.operators.shared import cut, large, small, written

MARKS = {"spdx": ("spdxVersion", "SPDXID"), "cyclonedx": ("bomFormat", "specVersion")}
#: Key of the list that a document's packages stand in.
LISTS = {"spdx": "packages", "cyclonedx": "components"}
COMPONENT = ["doc_id", "pos", "ecosystem", "name", "version", "license"]
SPACE = " \t\n\r\x0b\x0c"


def _v(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, f"$.{path}" if path else "$", kind)


def _string(v: Column, path: str) -> Column:
    """A field that is a JSON string; null for anything else."""
    return F.when(F.schema_of_variant(_v(v, path)) == "STRING", _v(v, path, "string"))


def _said(v: Column, path: str) -> Column:
    """A string field without white space around it; null if that leaves nothing."""
    return F.nullif(F.btrim(_string(v, path), F.lit(SPACE)), F.lit(""))


def _list(v: Column, path: str) -> Column:
    """The entries of a list, whatever each of them is; null if the field is no list."""
    return _v(v, path, "array<variant>")


def _format(v: Column) -> Column:
    has = lambda keys: F.coalesce(*[_v(v, k, "string") for k in keys]).isNotNull()
    return F.when(has(MARKS["spdx"]), "spdx").when(has(MARKS["cyclonedx"]), "cyclonedx")


def read_sboms(docs: DataFrame) -> DataFrame:
    """docs with format: spdx, cyclonedx, or null for anything else (also for text that isn't JSON)."""
    return docs.withColumn("format", _format(F.try_parse_json("json")))


def _identified(rows: DataFrame, *more: str) -> DataFrame:
    """Identity by package URL, else the stated name and version as generic."""
    p = parse_purl(F.col("purl"))
    rows = rows.withColumn("p", p)
    return rows.select("doc_id", "pos", F.coalesce("p.ecosystem", F.lit("generic")).alias("ecosystem"), F.coalesce("p.name", "name").alias("name"), F.coalesce(F.nullif("p.version", F.lit("")), "version", F.lit("")).alias("version"), "license", *more)


def expand_license_refs(license: Column, refs: Column) -> Column:
    """Document-local ids replaced by the licence that their text is, else by their name; longest id first.

    refs: array of struct(licenseId, name, extractedText). An id whose text and name say nothing stays; of entries with
    one id the last counts.
    """
    return _with_refs(license, _known_refs(refs))


def _known_refs(refs: Column) -> Column:
    known = lambda r: F.coalesce(detect_license(r["extractedText"]), F.when(is_stated(r["name"]), r["name"]))
    named = lambda r, i: F.named_struct(F.lit("n"), -F.length(r["licenseId"]), F.lit("i"), -i, F.lit("id"), r["licenseId"], F.lit("to"), known(r))
    return F.array_sort(F.filter(F.transform(refs, named), lambda r: r["to"].isNotNull() & r["id"].isNotNull()))


def _with_refs(license: Column, known: Column) -> Column:
    none = F.array().cast("array<struct<n:int,i:int,id:string,to:string>>")
    return F.when(F.contains(license, F.lit("LicenseRef-")), F.aggregate(F.coalesce(known, none), license, lambda acc, r: F.replace(acc, r["id"], r["to"]))).otherwise(license)


def _entries(docs: DataFrame, formats: list[str]) -> DataFrame:
    """(doc_id, format, refs, pos, x): every entry of the package lists of documents, as it is."""
    d = docs.select("doc_id", F.try_parse_json("json").alias("v"))
    d = d.withColumn("format", _format(F.col("v")) if len(formats) > 1 else F.lit(formats[0]))
    infos = F.transform(_list(F.col("v"), "hasExtractedLicensingInfos"), lambda r: F.named_struct(*[x for k in ("licenseId", "name", "extractedText") for x in (F.lit(k), _said(r, k))]))
    parts = F.coalesce(*[F.when(F.col("format") == f, _list(F.col("v"), LISTS[f])) for f in formats])
    # what rows carry must be worked out below the explosion: else the whole document goes with each of its entries
    d = d.select("doc_id", "format", _known_refs(infos).alias("refs"), parts.alias("parts"))
    # outer: else Spark looks for empty lists first, and parses each document again for that
    return d.select("doc_id", "format", "refs", F.posexplode_outer("parts").alias("pos", "x")).where("pos is not null")


def _spdx_purl(x: Column) -> Column:
    """What an entry's first reference of that type locates, as it is."""
    refs = F.filter(_list(x, "externalRefs"), lambda r: F.lower(F.btrim(_string(r, "referenceType"), F.lit(SPACE))) == "purl")
    return _v(F.get(refs, F.lit(0)), "referenceLocator")


def _cyclonedx_licenses(x: Column) -> Column:
    each = F.transform(_list(x, "licenses"), lambda e: F.coalesce(_said(e, "expression"), _said(e, "license.id"), _said(e, "license.name")))
    return F.array_distinct(F.filter(each, lambda e: is_stated(e)))


def _joined(each: Column) -> Column:
    """Several licences are joined by AND."""
    return F.array_join(F.transform(each, lambda e: F.when(F.contains(e, F.lit(" OR ")) & (F.size(each) > 1), F.concat(F.lit("("), e, F.lit(")"))).otherwise(e)), " AND ")


def _components(docs: DataFrame, *formats: str) -> DataFrame:
    return _read_entries(_entries(docs, list(formats)))


def _read_entries(entries: DataFrame, *more: str, keep: Column | None = None) -> DataFrame:
    """COMPONENT rows with format, and columns of entries besides; rows to keep need no name. Every entry is read by itself: numbers, nulls, lists and nameless entries among the
    packages cost only themselves, and positions are those of the document."""
    x, spdx = F.col("x"), F.col("format") == "spdx"
    fields = {
        "name": _v(x, "name"),
        "version": F.when(spdx, _v(x, "versionInfo")).otherwise(_v(x, "version")),
        "purl": F.when(spdx, _spdx_purl(x)).otherwise(_v(x, "purl")),
        "concluded": F.when(spdx, _v(x, "licenseConcluded")),
        "declared": F.when(spdx, _v(x, "licenseDeclared")),
    }
    # one step after another: what a step names twice has been worked out once
    own = ["doc_id", "format", "refs", "pos", *more]
    rows = entries.select(*own, *[c.alias(n) for n, c in fields.items()], F.when(~spdx, _cyclonedx_licenses(x)).alias("listed"))
    text = lambda n: F.when(F.schema_of_variant(n) == "STRING", _v(F.col(n), "", "string")).alias(n)
    rows = rows.select(*own, *[text(n) for n in fields], _joined(F.col("listed")).alias("listed"))
    rows = rows.select(*own, *[F.btrim(n, F.lit(SPACE)).alias(n) for n in fields], "listed")
    filled = lambda n: F.nullif(F.col(n), F.lit(""))
    # the name is exploded: else the filter on it goes down to the entries, which are read (and parsed) several times for it
    rows = rows.select(*own, *[filled(n).alias(n) for n in [*fields, "listed"] if n != "name"], F.explode_outer(F.array(filled("name"))).alias("name"))
    rows = rows.where("name is not null" if keep is None else F.col("name").isNotNull() | keep)
    # the concluded licence if it is stated, else the declared one
    said = F.coalesce(*[F.when(is_stated(F.col(c)), F.col(c)) for c in ("concluded", "declared")])
    lic = F.when(spdx, _with_refs(said, F.col("refs"))).otherwise(F.col("listed"))
    return _identified(rows.withColumn("license", lic), "format", *more)


def spdx_components(docs: DataFrame) -> DataFrame:
    """COMPONENT rows of SPDX documents; entries without a name go."""
    return _components(docs, "spdx").drop("format")


def cyclonedx_components(docs: DataFrame) -> DataFrame:
    """COMPONENT rows of CycloneDX documents (top level); entries without a name go."""
    return _components(docs, "cyclonedx").drop("format")


def ingest_sboms(docs: DataFrame) -> DataFrame:
    """COMPONENT rows with format of all readable documents; each is parsed once."""
    return _components(docs, "spdx", "cyclonedx")


def judge_sboms(docs: DataFrame, cfg: ComplianceConfig, snapshot: DataFrame | None = None, definitions: DataFrame | None = None, project_license: str | None = None) -> DataFrame:
    """Components of all readable documents with verdicts. Licences that a document doesn't state are resolved from
    the registry snapshot, then from definitions; rows keep their document, position and format. Documents are parsed once:
    their rows are written out before they are looked up and judged."""
    rows = cut(ingest_sboms(docs)).withColumn("project_license", F.lit(project_license).cast("string"))
    if snapshot is not None:
        rows = resolve_from_registry(rows, snapshot)
    if definitions is not None:
        rows = resolve_from_definitions(rows, definitions)
    return judge(rows, cfg)


def sanitize_spdx(df: DataFrame) -> DataFrame:
    """spdx_name, spdx_version, spdx_license and element_id as a document may hold them, and how many were changed."""
    clean = lambda c, most: F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x1f\x7f\"\\]", "")), 1, most)
    name, version = F.coalesce(F.nullif(clean(F.col("name"), 255), F.lit("")), F.lit("unknown")), clean(F.coalesce("version", F.lit("")), 100)
    lic = to_spdx_expression(F.coalesce("license", F.lit("")))
    fixes = (name != F.col("name")).cast("int") + (version != F.coalesce("version", F.lit(""))).cast("int") + (~lic.eqNullSafe(F.col("license"))).cast("int")
    key = F.concat_ws("@", "ecosystem", "name", "version")
    return df.withColumns({"spdx_name": name, "spdx_version": version, "spdx_license": lic, "element_id": F.concat(F.lit("SPDXRef-Package-"), F.hex(F.xxhash64(key))), "fixes": fixes})


def _spdx_package(no_assertion: bool = False) -> Column:
    """The entry of a package, of sanitised rows."""
    stated = F.lit("NOASSERTION") if no_assertion else F.col("spdx_license")
    url = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    # filter and transform: the address is worked out once
    refs = F.transform(F.filter(F.array(url), lambda u: u.isNotNull()), lambda u: F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), u.alias("referenceLocator")))
    ref = F.get(F.filter(F.array(refs), lambda r: F.size(r) > 0), F.lit(0))
    return F.struct(F.col("spdx_name").alias("name"), F.col("element_id").alias("SPDXID"), F.col("spdx_version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"), F.lit("NOASSERTION").alias("licenseConcluded"), stated.alias("licenseDeclared"), F.lit("NOASSERTION").alias("copyrightText"), ref.alias("externalRefs"))


def _describes(element_id: Column) -> Column:
    return F.struct(F.lit("SPDXRef-DOCUMENT").alias("spdxElementId"), F.lit("DESCRIBES").alias("relationshipType"), element_id.alias("relatedSpdxElement"))


def _spdx_head(created: str) -> list[Column]:
    label = F.concat(F.lit("project-"), "project_id")
    return [F.lit("SPDX-2.3").alias("spdxVersion"), F.lit("CC0-1.0").alias("dataLicense"), F.lit("SPDXRef-DOCUMENT").alias("SPDXID"), label.alias("name"), F.concat(F.lit("https://spdx.example/"), label).alias("documentNamespace"), F.struct(F.lit(created).alias("created"), F.array(F.lit("Tool: lixora")).alias("creators")).alias("creationInfo")]


def _by_document(df: DataFrame) -> DataFrame:
    """Rows of a document in one task, before entries are made of them. In a fixed number of tasks: entries of few bytes once
    compressed would be put together to tasks of gigabytes."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "project_id")


def to_spdx(df: DataFrame, created: str, no_assertion: bool = False) -> DataFrame:
    """(doc_id, json): one SPDX 2.3 document per project_id, packages ordered by ecosystem, name and version."""
    rows = sanitize_spdx(_by_document(df))
    docs = rows.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ecosystem", "name", "version", _spdx_package(no_assertion).alias("pack")))), lambda x: x["pack"]).alias("packages"))
    doc = F.struct(*_spdx_head(created), F.col("packages"), F.transform("packages", lambda p: _describes(p["SPDXID"])).alias("relationships"))
    return docs.select(F.col("project_id").alias("doc_id"), F.to_json(doc).alias("json"))


def _cyclonedx_component() -> Column:
    lic = F.trim(F.col("license"))
    choice = F.when(to_spdx_expression(F.coalesce(lic, F.lit(""))) == "NOASSERTION", F.when(is_stated(lic), F.struct(F.struct(F.lit(None).cast("string").alias("id"), lic.alias("name")).alias("license"), F.lit(None).cast("string").alias("expression"))))
    choice = choice.when(F.contains(lic, F.lit(" ")), F.struct(F.lit(None).cast("struct<id:string,name:string>").alias("license"), lic.alias("expression"))).when(is_stated(lic), F.struct(F.struct(lic.alias("id"), F.lit(None).cast("string").alias("name")).alias("license"), F.lit(None).cast("string").alias("expression")))
    url = purl(F.col("ecosystem"), F.col("name"), F.col("version"))
    return F.to_json(F.struct(F.lit("library").alias("type"), url.alias("bom-ref"), F.col("name").alias("name"), F.col("version").alias("version"), url.alias("purl"), F.when(choice.isNotNull(), F.array(choice)).alias("licenses")))


def _cyclonedx_head(created: str) -> str:
    return f'{{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{{"timestamp":"{created}","tools":[{{"name":"lixora"}}]}},"components":['


def to_cyclonedx(df: DataFrame, created: str) -> DataFrame:
    """(doc_id, json): one CycloneDX 1.5 document per project_id."""
    docs = _by_document(df).groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("ecosystem", "name", "version", _cyclonedx_component().alias("part")))), lambda x: x["part"]).alias("parts"))
    return docs.select(F.col("project_id").alias("doc_id"), F.concat(F.lit(_cyclonedx_head(created)), F.array_join("parts", ","), F.lit("]}")).alias("json"))


PARTS = ["doc_id", "section", "key", "text"]
#: How the line of a relationship begins (see ``_describes``).
RELATED = '{"spdxElementId":'


def _parts(rows: DataFrame, fixed: dict[int, Column], listed: dict[int, Column]) -> DataFrame:
    """(PARTS): the fixed sections of each project's document once, and an entry for each row in the listed ones."""
    key = F.struct("ecosystem", "name", "version")
    entries = rows.select("project_id", F.explode(F.array(*[F.struct(F.lit(i).alias("section"), key.alias("key"), c.alias("text")) for i, c in listed.items()])).alias("p"))
    once = rows.select("project_id").distinct().select("project_id", F.explode(F.array(*[F.struct(F.lit(i).alias("section"), c.alias("text")) for i, c in fixed.items()])).alias("p"))
    once = once.select("project_id", "p.section", F.lit(None).cast(entries.schema["p"].dataType["key"].dataType).alias("key"), "p.text")
    return entries.select("project_id", "p.section", "p.key", "p.text").unionByName(once).withColumnRenamed("project_id", "doc_id")


def spdx_parts(df: DataFrame, created: str, no_assertion: bool = False) -> DataFrame:
    """The documents of ``to_spdx`` in parts: a row for the head, for each package, and so on; no row grows with a document."""
    rows = sanitize_spdx(df)
    head = F.to_json(F.struct(*_spdx_head(created)))
    fixed = {0: F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"packages":[')), 2: F.lit('],"relationships":['), 4: F.lit("]}")}
    return _parts(rows, fixed, {1: F.to_json(_spdx_package(no_assertion)), 3: F.to_json(_describes(F.col("element_id")))})


def cyclonedx_parts(df: DataFrame, created: str) -> DataFrame:
    """The documents of ``to_cyclonedx`` in parts."""
    return _parts(df, {0: F.lit(_cyclonedx_head(created)), 2: F.lit("]}")}, {1: _cyclonedx_component()})


def write_documents(parts: DataFrame, path: str) -> None:
    """Write one file for each document, path/doc_id=.../, from its parts in order; path must be new.

    A document is a sorted stream of rows in one task, as it is one file; it is never held as a whole. Entries of a list are
    set apart by commas, and each part is a line. Files are compressed, as entries are much alike.
    """
    order = Window.partitionBy("doc_id").orderBy("section", "key", "text")
    again = (F.col("section") % 2 == 1) & (F.lag("section").over(order) == F.col("section"))
    lines = parts.select("doc_id", F.when(again, F.concat(F.lit(","), "text")).otherwise(F.col("text")).alias("value"), "section", "key", "text")
    lines.sortWithinPartitions("doc_id", "section", "key", "text").select("doc_id", "value").write.partitionBy("doc_id").text(path, compression="gzip")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json) of documents that fit in a row."""
    return spark.read.option("basePath", path).text(path, wholetext=True).select("doc_id", F.col("value").alias("json"))


def read_parts(spark: SparkSession, path: str, format: str) -> DataFrame:
    """COMPONENT rows of documents of any length that ``write_documents`` has written, line by line: no row holds a document.

    A compressed file is one stream of a task, so its lines are numbered in order; the numbers are written out with the
    components, as another reading may number otherwise. A position counts from the line that opens the list.
    """
    value = F.col("value")
    lines = spark.read.option("basePath", path).text(path).select("doc_id", "value", F.monotonically_increasing_id().alias("pos"))
    opens = value.startswith("{") & value.endswith("[")
    # relationships are half of a document's lines and no components
    listed = ~opens & ~value.startswith(RELATED) & ~value.startswith(f",{RELATED}")
    entries = lines.select("doc_id", F.lit(format).alias("format"), _known_refs(F.lit(None).cast("array<struct<licenseId:string,name:string,extractedText:string>>")).alias("refs"), "pos", opens.alias("opens"), F.try_parse_json(F.when(listed, F.regexp_replace(value, "^,", ""))).alias("x"))
    kept = written(_read_entries(entries, "opens", keep=F.col("opens")), "components")
    starts = small(kept.where("opens").select("doc_id", F.col("pos").alias("start")))
    return kept.where("not opens").join(starts, "doc_id").select("doc_id", (F.col("pos") - F.col("start") - 1).cast("int").alias("pos"), *COMPONENT[2:])


def _text(value: Column) -> Column:
    """A string as JSON."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _object(fields: Column, put: dict[str, Column]) -> Column:
    """JSON of an object given as map<string,variant>, with the fields of ``put`` (JSON text) in place of its own or after them."""
    kept = F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(list(put)))
    pairs = F.transform(kept, lambda e: F.concat(_text(e["key"]), F.lit(":"), F.to_json(e["value"])))
    more = F.array_compact(F.array(*[F.concat(_text(F.lit(k)), F.lit(":"), v) for k, v in put.items()]))
    return F.concat(F.lit("{"), F.array_join(F.concat(pairs, more), ","), F.lit("}"))


def enrich_sbom(docs: DataFrame, resolved: DataFrame) -> DataFrame:
    """Documents of both formats with resolved(doc_id, pos, license) written to the entries, by position, that state no
    licence.

    Free text becomes a LicenseRef with an extracted-text entry in SPDX, a licence name in CycloneDX. Documents without such
    an entry stay byte for byte; the others are written anew from their values, keys in order. doc_id tells documents apart.
    """
    answers = resolved.where(~is_unresolved(F.col("license"))).select("doc_id", "pos", F.col("license").alias("answer"))
    fixes = _components(docs, "spdx", "cyclonedx").where("license is null").select("doc_id", "pos").join(large(answers), ["doc_id", "pos"])
    fixes = fixes.groupBy("doc_id", "pos").agg(F.max("answer").alias("answer")).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "answer"))).alias("by_pos"))
    # a document is shuffled once, as it is, and meets the answers of its entries as a list with gaps of nulls
    gap = lambda e, k: e["pos"] - F.coalesce(F.get("by_pos", k - 1)["pos"], F.lit(-1)) - 1
    every = F.flatten(F.transform("by_pos", lambda e, k: F.concat(F.array_repeat(F.lit(None).cast("string"), gap(e, k)), F.array(e["answer"]))))
    fixes = fixes.select("doc_id", every.alias("answers"), F.col("by_pos.answer").alias("in_order"))
    met = docs.join(large(fixes), "doc_id", "left").withColumn("v", F.try_parse_json(F.when(F.col("answers").isNotNull(), F.col("json"))))
    met = met.withColumn("format", _format(F.col("v")))
    met = met.withColumn("entries", F.coalesce(*[F.when(F.col("format") == f, _list(F.col("v"), key)) for f, key in LISTS.items()]))

    def written(x: Column, answer: Column) -> Column:
        named = F.struct(F.when(~is_license_id(answer), answer).alias("name"), F.when(is_license_id(answer), answer).alias("id"))
        choice = F.when(is_expression(answer), F.to_json(F.struct(answer.alias("expression")))).otherwise(F.to_json(F.struct(named.alias("license"))))
        spdx, cyclonedx = {"licenseConcluded": _text(F.coalesce(license_ref(answer), answer))}, {"licenses": F.concat(F.lit("["), choice, F.lit("]"))}
        fields = x.cast("map<string,variant>")
        return F.when(answer.isNull(), F.to_json(x)).when(F.col("format") == "spdx", _object(fields, spdx)).otherwise(_object(fields, cyclonedx))

    def info(answer: Column) -> Column:
        ref = license_ref(answer)
        return F.when(ref.isNotNull(), F.to_json(F.struct(ref.alias("licenseId"), answer.alias("name"), answer.alias("extractedText"))))

    both = met.withColumn("parts", F.array_join(F.transform("entries", lambda x, i: written(x, F.get("answers", i))), ","))
    both = both.withColumn("infos", F.when(F.col("format") == "spdx", F.array_compact(F.transform(F.array_distinct("in_order"), info))))
    top = F.col("v").cast("map<string,variant>")
    listed = F.concat(F.lit("["), F.col("parts"), F.lit("]"))
    old = F.transform(_list(F.col("v"), "hasExtractedLicensingInfos"), lambda e: F.to_json(e))
    infos = F.concat(F.lit("["), F.array_join(F.concat(F.coalesce(old, F.array().cast("array<string>")), F.col("infos")), ","), F.lit("]"))
    new = F.when(F.col("format") == "cyclonedx", _object(top, {"components": listed})).when(F.size("infos") == 0, _object(top, {"packages": listed})).otherwise(_object(top, {"packages": listed, "hasExtractedLicensingInfos": infos}))
    return both.select("doc_id", F.when(F.col("format").isNull(), F.col("json")).otherwise(new).alias("json"))


ISSUES = "array<struct<severity:string,field:string,message:string>>"


def _issues(docs: DataFrame, found: list[Column]) -> DataFrame:
    every = F.flatten(F.array(*[F.coalesce(f, F.array().cast(ISSUES)) for f in found]))
    return docs.select("doc_id", F.explode(F.filter(every, lambda i: i.isNotNull())).alias("i")).select("doc_id", "i.severity", "i.field", "i.message")


def _issue(when: Column, severity: str, field: str | Column, message: str) -> Column:
    at = F.lit(field) if isinstance(field, str) else field
    return F.when(when, F.struct(F.lit(severity).alias("severity"), at.alias("field"), F.lit(message).alias("message")))


def _is_object(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))


def _missing(v: Column, key: str) -> Column:
    """An object without a key; a key with null is there."""
    return _is_object(v) & _v(v, key).isNull()


#: Component types that are known.
PART_TYPES = ["application", "framework", "library", "container", "operating-system", "device", "firmware", "file", "install", "archive", "filing-system", "media", "other"]
#: Versions that are known.
SPDX_VERSIONS, CYCLONEDX_VERSIONS = ["SPDX-2.2", "SPDX-2.3"], ["1.0", "1.1", "1.2", "1.3", "1.4", "1.5"]
RFC_3339 = r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(?:\.\d+)?(?:[Zz]|[+-]\d\d:\d\d)$"


def validate_spdx(docs: DataFrame) -> DataFrame:
    """(doc_id, severity, field, message) of SPDX documents. Entries among the packages that are no objects are passed over."""
    d = docs.select("doc_id", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    top = [_issue(~_is_object(v), "error", "document", "not a JSON object")]
    top += [_issue(_missing(v, k), "error", k, "missing") for k in ("spdxVersion", "dataLicense", "SPDXID", "name", "documentNamespace", "creationInfo")]
    version, name, space, packs = _string(v, "spdxVersion"), _string(v, "name"), _string(v, "documentNamespace"), _list(v, "packages")
    known = reduce(Column.__or__, [version.startswith(k) for k in SPDX_VERSIONS])
    top += [_issue(~version.startswith("SPDX-"), "warning", "spdxVersion", "no SPDX- prefix"), _issue(~known, "info", "spdxVersion", "neither 2.2 nor 2.3")]
    top += [_issue(name == "", "error", "name", "empty"), _issue(space == "", "error", "documentNamespace", "empty"), _issue((space != "") & ~space.rlike("^https?://"), "warning", "documentNamespace", "not a URL")]
    top.append(_issue(F.size(packs) == 0, "warning", "packages", "empty"))

    def of(p: Column, i: Column) -> Column:
        at = lambda k: F.concat(F.lit("packages["), i, F.lit(f"].{k}"))
        return F.array(_issue(_missing(p, "SPDXID"), "error", at("SPDXID"), "missing"), _issue(~_string(p, "SPDXID").startswith("SPDXRef-"), "warning", at("SPDXID"), "no SPDXRef- prefix"), _issue(_missing(p, "downloadLocation"), "error", at("downloadLocation"), "missing"), _issue(_missing(p, "filesAnalyzed"), "info", at("filesAnalyzed"), "missing"))

    return _issues(d, [F.array(*top), F.flatten(F.transform(packs, of))])


def validate_cyclonedx(docs: DataFrame) -> DataFrame:
    """(doc_id, severity, field, message) of CycloneDX documents. Entries among the components that are no objects are passed over."""
    d = docs.select("doc_id", F.try_parse_json("json").alias("v"))
    v = F.col("v")
    form, spec, parts, stamp = _string(v, "bomFormat"), _string(v, "specVersion"), _list(v, "components"), _string(v, "metadata.timestamp")
    top = [_issue(~_is_object(v), "error", "document", "not a JSON object")]
    top += [_issue(_missing(v, k), "error", k, "missing") for k in ("bomFormat", "specVersion")]
    top += [_issue(form != "CycloneDX", "error", "bomFormat", "not CycloneDX"), _issue(~spec.isin(CYCLONEDX_VERSIONS), "warning", "specVersion", "unknown version"), _issue(F.size(parts) == 0, "info", "components", "empty")]
    top.append(_issue(stamp.isNotNull() & ~F.coalesce(stamp.rlike(RFC_3339) & F.try_to_timestamp(stamp).isNotNull(), F.lit(False)), "warning", "metadata.timestamp", "not a timestamp"))
    tools = F.transform(_list(v, "metadata.tools"), lambda t: _issue(_missing(t, "name"), "warning", "metadata.tools", "tool without a name"))

    def of(p: Column, i: Column) -> Column:
        at = lambda k: F.concat(F.lit("components["), i, F.lit(f"].{k}"))
        shapes = F.transform(_list(p, "licenses"), lambda x: _issue(_missing(x, "license") & _missing(x, "expression"), "warning", at("licenses"), "neither license nor expression"))
        own = F.array(_issue(_missing(p, "type"), "error", at("type"), "missing"), _issue(~_string(p, "type").isin(PART_TYPES), "warning", at("type"), "unknown type"), _issue(_string(p, "version") == "", "warning", at("version"), "empty"))
        return F.concat(own, F.coalesce(shapes, F.array().cast(ISSUES)))

    return _issues(d, [F.array(*top), tools, F.flatten(F.transform(parts, of))])


def validation_summary(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, errors, warnings, infos, is_valid) of every document, also of those without an issue."""
    count = lambda s: F.count_if(F.col("severity") == s).alias(f"{s}s")
    return docs.select("doc_id").join(issues, "doc_id", "left").groupBy("doc_id").agg(*map(count, ("error", "warning", "info"))).withColumn("is_valid", F.col("errors") == 0)


def validation_report(docs: DataFrame, issues: DataFrame) -> DataFrame:
    """(doc_id, report): the summary and the issues of each document as JSON."""
    listed = issues.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("severity", "field", "message"))).alias("issues"))
    both = validation_summary(docs, issues).join(listed, "doc_id", "left")
    return both.select("doc_id", F.to_json(F.struct("is_valid", "errors", "warnings", "infos", F.coalesce("issues", F.array().cast(ISSUES)).alias("issues"))).alias("report"))
