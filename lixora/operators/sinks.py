"""Reports as documents: JSON, SARIF, JUnit, CI annotations, NOTICE and third-party licence files.

Each gives one row (or one line) per project; a project's document is assembled in one group, ordered explicitly.
It is one string, so a document of 2 GB or more fails; ``findings_json`` and ``to_annotations`` give rows and have no
such bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOOL = "lixora"
#: The wording of reports.
WHO, HAS = "Dependency '", "' has "
RESTRICTIVE, RESTRICTIVE_RULE = "restrictive license: ", "Dependency has a restrictive license"
CLASH, CLASH_RULE = " which is incompatible with project license ", "Dependency license is incompatible with the project license"
WARNING, ERROR, NOTICE = "::warning title=Restrictive License::", "::error title=Incompatible License::", "::notice title=License Check Summary::Found "
MAY_CLASH, RESTRICTIVE_COUNT, CLASH_COUNT = " which may be incompatible with project license ", " dependencies with restrictive licenses", " dependencies with incompatible licenses"
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def _license() -> Column:
    return F.coalesce("license", F.lit("No License"))


def findings_json(df: DataFrame) -> DataFrame:
    """(project_id, json) of each finding: purl and sub_project are left out when null, license never is."""
    has = set(df.columns)
    fields = [c for c in ("name", "version", "is_restrictive", "compatibility", "osi_status", "ecosystem", "purl", "sub_project") if c in has]
    body = F.to_json(F.struct(*fields))
    lic = F.when(F.col("license").isNull(), "null").otherwise(F.to_json(F.array("license")).substr(F.lit(2), F.length(F.to_json(F.array("license"))) - 2))
    return df.select("project_id", F.concat(F.lit('{"license":'), lic, F.lit(","), F.substring(body, 2, 2**30)).alias("json"))


def write_findings_json(df: DataFrame, path: str) -> None:
    """One JSON object a line, files by project left to Spark."""
    findings_json(df).select("json").write.text(path)


def to_sarif(df: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, sarif): a run per project of projects(project_id, project_license), also without results."""
    who = F.concat(F.lit(WHO), "name", F.lit("@"), "version", F.lit(HAS))
    hit = lambda rule, level, text: F.struct(F.lit(rule).alias("ruleId"), F.lit(level).alias("level"), F.struct(text.alias("text")).alias("message"), F.array().cast("array<string>").alias("locations"))
    bad = F.when(F.col("is_restrictive"), hit("restrictive-license", "warning", F.concat(who, F.lit(RESTRICTIVE), _license())))
    clash = F.when(F.col("project_license").isNotNull() & (F.col("compatibility") == "Incompatible"), hit("incompatible-license", "error", F.concat(who, F.lit("license "), _license(), F.lit(CLASH), "project_license")))
    rows = df.select("project_id", "name", "version", F.posexplode(F.array(bad, clash)).alias("kind", "r")).where("r is not null")
    results = rows.groupBy("project_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("name", "version", "kind", "r"))), lambda x: x["r"]).alias("results"))
    rule = lambda i, text, level: F.struct(F.lit(i).alias("id"), F.struct(F.lit(text).alias("text")).alias("shortDescription"), F.struct(F.lit(level).alias("level")).alias("defaultConfiguration"))
    first, second = rule("restrictive-license", RESTRICTIVE_RULE, "warning"), rule("incompatible-license", CLASH_RULE, "error")
    rules = F.when(F.col("project_license").isNull(), F.array(first)).otherwise(F.array(first, second))
    kind = "array<struct<ruleId:string,level:string,message:struct<text:string>,locations:array<string>>>"
    run = F.struct(F.struct(F.struct(F.lit(TOOL).alias("name"), rules.alias("rules")).alias("driver")).alias("tool"), F.coalesce("results", F.array().cast(kind)).alias("results"))
    return projects.join(results, "project_id", "left").select("project_id", F.to_json(F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("sarif"))


def xml_escape(col: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(a), F.lit(b))
    return col


def to_junit(df: DataFrame) -> DataFrame:
    """(project_id, tests, failures, xml): a test per finding, one more where the project licence is known."""
    fail = F.col("is_restrictive") | (F.col("compatibility") == "Incompatible")
    why = F.concat_ws("; ", F.when(F.col("is_restrictive"), F.concat(F.lit("restrictive license "), _license())), F.when(F.col("compatibility") == "Incompatible", F.concat(F.lit("incompatible license "), _license())))
    name = xml_escape(F.concat("name", F.lit("@"), "version"))
    case = F.when(fail, F.concat(F.lit('<testcase name="'), name, F.lit('"><failure message="'), xml_escape(why), F.lit('"/></testcase>'))).otherwise(F.concat(F.lit('<testcase name="'), name, F.lit('"/>')))
    rows = df.select("project_id", "project_license", fail.alias("fail"), F.struct("name", "version", case.alias("case")).alias("c"))
    known = F.col("project_license").isNotNull().cast("int")
    out = rows.groupBy("project_id", "project_license").agg(F.count("*").alias("n"), F.count_if("fail").alias("failures"), F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda x: x["case"]), "").alias("cases"))
    extra = F.when(F.col("project_license").isNotNull(), F.concat(F.lit('<testcase name="project license: '), xml_escape(F.col("project_license")), F.lit('"/>'))).otherwise("")
    xml = F.concat(F.lit('<testsuite name="licenses" tests="'), (F.col("n") + known).cast("string"), F.lit('" failures="'), F.col("failures").cast("string"), F.lit('">'), extra, "cases", F.lit("</testsuite>"))
    return out.select("project_id", (F.col("n") + known).alias("tests"), "failures", xml.alias("xml"))


def to_annotations(df: DataFrame) -> DataFrame:
    """(project_id, line): a line per risk, and a summary line."""
    who = F.concat(F.lit(WHO), "name", F.lit("@"), "version", F.lit(HAS))
    bad = F.when(F.col("is_restrictive"), F.concat(F.lit(WARNING), who, F.lit(RESTRICTIVE), _license()))
    clash = F.when(F.col("project_license").isNotNull() & (F.col("compatibility") == "Incompatible"), F.concat(F.lit(ERROR), who, F.lit("license "), _license(), F.lit(MAY_CLASH), "project_license"))
    lines = df.select("project_id", F.explode(F.array_compact(F.array(bad, clash))).alias("line"))
    n = df.groupBy("project_id", "project_license").agg(F.count("*").alias("total"), F.count_if("is_restrictive").alias("r"), F.count_if(F.col("compatibility") == "Incompatible").alias("i"))
    text = lambda c: F.col(c).cast("string")
    both = F.when(F.col("project_license").isNotNull(), F.concat(F.lit(" and "), text("i"), F.lit(CLASH_COUNT))).otherwise("")
    summary = n.select("project_id", F.concat(F.lit(NOTICE), text("r"), F.lit(RESTRICTIVE_COUNT), both, F.lit(" out of "), text("total"), F.lit(" total")).alias("line"))
    return lines.unionByName(summary)


def to_notice(df: DataFrame) -> DataFrame:
    """(project_id, notice): components grouped by licence, sorted by name."""
    item = F.concat(F.lit("* "), "name", F.lit(" ("), "version", F.lit(")\n"))
    per = df.groupBy("project_id", _license().alias("lic")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("name", "version", item.alias("item")))), lambda x: x["item"]), "").alias("items"), F.count("*").alias("n"))
    part = F.concat(F.lit("## "), "lic", F.lit(" Licensed Components\n\n"), "items", F.lit("\n"))
    out = per.groupBy("project_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("lic", part.alias("part")))), lambda x: x["part"]), "").alias("parts"), F.sum("n").alias("n"))
    head = "NOTICE\n======\n\nThis project includes third-party software under the licenses below.\n\n"
    return out.select("project_id", F.concat(F.lit(head), "parts", F.lit("---\n\nThis NOTICE file contains "), F.col("n").cast("string"), F.lit(" third-party dependencies.\n")).alias("notice"))


def to_third_party(df: DataFrame, texts: DataFrame) -> DataFrame:
    """(project_id, sections, with_text, percent, document): numbered sections with licence text or a stand-in."""
    from lixora.operators.resolve import join_texts

    numbered = join_texts(df, texts).withColumn("number", F.row_number().over(Window.partitionBy("project_id").orderBy("name", "version", "ecosystem")))
    body = F.coalesce("text", F.concat(F.lit("No license text is available. Stated license: "), _license()))
    section = F.concat(F.col("number").cast("string"), F.lit(". "), "name", F.lit(" "), "version", F.lit("\nLicense: "), _license(), F.lit("\n\n"), body, F.lit("\n\n"))
    out = numbered.groupBy("project_id").agg(F.count("*").alias("sections"), F.count("text").alias("with_text"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("number", section.alias("s")))), lambda x: x["s"]), "").alias("document"))
    return out.withColumn("percent", F.round(100 * F.col("with_text") / F.col("sections"), 1))
