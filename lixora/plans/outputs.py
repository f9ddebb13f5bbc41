"""Queries of reports, streams and SQL functions."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from lixora.functions import register as R
from lixora.operators import sinks
from lixora.operators.shared import shared_path
from lixora.plans.judging import DNF_ROWS, JUDGED, PACKS, judged, norm_sql, pool
from lixora.plans.registry import query
from lixora.sources.fixtures import duck, fixture
from lixora.streaming import changes
from lixora.streaming.inventory import inventory, merge_changes

LIC = "coalesce(license, 'No License')"


@query("snk_01_json", JUDGED + "SELECT project_id, name, version, license, is_restrictive, compatibility FROM judged")
def snk_01(spark, sf_dir):
    rows = sinks.findings_json(judged(spark, sf_dir))
    back = F.from_json("json", "name string, version string, license string, is_restrictive boolean, compatibility string")
    return rows.select("project_id", back.alias("x")).select("project_id", "x.*")


WHO = "'Dependency ''' || name || '@' || version || ''' has '"
HITS = f"""hits AS (SELECT project_id, name, version, 0 AS kind, 'restrictive-license' AS rule, 'warning' AS level, {WHO} || 'restrictive license: ' || {LIC} AS message FROM judged WHERE is_restrictive
  UNION ALL SELECT project_id, name, version, 1, 'incompatible-license', 'error', {WHO} || 'license ' || {LIC} || ' which is incompatible with project license ' || project_license FROM judged WHERE compatibility = 'Incompatible' AND project_license IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY name, version, kind) - 1 AS n FROM hits)"""


@query("snk_02_sarif", JUDGED + f", {HITS} SELECT p.project_id, '2.1.0' AS format, 'restrictive-license: warning, Dependency has a restrictive license' || CASE WHEN p.project_license IS NULL THEN '' ELSE '; incompatible-license: error, Dependency license is incompatible with the project license' END AS rules, n, rule, level, message FROM fx_projects p LEFT JOIN placed USING (project_id)")
def snk_02(spark, sf_dir):
    """The documents, taken apart again: a row for every result in its place, one for a project without any."""
    s = sinks.to_sarif(judged(spark, sf_dir), fixture(spark, sf_dir, "fx_projects"))
    read = lambda p, kind: F.from_json(F.get_json_object("sarif", p), kind)
    rules = read("$.runs[0].tool.driver.rules", "array<struct<id:string,shortDescription:struct<text:string>,defaultConfiguration:struct<level:string>>>")
    rules = F.array_join(F.transform(rules, lambda r: F.concat(r["id"], F.lit(": "), r["defaultConfiguration"]["level"], F.lit(", "), r["shortDescription"]["text"])), "; ")
    results = read("$.runs[0].results", "array<struct<ruleId:string,level:string,message:struct<text:string>>>")
    rows = s.select("project_id", F.get_json_object("sarif", "$.version").alias("format"), rules.alias("rules"), F.posexplode_outer(results).alias("n", "r"))
    return rows.select("project_id", "format", "rules", F.col("n").cast("long").alias("n"), F.col("r.ruleId").alias("rule"), F.col("r.level").alias("level"), F.col("r.message.text").alias("message"))


CASES = f"""cases AS (SELECT project_id, project_license, name, version, is_restrictive OR compatibility = 'Incompatible' AS fail, '<testcase name="' || name || '@' || version || '"' || CASE WHEN is_restrictive OR compatibility = 'Incompatible'
  THEN '><failure message="' || concat_ws('; ', CASE WHEN is_restrictive THEN 'restrictive license ' || {LIC} END, CASE WHEN compatibility = 'Incompatible' THEN 'incompatible license ' || {LIC} END) || '"/></testcase>' ELSE '/>' END AS x FROM judged)"""


@query("snk_03_junit", JUDGED + f""", {CASES}, n AS (SELECT project_id, project_license, count(*) + CASE WHEN project_license IS NULL THEN 0 ELSE 1 END AS tests, count(*) FILTER (fail) AS failures, string_agg(x, '' ORDER BY name, version) AS body FROM cases GROUP BY 1, 2)
  SELECT project_id, tests, failures, '<testsuite name="licenses" tests="' || tests || '" failures="' || failures || '">' || coalesce('<testcase name="project license: ' || project_license || '"/>', '') || body || '</testsuite>' AS xml FROM n""")
def snk_03(spark, sf_dir):
    return sinks.to_junit(judged(spark, sf_dir))


@query("snk_04_annotations", JUDGED + f"""SELECT project_id, '::warning title=Restrictive License::Dependency ''' || name || '@' || version || ''' has restrictive license: ' || {LIC} AS line FROM judged WHERE is_restrictive
  UNION ALL SELECT project_id, '::error title=Incompatible License::Dependency ''' || name || '@' || version || ''' has license ' || {LIC} || ' which may be incompatible with project license ' || project_license FROM judged WHERE compatibility = 'Incompatible' AND project_license IS NOT NULL
  UNION ALL SELECT project_id, '::notice title=License Check Summary::Found ' || count(*) FILTER (is_restrictive) || ' dependencies with restrictive licenses' || CASE WHEN project_license IS NULL THEN '' ELSE ' and ' || count(*) FILTER (compatibility = 'Incompatible') || ' dependencies with incompatible licenses' END || ' out of ' || count(*) || ' total' FROM judged GROUP BY project_id, project_license""")
def snk_04(spark, sf_dir):
    return sinks.to_annotations(judged(spark, sf_dir))


@query("snk_08_notice", JUDGED + f", g AS (SELECT project_id, {LIC} AS lic, string_agg('* ' || name || ' (' || version || ')' || chr(10), '' ORDER BY name, version) AS items, count(*) AS n FROM judged GROUP BY 1, 2) SELECT project_id, 'NOTICE' || chr(10) || '======' || chr(10) || chr(10) || 'This project includes third-party software under the licenses below.' || chr(10) || chr(10) || string_agg('## ' || lic || ' Licensed Components' || chr(10) || chr(10) || items || chr(10), '' ORDER BY lic) || '---' || chr(10) || chr(10) || 'This NOTICE file contains ' || sum(n)::BIGINT || ' third-party dependencies.' || chr(10) AS notice FROM g GROUP BY 1")
def snk_08(spark, sf_dir):
    return sinks.to_notice(judged(spark, sf_dir))


@query("snk_09_third_party", JUDGED + f""", t AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY name, version, ecosystem) AS n FROM judged)
  SELECT project_id, count(*) AS sections, count(*) FILTER (pkg_id % 3 = 0) AS with_text, round(100.0 * count(*) FILTER (pkg_id % 3 = 0) / count(*), 1)::DOUBLE AS percent,
  string_agg(n || '. ' || name || ' ' || version || chr(10) || 'License: ' || {LIC} || chr(10) || chr(10) || CASE WHEN pkg_id % 3 = 0 THEN 'text of ' || name ELSE 'No license text is available. Stated license: ' || {LIC} END || chr(10) || chr(10), '' ORDER BY n) AS document FROM t GROUP BY 1""")
def snk_09(spark, sf_dir):
    texts = pool(spark, sf_dir).where("pkg_id % 3 = 0").select("ecosystem", "name", "version", F.concat(F.lit("text of "), "name").alias("text"))
    return sinks.to_third_party(judged(spark, sf_dir), texts)


@query("win_05_numbering", JUDGED + "SELECT project_id, string_agg(n || '. ' || name, '|' ORDER BY n) AS titles FROM (SELECT project_id, name, row_number() OVER (PARTITION BY project_id ORDER BY name, version, ecosystem) AS n FROM judged) x GROUP BY 1")
def win_05(spark, sf_dir):
    none = pool(spark, sf_dir).limit(0).select("ecosystem", "name", "version", F.lit("").alias("text"))
    doc = sinks.to_third_party(judged(spark, sf_dir), none)
    titles = F.transform(F.regexp_extract_all("document", F.lit(r"(?m)^(\d+\. \S+) \S+$"), F.lit(1)), lambda x: x)
    return doc.select("project_id", F.array_join(titles, "|").alias("titles"))


CH = duck("fx_changes")
RELEVANT = "path IN ('package.json', 'Cargo.lock')"


@query("str_01_relevant_changes", f"{CH} SELECT event_id, root_id, path FROM fx_changes WHERE {RELEVANT}")
def str_01(spark, sf_dir):
    return changes.relevant_changes(fixture(spark, sf_dir, "fx_changes")).select("event_id", "root_id", "path")


@query("str_02_debounce", f"""{CH.replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT root_id, ts, event_id, row_number() OVER (PARTITION BY root_id ORDER BY ts, event_id) AS n FROM fx_changes WHERE {RELEVANT}),
  w(root_id, n, till, event_id, opens) AS (SELECT root_id, n, ts + INTERVAL 3600 SECOND, event_id, true FROM e WHERE n = 1 UNION ALL SELECT e.root_id, e.n, CASE WHEN e.ts >= w.till THEN e.ts + INTERVAL 3600 SECOND ELSE w.till END, e.event_id, e.ts >= w.till FROM w JOIN e ON e.root_id = w.root_id AND e.n = w.n + 1)
  SELECT root_id, event_id FROM w WHERE opens""")
def str_02(spark, sf_dir):
    return changes.debounce(changes.relevant_changes(fixture(spark, sf_dir, "fx_changes")), ms=3_600_000).select("root_id", "event_id")


@query("str_05_windowed_counts", f"{CH} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, path AS kind, count(*) AS n FROM fx_changes GROUP BY 1, 2")
def str_05(spark, sf_dir):
    c = fixture(spark, sf_dir, "fx_changes").withColumnRenamed("path", "kind")
    return changes.windowed_counts(c, "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n")


def sbom_copies(spark, sf_dir):
    """Ten documents, each under many ids."""
    json = F.concat(F.lit('{"spdxVersion":"SPDX-2.3","packages":[{"name":"lib'), F.col("pkg_id") % 10, F.lit('"}]}'))
    return pool(spark, sf_dir).select(F.col("pkg_id").alias("doc_id"), json.alias("json"), F.timestamp_seconds("pkg_id").alias("ts"))


@query("str_06_sbom_ingest", PACKS + " SELECT pkg_id % 10 AS k, 0 AS pos, 'lib' || (pkg_id % 10) AS name FROM fx_packages GROUP BY 1, 3")
def str_06(spark, sf_dir):
    return changes.ingest_sbom_stream(sbom_copies(spark, sf_dir)).select((F.col("doc_id") % 10).alias("k"), "pos", "name")


def in_files(spark, name: str, *parts):
    """The parts as files of one folder that a stream reads in this order, one a batch."""
    at = shared_path(spark, name)
    for i, part in enumerate(parts):
        part.coalesce(1).write.mode("append").parquet(f"{at}/{i}")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(at)


#: On time: all but every tenth change; late: every tenth that is older than a day when the others have been seen.
LATE = "event_id % 10 = 0 AND ts < (SELECT max(ts) FROM fx_changes) - INTERVAL 1 DAY"


@query("str_04_late_data", f"{CH} SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M') AS start, path AS kind, count(*) AS n FROM fx_changes WHERE NOT ({LATE}) GROUP BY 1, 2")
def str_04(spark, sf_dir):
    """As a stream: changes that come when the watermark has passed their windows don't count."""
    c = fixture(spark, sf_dir, "fx_changes").select(F.col("ts").cast("timestamp").alias("ts"), F.col("path").alias("kind"), "event_id")
    last = c.agg(F.max("ts")).first()[0]
    late = (F.col("event_id") % 10 == 0) & (F.col("ts") < F.lit(last) - F.expr("interval 1 day"))
    # a batch's watermark drops rows from the batch after the next one on
    between = spark.createDataFrame([(last, "end", -1)], c.schema)
    end = between.withColumn("ts", F.col("ts") + F.expr("interval 30 days"))
    counts = changes.windowed_counts(in_files(spark, "changes", c.where(~late), between, c.where(late), end), "1 hour", watermark="10 minutes")
    done = changes.drained(counts, "counts")
    return done.where("kind <> 'end'").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "kind", "n")


@query("str_06_sbom_stream", PACKS + " SELECT DISTINCT 'lib' || (pkg_id % 10) AS name, 0 AS pos FROM fx_packages")
def str_06b(spark, sf_dir):
    """As a stream in two batches: a document that comes again within the watermark is ingested once."""
    docs = sbom_copies(spark, sf_dir).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    return changes.drained(changes.ingest_sbom_stream(in_files(spark, "sboms", docs.where("doc_id % 2 = 0"), docs)), "components").select("name", "pos")


@query("udf_01_sql_functions", PACKS + f" SELECT pkg_id, {norm_sql('license')} AS id, (license IS NULL OR lower(trim(license)) IN ('', 'unknown', 'no license')) AS unresolved FROM fx_packages")
def udf_01(spark, sf_dir):
    R.register(spark)
    return pool(spark, sf_dir).selectExpr("pkg_id", "normalize_license_id(license) AS id", "is_unresolved(license) AS unresolved")


@query("udf_02_parse", PACKS + " SELECT DISTINCT license, CASE WHEN contains(license, ' OR Apache') THEN 3 WHEN starts_with(license, '(MIT') THEN 5 WHEN contains(license, ' AND GPL') THEN 3 ELSE 1 END AS words FROM fx_packages WHERE license IS NOT NULL")
def udf_02(spark, sf_dir):
    R.register(spark)
    return pool(spark, sf_dir).where("license is not null").select("license").distinct().selectExpr("license", "size(parse_expr(license)) AS words")


@query("udtf_01_leaves", PACKS + f", dnf(license, clause, leaf) AS (VALUES {DNF_ROWS}) SELECT DISTINCT license, leaf FROM dnf WHERE license IN (SELECT license FROM fx_packages) AND license NOT LIKE 'The Apache%' AND license NOT LIKE 'No %' UNION ALL SELECT DISTINCT license, license FROM fx_packages WHERE license LIKE 'The Apache%' OR license LIKE 'No %'")
def udtf_01(spark, sf_dir):
    """The leaves of every licence; what is no expression is one leaf."""
    R.register(spark)
    p = pool(spark, sf_dir).where("license is not null").select("license").distinct()
    return spark.sql("SELECT license, leaf FROM {p}, LATERAL expr_leaves(license)", p=p)


@query("udaf_01_verdicts", JUDGED + "SELECT project_id, CASE WHEN bool_or(compatibility = 'Incompatible') THEN 'Incompatible' WHEN bool_or(compatibility = 'Unknown') THEN 'Unknown' ELSE 'Compatible' END AS worst, CASE WHEN bool_or(compatibility = 'Compatible') THEN 'Compatible' WHEN bool_or(compatibility = 'Unknown') THEN 'Unknown' ELSE 'Incompatible' END AS best FROM judged GROUP BY 1")
def udaf_01(spark, sf_dir):
    v = F.col("compatibility")
    return judged(spark, sf_dir).groupBy("project_id").agg(R.all_of(v).alias("worst"), R.any_of(v).alias("best"))


#: What is known of each root before a change, and after it: every seventh root changes, a third of its packages goes.
BEFORE = "SELECT pkg_id % 50 AS root, pkg_id, name, version, license FROM fx_packages"
AFTER = "SELECT root, pkg_id, name, CASE WHEN root % 7 = 0 THEN version || '.1' ELSE version END AS version, license FROM b WHERE root % 7 <> 0 OR pkg_id % 3 <> 0"


@query("set_04_incremental", f"{PACKS}, b AS ({BEFORE}) {AFTER}")
def set_04_incremental(spark, sf_dir):
    """A kept inventory after the scan of all roots and a scan of the changed ones alone."""
    before = pool(spark, sf_dir).select((F.col("pkg_id") % 50).alias("root"), "pkg_id", "name", "version", "license")
    path = shared_path(spark, "inventory")
    merge_changes(path, 0, before.select("root"), before)
    changed = before.where("root % 7 = 0")
    merge_changes(path, 1, changed.select("root"), changed.where("pkg_id % 3 <> 0").withColumn("version", F.concat("version", F.lit(".1"))))
    return inventory(spark, path)


WINDOWS = f"""{duck('fx_changes', 'fx_packages').replace('WITH ', 'WITH RECURSIVE ', 1)}, e AS (SELECT root_id, ts, event_id, row_number() OVER (PARTITION BY root_id ORDER BY ts, event_id) AS n FROM fx_changes WHERE {RELEVANT}),
  w(root_id, n, till, event_id, opens) AS (SELECT root_id, n, ts + INTERVAL 3600 SECOND, event_id, true FROM e WHERE n = 1 UNION ALL SELECT e.root_id, e.n, CASE WHEN e.ts >= w.till THEN e.ts + INTERVAL 3600 SECOND ELSE w.till END, e.event_id, e.ts >= w.till FROM w JOIN e ON e.root_id = w.root_id AND e.n = w.n + 1)"""


@query("str_03_rescans", f"{WINDOWS} SELECT w.root_id, event_id, pkg_id, license FROM w JOIN fx_packages p ON p.pkg_id % 50 = w.root_id WHERE opens")
def str_03(spark, sf_dir):
    """A stream of changes, debounced with timers; each trigger scans its root. The second batch breaks off while its rows
    are written, and the stream is started again: each trigger is there once."""
    c = changes.relevant_changes(fixture(spark, sf_dir, "fx_changes").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "root_id", "path"))
    first, last = c.agg(F.min("ts"), F.max("ts")).first()
    third = (last - first) / 3
    parts = [c.where(F.col("ts") < F.lit(first + third)), c.where((F.col("ts") >= F.lit(first + third)) & (F.col("ts") < F.lit(first + 2 * third))), c.where(F.col("ts") >= F.lit(first + 2 * third))]
    triggers = changes.debounce(in_files(spark, "triggers", *parts), ms=3_600_000)
    known = pool(spark, sf_dir).select((F.col("pkg_id") % 50).cast("long").alias("root_id"), "pkg_id", "license")
    path, scans = shared_path(spark, "rescans"), []

    def scan(batch):
        scans.append(1)
        rows = batch.join(known, "root_id").select("root_id", "event_id", "pkg_id", "license")
        return rows.where(F.when(F.col("pkg_id") % 50 == 7, F.raise_error(F.lit("broken off")).cast("boolean")).otherwise(True)) if len(scans) == 2 else rows

    def run():
        sink = changes.scan_into(f"{path}/kept", scan)
        triggers.writeStream.foreachBatch(sink).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()

    try:
        run()
    except StreamingQueryException:
        run()
    return changes.scanned(spark, f"{path}/kept").select("root_id", "event_id", "pkg_id", "license")
