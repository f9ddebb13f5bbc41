"""Filters and summaries of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.functions.ids import purl, semver_key
from lixora.functions.licenses import any_in, is_unresolved
from lixora.operators.rank import ranked
from lixora.operators.shared import small


def as_findings(df: DataFrame, source: str) -> DataFrame:
    """The finding row every source makes: missing columns are filled, the package URL is derived."""
    has = df.columns
    defaults = {"project_id": F.lit(None).cast("string"), "version": F.lit(""), "license": F.lit(None).cast("string"), "ecosystem": F.lit("generic"), "sub_project": F.lit(None).cast("string"), "is_restrictive": F.lit(False), "compatibility": F.lit("Unknown"), "osi_status": F.lit("Unknown")}
    df = df.withColumns({k: v for k, v in defaults.items() if k not in has})
    return df.select("project_id", "name", "version", "license", "ecosystem", purl(F.col("ecosystem"), F.col("name"), F.col("version")).alias("purl"), "sub_project", F.lit(source).alias("source"), "is_restrictive", "compatibility", "osi_status")


def drop_ignored_licenses(df: DataFrame, ignore: list[str]) -> DataFrame:
    """Rows whose licence holds an ignored substring go; null stays."""
    return df.where(F.col("license").isNull() | ~any_in(F.col("license"), ignore))


def drop_ignored_deps(df: DataFrame, ignored: DataFrame) -> DataFrame:
    """Rows named in ignored(name, version) go; an empty version there means any."""
    i = ignored.select(F.col("name").alias("_name"), F.coalesce("version", F.lit("")).alias("_version")).distinct()
    return df.join(small(i), (F.col("name") == F.col("_name")) & ((F.col("_version") == "") | (F.col("_version") == F.col("version"))), "left_anti")


def risk_filter(df: DataFrame, restrictive: bool = False, incompatible: bool = False) -> DataFrame:
    """Rows that any of the asked risks holds for; all rows if none is asked."""
    if not (restrictive or incompatible):
        return df
    return df.where((F.col("is_restrictive") & F.lit(restrictive)) | ((F.col("compatibility") == "Incompatible") & F.lit(incompatible)))


def osi_filter(df: DataFrame, status: str) -> DataFrame:
    """status: approved, not-approved or unknown."""
    return df.where(F.lower(F.regexp_replace("osi_status", "(?<=[a-z])(?=[A-Z])", "-")) == status)


def facet_filter(df: DataFrame, facets: dict[str, list]) -> DataFrame:
    """OR inside a facet (column -> values), AND across facets; an empty facet doesn't filter."""
    for column, values in facets.items():
        if values:
            df = df.where(F.col(column).isin(values))
    return df


def verbose_view(df: DataFrame, project_known: bool, sub_projects: bool) -> DataFrame:
    """Report columns; compatibility and sub_project only where they say something."""
    columns = ["name", "version", F.coalesce("license", F.lit("No License")).alias("license"), "is_restrictive", "osi_status"]
    return df.select(*columns, *["compatibility"] * project_known, *["sub_project"] * sub_projects)


def license_summary(df: DataFrame) -> DataFrame:
    """Rows per licence that aren't restrictive."""
    return df.where(~F.col("is_restrictive")).groupBy(F.coalesce("license", F.lit("No License")).alias("license")).agg(F.count("*").alias("n")).orderBy("license")


def bucket() -> Column:
    return F.when(F.col("is_restrictive"), "restrictive").when(is_unresolved(F.col("license")), "unresolved").otherwise("permissive")


def tally(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """permissive, restrictive and unresolved rows (per keys); their sum is total."""
    b = bucket()
    counts = [F.count_if(b == x).alias(x) for x in ("permissive", "restrictive", "unresolved")]
    return df.groupBy(*(keys or [])).agg(*counts, F.count("*").alias("total"))


def compat_counts(df: DataFrame) -> DataFrame:
    """Compatible, incompatible and unknown rows, none of which count without a project licence."""
    known = F.col("project_license").isNotNull()
    return df.agg(*[F.count_if(known & (F.col("compatibility") == x)).alias(x.lower()) for x in ("Compatible", "Incompatible", "Unknown")])


def gate(df: DataFrame, on_restrictive: bool = True, on_incompatible: bool = True) -> DataFrame:
    """Per project: whether it has a restrictive or an incompatible row, and whether it passes."""
    seen = df.groupBy("project_id").agg(F.bool_or("is_restrictive").alias("has_restrictive"), F.bool_or(F.col("compatibility") == "Incompatible").alias("has_incompatible"))
    return seen.withColumn("passed", ~((F.col("has_restrictive") & F.lit(on_restrictive)) | (F.col("has_incompatible") & F.lit(on_incompatible))))


def gist(df: DataFrame) -> DataFrame:
    """Totals and a verdict over whatever rows are given."""
    bad = F.count_if(F.col("is_restrictive")), F.count_if(F.col("compatibility") == "Incompatible")
    out = df.agg(F.count("*").alias("total"), bad[0].alias("restrictive"), bad[1].alias("incompatible"))
    return out.withColumn("verdict", F.when((F.col("restrictive") > 0) | (F.col("incompatible") > 0), "NEEDS ATTENTION").otherwise("ALL GOOD"))


def workspace_breakdown(df: DataFrame) -> DataFrame:
    """Rows per member of comma-separated sub_project labels."""
    members = df.select(F.explode(F.split("sub_project", ",")).alias("m")).select(F.trim("m").alias("member")).where("member <> ''")
    return members.groupBy("member").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "member")


def rollup_report(df: DataFrame) -> DataFrame:
    """Counts over the cube of ecosystem, bucket and compatibility."""
    return df.withColumn("bucket", bucket()).cube("ecosystem", "bucket", "compatibility").agg(F.grouping_id().alias("level"), F.count("*").alias("n"))


SORTABLE = ["name", "version", "license", "is_restrictive", "compatibility", "osi_status"]


def sort_order(column: str, ascending: bool = True) -> list[Column]:
    """The order of a table sorted by one of six columns, versions semantically; name and version break ties."""
    if column not in SORTABLE:
        raise ValueError(f"{column} is none of {SORTABLE}")
    key = semver_key(F.col("version")) if column == "version" else F.col(column)
    return [key.asc() if ascending else key.desc(), F.col("name"), F.col("version")]


def sort_findings(df: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Rows in ``sort_order``."""
    return df.orderBy(*sort_order(column, ascending))


def place_findings(df: DataFrame, column: str, ascending: bool = True, ties: tuple[str, ...] = ()) -> DataFrame:
    """df with each row's place in ``sort_order``, further columns breaking ties."""
    return ranked(df, *sort_order(column, ascending), *ties)


def inventory(*sources: DataFrame) -> DataFrame:
    """All sources as one table; columns that one lacks are null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def diff_findings(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys with change: added, removed or changed (license differs, null-safe)."""
    a, b = old.select(*keys, F.col("license").alias("old_license"), F.lit(True).alias("_old")), new.select(*keys, F.col("license").alias("new_license"), F.lit(True).alias("_new"))
    change = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~F.col("old_license").eqNullSafe(F.col("new_license")), "changed")
    return a.join(b, keys, "full_outer").withColumn("change", change).where("change is not null").drop("_old", "_new")
