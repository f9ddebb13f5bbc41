"""The scalar functions, table function and verdict aggregates for use in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lixora.functions import ids, licenses
from lixora.functions.expressions import parse, postfix
from lixora.functions.licenses import COMPOUND

#: Name -> (parameters, Column function of them).
FUNCTIONS = {
    "normalize_license_id": (["license"], licenses.normalize_license_id),
    "detect_license": (["content"], licenses.detect_license),
    "is_unresolved": (["license"], licenses.is_unresolved),
    "purl": (["ecosystem", "name", "version"], ids.purl),
    "coordinates": (["ecosystem", "name"], ids.coordinates),
    "cd_coordinate": (["ecosystem", "name", "version"], ids.cd_coordinate),
}


def with_function(df: DataFrame, name: str, out: str, *columns: str) -> DataFrame:
    """df with one of FUNCTIONS applied to columns."""
    params, fn = FUNCTIONS[name]
    if len(columns) != len(params):
        raise ValueError(f"{name} takes {params}")
    return df.withColumn(out, fn(*map(F.col, columns)))


@F.udtf(returnType="leaf string")
class ExprLeaves:
    """expr_leaves('MIT OR X') -> a row per distinct id, in order; a text that is no compound is one."""

    def eval(self, license: str):
        compound = license and any(x in license for x in COMPOUND)
        for leaf in dict.fromkeys(postfix(license) if compound else [license] if license else []):
            if leaf not in ("AND", "OR"):
                yield (leaf,)


def register(spark: SparkSession) -> None:
    """parse_expr and expr_leaves for SQL text; licence predicates as SQL functions that Catalyst inlines.

    parse_expr is a pandas UDF that parses value by value: call it on distinct licences, as ``parse_expr(df)`` does.
    """
    spark.udf.register("parse_expr", parse)
    spark.udtf.register("expr_leaves", ExprLeaves)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_unresolved(license STRING) RETURNS BOOLEAN RETURN license IS NULL OR lower(trim(license)) IN ('', 'unknown', 'no license') OR startswith(lower(trim(license)), 'unknown (')")
    arms = []
    for names, groups, never, result in licenses.ALIASES:
        hit = f"u IN ({', '.join(map(repr, names))})" if names else "(" + " OR ".join("(" + " AND ".join(f"contains(u, '{p}')" for p in g) + ")" for g in groups) + ")"
        arms.append(f"WHEN {hit}" + "".join(f" AND NOT contains(u, '{p}')" for p in never) + f" THEN '{result}'")
    body = " ".join(arms).replace("contains(u,", "contains(upper(trim(license)),").replace("u IN", "upper(trim(license)) IN")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION normalize_license_id(license STRING) RETURNS STRING RETURN CASE {body} ELSE license END")
    texts = []
    for result, groups in licenses.TEXT_RULES:
        texts.append("WHEN " + " OR ".join("(" + " AND ".join(f"contains(content, '{p}')" for p in g) + ")" for g in groups) + f" THEN '{result}'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION detect_license(content STRING) RETURNS STRING RETURN CASE {' '.join(texts)} END")


def _code(verdict: Column) -> Column:
    return F.when(verdict == "Compatible", 2).when(verdict == "Incompatible", 0).otherwise(1)


def _text(code: Column) -> Column:
    return F.when(code == 2, "Compatible").when(code == 0, "Incompatible").otherwise("Unknown")


def all_of(verdict: Column) -> Column:
    """Worst verdict of a group (AND)."""
    return _text(F.min(_code(verdict)))


def any_of(verdict: Column) -> Column:
    """Best verdict of a group (OR)."""
    return _text(F.max(_code(verdict)))
