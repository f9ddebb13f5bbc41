"""Judging licences: restrictive or not, OSI status, compatible with the project's licence or not.

Verdicts are found once per distinct licence string and written out: whether it is restrictive, its OSI status, and
the set of project licences of the matrix that allow it (OR unites such sets, AND intersects them). That small table
is counted and broadcast to the findings, which are read once and not shuffled; the licence column of a fleet is
large and skewed, its distinct values are few. Give the table of packages as ``licenses``, so that the distinct
values aren't looked for in the findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lixora.functions.expressions import expr_leaves, fold_expr, parse_expr
from lixora.functions.licenses import any_in, normalize_license_id
from lixora.operators.config import OSI, ComplianceConfig
from lixora.operators.shared import cut, small

COMPATIBILITY = {True: "Compatible", False: "Incompatible", None: "Unknown"}


def as_compatibility(col: Column) -> Column:
    return F.when(col, "Compatible").when(~col, "Incompatible").otherwise("Unknown")


def as_osi(col: Column) -> Column:
    return F.when(col, "Approved").when(~col, "NotApproved").otherwise("Unknown")


def base_id(col: Column) -> Column:
    """An id without trailing +, -only and -or-later."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col, r"\++$", ""), "(?:-only)+$", ""), "(?:-or-later)+$", "")


def join_registry(leaves: DataFrame, registry: DataFrame) -> DataFrame:
    """conditions of each leaf's registry entry: under its own id, else under its base id."""
    exact = registry.select(F.col("spdx_id").alias("leaf"), F.col("conditions").alias("exact"))
    base = registry.select(F.col("spdx_id").alias("base"), F.col("conditions").alias("of_base"))
    found = leaves.withColumn("base", base_id(F.col("leaf"))).join(exact, "leaf", "left").join(base, "base", "left")
    return found.withColumn("conditions", F.coalesce("exact", "of_base")).drop("base", "exact", "of_base")


def leaf_restrictive(leaves: DataFrame, cfg: ComplianceConfig, strict: bool = False) -> DataFrame:
    """leaves with restrictive: a custom rule's word, else the registry's, else the list of substrings."""
    leaf = F.col("leaf")
    bad = ["disclose-source", "network-use-disclosure"] + ["same-license"] * strict
    declared = F.coalesce(*[F.when(leaf == i, F.lit(r)) for i, _, r in cfg.custom if r is not None], F.lit(None).cast("boolean"))
    listed = any_in(leaf, cfg.restrictive)
    if strict:
        listed = listed | F.contains(leaf, F.lit("Unknown"))
    by_registry = F.when(F.col("conditions").isNotNull(), F.arrays_overlap("conditions", F.array(*map(F.lit, bad))))
    return join_registry(leaves, cfg.registry).withColumn("restrictive", F.coalesce(declared, by_registry, listed)).drop("conditions")


def osi_status(leaves: DataFrame, osi: DataFrame) -> DataFrame:
    """leaves with approved: true, false ("No License") or null."""
    norm = osi.select(F.col("spdx_id").alias("norm"), F.lit(True).alias("by_norm")).distinct()
    raw = osi.select(F.col("spdx_id").alias("leaf"), F.lit(True).alias("by_raw")).distinct()
    found = leaves.withColumn("norm", normalize_license_id(F.col("leaf"))).join(norm, "norm", "left").join(raw, "leaf", "left")
    static = F.when(F.col("norm").isin(OSI), True).when(F.col("norm") == "No License", False)
    return found.withColumn("approved", F.coalesce("by_norm", "by_raw", static)).drop("norm", "by_norm", "by_raw")


def license_verdicts(licenses: DataFrame, cfg: ComplianceConfig, strict: bool = False) -> DataFrame:
    """(license, free, approved, allowed) of each distinct licence; allowed: project licences of the matrix."""
    parsed = cut(parse_expr(licenses))
    leaves = osi_status(leaf_restrictive(expr_leaves(parsed).select("leaf").distinct(), cfg, strict), cfg.osi)
    allowing = cfg.matrix.groupBy(F.col("dep_license").alias("dep")).agg(F.collect_set("project_license").alias("allowed"))
    leaves = leaves.withColumn("dep", normalize_license_id(F.col("leaf"))).join(allowing, "dep", "left")
    # OR is restrictive only if all branches are, AND if any is: fold the opposite
    verdicts = leaves.select("leaf", (~F.col("restrictive")).alias("free"), "approved", F.coalesce("allowed", F.array().cast("array<string>")).alias("allowed"))
    return cut(fold_expr(parsed, verdicts, ["free", "approved", "allowed"]))


#: Names of helper columns; an input that has them is refused by Spark as ambiguous, all other names may occur.
VERDICT, PROJECT, KNOWN = "_lixora_verdict", "_lixora_project", "_lixora_known"


def _with_verdicts(df: DataFrame, cfg: ComplianceConfig, strict: bool, licenses: DataFrame | None) -> DataFrame:
    verdicts = license_verdicts(df if licenses is None else licenses, cfg, strict)
    table = small(verdicts.select("license", F.struct("free", "approved", "allowed").alias(VERDICT)))
    return df.join(table, "license", "left")


def _classified(df: DataFrame, strict: bool) -> DataFrame:
    free = F.when(F.col("license") == "No License", False).otherwise(F.coalesce(f"{VERDICT}.free", F.lit(not strict)))
    return df.withColumns({"is_restrictive": ~free, "osi_status": as_osi(F.col(f"{VERDICT}.approved"))})


def _annotated(df: DataFrame, cfg: ComplianceConfig, strict: bool) -> DataFrame:
    known = small(cut(cfg.matrix.select(F.col("project_license").alias(PROJECT)).distinct()).withColumn(KNOWN, F.lit(True)))
    found = df.withColumn(PROJECT, normalize_license_id(F.col("project_license"))).join(known, PROJECT, "left")
    stated = F.col("project_license").isNotNull() & F.col("license").isNotNull()
    # an unknown project under strict leaves its leaves incompatible; a null licence too
    unknown = F.when(F.col("project_license").isNotNull() & F.lit(strict), F.lit(False))
    compatible = F.when(stated & F.col(KNOWN), F.array_contains(f"{VERDICT}.allowed", F.col(PROJECT))).otherwise(unknown)
    return found.withColumn("compatibility", as_compatibility(compatible)).drop(PROJECT, KNOWN)


def classify(df: DataFrame, cfg: ComplianceConfig, strict: bool = False, licenses: DataFrame | None = None) -> DataFrame:
    """df with is_restrictive and osi_status."""
    return _classified(_with_verdicts(df, cfg, strict, licenses), strict).drop(VERDICT)


def annotate(df: DataFrame, cfg: ComplianceConfig, strict: bool = False, licenses: DataFrame | None = None) -> DataFrame:
    """df (license, project_license) with compatibility. No project licence: Unknown, always."""
    return _annotated(_with_verdicts(df, cfg, strict, licenses), cfg, strict).drop(VERDICT)


def judge(df: DataFrame, cfg: ComplianceConfig, strict: bool = False, licenses: DataFrame | None = None) -> DataFrame:
    """df with is_restrictive, osi_status and compatibility, by one join."""
    return _annotated(_classified(_with_verdicts(df, cfg, strict, licenses), strict), cfg, strict).drop(VERDICT)


def judge_compat(leaves: DataFrame, matrix: DataFrame, strict: bool = False) -> DataFrame:
    """(leaf, project_license) with compatible: in the matrix or not; null if the matrix doesn't know the project."""
    keyed = leaves.withColumns({"dep": normalize_license_id(F.col("leaf")), "project": normalize_license_id(F.col("project_license"))})
    pairs = matrix.select(F.col("project_license").alias("project"), F.col("dep_license").alias("dep"), F.lit(True).alias("allowed"))
    known = matrix.select(F.col("project_license").alias("project"), F.lit(True).alias("known")).distinct()
    found = keyed.join(pairs, ["project", "dep"], "left").join(known, "project", "left")
    unknown = F.lit(False) if strict else F.lit(None).cast("boolean")
    return found.withColumn("compatible", F.when(F.col("known"), F.coalesce("allowed", F.lit(False))).otherwise(unknown)).drop("dep", "project", "allowed", "known")
