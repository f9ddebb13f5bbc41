"""Reference tables of a compliance run: matrix, lists, registry, rules. Small by nature; joins broadcast them."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Project licence -> dependency licences it allows.
COMPATIBLE = {
    "MIT": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "0BSD", "Zlib", "Unlicense", "WTFPL", "CC0-1.0"],
    "Apache-2.0": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "ISC", "0BSD", "Zlib", "Unlicense", "WTFPL", "CC0-1.0"],
    "GPL-3.0": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "ISC", "0BSD", "Zlib", "Unlicense", "WTFPL", "CC0-1.0"],
    "GPL-2.0": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", "GPL-2.0", "ISC", "0BSD", "Zlib", "Unlicense", "WTFPL", "CC0-1.0"],
    "AGPL-3.0": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "LGPL-2.1", "LGPL-3.0", "GPL-2.0", "GPL-3.0", "AGPL-3.0", "ISC", "0BSD", "Zlib", "Unlicense", "WTFPL", "CC0-1.0"],
    "LGPL-3.0": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "LGPL-2.1", "LGPL-3.0", "ISC", "0BSD", "CC0-1.0"],
    "LGPL-2.1": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "LGPL-2.1", "ISC", "0BSD", "CC0-1.0"],
    "MPL-2.0": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "0BSD", "CC0-1.0"],
    "BSD-3-Clause": ["MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "CC0-1.0"],
    "BSD-2-Clause": ["MIT", "BSD-2-Clause", "ISC", "0BSD", "CC0-1.0"],
    "ISC": ["MIT", "ISC", "0BSD", "CC0-1.0"],
    "0BSD": ["0BSD", "CC0-1.0"],
    "Unlicense": ["Unlicense", "0BSD", "CC0-1.0"],
    "WTFPL": ["WTFPL", "0BSD", "Unlicense", "CC0-1.0"],
}
#: Substrings of restrictive licences, and ids that are always OSI-approved.
RESTRICTIVE = ["GPL-3.0", "AGPL-3.0", "LGPL-3.0", "MPL-2.0", "SEE LICENSE IN LICENSE", "CC-BY-SA-4.0", "EPL-2.0"]
OSI = ["MIT", "Apache-2.0", "BSD-3-Clause", "BSD-2-Clause", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "ISC", "0BSD"]
REGISTRY = "spdx_id string, title string, permissions array<string>, conditions array<string>, limitations array<string>"


@dataclass
class ComplianceConfig:
    """registry: REGISTRY rows. Lists are plain values, because they become part of the plan."""

    registry: DataFrame
    matrix: DataFrame
    osi: DataFrame
    restrictive: list[str] = field(default_factory=lambda: list(RESTRICTIVE))
    ignore: list[str] = field(default_factory=list)
    custom: list[tuple[str, list[str], bool | None]] = field(default_factory=list)

    @classmethod
    def default(cls, spark: SparkSession, **changes) -> ComplianceConfig:
        pairs = [(p, d) for p, allowed in COMPATIBLE.items() for d in allowed]
        tables = {
            "registry": spark.createDataFrame([], REGISTRY),
            "matrix": spark.createDataFrame(pairs, "project_license string, dep_license string"),
            "osi": spark.createDataFrame([(i,) for i in OSI], "spdx_id string"),
        }
        return cls(**tables | changes)

    @classmethod
    def from_tables(cls, spark: SparkSession, registry=None, matrix=None, osi=None, restrictive=None, ignore=None, custom=None) -> ComplianceConfig:
        """An explicit table wins over the default one. restrictive and ignore: (pattern); custom: (rule_order, id, match_all, restrictive)."""
        changes = {k: v for k, v in {"registry": registry, "matrix": matrix, "osi": osi}.items() if v is not None}
        if restrictive is not None:
            changes["restrictive"] = [r["pattern"] for r in restrictive.collect()]
        if ignore is not None:
            changes["ignore"] = [r["pattern"] for r in ignore.collect()]
        if custom is not None:
            changes["custom"] = [(r["id"], list(r["match_all"]), r["restrictive"]) for r in custom.orderBy("rule_order").collect()]
        return cls.default(spark, **changes)


#: Options with their defaults, and the range of the depth.
DEFAULTS: dict[str, Any] = {"licenses.restrictive": RESTRICTIVE, "licenses.ignore": [], "dependencies.ignore": [], "dependencies.max_depth": 10, "strict": False}
DEPTHS = range(1, 101)


def settings(file: str | None = None, environment: Mapping[str, str] | None = None, prefix: str = "LIXORA") -> dict[str, Any]:
    """Every option: what the environment says, else the configuration file (TOML text), else the default.

    LIXORA_LICENSES_RESTRICTIVE is licenses.restrictive, and so on. Lists there are JSON, or names between commas.
    """
    said = tomllib.loads(file or "")
    out: dict[str, Any] = {}
    for option, default in DEFAULTS.items():
        value: Any = said
        for part in option.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        out[option] = default if value is None else value
        text = (environment or {}).get(f"{prefix}_{option.upper().replace('.', '_')}")
        if text is not None and isinstance(default, list):
            out[option] = json.loads(text) if text.lstrip().startswith("[") else [x.strip() for x in text.split(",") if x.strip()]
        elif text is not None:
            out[option] = text.lower() in ("1", "true") if isinstance(default, bool) else int(text)
    if out["dependencies.max_depth"] not in DEPTHS:
        raise ValueError(f"dependencies.max_depth is from {DEPTHS[0]} to {DEPTHS[-1]}")
    return out


def overlap(restrictive: DataFrame, ignore: DataFrame) -> DataFrame:
    """Patterns that are both restrictive and ignored."""
    return restrictive.select("pattern").intersect(ignore.select("pattern"))


def duplicates(patterns: DataFrame) -> DataFrame:
    """Patterns that a list holds more than once."""
    return patterns.groupBy("pattern").agg(F.count("*").alias("times")).where("times > 1")
