"""All registered queries of the library."""

from lixora.plans import identity, judging, manifests, outputs, projects, sboms, scans  # noqa: F401
from lixora.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
