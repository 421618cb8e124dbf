"""Registered queries. Importing this package fills the registry."""

import importlib

from codeloom.plans.registry import CHECKS, QUERIES

MODULES = ["extraction", "naming", "duplicates", "merging", "analytics", "versions", "search", "quality", "trees", "exports", "streams", "elements", "site_rules", "stores"]
for _name in MODULES:
    importlib.import_module(f"codeloom.plans.{_name}")

__all__ = ["CHECKS", "QUERIES"]
