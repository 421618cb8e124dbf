"""Registered queries of the subpackage. Importing this package fills ``QUERIES`` and ``CHECKS``."""

import importlib

from codeloom.llm.queries.registry import CHECKS, QUERIES

MODULES = ["op01_sharding", "op02_url_lists", "op03_quality", "op04_personal_data", "op05_nearest", "op06_simhash", "op07_exact", "op08_warc", "op09_packing", "op10_pieces",
           "op11_toxicity", "op12_lexical", "op13_whitening"]
for _name in MODULES:
    importlib.import_module(f"codeloom.llm.queries.{_name}")

__all__ = ["CHECKS", "QUERIES"]
