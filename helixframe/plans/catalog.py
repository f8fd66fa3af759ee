"""Loads all query modules and exposes the filled registry."""

import importlib

from helixframe.plans.registry import ORACLES, QUERIES

for _name in ("sources", "parsing", "coordinates", "joins", "features", "aggregates", "ranking",
              "evidence", "scoring", "evaluation", "vcf_files", "report", "streams"):
    try:
        importlib.import_module(f"helixframe.plans.{_name}")
    except ModuleNotFoundError as e:
        if f"helixframe.plans.{_name}" not in str(e):
            raise

__all__ = ["ORACLES", "QUERIES"]
