"""All registered queries and oracles, collected from the query modules."""

from __future__ import annotations

import importlib

MODULES = ["motion_queries", "catalog_queries", "text_queries", "geo_queries", "delivery_queries"]


def _modules():
    return [importlib.import_module(f"reelgrid.plans.{name}") for name in MODULES]


def queries():
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
