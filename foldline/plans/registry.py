"""Collects every registered query module into one mapping."""

from __future__ import annotations


def all_queries():
    from foldline.plans import catalog
    for mod in ("catalog_eval", "catalog_features", "catalog_tasks", "catalog_models", "catalog_reports"):
        __import__(f"foldline.plans.{mod}")
    return dict(catalog.QUERIES)
