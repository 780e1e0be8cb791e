"""Registered queries over the given tables, each next to the SQL that checks it."""

from importlib import import_module

SECTIONS = ["sources", "rows", "joins", "aggregates", "windows", "ranking", "scoring", "models", "density", "streams"]


def load():
    """Import all sections and return the catalog."""
    for section in SECTIONS:
        import_module(f"sessionlens.plans.{section}")
    return import_module("sessionlens.plans.catalog")
