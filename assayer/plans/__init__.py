"""Registered queries by theme."""

from importlib import import_module

THEMES = ("metrics", "projections", "statistics", "judging", "audit", "text", "retrieval", "sampling", "tables", "sources",
          "streams")


def load():
    """The registry with every theme loaded."""
    registry = import_module("assayer.plans.registry")
    for theme in THEMES:
        import_module(f"assayer.plans.{theme}")
    return registry
