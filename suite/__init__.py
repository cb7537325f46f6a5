"""The registered workload: analog inputs, queries and their SQL oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = ("grid_cases", "clean_cases", "panel_cases", "model_cases")


def load():
    """The registry with every case module imported."""
    for name in MODULES:
        import_module(f"suite.{name}")
    return import_module("suite.registry")
