"""Queries: one module per operator family, collected in one registry."""
import importlib

FAMILIES = ("joins", "events", "windows", "crosssection", "evaluation", "aggregates", "labels", "audits", "scalars", "sources", "models", "streams")


def load():
    from tidemark.plans.registry import ORACLES, QUERIES

    for name in FAMILIES:
        importlib.import_module(f"tidemark.plans.{name}")
    return QUERIES, ORACLES
