"""Registered queries: key -> (Spark callable, oracle SQL or None)."""

from importlib import import_module

MODULES = ["voting", "people", "matters", "debates", "disclosure", "quality", "search", "register", "markup"]


def registry() -> dict:
    out: dict = {}
    for name in MODULES:
        for key, pair in import_module(f"plenum.catalog.{name}").QUERIES.items():
            if key in out:
                raise ValueError(f"registered twice: {key}")
            out[key] = pair
    return out
