"""Checked queries: each registered Spark query with an independent SQL twin."""

from importlib import import_module

MODULES = (
    "scalars", "lookups", "spatial", "evidence", "names", "occurrences", "accuracy", "reports",
    "gates", "incremental",
)


def load_all() -> None:
    for module in MODULES:
        import_module(f"waymark.checks.{module}")
