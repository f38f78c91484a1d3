"""Named queries: every operator applied to the driver tables."""

from __future__ import annotations

import importlib

MODULES = ["logs", "private", "rollups", "search", "guard", "clusters", "streams"]


def load_all():
    """(queries, SQL twins) of all catalogue modules."""
    for name in MODULES:
        importlib.import_module(f"alertloom.catalog.{name}")
    from alertloom.catalog import base

    return dict(base.QUERIES), dict(base.ORACLES)
