"""Query plans on the test tables."""

from __future__ import annotations

import importlib

MODULES = ("eval_queries", "import_queries", "text_queries", "graph_queries", "profile_queries", "state_queries", "page_queries")


def all_queries():
    """The catalog of the core's queries, filled by importing their modules."""
    from .catalog import core

    for m in MODULES:
        importlib.import_module(f"{__name__}.{m}")
    return core
