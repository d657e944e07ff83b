"""All registered queries, gathered from the modules that register them."""

from __future__ import annotations

import functools


@functools.lru_cache(maxsize=1)
def all_queries():
    from tavola.plans import catalog  # noqa: F401  (registers reports)
    for mod in ("tavola.plans.catalog_checks", "tavola.plans.catalog_changes", "tavola.plans.catalog_streams"):
        try:
            __import__(mod)
        except ModuleNotFoundError as e:  # module not written yet
            if e.name != mod:
                raise
    return dict(catalog.REGISTRY)
