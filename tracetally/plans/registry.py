"""All registered queries and reference SQL, by name."""

from __future__ import annotations

from importlib import import_module

AREAS = ["cost", "trees", "tables", "retrieval", "search", "sessions", "measure", "streams"]

QUERIES: dict = {}
ORACLES: dict = {}
for _area in AREAS:
    _module = import_module(f"{__package__}.{_area}")
    _twice = QUERIES.keys() & _module.QUERIES.keys()
    if _twice:
        raise ValueError(f"registered twice: {sorted(_twice)}")
    QUERIES.update(_module.QUERIES)
    ORACLES.update(_module.ORACLES)
