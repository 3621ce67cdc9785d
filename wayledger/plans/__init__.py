"""The registered queries, one module per area."""

from __future__ import annotations

import importlib

AREAS = ["trips", "timeline", "shopping", "changes", "quality", "exports", "replies", "expressions", "live", "storage"]


def load_all() -> None:
    for area in AREAS:
        importlib.import_module(f"{__name__}.{area}")
