"""Registered queries (one per operator of the inventory) and their oracles."""

from __future__ import annotations

import importlib

MODULES = [
    "decisions",
    "joins",
    "records",
    "scoring",
    "evaluation",
    "streams",
    "runs",
]


def load_all():
    from arbiter.plans.registry import REGISTRY

    for m in MODULES:
        importlib.import_module(f"arbiter.plans.{m}")
    return REGISTRY
