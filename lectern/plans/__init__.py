"""Registered queries, grouped by area."""

import importlib

from lectern.plans.base import REGISTRY

AREAS = ("retrieval", "shaping", "curation", "evaluation", "collections", "series")


def registry() -> dict:
    for area in AREAS:
        importlib.import_module(f"lectern.plans.{area}")
    return REGISTRY
