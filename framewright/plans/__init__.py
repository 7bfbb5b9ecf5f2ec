"""Registered queries over the supplied tables."""

from __future__ import annotations

import importlib

from framewright.plans.registry import QUERIES, Query

AREAS = ("screening", "frames", "fourier", "evaluation", "timing", "geometry", "motion", "records", "relations")


def catalogue() -> dict[str, Query]:
    """Every registered query, importing the areas on first use."""
    for area in AREAS:
        importlib.import_module(f"framewright.plans.{area}")
    return dict(QUERIES)
