"""Registered queries over rasters derived from the driver tables."""

from __future__ import annotations

from importlib import import_module

from skysift.plans import registry

AREAS = ("scalars", "gridding", "aggregates", "comparison", "sweeps", "model", "vectors", "inputs", "outputs", "validation")


def _load() -> None:
    for area in AREAS:
        import_module(f"skysift.plans.{area}")


def queries() -> dict[str, registry.Query]:
    _load()
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
