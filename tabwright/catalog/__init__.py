"""Registered queries and their oracles, one module per area."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

AREAS = ("profile", "quality", "repair", "prepare", "evaluate", "model", "report", "identity")


def _merge(attribute: str) -> dict:
    merged: dict = {}
    for area in AREAS:
        merged.update(getattr(import_module(f"tabwright.catalog.{area}_queries"), attribute))
    return merged


def all_queries() -> dict[str, Callable]:
    return _merge("QUERIES")


def all_oracles() -> dict[str, str]:
    return _merge("ORACLES")
