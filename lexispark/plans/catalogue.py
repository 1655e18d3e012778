"""All queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib

#: Modules of queries; each has Q: name -> (function of (spark, sf_dir), SQL or None).
MODULES = ("text_models", "structure", "records", "registry", "models", "files", "sources", "more", "chains")


def _all() -> dict:
    out: dict = {}
    for name in MODULES:
        out |= importlib.import_module(f"lexispark.plans.{name}").Q
    return out


def queries() -> dict:
    return {k: f for k, (f, _) in _all().items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in _all().items() if sql}
