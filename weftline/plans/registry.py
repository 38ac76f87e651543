"""All queries of the core, gathered from the modules of this package."""

from __future__ import annotations

import importlib
import pkgutil

import weftline.plans as _here


def _modules():
    names = sorted(m.name for m in pkgutil.iter_modules(_here.__path__) if m.name != "registry")
    return [importlib.import_module(f"weftline.plans.{n}") for n in names]


def queries() -> dict:
    return {k: q for m in _modules() for k, q in getattr(m, "QUERIES", {}).items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _modules() for k, s in getattr(m, "ORACLE", {}).items()}
