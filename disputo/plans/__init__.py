"""Query plans over the given tables: every module has QUERIES (name to function) and ORACLES (name to SQL)."""

import importlib
import pkgutil


def modules() -> list:
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if not m.name.startswith("_")]
