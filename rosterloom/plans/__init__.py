"""Bindings of the operators to the given tables."""

import importlib
import pkgutil


def registered():
    """(queries, oracles) of all binding modules."""
    from . import tables

    for m in pkgutil.iter_modules(__path__):
        if m.name.startswith("bind_"):
            importlib.import_module(f"{__name__}.{m.name}")
    return tables.QUERIES, tables.ORACLES
