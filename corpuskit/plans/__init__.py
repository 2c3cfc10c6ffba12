"""Registered queries over the driver tables."""

from __future__ import annotations

import functools
import importlib
import pkgutil

from corpuskit import runtime
from corpuskit.plans import registry


def _load() -> None:
    for module in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{module.name}")


def _with_package(fn: registry.Query) -> registry.Query:
    """The workers need this package, from wherever the driver was started."""

    @functools.wraps(fn)
    def run(spark, sf):
        runtime.ship_package(spark)
        return fn(spark, sf)

    return run


def queries() -> dict[str, registry.Query]:
    _load()
    return {name: _with_package(fn) for name, fn in registry.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(registry.ORACLES)
