"""The registered queries over the driver's tables."""

import importlib
import pkgutil

from .registry import QUERIES, SQL


def _load() -> None:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")


def all_queries() -> dict:
    _load()
    return dict(QUERIES)


def all_sql() -> dict:
    _load()
    return dict(SQL)
