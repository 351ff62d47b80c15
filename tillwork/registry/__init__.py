"""All registered queries."""

from importlib import import_module

from tillwork.registry.base import ORACLES, QUERIES

_MODULES = ("payments", "features", "ledger", "drift", "monitoring", "governance", "models", "sources", "streams")


def _load() -> None:
    for name in _MODULES:
        import_module(f"tillwork.registry.{name}")


def queries():
    _load()
    return dict(QUERIES)


def oracles():
    _load()
    return dict(ORACLES)
