"""Registered queries over the driver's tables."""

from importlib import import_module

_MODULES = ("metrics", "interval", "event", "scoring", "fusion", "corpus", "model", "streaming")


def load_queries():
    from .registry import ORACLES, QUERIES
    for m in _MODULES:
        import_module(f"{__name__}.{m}_queries")
    return QUERIES, ORACLES
