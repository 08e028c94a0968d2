"""quarry: document-corpus analytics as plain Spark DataFrame operators.

The read API can be taken from here; its modules are loaded when it is first used.
"""

from importlib import import_module

_API = ("ReadBudget", "search", "context", "evidence", "dedupe", "diagnostics", "lineage", "asset_health", "operational_intent", "scopes")
__all__ = list(_API)


def __getattr__(name: str):
    if name in _API:
        return getattr(import_module("quarry.api"), name)
    raise AttributeError(f"module 'quarry' has no attribute {name!r}")
