"""Objects kept by Python worker processes."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable


def worker_cache(key, make: Callable):
    """One object per Python worker process, kept across tasks (functions arrive by value)."""
    store = sys.modules.get("_spanforge_worker_cache")
    if store is None:
        store = sys.modules["_spanforge_worker_cache"] = types.ModuleType("_spanforge_worker_cache")
        store.items = {}
    if key not in store.items:
        store.items[key] = make()
    return store.items[key]
