"""What lives as long as a Python worker: code of this package travels by value, so its own globals last for a task only."""

from __future__ import annotations

import sys
import types


def kept(key, make):
    """The value made for ``key`` by the first task of this worker process that asked for it."""
    store = sys.modules.setdefault("_spanguard_worker", types.ModuleType("_spanguard_worker")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]
