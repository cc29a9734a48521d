"""What lives as long as a Python worker process, not only as long as a task."""

from __future__ import annotations

import sys
import types

_NAME = "_spanguard_kept"


def once(key, make):
    """What ``make`` gave when this process first asked for ``key``; code that travels by value keeps no globals of its own."""
    kept = sys.modules.setdefault(_NAME, types.ModuleType(_NAME)).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def latest(key, version, make):
    """The same for what comes in versions: only the one asked for last is kept."""
    held = once(("latest", key), dict)
    if version not in held:
        held.clear()
        held[version] = make()
    return held[version]
