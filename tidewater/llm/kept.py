"""Things made once per process."""

from __future__ import annotations

from collections.abc import Callable


def kept(key: tuple, make: Callable):
    """``make()`` once per process. A plain function over a dict in ``sys``, not
    functools.cache, whose wrappers don't travel to workers by value."""
    import sys

    store = sys.__dict__.setdefault("_tidewater_kept", {})
    if key not in store:
        store[key] = make()
    return store[key]
