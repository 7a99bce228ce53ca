"""What an operator keeps in a Python worker from task to task. A worker serves all stages of an application one after another;
it holds the caches of one operator at a time, so that its memory doesn't grow with the number of operators run."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

_held: dict[str, Callable[[], None]] = {}


def turn(name: str, release: Callable[[], None] | None = None) -> None:
    """Now ``name`` runs in this worker: what others keep is released. ``release`` drops what ``name`` itself keeps."""
    others = [k for k in _held if k != name]
    for k in others:
        _held.pop(k)()
    if others:
        gc.collect()
        try:  # gives freed memory back to the system, where the C library can
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):
            pass
    if release is not None:
        _held[name] = release
