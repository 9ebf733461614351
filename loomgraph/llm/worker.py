"""Memory of Python workers, which Spark uses again for stage after stage.

A worker keeps tables from task to task (the automaton of ``bpe``, say, with
hundreds of thousands of words). ``start`` drops those of other operators, so
that a worker holds the tables of one operator only, and ``trim`` gives what is
free back to the system, where it would count for as long as the worker lives;
``start`` does so too, where nothing is kept for what begins.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_KEPT: list[dict] = []


def kept() -> dict:
    """A table that a worker keeps until another operator starts in it."""
    _KEPT.append({})
    return _KEPT[-1]


def start(mine: dict | None = None) -> None:
    """Drops what is kept, but for ``mine``, and gives back what the last task has left."""
    others = [x for x in _KEPT if x and x is not mine]
    for x in others:
        x.clear()
    if others:
        gc.collect()
    if others or not mine:
        trim()


def trim() -> None:
    """Free memory goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass
