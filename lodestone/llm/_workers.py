"""What a Python worker keeps from task to task.

Spark uses workers again for later stages.  An operator's memos save time in its own tasks only; what they hold goes when
the tasks of another operator begin, or a pipeline's stages would add up in every worker.
"""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa

_held: dict[str, dict] = {}


def trim() -> None:
    """Give free memory back to the system."""
    pa.default_memory_pool().release_unused()
    back = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if back:
        back(0)


def kept(owner: str) -> dict:
    """What the operator ``owner`` keeps in this worker; what others kept is let go, and free memory given back to the system."""
    if owner not in _held:
        _held.clear()
        gc.collect()
        trim()
        _held[owner] = {}
    return _held[owner]
