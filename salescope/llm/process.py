"""State that a Python worker process keeps between tasks (tables, caches); rebuilt where it is missing."""

from __future__ import annotations

import ctypes
import sys
import types
from collections.abc import Callable
from typing import Any

import pyarrow as pa

_HOME = "_salescope_llm_process_state"


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """The value made first under ``name`` in this process.

    Functions reach executors by value, with their own module globals each time, so a module-level
    cache would not outlive a task.
    """
    home = sys.modules.setdefault(_HOME, types.ModuleType(_HOME))
    state = home.__dict__.setdefault("state", {})
    if name not in state:
        state[name] = make()
    return state[name]


def give_back() -> None:
    """Return freed memory to the system at the end of a task.

    Workers live on between tasks, and an executor's memory holds theirs too; allocators keep what they
    have freed unless told otherwise.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library: nothing to trim
        pass
