"""Memory of Python workers, which Spark keeps between tasks and stages."""

from __future__ import annotations

import ctypes
import gc

import pyarrow as pa


def given_back() -> None:
    """Returns what a task has freed to the system, for the next stage's JVM and workers on the same machine."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)
