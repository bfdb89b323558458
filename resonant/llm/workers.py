"""What a Python worker keeps between its tasks.

A worker serves task after task of all operators. Freed arrays stay with the C library and
Arrow's pool, which serve their next users, but count beside the executor's heap meanwhile.
"""

from __future__ import annotations

import ctypes
import sys

import pyarrow as pa


def give_back() -> None:
    """Freed memory goes back to the system, as far as Arrow's pool and the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # only glibc has it
        pass


def returning(run, encodes: bool = False):
    """``run``, a function of batches, which gives back memory as it ends.

    If it does not encode texts, the encoder that an earlier task left goes as it begins.
    """

    def task(batches):
        tokens = None if encodes else sys.modules.get("resonant.llm.tokens")
        if tokens and tokens.encoder.cache_info().currsize:
            tokens.encoder.cache_clear()
            give_back()
        try:
            yield from run(batches)
        finally:
            give_back()

    return task
