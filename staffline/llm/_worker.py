"""What a Python worker keeps from one task to the next.

Workers outlive their tasks, and one worker serves all operators of a session in turn. It keeps one model (vocabulary,
automata and what they have stored) at a time, so that its memory is that of the largest, not of all of them.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import pyarrow as pa

from . import _text

_kept: list = []


def release() -> None:
    """Frees what is kept and gives free memory back to the system."""
    _kept.clear()
    _text.forget_powers()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):  # not glibc
        pass


def resident(build: Callable, *key):
    """build(*key), kept until this worker is asked for another one; that frees it before the next is built."""
    if not _kept or _kept[0] is not build or _kept[1] != key:
        release()
        made = build(*key)
        _kept[:] = [build, key, made]
    return _kept[2]
