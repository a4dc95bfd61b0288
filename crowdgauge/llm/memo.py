"""A bounded memory for pure functions of a key."""

from __future__ import annotations


HELD: dict = {}


def held(kind, make=None):
    """The one large object a Python worker keeps between tasks, such as an encoder with its memory. Asking for another
    kind lets go of it, so a worker that serves one stage after the other never holds two; None only lets go."""
    if kind not in HELD:
        if HELD:
            HELD.clear()
            give_back()
        if make is None:
            return None
        HELD[kind] = make()
    return HELD[kind]


def give_back() -> None:
    """Returns freed memory to the machine: a worker lives through many stages, and allocators keep what each of them used."""
    import ctypes
    import gc

    import pyarrow

    gc.collect()
    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
    if trim:
        trim(0)


class Memo:
    """Two generations of at most ``size`` entries: what is asked for again moves to the young one, and the old
    one goes when the young one is full. Keys longer than ``longest`` are not kept, so that a memory of texts is bounded
    in bytes, too."""

    def __init__(self, size: int, longest: int = 64):
        self.size, self.longest, self.young, self.old = size, longest, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got

    def put(self, key, value):
        if len(key) > self.longest:
            return value
        if len(self.young) >= self.size:
            self.old, self.young = self.young, {}
        self.young[key] = value
        return value
