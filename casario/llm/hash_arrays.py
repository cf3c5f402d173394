"""Sorted arrays in files of the shared folder, written once by a task and memory-mapped by all workers."""

from __future__ import annotations

import mmap
import os
import sys

import numpy as np


def joined(*arrays: np.ndarray) -> bytes:
    """Arrays behind their lengths in bytes, each padded to 8."""
    raw = [a.tobytes() for a in arrays]
    return np.array([len(raw), *map(len, raw)], "<u8").tobytes() + b"".join(r + b"\0" * (-len(r) % 8) for r in raw)


def split(raw, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    n = int(raw[:8].view("<u8")[0])
    sizes, at, out = raw[8 : 8 + 8 * n].view("<u8"), 8 + 8 * n, []
    for size, kind in zip(map(int, sizes), kinds, strict=True):
        out.append(raw[at : at + size].view(kind))
        at += size + -size % 8
    return out


def write(path: str, *arrays: np.ndarray) -> None:
    """Atomic, so that a repeated or speculative task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    own = f"{path}.{os.getpid()}.{os.urandom(4).hex()}"
    with open(own, "wb") as f:
        f.write(joined(*arrays))
    os.replace(own, path)


class Files:
    """The arrays of files as views of their mappings, each mapped once; they are unmapped with this object, which a task has to itself.

    A mapping holds no open file (from Python 3.13 on).
    """

    def __init__(self):
        self._open: dict[str, tuple[np.ndarray, ...] | None] = {}

    def arrays(self, path: str, *kinds: str) -> tuple[np.ndarray, ...] | None:
        """The arrays of a file, or None without one."""
        if path not in self._open:
            self._open[path] = None
            if os.path.exists(path):
                with open(path, "rb") as f:
                    free = {"trackfd": False} if sys.version_info >= (3, 13) else {}
                    self._open[path] = tuple(split(np.frombuffer(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **free), np.uint8), *kinds))
        return self._open[path]

    def __reduce__(self):
        return Files, ()
