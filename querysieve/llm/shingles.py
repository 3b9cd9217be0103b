"""Word n-gram sets of whole texts as sorted 64-bit hashes, inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

CACHE_WORDS = 100_000
_MIX = [np.uint64(m) for m in (
    0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xFF51AFD7ED558CCD
)]


class _Words(dict):
    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_digest(word)
        return value


_words = _Words()


def forget() -> None:
    """Empty the cache of words."""
    _words.clear()


def shingle_set(text: bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of ``n`` consecutive words of ``text`` (ASCII case folded).

    Words are runs of anything but ASCII white space. A text of fewer words is one shingle, a text
    without words the empty set.
    """
    words = text.lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], np.uint64)
    each = np.frombuffer(b"".join(map(_words.__getitem__, words)), np.uint64)
    held = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        held = (held ^ each[k:k + len(held)]) * _MIX[k % len(_MIX)]
        held ^= held >> np.uint64(29)
    held.sort()
    return held[np.concatenate([[True], held[1:] != held[:-1]])]


def sets_of(batch: pa.RecordBatch, text: int, n: int = 5) -> Iterator[np.ndarray]:
    for value in batch.column(text).cast(pa.binary()):
        yield shingle_set(value.as_py(), n)
