"""Texts of an Arrow batch as UTF-8 bytes, and polynomial hashes of their parts.

Hashes are sums of ``value * base ** position`` modulo 2^64, turned to position
zero by the inverse power, so that the hash of any run of values is a difference
of two running sums. Equal runs have equal hashes; users verify or combine
several hashes where equality matters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21
BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = np.uint64(0xD6E8FEB86659FD93)


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``first row, bytes, offsets`` of runs of texts with about ``limit`` bytes; null is empty.

    ``offsets`` has one more entry than there are texts. A text is never cut.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("").cast(pa.large_string())
    if not len(texts):
        return
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, "i8")[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, "u1") if data is not None and data.size else np.zeros(0, "u1")
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), len(texts))
        yield first, whole[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def _inverse(x: np.uint64) -> np.uint64:
    return np.uint64(pow(int(x), -1, 2**64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    if n:
        out[0] = 1
        np.multiply.accumulate(out, out=out)
    return out


class Powers:
    """Powers of a base and of its inverse, grown when more are asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.up, self.down = base, powers(base, 0), powers(base, 0)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up, self.down = powers(self.base, n), powers(_inverse(self.base), n)
        return self.up, self.down


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= MIX
    h ^= h >> np.uint64(29)
    h *= MIX
    return h ^ (h >> np.uint64(32))


def running(values: np.ndarray, up: np.ndarray) -> np.ndarray:
    """Running sums with a leading zero."""
    out = np.zeros(len(values) + 1, "u8")
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def run_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, down: np.ndarray) -> np.ndarray:
    """Hashes of the runs ``starts .. ends``, lengths included."""
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype("u8") * MIX)
