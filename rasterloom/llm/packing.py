"""Numbers and words of many rows in one compressed value."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: No UTF-8 text has this byte, so it parts words.
BREAK = b"\xff"


def packed(data: bytes) -> bytes:
    """data compressed, its length before it."""
    return len(data).to_bytes(8, "little") + pa.Codec("zstd").compress(data, asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def planes(numbers: np.ndarray) -> bytes:
    """Numbers under 2**32, lowest bytes of all first, compressed."""
    return packed(np.ascontiguousarray(numbers.astype("<u4").view("u1").reshape(-1, 4).T).tobytes())


def numbers(data: bytes) -> np.ndarray:
    """What planes was given."""
    return np.ascontiguousarray(np.frombuffer(unpacked(data), "u1").reshape(4, -1).T).view("<u4").ravel().astype("i8")
