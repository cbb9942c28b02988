"""Vectorised hashes of words and of windows of words, over many texts at once."""

from __future__ import annotations

import numpy as np

from . import common

#: Odd multipliers of two byte polynomials and the word polynomial modulo 2**64 (fixed values), and the last one's inverse.
BYTE_BASE = 0x9E3779B97F4A7C15
OTHER_BASE = 0xC6A4A7935BD1E995
WORD_BASE = 0xD6E8FEB86659FD93
WORD_INVERSE = pow(WORD_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2**64."""
    steps = np.full(max(n, 1), base, "u8")
    steps[0] = 1
    return np.cumprod(steps, dtype="u8")[:n]


def word_hashes(texts: list[str | None], table: bytes = common.BLANK_BYTES, base: int = BYTE_BASE) -> tuple[np.ndarray, np.ndarray]:
    """The words' hashes, text by text, and where each text's begin (one more entry: the end).

    ``table`` maps bytes for bytes.translate; spaces part words. Another odd
    ``base`` gives other hashes.
    """
    raw = [(t or "").encode("utf-8").translate(table) for t in texts]
    joined = np.frombuffer(b" ".join(raw) + b" ", "u1")
    sizes = np.array([len(r) + 1 for r in raw], "i8")
    inside = joined != 32
    edge = np.diff(np.concatenate([[False], inside]).astype("i1"))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.empty(0, "u8"), np.zeros(len(texts) + 1, "i8")
    lengths = ends - starts
    kept = joined[inside].astype("u8") + np.uint64(1)
    first = np.cumsum(lengths) - lengths
    power = powers(base, int(lengths.max()))
    kept *= power[np.arange(len(kept)) - np.repeat(first, lengths)]
    hashes = mixed(np.add.reduceat(kept, first) + lengths.astype("u8"))
    bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(sizes)]))
    return hashes, bounds


class Windows:
    """Hashes of windows of any length over one row of word hashes."""

    def __init__(self, words: np.ndarray):
        n = len(words)
        self.n = n
        self.sums = np.zeros(n + 1, "u8")
        np.cumsum(words * powers(WORD_BASE, n), out=self.sums[1:], dtype="u8")
        self.back = powers(WORD_INVERSE, n)

    def of(self, length: int) -> np.ndarray:
        """The hash of the window of ``length`` words that starts at each place."""
        count = max(0, self.n - length + 1)
        return mixed((self.sums[length:length + count] - self.sums[:count]) * self.back[:count] + np.uint64(length))


def sliding(f, values: np.ndarray, width: int) -> np.ndarray:
    """f (np.minimum or np.maximum) over ``width`` values from each place on."""
    size, grown = 1, values
    while 2 * size <= width:
        grown = f(grown[:-size], grown[size:])
        size *= 2
    rest = width - size
    return f(grown[:len(grown) - rest], grown[rest:]) if rest else grown


def starts_inside(bounds: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of the places 0 ... n - length start a window that stays inside its text."""
    ok = np.zeros(max(0, n - length + 1) + 1, "i8")
    begin, end = bounds[:-1], bounds[1:] - length + 1
    use = end > begin
    np.add.at(ok, begin[use], 1)
    np.add.at(ok, end[use], -1)
    return np.cumsum(ok[:-1]) > 0


def portions(texts: list[str | None], most: int = 2_000_000, each: int = 0):
    """Ranges of texts, in order, of about so many characters together, where each text counts ``each`` more."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "") + each
        if size >= most:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
