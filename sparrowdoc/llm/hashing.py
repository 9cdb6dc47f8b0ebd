"""Numpy hashes over whole slices: every window of a slice at once, by prefix sums of a polynomial mod 2**64."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
HIGH = np.uint64(0xFFFFFFFF00000000)
LOW = np.uint64(0xFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A random-looking word for each byte value.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n at least."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = (np.cumprod(up), np.cumprod(down))
    return _powers[size]


def prefix(units: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units) + 1)[0][: len(units)], out=out[1:])
    return out


def ranges(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each [start, end), from ``prefix`` sums."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def windows(sums: np.ndarray, size: int) -> np.ndarray:
    """Hash of every window of ``size`` units."""
    n = len(sums) - size
    if n <= 0:
        return np.zeros(0, np.uint64)
    return mix((sums[size:] - sums[:n]) * powers(len(sums))[1][:n])


def owners(grams: np.ndarray, width: int) -> np.ndarray:
    """For every ``width`` neighbouring grams, the place of the least (by its high half; the leftmost of equals).

    A sliding minimum in two passes over blocks of ``width``; the low half of each value is its place.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(grams) // width)
    v = np.full(blocks * width, np.uint64(0xFFFFFFFFFFFFFFFF))
    v[: len(grams)] = (grams & HIGH) | np.arange(len(grams), dtype=np.uint64)
    v = v.reshape(blocks, width)
    ahead = np.minimum.accumulate(v, axis=1).reshape(-1)
    behind = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(behind[:n], ahead[width - 1 : width - 1 + n]) & LOW).astype(np.int64)


#: Bytes between words: 0x20 and 0x09 to 0x0D.
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a byte array."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_BLANK[data]
    edge = np.flatnonzero(solid[1:] != solid[:-1])
    return edge[0::2], edge[1::2]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One byte array of all texts, a newline after each, and where each text starts (one more at the end)."""
    data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return data, starts
