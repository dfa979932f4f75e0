"""Word and word-window hashes of whole batches of texts, as numpy arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
CHUNK = 1 << 19
_PRIME = 0x9E3779B97F4A7C15 | 1
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _PRIME), ("down", pow(_PRIME, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.cumprod(x, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def cut(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in bytes that begin and end with white space."""
    is_space = SPACE[blob]
    edges = np.flatnonzero(is_space[1:] != is_space[:-1]) + 1
    return edges[0::2], edges[1::2]


def word_hashes(blob: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over its bytes, mixed."""
    out, a = np.empty(len(start), np.uint64), 0
    while a < len(start):
        b = max(a + 1, int(np.searchsorted(end, start[a] + CHUNK, "right")))
        low, high = int(start[a]), int(end[b - 1])
        up, down = _power(max(high - low, CHUNK) + 1)
        sums = np.zeros(high - low + 1, np.uint64)
        np.cumsum((blob[low:high].astype(np.uint64) + np.uint64(1)) * up[: high - low], out=sums[1:])
        s, e = start[a:b] - low, end[a:b] - low
        out[a:b] = (sums[e] - sums[s]) * down[s]
        a = b
    return mixed(out)


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` words, by doubling: entry i is of words i to i+width-1."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    done, out, size, power = 0, None, 1, words
    while True:
        if width & size:
            part = power[done : done + n]
            out = part.copy() if out is None else mixed(out * np.uint64(0x9DDFEA08EB382D69) + part)
            done += size
        size *= 2
        if size > width:
            return out
        half = size // 2
        power = mixed(power[: len(power) - half] * np.uint64(0xA0761D6478BD642F) + power[half:])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` entries, by doubling."""
    n, size, now = len(x) - width + 1, 1, x
    if n <= 0:
        return np.empty(0, x.dtype)
    while size * 2 <= width:
        now = np.minimum(now[:-size], now[size:])
        size *= 2
    return np.minimum(now[:n], now[width - size : width - size + n])
