"""Word and shingle hashing for whole texts, many documents at a time, in numpy.

Words are runs of bytes other than space and tab..carriage return, A-Z lower-cased. UTF-8 keeps every
byte of a non-ASCII character above 0x7F, so the byte view and the character view agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SHINGLE_WORDS = 5
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BYTE_VALUES = np.random.default_rng(20240607).integers(1, _MASK, size=256, dtype=np.uint64)
_LENGTH_SALT = np.uint64(0xD6E8FEB86659FD93)
_SHINGLE_BASE = 0xC2B2AE3D27D4EB4F


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            step = np.full(size, _BASE, dtype=np.uint64)
            back = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
            step[0] = back[0] = 1
            self.up, self.down = np.cumprod(step), np.cumprod(back)
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of whole texts of about ``limit`` bytes, each with the index of its first text."""
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if t else b""
        if held and size + len(b) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(b)
        size += len(b) + 1
    if held:
        yield start, held


def _separators(is_separator) -> np.ndarray:
    return np.asarray([is_separator(i) for i in range(256)], dtype=bool)


#: Space and tab..carriage return.
SPACES = _separators(lambda i: i == 32 or 9 <= i <= 13)
#: All ASCII but digits and letters.
NON_WORD = _separators(lambda i: i < 128 and not chr(i).isalnum())


def word_spans(docs: list[bytes], separators: np.ndarray = SPACES, latin: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, hashes, first): all words in order; ``first`` says where each document's words begin
    (one more than documents). A-Z are lower-cased, and with ``latin`` the Latin-1 capitals too."""
    buf = np.frombuffer(b" ".join(docs) + b" ", dtype=np.uint8)
    buf = np.where((buf >= 65) & (buf <= 90), buf | 32, buf)
    if latin:
        capital = (buf >= 0x80) & (buf <= 0x9E) & (buf != 0x97)
        capital[1:] &= buf[:-1] == 0xC3
        capital[0] = False
        buf = np.where(capital, buf + np.uint8(32), buf)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], separators[buf])).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    # runs of whole words of bounded length: a hash does not depend on where its word stands
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + BLOCK_BYTES, "right")))
        run, s, e = buf[a : ends[j - 1]], starts[i:j] - a, ends[i:j] - a
        up, down = _POWERS.of(len(run))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_VALUES[run] * up)))
        hashes[i:j] = mix64((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) * _LENGTH_SALT)
        i = j
    at = np.cumsum([0, *(len(d) + 1 for d in docs)])
    return buf, starts, ends, hashes, np.searchsorted(starts, at)


def shingle_sets(docs: list[bytes], k: int = SHINGLE_WORDS) -> tuple[list[np.ndarray], np.ndarray]:
    """For each document its sorted distinct shingle hashes, and a 128-bit key of its whole word sequence."""
    _, _, _, words, at = word_spans(docs)
    n = len(words)
    base = [np.uint64(pow(_SHINGLE_BASE, e, 1 << 64)) for e in range(k)]
    if n >= k:
        rolled = np.zeros(n - k + 1, dtype=np.uint64)
        for j in range(k):
            rolled += words[j : n - k + 1 + j] * base[k - 1 - j]
        rolled = mix64(rolled)
    else:
        rolled = np.zeros(0, dtype=np.uint64)
    order = np.arange(n, dtype=np.uint64)
    local = order - np.repeat(at[:-1], np.diff(at)).astype(np.uint64)
    once = mix64(words + mix64(local + np.uint64(1)))
    again = mix64(words * np.uint64(3) ^ mix64(local + np.uint64(0x5851F42D4C957F2D)))
    sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(x))) for x in (once, again)]
    keys = np.stack([s[at[1:]] - s[at[:-1]] for s in sums], axis=1)
    sets = []
    for i in range(len(docs)):
        a, b = at[i], at[i + 1]
        if b - a >= k:
            sets.append(np.unique(rolled[a : b - k + 1]))
        elif b > a:
            short = np.asarray([b - a], dtype=np.uint64) * _LENGTH_SALT
            for w in words[a:b]:
                short = mix64(short ^ w)
            sets.append(short)
        else:
            sets.append(np.zeros(0, dtype=np.uint64))
    return sets, keys


class MinHash:
    """``size`` 32-bit minimum hashes of 64-bit sets."""

    def __init__(self, size: int, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.size = size
        self.mult = rng.integers(0, 1 << 31, size=size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.flip = rng.integers(0, (1 << 32) - 1, size=size, dtype=np.uint32)

    def of(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row for each set; an empty set has the largest value everywhere."""
        out = np.full((len(sets), self.size), np.uint32(0xFFFFFFFF), dtype=np.uint32)
        full = [i for i, s in enumerate(sets) if len(s)]
        if not full:
            return out
        flat = np.concatenate([sets[i] for i in full])
        flat = (flat ^ (flat >> np.uint64(32))).astype(np.uint32)
        at = np.cumsum([0, *(len(sets[i]) for i in full[:-1])])
        rows = np.empty((self.size, len(full)), dtype=np.uint32)
        for j in range(self.size):
            x = (flat ^ self.flip[j]) * self.mult[j]
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            rows[j] = np.minimum.reduceat(x, at)
        out[full] = rows.T
        return out
