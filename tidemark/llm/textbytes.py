"""The texts of a batch as one byte array, with words, lines and 64-bit hashes found by numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multiplier of the rolling hash; 3 modulo 4, so that neighbours that swap places differ.
BASE = 0x9E3779B97F4A7C17
U64 = np.uint64
#: Bytes that are hashed at once, whatever the length of a text.
BLOCK = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


@lru_cache(1)
def byte_values() -> np.ndarray:
    """A random odd 64-bit number for each byte."""
    return np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE ** i and its inverse modulo 2 ** 64, for i up to n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        steps = [np.full(size, U64(b), np.uint64) for b in (BASE, inverse)]
        for s in steps:
            s[0] = 1
        _powers[:] = [np.multiply.accumulate(s) for s in steps]
    return _powers[0], _powers[1]


def forget() -> None:
    """Drop the powers; the next use makes them again."""
    _powers.clear()


class TextBytes:
    """data: all bytes; starts, ends: of each text in data. With lower, A-Z become a-z."""

    def __init__(self, column: pa.Array, lower: bool = False):
        column = pc.fill_null(column, "").cast(pa.large_string())
        if column.offset:
            column = pa.concat_arrays([column])
        offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1 + column.offset)[column.offset :]
        buffer = column.buffers()[2]
        whole = np.frombuffer(buffer, np.uint8) if buffer is not None else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.starts, self.ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        if lower:
            table = np.arange(256, dtype=np.uint8)
            table[65:91] += 32
            self.data = table[self.data]

    def __len__(self) -> int:
        return len(self.starts)

    def words(self, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of each maximal run of bytes with is_word, within a text."""
        inside = is_word[self.data]
        before = np.empty(len(inside), bool)
        before[1:], before[:1] = inside[:-1], False
        before[self.starts[self.starts < len(inside)]] = False
        starts = np.flatnonzero(inside & ~before)
        after = np.empty(len(inside), bool)
        after[:-1], after[-1:] = inside[1:], False
        after[self.ends[self.ends > 0] - 1] = False
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(self.ends, starts, side="right")

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of the bytes of each range; ranges come in order and don't overlap. It is done
        block by block, so that what it needs beside the text is bounded."""
        out = np.empty(len(starts), np.uint64)
        long = np.flatnonzero(ends - starts > BLOCK)
        a = 0
        while a < len(starts):
            base = starts[a]
            next_long = long[np.searchsorted(long, a)] if len(long) and a <= long[-1] else len(starts)
            if next_long == a:
                out[a] = self.long_sum(int(starts[a]), int(ends[a]))
                a += 1
                continue
            b = min(int(np.searchsorted(starts, base + BLOCK)), int(next_long))
            stop = ends[b - 1]
            power, inverse = powers(2 * BLOCK)
            sums = np.zeros(stop - base + 1, np.uint64)
            np.cumsum(byte_values()[self.data[base:stop]] * power[: stop - base], out=sums[1:])
            out[a:b] = (sums[ends[a:b] - base] - sums[starts[a:b] - base]) * inverse[starts[a:b] - base]
            a = b
        return mix(out)

    def long_sum(self, start: int, end: int) -> int:
        total, power = 0, powers(2 * BLOCK)[0]
        for k in range(start, end, BLOCK):
            part = byte_values()[self.data[k : min(k + BLOCK, end)]]
            total += int((part * power[: len(part)]).sum(dtype=np.uint64)) * pow(BASE, k - start, 1 << 64)
        return total % (1 << 64)


def equal_ranges(x: np.ndarray, x_starts: np.ndarray, x_ends: np.ndarray, y: np.ndarray, y_starts: np.ndarray, y_ends: np.ndarray) -> np.ndarray:
    """Whether the bytes of each range of x are those of the range of y of the same number."""
    size = x_ends - x_starts
    same = size == y_ends - y_starts
    at = np.flatnonzero(same & (size > 0))
    if len(at):
        size = size[at]
        first = np.cumsum(size) - size
        step = np.arange(int(size.sum())) - np.repeat(first, size)
        same[at] = np.logical_and.reduceat(x[np.repeat(x_starts[at], size) + step] == y[np.repeat(y_starts[at], size) + step], first)
    return same


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """True for the bytes in these inclusive spans."""
    found = np.zeros(256, bool)
    for a, b in spans:
        found[a : b + 1] = True
    return found


#: Words of [^\x20\x09-\x0D]+ and of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, byte by byte: every byte of a
#: character beyond ASCII is in both.
BLANK_WORDS = ~byte_class((0x20, 0x20), (0x09, 0x0D))
ALNUM_WORDS = ~byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """A rolling hash of each n consecutive word hashes; len(h) - n + 1 of them."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = powers(len(h))
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=sums[1:])
    return mix((sums[n:] - sums[:m]) * inverse[:m])


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """True at each position inside any of the ranges."""
    change = np.bincount(starts, minlength=size + 1) - np.bincount(ends, minlength=size + 1)
    return np.cumsum(change)[:size] > 0
