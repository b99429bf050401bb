"""Word and shingle hashes of whole Arrow text columns in numpy."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

M64 = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds); input and output are uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit numbers."""
    steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed * 0xD1342543DE82EF95 & M64)
    return mix(steps) | np.uint64(1)


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
SHORT = 15  # bytes of a word that two 64-bit numbers hold as they are, beside its length
_LENGTH = np.arange(SHORT + 1)
_LOW_MASK = np.array([(1 << 8 * min(n, 8)) - 1 for n in _LENGTH.tolist()], dtype=np.uint64)
_HIGH_MASK = np.array([(1 << 8 * max(n - 8, 0)) - 1 for n in _LENGTH.tolist()], dtype=np.uint64)
_FAMILY = constants(4, 1)


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null is empty."""
    binary = column.cast(pa.large_string()).cast(pa.large_binary())
    if binary.null_count:
        binary = binary.fill_null(b"")
    offsets = np.frombuffer(binary.buffers()[1], dtype=np.int64)[binary.offset : binary.offset + len(binary) + 1]
    data = np.frombuffer(binary.buffers()[2], dtype=np.uint8) if binary.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(data) else data, offsets - offsets[0]


def _eight_bytes(padded: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; ``padded`` goes on for 16 bytes at least behind the last place."""
    cells, cell, shift = padded.view("<u8"), at >> 3, ((at & 7) << 3).astype(np.uint64)
    return (cells[cell] >> shift) | (cells[cell + 1] << (np.uint64(63) - shift) << np.uint64(1))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first hash, second hash, row, first byte and end byte as an n x 2 array) of the words of each row, in order.

    Words are the runs of bytes other than the six ASCII white-space characters; they never cross rows. A word of up to ``SHORT`` bytes is taken as it is into two
    numbers, its length beside it, so unlike words are unlike numbers; a longer one gives the 127 bits of a BLAKE2b digest, apart from those of all short
    words. Both hashes are one-to-one mixes of these numbers when the other is given: words that agree in one are told apart by the other.
    """
    if lower:
        data = _LOWER[data]
    nonspace = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.zeros(len(data), dtype=bool)
    before[1:] = nonspace[:-1]
    starts = np.flatnonzero(nonspace & (~before | edge[:-1]))
    after = np.zeros(len(data), dtype=bool)
    after[:-1] = nonspace[1:]
    ends = np.flatnonzero(nonspace & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    length = ends - starts
    padded = np.zeros((len(data) + 39) // 8 * 8, dtype=np.uint8)
    padded[: len(data)] = data
    known = np.minimum(length, SHORT)
    low = _eight_bytes(padded, starts) & _LOW_MASK[known]
    high = (_eight_bytes(padded, starts + 8) & _HIGH_MASK[known]) | (known.astype(np.uint64) << np.uint64(56))
    for i in np.flatnonzero(length > SHORT).tolist():
        digest = hashlib.blake2b(data[starts[i] : ends[i]], digest_size=16).digest()
        low[i], high[i] = int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little") | 1 << 63
    k = _FAMILY
    first, second = mix(mix(low ^ k[0]) + high * k[1]), mix(mix(high ^ k[2]) + low * k[3])
    return first, second, rows, np.stack([starts, ends], axis=1)


def window_hashes(words: np.ndarray, rows: np.ndarray, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, index of the first word) of all windows of ``size`` consecutive words of one row."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.flatnonzero(rows[:n] == rows[size - 1 :])
    value = np.zeros(n, dtype=np.uint64)
    for k, c in enumerate(constants(size, seed)):
        value += words[k : n + k] * c
    return mix(value[first]), first
