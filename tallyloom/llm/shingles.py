"""Word shingles as 64-bit hashes, vectorised over the bytes of many texts.

A-Z is lower-cased; words are runs of bytes other than space and the control characters 9 to 13.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_STEP = U(0x9E3779B97F4A7C15)
_PLACE = _rng.integers(0, 1 << 63, 64, dtype=np.uint64) * U(2) + U(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
SEGMENT = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit integers."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def word_hashes(data: np.ndarray) -> np.ndarray:
    """One hash per word.  Long texts go through in segments cut at blanks, so memory follows the words."""
    parts, at = [], 0
    while at < len(data):
        end = min(at + SEGMENT, len(data))
        while end < len(data):
            blanks = np.flatnonzero(_BLANK[data[max(at, end - 4096):end]])
            if len(blanks):
                end = max(at, end - 4096) + int(blanks[-1]) + 1
                break
            end = min(end + SEGMENT, len(data))
        seg = data[at:end]
        at = end
        full = np.flatnonzero(~_BLANK[seg])
        if not len(full):
            continue
        first = np.empty(len(full), bool)
        first[0] = True
        np.not_equal(full[1:], full[:-1] + 1, out=first[1:])
        begins = np.flatnonzero(first)
        place = np.arange(len(full)) - np.repeat(begins, np.diff(np.append(begins, len(full))))
        powers = np.full(int(place.max()) + 1, _STEP, np.uint64)
        powers[0] = U(1)
        powers = np.multiply.accumulate(powers)
        sums = np.add.reduceat(_BYTE[_LOWER[seg[full]]] * powers[place], begins)
        parts.append(mix(sums))
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingle_set(data: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; fewer words than ``width`` make one shingle, no word makes none."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    k = min(n, width)
    total = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        total += words[j:n - k + 1 + j] * _PLACE[j]
    return np.unique(mix(total + U(k)))


def text_bytes(column: pa.Array) -> list[np.ndarray]:
    """UTF-8 bytes of each text without copying; null counts as empty."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else []
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    holds = column.is_valid().to_pylist()
    return [data[ends[i]:ends[i + 1]] if holds[i] else data[:0] for i in range(len(column))]
