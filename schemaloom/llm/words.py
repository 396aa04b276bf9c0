"""Vectorised words, word hashes and shingle hashes over whole Arrow string columns.

A word is a run of bytes other than space and tab..carriage return (UTF-8 never uses those bytes
inside a longer character). Case folding is A-Z only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
SHINGLE = 5
#: Texts are gone through in steps of about so many bytes: arrays have eight bytes for each, and there are two or three at a time.
STEP_BYTES = 1 << 18
#: Powers up to this one are kept.
POWERS = (1 << 20) + 65536

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
WORD_BYTE = ~_space
#: Letters, digits and all bytes of longer characters: words without punctuation.
PLAIN_BYTE = np.array([i >= 0x80 or chr(i).isalnum() for i in range(256)])
FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudo-random 64-bit values."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BYTE = stream(11, 256)
_FOLDED = _BYTE[FOLD]
_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = U64(0x9E3779B97F4A7C15)
_WEIGHTS = stream(23, SHINGLE) | U64(1)
_SHORT = stream(37, SHINGLE)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        full = np.full(max(n, POWERS), base, U64)
        full[0] = 1
        have = np.cumprod(full, dtype=U64)
        if n <= POWERS:  # what longer texts need is made for them alone
            _powers[base] = have
    return have[:n]


def steps(column: pa.Array | pa.ChunkedArray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of consecutive rows of about limit bytes; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if not n:
        return
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None and column.buffers()[2].size else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, side="right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def spans(data: np.ndarray, at: np.ndarray, in_word: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends, and the index of each row's first word (with one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    word = in_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    gap = np.empty(len(data) + 1, bool)
    gap[0] = gap[-1] = True
    np.logical_not(word, out=gap[1:])
    starts = np.flatnonzero(word & (gap[:-1] | edge[:-1]))
    gap[:-1] = ~word
    gap[-1] = True
    ends = np.flatnonzero(word & (gap[1:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A hash of every word: the sum of what its bytes give, each mixed with its place in the word. No two pairs of byte and place are related, as powers of one base would be."""
    n = len(data)
    if not n:
        return np.zeros(0, U64)
    value, begins = np.arange(n, dtype=U64), np.zeros(n, U64)
    begins[starts] = starts
    np.maximum.accumulate(begins, out=begins)
    value -= begins  # the place in the word; what lies between words is of no account
    del begins
    value *= _PLACE
    value += (_FOLDED if fold else _BYTE)[data]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0)):  # as mix, but in place: these are the largest arrays there are
        value ^= value >> U64(shift)
        if factor:
            value *= U64(factor)
    np.cumsum(value, out=value)
    return mix(value[ends - 1] - np.where(starts > 0, value[starts - 1], U64(0)))


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word 5-grams of the rows, and each row's first index. A row of 1 to 4 words gives one: its whole sequence."""
    starts, ends, first = spans(data, at)
    words = word_hashes(data, starts, ends)
    counts = np.diff(first)
    made = np.where(counts >= SHINGLE, counts - SHINGLE + 1, (counts > 0).astype(np.int64))
    out_at = np.concatenate([[0], np.cumsum(made)])
    out = np.empty(out_at[-1], U64)
    if len(words) >= SHINGLE:
        whole = sum(words[k : len(words) - SHINGLE + 1 + k] * _WEIGHTS[k] for k in range(SHINGLE))
        long = counts >= SHINGLE
        rows = np.repeat(np.flatnonzero(long), made[long])
        within = np.arange(len(rows)) - np.repeat(np.cumsum(made[long]) - made[long], made[long])
        out[out_at[rows] + within] = mix(whole[first[rows] + within])
    for r in np.flatnonzero((counts > 0) & (counts < SHINGLE)):
        own = words[first[r] : first[r + 1]]
        out[out_at[r]] = mix(np.sum(own * _WEIGHTS[: len(own)], dtype=U64).reshape(1) ^ _SHORT[len(own)])[0]
    return out, out_at


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    for row, end, data, at in steps(column):
        hashes, first = shingles(data, at)
        for r in range(end - row):
            own = np.sort(hashes[first[r] : first[r + 1]])
            yield own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) else own
