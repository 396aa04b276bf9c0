"""Vectorised character n-grams inside words, hashed, over lists of whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .words import _BASE, _INVERSE, _power, mix

U64 = np.uint64
STEP_CHARS = 1 << 18
_MULTIPLY = U64(0x9E3779B97F4A7C15)

_letters: list[np.ndarray] = []


def letter_table() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def code_points(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, lower-cased code points with a line feed before each text and after the last, offsets) of rows of about STEP_CHARS. The line feed before a text
    is its own, so that n-grams that begin with the blank before its first word are too."""
    row = 0
    while row < len(texts):
        part, size = [], 0
        for text in texts[row:]:
            if part and size + len(text or "") > STEP_CHARS:
                break
            part.append((text or "").lower())
            size += len(part[-1]) + 1
        points = np.frombuffer(("\n" + "\n".join(part) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        yield row, row + len(part), points, np.concatenate([[0], np.cumsum([len(x) + 1 for x in part])])
        row += len(part)


def grams(points: np.ndarray, orders: range, bits: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(order, start of each n-gram, its bucket of 2**bits). Other characters than letters count as blanks; an
    n-gram may begin or end with one blank, which marks the start or end of a word, and holds none inside."""
    letter = letter_table()[points]
    signs = np.where(letter, points, 0x20).astype(U64)
    state = signs.copy()
    solid = letter.copy()  # the n-gram so far, but for its first sign, is of letters only
    solid[:] = True
    for order in range(2, orders.stop):
        n = len(points) - order + 1
        if n <= 0:
            return
        state = state[:n] * _MULTIPLY + signs[order - 1 :]
        if order > 2:
            solid = solid[:n] & letter[order - 2 : order - 2 + n]
        else:
            solid = solid[:n]
        if order in orders:
            whole = solid & (letter[:n] | letter[order - 1 :]) if order == 2 else solid
            at = np.flatnonzero(whole)
            yield order, at, (mix(state[at] + U64(order)) >> U64(64 - bits)).astype(np.int64)


def letter_runs(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, which code points are letters) of the words, runs of letters. The last code point must be none."""
    letter = letter_table()[points]
    turn = np.diff(letter.astype(np.int8), prepend=0)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), letter


def run_hashes(points: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.zeros(len(points) + 1, U64)
    np.cumsum(mix(points.astype(U64) + U64(1)) * _power(_BASE, len(points)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(points))[starts])
