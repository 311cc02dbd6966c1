"""Rule flags of all windows of one text at once, on arrays of its letters."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

_PIECE = 1 << 16  # windows looked at together
_PAIRS = str.maketrans("ACGU", "UGCA")
_NO_END = np.int64(1) << 62


def letter_windows(text: str, k: int, gc_min: float, gc_max: float, run: int, gc_run: int, palindrome: int) -> tuple:
    """(windows, last position, least window, greatest complement, windows by flag: gc, run, gc_run, palindrome, any)."""
    count = len(text) - k + 1
    least = greatest = None
    sums = np.zeros(5, np.int64)
    for start in range(0, count, _PIECE):
        piece = text[start : start + _PIECE + k - 1]
        letters = _letters(piece)
        pairs = _letters(piece.translate(_PAIRS))
        sums += _flags(letters, pairs, k, gc_min, gc_max, run, gc_run, palindrome)
        i, j = _extreme(letters, k, np.min), _extreme(pairs, k, np.max)
        first, last = piece[i : i + k], piece[j : j + k].translate(_PAIRS)
        least = first if least is None else min(least, first)
        greatest = last if greatest is None else max(greatest, last)
    return (count, count, least, greatest, *(int(x) for x in sums))


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)


def _extreme(letters: np.ndarray, k: int, pick) -> int:  # noqa: ANN001
    """Where the least (greatest) window begins: candidates are thinned letter by letter."""
    at = np.arange(len(letters) - k + 1)
    for i in range(k):
        seen = letters[at + i]
        at = at[seen == pick(seen)]
        if len(at) == 1:
            break
    return int(at[0])


def _within(starts: np.ndarray, size: int, k: int, n: int) -> np.ndarray:
    """Windows that hold a stretch of ``size`` letters beginning at a true place."""
    if size > k:
        return np.zeros(n, bool)
    total = np.concatenate([[0], np.cumsum(starts)])
    span = k - size + 1
    return total[span : span + n] > total[:n]


def _stretches(true: np.ndarray, size: int) -> np.ndarray:
    """Places at which ``size`` trues in a row begin."""
    total = np.concatenate([[0], np.cumsum(true)])
    return total[size:] - total[:-size] == size


def _flags(letters: np.ndarray, pairs: np.ndarray, k: int, gc_min: float, gc_max: float, run: int, gc_run: int, palindrome: int) -> np.ndarray:
    n = len(letters) - k + 1
    strong = (letters == ord("G")) | (letters == ord("C"))
    total = np.concatenate([[0], np.cumsum(strong)])
    share = (total[k:] - total[:n]) / k
    gc = (share < gc_min) | (share > gc_max)
    equal = letters[1:] == letters[:-1]
    runs = _within(_stretches(equal, run - 1), run, k, n)
    strong_runs = _within(_stretches(strong, gc_run), gc_run, k, n)
    folded = _folded(letters, pairs, k, palindrome, n)
    return np.array([np.count_nonzero(x) for x in (gc, runs, strong_runs, folded, gc | runs | strong_runs | folded)])


def _folded(letters: np.ndarray, pairs: np.ndarray, k: int, size: int, n: int) -> np.ndarray:
    """Windows with a stretch whose reverse complement is in the window too.

    Stretches at p and p + d are such a pair if the letters at p + i and
    p + d + size - 1 - i are complements for all i; the nearest d counts.
    """
    if size > k:
        return np.zeros(n, bool)
    last = np.full(len(letters) - size + 1, _NO_END)
    for d in range(k - size, -1, -1):
        places = len(last) - d
        if places <= 0:
            continue
        match = np.ones(places, bool)
        for i in range(size):
            j = d + size - 1 - i
            match &= letters[i : i + places] == pairs[j : j + places]
        at = np.flatnonzero(match)
        last[at] = at + d
    reach = np.minimum.accumulate(last[::-1])[::-1][:n]
    return reach <= np.arange(n) + (k - size)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
