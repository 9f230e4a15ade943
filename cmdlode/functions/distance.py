"""Edit distances of many pairs of long texts at once, in numpy.

Myers' algorithm holds a column of the distance table as bits of differences, 64 characters a word.
All pairs of a batch take a step together: 0.33 ms a pair of up to 710 characters, as measured for 4000 pairs.
The module imports nothing of the package and is sent to workers by value.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd

_TOGETHER = 4000  # pairs that take their steps together
_TABLE_BYTES = 64 << 20  # of matches by character; above that, each step compares
_ONE = np.uint64(1)
_TOP = np.uint64(63)


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Code points from 1, a row for each text; 0 behind its end."""
    codes = np.zeros((len(texts), width), dtype=np.uint32)
    for row, text in zip(codes, texts):
        row[: len(text)] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4") + 1
    return codes


def _packed(equal: np.ndarray) -> np.ndarray:
    """Flags (pairs, places) as words of 64 (words, pairs)."""
    return np.ascontiguousarray(np.packbits(equal, axis=1, bitorder="little").view("<u8").T)


def _distances(a: list[str], b: list[str]) -> np.ndarray:
    """Distances of pairs of texts that are not empty."""
    n, m = (np.array([len(t) for t in texts]) for texts in (a, b))
    words = -(-int(m.max()) // 64)
    text, pattern = _codes(a, int(n.max())), _codes(b, words * 64)
    alphabet, places = np.unique(text, return_inverse=True)
    places = np.ascontiguousarray(places.reshape(text.shape).T)
    small = len(alphabet) * words * len(a) * 8 <= _TABLE_BYTES
    # Matches by word, then (character, pair) in one row.
    table = np.stack([_packed(pattern == c) for c in alphabet], axis=1).reshape(words, -1) if small else None
    every = np.arange(len(a))
    last, bit = (m - 1) // 64, ((m - 1) % 64).astype(np.uint64)
    ends, first_end = [last == w for w in range(words)], int(last.min())
    up = np.full((words, len(a)), np.iinfo(np.uint64).max, dtype=np.uint64)
    down = np.zeros_like(up)
    ones, none = np.ones(len(a), dtype=np.uint64), np.zeros(len(a), dtype=np.uint64)
    score = m.copy()
    for step in range(text.shape[1]):
        if small:
            at = places[step] * len(a) + every
        else:
            match = _packed(pattern == text[:, step, None])
        goes_on = step < n
        more, less = ones, none
        for w in range(words):
            eq, pv, mv = table[w].take(at) if small else match[w], up[w], down[w]
            xv = eq | mv
            eq |= less
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph = xh | pv
            np.invert(ph, out=ph)
            ph |= mv
            xh &= pv  # down along the row
            if w >= first_end:
                here = ends[w] & goes_on
                score += here * (((ph >> bit) & _ONE).view(np.int64) - ((xh >> bit) & _ONE).view(np.int64))
            more_out, less_out = ph >> _TOP, xh >> _TOP
            ph <<= _ONE
            ph |= more
            xh <<= _ONE
            xh |= less
            np.bitwise_and(ph, xv, out=mv)
            xv |= ph
            np.invert(xv, out=xv)
            np.bitwise_or(xh, xv, out=pv)
            more, less = more_out, less_out
    return score


def ratios_at_least(a: list[str | None], b: list[str | None], longest: np.ndarray, floor: float) -> np.ndarray:
    """Whether ``1 - distance / longest >= floor``; not for nulls, nor where ``longest`` is 0."""
    sizes = np.array([-1 if x is None or y is None else max(len(x), len(y)) for x, y in zip(a, b)], dtype=np.int64)
    apart = np.array([0 if x is None or y is None else abs(len(x) - len(y)) for x, y in zip(a, b)], dtype=np.int64)
    size = np.where(longest > 0, longest, 1).astype(np.float64)
    able = (sizes >= 0) & (longest > 0) & (1.0 - apart / size >= floor)  # no distance is below that of the lengths
    order = np.flatnonzero(able)
    order = order[np.argsort(sizes[order], kind="stable")]
    found = np.zeros(len(a), dtype=bool)
    for i in range(0, len(order), _TOGETHER):
        part = order[i : i + _TOGETHER]
        empty = np.array([not a[j] or not b[j] for j in part])
        distance, full = sizes[part], part[~empty]
        if len(full):
            distance[~empty] = _distances([a[j] for j in full], [b[j] for j in full])
        found[part] = 1.0 - distance / size[part] >= floor
    return found


def ratio_udf(floor: float) -> Callable[[pd.Series, pd.Series, pd.Series], pd.Series]:
    """``ratios_at_least`` for a pandas UDF."""

    def close(a: pd.Series, b: pd.Series, longest: pd.Series) -> pd.Series:
        return pd.Series(ratios_at_least(a.tolist(), b.tolist(), longest.fillna(0).to_numpy(dtype=np.int64), floor))

    return close
