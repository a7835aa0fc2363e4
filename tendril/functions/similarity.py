"""Name similarity, 0 to 100, on normalised Indel distance."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _places(a: str) -> dict[str, int]:
    """Where each character is, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(a):
        out[c] = out.get(c, 0) | 1 << k
    return out


def _common(places: dict[str, int], n: int, b: str) -> int:
    full = state = (1 << n) - 1
    for c in b:
        hit = state & places.get(c, 0)
        state = ((state + hit) | (state - hit)) & full
    return n - state.bit_count()


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a row of bits at a time."""
    if len(a) > len(b):
        a, b = b, a
    return _common(_places(a), len(a), b)


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * common(a, b) / total if total else 100.0


def _by_words(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    x, y = set(a.split()), set(b.split())
    return sorted(x & y), sorted(x - y), sorted(y - x)


def word_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def word_set_ratio(a: str, b: str) -> float:
    both, left, right = _by_words(a, b)
    if both and not (left and right):
        return 100.0
    x, y = " ".join(left), " ".join(right)
    if not (both or (x and y)):
        return 0.0
    shared = len(" ".join(both))
    gap = 1 if both else 0
    long_x, long_y = shared + gap + len(x), shared + gap + len(y)
    apart = len(x) + len(y) - 2 * common(x, y)
    best = 1 - apart / (long_x + long_y)
    if both:
        best = max(best, 1 - (gap + len(x)) / (shared + long_x), 1 - (gap + len(y)) / (shared + long_y))
    return 100.0 * best


def window_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The best ratio of the shorter text with any window of the longer one
    that is as long, or is cut by its ends; 0 if it can't be above ``least``."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if not n:
        return 100.0 if not m else 0.0
    places = _places(a)
    shared = _common(places, n, b)
    if 200.0 * shared <= least * (n + shared):  # a window has no more in common
        return 0.0
    windows = [b[max(0, k) : k + n] for k in range(1 - n, m)]
    best = max(200.0 * _common(places, n, w) / (n + len(w)) for w in windows)
    if n == m:
        best = max(best, max(ratio(b, a[max(0, k) : k + n]) for k in range(1 - n, n)))
    return best


def weighted_ratio(a: str, b: str, least: float = 0.0) -> float:
    """The weighted ratio, or something up to ``least`` if it isn't above."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    best = max(ratio(a, b), least)
    if longer < 1.5:
        return max(best, 0.95 * max(word_sort_ratio(a, b), word_set_ratio(a, b)))
    scale = 0.9 if longer <= 8.0 else 0.6
    both, left, right = _by_words(a, b)
    if both:
        best = max(best, 95.0 * scale)
    else:
        floor = best / (0.95 * scale)
        best = max(best, 0.95 * scale * window_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())), floor))
        best = max(best, 0.95 * scale * window_ratio(" ".join(left), " ".join(right), best / (0.95 * scale)))
    return max(best, scale * window_ratio(a, b, best / scale))


def name_score(query: str | None, choice: str | None) -> float:
    if not query or not choice:
        return 0.0
    if query == choice:
        return 100.0
    best = max(word_set_ratio(query, choice), word_sort_ratio(query, choice))
    return best if best >= 100.0 else weighted_ratio(query, choice, best)


@F.pandas_udf(DoubleType())
def name_match_score(query: pd.Series, choice: pd.Series) -> pd.Series:
    """The composite score of normalised names, in Arrow batches."""
    return pd.Series([name_score(q, c) for q, c in zip(query, choice, strict=True)], dtype="float64")
