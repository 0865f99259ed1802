"""Longest common subsequences and merges of word sequences, in space far below the product of their lengths."""

from __future__ import annotations

import re
from math import isqrt

import numpy as np

# Fixed value: white space of texts.
SPACE = re.compile("[\\t\\n\\v\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+")


def next_row(row: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """The lengths for one element more of the left: each is the largest of those above, before, and before above where the elements are equal."""
    out = row.copy()
    out[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + equal))
    return out


def common(a: list, b: list) -> list:
    """The longest common subsequence; of several the one that a walk from the ends meets, which leaves out a's element where it may leave out either.

    Only about every sqrt(len(a))-th row of the table is kept; the walk works out
    the rows between two of them again as it comes by.
    """
    number = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    x, y = np.array([number[w] for w in a], np.int64), np.array([number[w] for w in b], np.int64)
    step = isqrt(len(a)) + 1
    row = np.zeros(len(b) + 1, np.int32)
    kept = [row]
    for i in range(len(a)):
        row = next_row(row, y == x[i])
        if (i + 1) % step == 0:
            kept.append(row)
    out, i, j = [], len(a), len(b)
    rows, first = [], len(a) + 1
    while i and j:
        if i - 1 < first:
            first = (i - 1) // step * step
            rows = [kept[first // step]]
            for k in range(first, min(first + step, len(a))):
                rows.append(next_row(rows[-1], y == x[k]))
        if x[i - 1] == y[j - 1]:
            out.append(a[i - 1])
            i, j = i - 1, j - 1
        elif rows[i - 1 - first][j] >= rows[i - first][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


def gaps(words: list[str], marks: list[str]) -> list[list[str]]:
    """What stands before the first of the marks, between it and the next, and so on; at last the rest."""
    out, at = [], 0
    for m in marks:
        to = words.index(m, at)
        out.append(words[at:to])
        at = to + 1
    return [*out, words[at:]]


def merged(a: str | None, b: str | None) -> str | None:
    """Both texts' words in one: common ones once, in between first those that only the left has there, then the right's. An empty or null side gives the other."""
    if a == b or not b:
        return a
    if not a:
        return b
    left, right = ([w for w in SPACE.split(t) if w] for t in (a, b))
    marks = common(left, right)
    out = []
    for own, other, mark in zip(gaps(left, marks), gaps(right, marks), [[m] for m in marks] + [[]], strict=True):
        there = set(other)
        out += [w for w in own if w not in there] + other + mark
    return " ".join(out)
