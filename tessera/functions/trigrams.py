"""Resemblance of many texts with one query by trigrams, in numpy over a batch's characters.

A text's trigrams stand in the order of its words, repeats included. similarity
is the Jaccard similarity of all of them with the query's; word_similarity that
of the best extent, a run of consecutive trigrams. An extent that can't be
shortened without losing a trigram begins and ends with one of the query's,
ends where that one is new to it, and holds its first one only there. So each
place of a query's trigram starts one sweep, which ends before that trigram
comes again: over all starts at most (trigrams of the query) * (length) steps.
A sweep ends sooner once its other trigrams alone rule out a better extent.
"""

from __future__ import annotations

import re

import numpy as np

from .text import trigrams_of

WORD = re.compile(r"[^\W_]+")
#: Characters taken at once; steps that sweeps take together, before those left go one by one.
SLAB, STEPS = 1 << 20, 512


def coded(trigram: str) -> int:
    return sum(ord(c) << 21 * k for k, c in enumerate(trigram))


def resemblances(texts: list[str | None], query: str) -> tuple[np.ndarray, np.ndarray]:
    """similarity and word_similarity of each lower-cased text with the query; 0 for null, for texts without words, and all for such a query."""
    wanted = np.sort(np.array([coded(g) for g in trigrams_of(query)], np.int64))
    whole, best = np.zeros(len(texts)), np.zeros(len(texts))
    first, padded, size = 0, [], 0
    for k, t in enumerate(texts):
        words = WORD.findall(t or "")
        padded.append(f"  {'   '.join(words)} " if words else "")
        size += len(padded[-1])
        if size >= SLAB or k == len(texts) - 1:
            if len(wanted) and size:
                whole[first : k + 1], best[first : k + 1] = swept(padded, wanted)
            first, padded, size = k + 1, [], 0
    return whole, best


def swept(padded: list[str], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    doc = np.repeat(np.arange(len(padded)), [len(p) for p in padded])[:-2]
    inside = (chars[2:] != 32) | (chars[1:-1] != 32)  # else it runs over the end of a word
    code, doc = (chars[:-2] | chars[1:-1] << 21 | chars[2:] << 42)[inside], doc[inside]
    n, u = len(code), len(wanted)
    ours = wanted[np.minimum(np.searchsorted(wanted, code), u - 1)] == code
    # the places before and after of the same trigram in the same text
    order = np.argsort(code, kind="stable")
    same = (code[order][1:] == code[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    before, after = np.full(n, -1), np.searchsorted(doc, doc, "right")
    before[order[1:][same]] = order[:-1][same]
    after[order[:-1][same]] = order[1:][same]

    shared = np.bincount(doc[(before < 0) & ours], minlength=len(padded))
    kinds = np.bincount(doc[before < 0], minlength=len(padded))
    whole = shared / (u + kinds - shared)
    best = np.maximum(whole, (shared > 0) / u)

    start = np.flatnonzero(ours)
    of, end = doc[start], after[start]
    c, d = np.ones(len(start), np.int64), np.ones(len(start), np.int64)
    for k in range(1, STEPS + 1):
        # an extent has at most the text's shared trigrams, and loses no other that it has
        on = (start + k < end) & (shared[of] / (u + d - c) > best[of])
        start, of, end, c, d = start[on], of[on], end[on], c[on], d[on]
        if not len(start):
            return whole, best
        p = start + k
        new = before[p] < start
        hit = new & ours[p]
        d += new
        c += hit
        np.maximum.at(best, of[hit], (c / (u + d - c))[hit])
    for i, t, e in zip(start, of, end, strict=True):
        new = before[i + 1 : e] < i
        some, every = 1 + np.cumsum(new & ours[i + 1 : e]), 1 + np.cumsum(new)
        best[t] = max(best[t], np.max(some / (u + every - some), initial=0.0))
    return whole, best
