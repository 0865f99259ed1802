"""Words, shingles and their 64-bit hashes for a batch of texts, in numpy over the UTF-8 bytes."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse modulo 2^64, and a random value for each byte (seeded, so that all workers agree).
P = np.uint64(0x9E3779B97F4A7C15)
P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64)
MARK = np.isin(np.arange(256), np.frombuffer(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", np.uint8))
MIX1, MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Bytes hashed at once.
SLAB = 1 << 19

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^0 .. P^(n-1) and their inverses, kept for the next call."""
    if len(_powers[0]) < n:
        size = max(n, SLAB + 1)
        for k, p in enumerate((P, P_INVERSE)):
            steps = np.full(size, p, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: every bit of x reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * MIX1
    x = (x ^ (x >> np.uint64(27))) * MIX2
    return x ^ (x >> np.uint64(31))


def run_hashes(b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs b[start:end], which ascend; about SLAB bytes at a time (a hash doesn't depend on where its run stands)."""
    out, k = np.empty(len(start), np.uint64), 0
    while k < len(start):
        to = max(k + 1, int(np.searchsorted(end, start[k] + SLAB, "right")))
        low, high = start[k], end[to - 1]
        up, down = powers(int(high - low) + 1)
        total = np.zeros(high - low + 1, np.uint64)
        np.cumsum(BYTE[b[low:high]] * up[:-1], out=total[1:])
        i, j = start[k:to] - low, end[k:to] - low
        out[k:to] = mixed((total[j] - total[i]) * down[i])
        k = to
    return out


class Words:
    """The words `[^\\x20\\x09-\\x0D]+` of a batch of texts after lower-casing A-Z.

    bytes: all texts after one another, a space behind each; start, end: each
    word's place in bytes; hash: its 64-bit hash; doc: the number of its text;
    first: for each text, the number of its first word, and at the end the
    number of words. bare: without up to four ASCII punctuation marks on either
    side of a word, as long as something stays.
    """

    def __init__(self, texts: list[str | None], bare: bool = False):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        b = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        b = b + ((b >= 65) & (b <= 90)).astype(np.uint8) * np.uint8(32)
        space = (b == 32) | ((b >= 9) & (b <= 13))
        edge = np.flatnonzero(np.diff(space, prepend=True))  # each word's start, then its end
        self.bytes, self.start, self.end = b, edge[0::2], edge[1::2]
        for _ in range(4 if bare else 0):
            long = self.end - self.start > 1
            self.end = self.end - (MARK[b[self.end - 1]] & long)
            self.start = self.start + (MARK[b[self.start]] & (self.end - self.start > 1))
        self.hash = run_hashes(b, self.start, self.end)
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self.first = np.concatenate([[0], np.searchsorted(self.start, ends)]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(raw)), np.diff(self.first))


def shingle_sets(w: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, in ascending order of hash, and where each text's begin.

    A text of fewer words than size has its whole sequence as its only shingle;
    a text without words has none.
    """
    n = np.diff(w.first)
    h = w.hash
    s = np.zeros(max(0, len(h) - size + 1), np.uint64)
    for k in range(size):
        s = s * P + h[k : len(h) - size + 1 + k]
    inside = (w.doc[: len(s)] == w.doc[size - 1 :]) if len(s) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < size))
    whole = np.zeros(len(short), np.uint64)
    for k in range(size - 1):
        has = n[short] > k
        whole[has] = whole[has] * P + h[w.first[short[has]] + k]
    whole += n[short].astype(np.uint64)  # never that of a longer sequence
    docs = np.concatenate([w.doc[: len(s)][inside], short])
    sets = mixed(np.concatenate([s[inside], whole]))
    order = np.lexsort((sets, docs))
    docs, sets = docs[order], sets[order]
    new = np.ones(len(sets), bool)
    new[1:] = (sets[1:] != sets[:-1]) | (docs[1:] != docs[:-1])
    docs, sets = docs[new], sets[new]
    return sets, np.searchsorted(docs, np.arange(len(n) + 1))
