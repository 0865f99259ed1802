"""Common substrings and containment for batches of strings, by rolling hashes in numpy."""

from __future__ import annotations

import numpy as np

#: An odd multiplier and its inverse: the hash of a run is the sum of its characters, mixed, times ascending powers of it, modulo 2^64.
P, INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Characters of a fingerprint's run, and runs a window: a string of RUN + WINDOW - 1 characters has a fingerprint.
RUN, WINDOW = 20, 21


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(of: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, of, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Strings:
    """Strings after one another, with hashes of all that comes before each character."""

    def __init__(self, strings: list[str]):
        raw = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.down = powers(INVERSE, len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(mixed(raw + np.uint64(1)) * powers(P, len(raw)), out=self.total[1:])

    def runs(self, which: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every run of length[k] characters in string which[k], and k for each. A hash depends on the run alone."""
        many = self.size[which] - length + 1
        of = np.repeat(np.arange(len(which)), many)
        i = self.first[which][of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        return mixed((self.total[i + length[of]] - self.total[i]) * self.down[i]), of


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """The length of the longest common substring of each a and b.

    If a length is shared, so are all shorter ones: all pairs halve their range of
    lengths at once, by whether any run's hash of one is among the other's.
    """
    sa, sb = Strings(a), Strings(b)
    low, high = np.zeros(len(a), np.int64), np.minimum(sa.size, sb.size)
    while len(open_ := np.flatnonzero(low < high)):
        middle = (low[open_] + high[open_] + 1) // 2
        ha, ka = sa.runs(open_, middle)
        hb, kb = sb.runs(open_, middle)
        tag = mixed(np.arange(len(open_), dtype=np.uint64))
        shared = np.zeros(len(open_), bool)
        shared[ka[np.isin(ha ^ tag[ka], hb ^ tag[kb])]] = True
        low[open_[shared]] = middle[shared]
        high[open_[~shared]] = middle[~shared] - 1
    return low


def fingerprints(strings: list[str]) -> list[np.ndarray]:
    """The different hashes that are smallest in some WINDOW consecutive runs of RUN characters of each string; none of shorter strings.

    A window of a string's runs is a window of every string that contains it, so
    the fingerprints of the one are among those of the other.
    """
    s = Strings(strings)
    out = []
    long = np.flatnonzero(s.size >= RUN + WINDOW - 1)
    hashes, of = s.runs(long, np.full(len(long), RUN, np.int64))
    ends = np.searchsorted(of, np.arange(len(long)), "right")
    begin = dict(zip(long.tolist(), np.append(0, ends[:-1]).tolist(), strict=True)) if len(long) else {}
    end = dict(zip(long.tolist(), ends.tolist(), strict=True))
    for k in range(len(strings)):
        if k not in begin:
            out.append(np.zeros(0, np.int64))
            continue
        h = hashes[begin[k] : end[k]]
        out.append(np.unique(np.lib.stride_tricks.sliding_window_view(h, WINDOW).min(axis=1)).view(np.int64))
    return out
