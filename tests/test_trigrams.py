"""Trigram resemblance against all extents."""

import random

import numpy as np
import pytest

from tessera.functions import trigrams
from tessera.functions.text import trigrams_of


def ordered(text):
    words = trigrams.WORD.findall(text or "")
    return [f"  {w} "[k : k + 3] for w in words for k in range(len(w) + 1)]


def best_extent(text, query):
    g, q = ordered(text), set(trigrams_of(query))
    out = 0.0
    for i in range(len(g)):
        seen = set()
        for j in range(i, len(g)):
            seen.add(g[j])
            out = max(out, len(seen & q) / len(seen | q))
    return out


TEXTS = ["", None, "  .. ", "word", "words", "two words", "x", "the the the the", "one word two word three", "a" * 60, "aa ab ba aa wor ord", "ein wörd 漢字 word_word", "two\nwords two\nwords two words"]


@pytest.mark.parametrize("steps", [0, 1, 3, 512])
def test_against_all_extents(monkeypatch, steps):
    monkeypatch.setattr(trigrams, "STEPS", steps)
    monkeypatch.setattr(trigrams, "SLAB", 50)
    r = random.Random(4)
    texts = TEXTS + ["".join(r.choices("abwords  t", k=r.randint(0, 70))) for _ in range(150)]
    for query in ("word", "two words", "abba words", "a", "漢字 wörd"):
        whole, best = trigrams.resemblances(texts, query)
        q = set(trigrams_of(query))
        for t, w, b in zip(texts, whole, best, strict=True):
            s = set(ordered(t))
            assert w == pytest.approx(len(s & q) / len(s | q)) and b == pytest.approx(best_extent(t, query))


def test_known_value():
    """The example of the PostgreSQL manual."""
    whole, best = trigrams.resemblances(["two words"], "word")
    assert whole[0] == pytest.approx(4 / 11) and best[0] == pytest.approx(0.8)


def test_query_without_words():
    assert np.array_equal(trigrams.resemblances(TEXTS, " . ")[1], np.zeros(len(TEXTS)))


def test_long_runs_are_quick():
    texts = ["the " * 100_000, "word " + "a" * 400_000 + " word", "w" * 300_000]
    assert trigrams.resemblances(texts, "word")[1].tolist() == [0.0, 1.0, pytest.approx(0.2)]
