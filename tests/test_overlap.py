"""Substrings, containment, alignments and merges against plain forms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import sequences, substrings
from tessera.operators import overlap


def longest(a, b):
    return max((j - i for i in range(len(a)) for j in range(i + 1, len(a) + 1) if a[i:j] in b), default=0)


def test_common_lengths():
    r = random.Random(1)
    a = ["".join(r.choices("abcß漢🙂", k=r.randint(0, 25))) for _ in range(300)] + ["", "x", "same", "aaaa"]
    b = ["".join(r.choices("abcß漢🙂", k=r.randint(0, 25))) for _ in range(300)] + ["x", "", "same", "aaaaaaa"]
    assert substrings.common_lengths(a, b).tolist() == [longest(x, y) for x, y in zip(a, b, strict=True)]
    assert substrings.common_lengths([], []).tolist() == []


def test_fingerprints_of_parts_are_those_of_the_whole():
    r = random.Random(2)
    whole = ["".join(r.choices("abcdefg ", k=400)) for _ in range(30)] + ["a" * 300, "short"]
    part = [w[r.randint(0, 200) :][: r.randint(40, 150)] for w in whole]
    for p, w, text in zip(substrings.fingerprints(part), substrings.fingerprints(whole), part, strict=True):
        assert set(p) <= set(w) and (len(p) > 0) == (len(text) >= 40)


def test_overlapping_keys(spark):
    r = random.Random(3)
    keys = ["".join(r.choices("abc", k=r.randint(1, 14))) for _ in range(120)]
    keys += [k[: max(1, len(k) * 3 // 4)] + "z" for k in keys[:40]] + [keys[0].upper(), "", keys[1]]
    rows = [(k, f"p{k % 2}", key) for k, key in enumerate(keys)]
    got = {(x.project_id, x.a, x.b): (x.shared, x.n_a, x.n_b) for x in overlap.overlapping_keys(spark.createDataFrame(rows, "id long, project_id string, key string")).collect()}
    want = {}
    for p in ("p0", "p1"):
        own = [key.lower() for _, q, key in rows if q == p and key]
        for a in sorted(set(own)):
            for b in sorted(set(own)):
                if a < b and 10 * longest(a, b) > 6 * min(len(a), len(b)):
                    want[p, a, b] = (longest(a, b), own.count(a), own.count(b))
    assert got == want and len(want) > 50


def test_contained(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 60))) for _ in range(60)]
    texts += [t[r.randint(0, len(t) // 2) :][: r.randint(20, 90)].strip() for t in texts[:40] * 4] + [texts[0].upper().replace(" ", "\n ") + "\t", texts[1], "", None, "  ", "short", "short"]
    r.shuffle(texts)
    rows = [(k, f"p{k % 2}", (k * 37) % 11, t) for k, t in enumerate(texts)]
    got = {x.id: x.of for x in overlap.contained(spark.createDataFrame(rows, "id long, project_id string, rank int, value string"), [F.col("rank"), F.col("id").alias("n")]).collect()}
    kept, want = {}, {}
    for k, p, _, t in sorted(rows, key=lambda x: (x[2], x[0])):
        n = " ".join((t or "").lower().split())
        before = [(i, m) for i, m in kept.get(p, []) if n and (n == m or len(n) >= 40 and n in m)]
        if before:
            want[k] = before[0][0]
        if n:
            kept.setdefault(p, []).append((k, n))
    assert got == want and len(want) > 20


def plain_common(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    out, i, j = [], len(a), len(b)
    while i and j:
        if a[i - 1] == b[j - 1]:
            out.insert(0, a[i - 1])
            i, j = i - 1, j - 1
        elif t[i - 1, j] >= t[i, j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_common_subsequences():
    r = random.Random(5)
    for _ in range(300):
        a, b = (r.choices("abcd", k=r.randint(0, 30)) for _ in range(2))
        assert sequences.common(a, b) == plain_common(a, b)


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [("x", "x", "x"), ("", "b c", "b c"), (None, "b", "b"), ("a", None, "a"), ("the cat sat", "the dog sat", "the cat dog sat"), ("a b c", "a b c d", "a b c d"), ("one two", "three", "one two three"), ("x y z", "y", "x y z"), ("same  words", "same words", "same words"), (" ", "b", "b")],
)
def test_merged_texts(a, b, want):
    assert sequences.merged(a, b) == want


def test_long_texts_merge():
    r = random.Random(6)
    a = [str(r.randint(0, 500)) for _ in range(4000)]
    b = [w for w in a if r.random() < 0.9]
    assert sequences.common(a, b) == b
