import random
import re

import numpy as np
import pytest

from tessera.llm import ngram_join


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size, percent):
    """Components by comparing everything."""
    sets = [(k, shingles(t, size)) for k, t, *_ in rows]
    up = {k: k for k, _ in sets if k is not None}

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted(((k, len(s), root(k) if k is not None else None) for k, s in sets), key=str)


def made(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice("alpha beta gamma delta eps zeta eta theta iota kappa".split()) + str(r.randint(0, 60))
    passage = [word() for _ in range(50)]
    rows, bases = [], [[word() for _ in range(r.choice([3, 30, 120]))] for _ in range(8)]
    for k in range(n):
        w = list(r.choice(bases)) if r.random() < 0.8 else [word() for _ in range(r.randint(1, 150))]
        for _ in range(r.choice([0, 0, 1, 1, 2, 4, 8])):
            w[r.randrange(len(w))] = word()
        if r.random() < 0.3:
            w += passage
        rows.append((k + 10, " ".join(x.upper() if r.random() < 0.1 else x for x in w), "clash"))
    return rows + [(1, None, ""), (2, "", ""), (3, " \n", ""), (None, "no id here at all", ""), (4, "one", ""), (5, "ONE", ""), rows[0]]


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_components_against_all_pairs(spark, size, percent):
    rows = made(size, 220)
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((tuple(r) for r in ngram_join.components(docs, size, percent).collect()), key=str)
    assert got == brute(rows, size, percent)


def test_keep_and_empty(spark):
    docs = spark.createDataFrame([(2, "a b c d e f", "x"), (1, "A b c d e f", "y"), (3, None, "z"), (None, None, "n"), (1, "A b c d e f", "y")], "doc_id long, text string, label string")
    assert sorted(map(str, ngram_join.keep(docs).collect())) == sorted(map(str, docs.where("doc_id = 1 or doc_id = 3 or doc_id is null").distinct().collect()))
    assert ngram_join.components(docs.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(20))
@pytest.mark.parametrize("cells", [1, 1 << 22])
def test_trie_against_sets(seed, cells, monkeypatch):
    monkeypatch.setattr(ngram_join, "CELLS", cells)
    r = np.random.default_rng(seed)
    base = np.unique(r.integers(0, 300, 60).astype(np.uint64))
    sets = [np.unique(np.concatenate([r.choice(base, int(r.integers(1, len(base)))), r.integers(0, 300, int(r.integers(0, 9))).astype(np.uint64)])) for _ in range(50)] + [base, base[:0]]
    probes = [sets[k] for k in r.permutation(len(sets))[:20]]
    want = {(i, j) for i, p in enumerate(probes) for j, s in enumerate(sets) if len(p) and len(s) and 100 * len(np.intersect1d(p, s)) >= 60 * len(np.union1d(p, s))}
    got = {(i, j) for who, j in ngram_join.Trie(sets).walk(probes, 60) for i in who.tolist() if len(probes[i])}
    assert got == want


def test_passages_in_every_text(spark, monkeypatch):
    """Texts made of a few lines that all share: every n-gram is frequent, in blocks of a few sets."""
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 2000)
    r = random.Random(3)
    lines = [" ".join(f"w{k}x{i}" for i in range(12)) for k in range(10)]
    rows = [(k + 1, "\n".join(sorted(r.sample(lines, r.choice([3, 7, 8, 9])))), "x") for k in range(150)]
    rows += [(1000 + k, f"{lines[0]} {k} {lines[1]}", "x") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string")
    got = sorted((tuple(x) for x in ngram_join.components(docs, 4, 85).collect()), key=str)
    assert got == brute(rows, 4, 85)


def test_keep_judges_rows(spark):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, a, "x"), (1, b, "x"), (2, b + " ", "y"), (1, a, "z"), (3, "", "p"), (3, "", "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    got = sorted(tuple(x) for x in ngram_join.keep(docs).collect())
    assert got == sorted([(1, a, "x"), (1, b, "x"), (3, "", "p"), (3, "", "p")])
