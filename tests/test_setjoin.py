"""The join of sets by blocks against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import quality, setjoin


def made(r, n, words=60):
    """Rows of sets: near copies, copies, one element, large ones, and empty and null ones."""
    sets = [[f"w{int(r.paretovariate(0.6)) % words}" for _ in range(r.choice([1, 2, 5, 12, 30]))] for _ in range(n)]
    sets += [s[:-1] + [f"x{k % 3}"] for k, s in enumerate(sets[: n // 2])] + sets[: n // 5] + [[], None, ["only"], ["only"]] + [["many", f"m{k % 4}"] for k in range(20)]
    return [(k, None if k % 41 == 40 else f"g{k % 3}", s, r.random() < 0.5, r.random() < 0.4) for k, s in enumerate(sets)]


def similarity(s, t, of_union):
    s, t = set(s or []), set(t or [])
    return len(s & t) / (len(s | t) if of_union else max(len(s), len(t))) if s and t else 0


@pytest.mark.parametrize(("least", "of_union", "block"), [(0.7, True, 400), (0.3, True, 30), (0.25, False, 400), (1.0, True, setjoin.BLOCK)])
def test_all_pairs(spark, least, of_union, block):
    rows = made(random.Random(block), 60)
    df = spark.createDataFrame(rows, "id int, by string, s array<string>, left boolean, right boolean")
    want = {(a[0], b[0]): (similarity(a[2], b[2], of_union), a[3], a[4], b[3], b[4]) for a in rows for b in rows if a[0] != b[0] and a[1] and a[1] == b[1]}
    want = {k: x for k, x in want.items() if x[0] >= least - 1e-12}
    got = setjoin.sharing(setjoin.hashed(df.drop("left", "right")), least, of_union, block).collect()
    assert sorted((x.a, x.b, x.similarity) for x in got) == sorted((*k, x[0]) for k, x in want.items() if k[0] < k[1])
    got = setjoin.sharing(setjoin.hashed(df), least, of_union, block).collect()
    assert sorted((x.a, x.b, x.similarity) for x in got) == sorted((*k, x[0]) for k, x in want.items() if x[1] and x[4])
    assert len(want) > 40


@pytest.mark.parametrize("few", [3, 50, 5000])
@pytest.mark.parametrize(("least", "of_union"), [(0.7, True), (0.3, True), (0.25, False)])
def test_pairs_of_a_block(monkeypatch, least, of_union, few):
    for name in ("COUNTERS", "MATCHES"):
        monkeypatch.setattr(setjoin, name, few)
    sets = [sorted({int(w[1:]) * 7919 for w in s if w[1:].isdigit()}) for _, _, s, _, _ in made(random.Random(few), 50) if s]
    sets = [s for s in sets if s]
    h, size = np.concatenate(sets).astype(np.int64), np.array([len(s) for s in sets])
    for side in (np.full(len(sets), 2), np.arange(len(sets)) % 2):
        got = sorted((i, j, s) for part in setjoin.alike(*setjoin.ranked(h, size), size, side, least, of_union) for i, j, s in zip(*part, strict=True))
        want = [(i, j, similarity(s, t, of_union)) for i, s in enumerate(sets) for j, t in enumerate(sets) if (i < j if side[0] == 2 else side[i] == 0 and side[j] == 1)]
        assert got == [x for x in want if x[2] >= least - 1e-12] and len(got) > 20


def shuffled(spark):
    """Bytes that tasks of this session have written for shuffles."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


QUERIES = {
    "near_duplicates": quality.near_duplicates,
    "similar_keys": quality.similar_keys,
    "contradictions": quality.contradictions,
    "convention_checks": lambda m: quality.convention_checks(m, m),
    "quality_scores": quality.quality,
    "project_health": lambda m: quality.health(quality.quality(m)),
    "auto_archive": lambda m: quality.archivable(m, quality.quality(m)),
}


@pytest.mark.parametrize("name", QUERIES)
def test_pairs_do_not_carry_sets(spark, name):
    """Texts of which nearly all pairs meet, and few are alike."""
    r = random.Random(7)
    words = ["".join(r.choices("bcdfghjkl", k=6)) for _ in range(1000)]
    texts = [" ".join(r.sample(words, 200)) + (" always", " never")[k % 2] for k in range(500)]
    m = spark.createDataFrame([(k, "p", "convention", t[:700], t) for k, t in enumerate(texts)], "id long, project_id string, type string, key string, value string")
    lists = {c: F.lit(None).cast("array<string>") for c in ("conditions", "examples", "tags")}
    days = {c: F.lit("2024-01-01").cast("date") for c in ("created_on", "updated_on")}
    m = m.withColumns({**lists, **days, "status": F.lit("live"), "n_refs": F.lit(0), "path": F.lit("p"), "confidence": F.lit(0.1)})
    before = shuffled(spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as of large tables
    try:
        QUERIES[name](m).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shuffled(spark) - before < 4 * sum(map(len, texts))
