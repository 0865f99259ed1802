"""Graphs by example and against plain searches."""

import random

import pytest

from tessera.operators import graph


def frame(spark, edges):
    return spark.createDataFrame(edges, "src long, dst long")


def reached(edges):
    """Pairs (from, to) along paths of one edge or more."""
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
    pairs = set()
    for s in out:
        front = set(out[s])
        seen = set()
        while front:
            seen |= front
            front = {y for x in front for y in out.get(x, ())} - seen
        pairs |= {(s, t) for t in seen}
    return pairs


def test_impact_of_long_paths_and_cycles(spark):
    chain = [(k, k + 1) for k in range(12)]
    got = {r["id"]: (r["dependents"], r["impact"]) for r in graph.impact(frame(spark, [*chain, (100, 101), (101, 102), (102, 100)])).collect()}
    assert got == {k: (k, k) for k in range(1, 13)} | {k: (2, 3) for k in (100, 101, 102)}


@pytest.mark.parametrize("seed", [1, 5])
def test_against_plain_search(spark, seed):
    r = random.Random(seed)
    edges = list({(r.randint(-20, 60), r.randint(0, 90)) for _ in range(110)})
    pairs = reached(edges)
    df = frame(spark, [*edges, edges[0]])
    strong = {}
    for x in graph.strong(df).collect():
        strong.setdefault(x["component"], set()).add(x["id"])
    nodes = {x for e in edges for x in e}
    want = {}
    for x in nodes:
        own = frozenset({x} | {y for y in nodes if (x, y) in pairs and (y, x) in pairs})
        if len(own) > 1:
            want[min(own)] = set(own)
    assert strong == want
    assert {x["id"] for x in graph.on_cycles(df).collect()} == {x for x in nodes if (x, x) in pairs}
    degree = {x: sum(b == x != a for a, b in edges) for x in nodes}
    up = {x: {a for a, b in pairs if b == x != a} for x in nodes if degree[x]}
    want = {x: (len(u), degree[x] + sum(degree[y] for y in u)) for x, u in up.items()}
    for blocks, condense in ((1, True), (2, False)) if seed == 1 else ((1, False),):
        assert {x["id"]: (x["dependents"], x["impact"]) for x in graph.impact(df, blocks, condense).collect()} == want
    for x in graph.cycles(df).collect():
        c = x["cycle"]
        assert len(c) == x["n"] == len(set(c)) and c[0] == min(c) and all(e in edges for e in zip(c, c[1:] + c[:1], strict=True))
    assert {k for x in graph.cycles(df).collect() for k in x["cycle"]} == {x for x in nodes if (x, x) in pairs}


def test_no_edges(spark):
    none = frame(spark, [])
    assert graph.strong(none).count() == graph.impact(none).count() == graph.cycles(none).count() == graph.on_cycles(none).count() == 0
