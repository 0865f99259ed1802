"""The operators with SQL against DuckDB, on the smallest tables and on rows of odd shape."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import pytest

from tessera.llm import decontaminate, license_scan, quality_rules
from tessera.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
NATIVE = ["op5_license_scan", "op9_quality_rules", "op10_decontaminate"]
LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
ODD = [
    (1, None, "a", "x"), (2, "", None, "x"), (3, " \n\t ", "a", "x"), (4, " ".join(LONG), "a", "x"), (5, " ".join(LONG * 40), "b", "x"),
    (6, "Released under the MIT License.\n\nx", "b", "x"), (7, "same line\nsame line\n" * 30, "b", "x"), (8, "ß É\u00a0漢字 🙂 # $", "c", "x"),
    (9, "before " + " ".join(LONG[:20]) + " after", "c", "x"), (9, "before " + " ".join(LONG[:20]) + " after", "c", "x"), (None, " ".join(LONG[2:]), None, "x"),
]
ITEMS = [(1, " ".join(LONG[:20]), "x"), (2, None, "x"), (3, "", "x"), (4, "alpha beta", "x"), (5, " ".join(LONG[:20]), "x")]


def tables(spark, tmp_path, docs=ODD, items=ITEMS):
    spark.createDataFrame(docs, "doc_id long, text string, source string, n_words string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string, w string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def plain(v):
    return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else None if v is None else str(v)


def both(spark, name, sf_dir, parts=""):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet{parts}')")
    rel = con.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    want = sorted(([plain(r[names.index(c)]) for c in cols] for r in rel.fetchall()), key=repr)
    return sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr), want


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_smallest_tables(spark, name):
    got, want = both(spark, name, SF)
    assert got == want and got


def test_odd_rows_rules(spark, tmp_path):
    got, want = both(spark, "op9_quality_rules", tables(spark, tmp_path), "/*.parquet")
    assert got == want and len(got) == len(ODD)


def test_odd_rows_licences(spark, tmp_path):
    got, want = both(spark, "op5_license_scan", tables(spark, tmp_path), "/*.parquet")
    assert got == want and len(got) == 1


def test_odd_rows_leaks(spark, tmp_path):
    d = tables(spark, tmp_path)
    rows = QUERIES["op10_decontaminate"](spark, d).collect()
    # items 1 and 5 have one text; documents 4, 5 and 9 hold it, the rows of 9 are one document
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(k, i) for k in (4, 5, 9) for i in (1, 5)]


def test_empty_tables(spark, tmp_path):
    d = tables(spark, tmp_path, [], [])
    assert [QUERIES[n](spark, d).count() for n in NATIVE] == [0, 0, 0]


def test_keeps_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{tables(spark, tmp_path)}/documents.parquet")
    items = spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    assert quality_rules.keep(docs).columns == docs.columns == decontaminate.clean(docs, items).columns
    assert {r["doc_id"] for r in decontaminate.clean(docs, items).collect()} == {1, 2, 3, 6, 7, 8, None}
    assert license_scan.scan(docs).columns == ["doc_id", "unit", "unit_no", "license", "template_no", "dice"]


def slid(docs, items, least=0.8):
    """doc_id, item_id of every window of every document that reaches an item, by the definition."""
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    shingles = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)])
    known = {k: words(t) for k, t in items if words(t)}
    holders = Counter(g for w in known.values() for g in shingles(w))
    weight = lambda g: math.log1p(len(known) / max(1, holders[g]))
    out = {}
    for d, t in docs:
        w = words(t)
        for k, v in known.items():
            mine, best = shingles(v), (0, 0, 0)
            for start in range(max(0, len(w) - len(v)) + 1) if w and (len(v) >= 5 or len(v) == len(w)) else ():
                own = shingles(w[start : start + len(v)])
                low = sum(min(own[g], mine[g]) * weight(g) for g in own | mine)
                high = sum(max(own[g], mine[g]) * weight(g) for g in own | mine)
                best = max(best, (round(low / high, 9), -start, min(len(v), len(w))))
            if best[0] >= least:
                out[d, k] = (-best[1], best[2], round(best[0], 6))
    return out


def test_leaks_slide_over_all_windows(spark):
    r = random.Random(3)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    items = [(k, fresh(50)) for k in range(6)] + [(6, fresh(7)), (7, fresh(3))]
    docs = []
    for _, w in items[:6]:
        for n in range(1, 7):
            docs += [w[n:] + fresh(30), fresh(30) + w[:-n], w[n:], w[: len(w) - n], w[n // 2 : len(w) - n + n // 2], fresh(9) + w[n:] + fresh(9)]
        docs += [fresh(20) + w[25:] + w[:25] + fresh(20), fresh(5) + w[:20] + fresh(2) + w[20:] + fresh(5), fresh(5) + w + w, w[:20] + fresh(1) + w[22:]]
    docs += [w for _, w in items] + [items[6][1][1:] + fresh(3), items[7][1] + fresh(1), fresh(4)]
    docs = [(k, " ".join(w)) for k, w in enumerate(docs)]
    items = [(k, " ".join(w)) for k, w in items]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    want = slid(docs, items)
    assert {(r["doc_id"], r["item_id"]): (r["start_word"], r["n_words"], round(r["similarity"], 6)) for r in got} == want
    assert {(k, 0) for k in range(29)} - {(k, 0) for k in (5, 11, 17, 23)} <= set(want)  # 1 to 5 words missing at an edge


def test_notices_within_lines(spark, tmp_path):
    docs = [
        (1, "Copyright 2020 Foo. Licensed under the MIT License. More text follows here", "a", "x"), (2, "x\u0001y\nReleased under the mit LICENSE", "a", "x"),
        (3, "Permission to use, copy, modify and/or distribute this software for any purpose\nwith or without fee is hereby granted, provided that the above copyright notice\nand this permission notice appear in all copies.", "a", "x"),
        (4, "about licences. nothing", "a", "x"), (5, "commits under the submit license", "a", "x"), (6, "the mit license " * 3, "a", "x"),
    ]
    sf = tables(spark, tmp_path, docs=docs)
    got, want = both(spark, "op5_license_scan", sf, "/*.parquet")
    assert got == want
    got = {(r["doc_id"], r["unit"], r["license"]) for r in QUERIES["op5_license_scan"](spark, sf).collect()}
    assert got == {(1, "sentence", "mit"), (2, "line", "mit"), (2, "block", "mit"), (3, "block", "isc")}


def test_stages_judge_rows(spark):
    good = " ".join(f"w{k}" for k in range(40))
    item = " ".join(LONG[:20])
    rows = [(1, good, "a", "x"), (1, "too short", "a", "y"), (None, "short", "a", "z"), (None, good + " more", None, "q"), (2, item, "a", "p"), (2, good + " other", "a", "r"), (None, item, "a", "s"), (3, None, "a", "t")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, mark string")
    assert quality_rules.keep(docs).columns == docs.columns
    assert sorted(r["mark"] for r in quality_rules.keep(docs).collect()) == ["p", "q", "r", "s", "x"]
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = decontaminate.clean(docs, items)
    assert got.columns == docs.columns and sorted(r["mark"] for r in got.collect()) == ["q", "r", "t", "x", "y", "z"]
    assert quality_rules.keep(docs.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), items).count() == 0
