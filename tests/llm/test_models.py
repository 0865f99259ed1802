"""Learned operators and the renderer: held-out accuracy, brute force, examples."""

import math
import random
import zlib
from collections import Counter
from itertools import pairwise

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import gru, packing, perplexity, toxicity, url_filter
from tessera.llm.hashing import Words
from tessera.llm.html_text import extract, visible_text
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def labelled(n, seed):
    r = random.Random(seed)
    rows = []
    for k in range(n):
        w = [r.choice("lorem ipsum dolor sit amet consectetur elit sed do".split()) + str(r.randint(0, 50)) for _ in range(r.randint(5, 120))]
        if k % 3 == 0:
            w[r.randrange(len(w))] = r.choice(["vile", "Vile,", "rotten"])
        rows.append((k, " ".join(w), int(k % 3 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = labelled(900, 5)
    docs = spark.createDataFrame([(k, t, "x") for k, t, _ in rows] + [(None, None, "x"), (5000, "", "x"), (0, rows[0][1], "x")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows] + [(None, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.score(docs, toxicity.train(docs, labels)).collect()
    assert len(got) == 903 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [r["score"] for r in got if r["doc_id"] in (None, 5000)] == [0, 0]
    held = [(r["predicted"], int(r["doc_id"] % 3 == 0)) for r in got if r["held_out"] and r["doc_id"] not in (None, 5000)]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert toxicity.score(docs, toxicity.train(docs, labels.where("toxic = 0"))).where("score > 0").count() == 0
    assert toxicity.score(docs.limit(0), None).count() == 0
    assert toxicity.keep(docs, labels).columns == docs.columns


def test_gradients_of_the_network():
    r = np.random.default_rng(1)
    m = {k: v.astype(np.float64) if v.dtype == np.float32 else v for k, v in gru.start_model(np.zeros(0, np.uint64), np.zeros(0), 3).items()}
    p, words = r.normal(0, 1, (2, 9, 3 * gru.HIDDEN)), r.integers(0, 9, (4, gru.WINDOW))
    fills = np.arange(gru.WINDOW) < np.array([[gru.WINDOW], [5], [1], [11]])
    logit, kept = gru.forward(m, p, words, fills, keep=True)
    g, d_p = gru.backward(m, kept, np.ones(4), 9)
    for name, grad, value in [("u", g["u"], m["u"]), ("wa", g["wa"], m["wa"]), ("wo", g["wo"], m["wo"]), ("p", d_p, p)]:
        for _ in range(5):
            at = tuple(r.integers(0, n) for n in value.shape)
            old = value[at]
            value[at] = old + 1e-3
            up = gru.forward(m, p, words, fills).sum()
            value[at] = old - 1e-3
            down = gru.forward(m, p, words, fills).sum()
            value[at] = old
            assert grad[at] == pytest.approx((up - down) / 2e-3, abs=2e-3), name


def plain_score(m, words):
    """The probability of the highest of all windows, a window and a word at a time."""
    sig, h = lambda x: 1 / (1 + np.exp(-x)), gru.HIDDEN
    starts = [0] if len(words) <= gru.WINDOW else sorted({*range(0, len(words) - gru.WINDOW + 1, gru.STRIDE), len(words) - gru.WINDOW})
    best = -math.inf
    for s in starts if words else []:
        vectors = [gru.Inputs(m, Words([w], bare=True)).vectors(m)[0] for w in words[s : s + gru.WINDOW]]
        states = []
        for way, order in enumerate((vectors, vectors[::-1])):
            state, seen = np.zeros(h), []
            for v in order:
                x, g = v @ m["w"][way] + m["b"][way], state @ m["u"][way]
                z, r = sig(x[:h] + g[:h]), sig(x[h : 2 * h] + g[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(x[2 * h :] + r * g[2 * h :])
                seen.append(state)
            states.append(seen if way == 0 else seen[::-1])
        both = [np.concatenate(p) for p in zip(*states, strict=True)]
        e = np.exp([np.tanh(b @ m["wa"] + m["ba"]) @ m["va"] for b in both])
        best = max(best, float(sum(w * b for w, b in zip(e / e.sum(), both, strict=True)) @ m["wo"] + m["bo"][0]))
    return sig(best) if words else 0.0


def test_scores_against_a_plain_loop(monkeypatch):
    r = random.Random(2)
    rows = labelled(60, 9)
    m = gru.fit([t for _, t, _ in rows], np.array([y for *_, y in rows]), epochs=2)
    texts = [" ".join(r.choice(rows)[1].split(",")[0].split()[:n]) for n in (1, 5, 23, 24, 25, 31, 32, 33, 60)] + [" ".join(f"w{k}" for k in range(200)), "", None, " "]
    for chunk in (10, 1 << 21):
        monkeypatch.setattr(gru, "CHUNK", chunk)
        assert gru.scores(m, texts) == pytest.approx([plain_score(m, (t or "").split()) for t in texts], abs=1e-4)


def kneser_ney(texts):
    """The perplexity function of the interpolated modified Kneser-Ney model of word pairs, by its definition."""
    signs = lambda t: list(pairwise(["<s>", *t.lower().split(), "</s>"]))
    two = Counter(p for t in texts for p in signs(t))
    one = Counter(w for _, w in two)

    def taken(c):
        n = [sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0
        d = [0] + [min(i, max(0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]
        return lambda v: d[min(3, v)]

    d1, d2 = taken(one), taken(two)
    p1 = lambda w: (one[w] - d1(one[w]) + sum(map(d1, one.values())) / (len(one) + 1)) / sum(one.values())

    def p2(h, w):
        own = [v for (x, _), v in two.items() if x == h]
        return (two[h, w] - d2(two[h, w]) + sum(map(d2, own)) * p1(w)) / sum(own) if own else p1(w)

    return lambda t: math.exp(-sum(math.log(p2(*p)) for p in signs(t)) / len(signs(t)))


def test_perplexity_against_the_definition(spark, monkeypatch):
    r = random.Random(3)
    texts = [" ".join(r.choice("the The cat sat on a mat hat and rat".split()) for _ in range(r.randint(1, 12))) for _ in range(40)]
    new = ["zzz qqq cat", "Cat cat CAT", "unseen", "the cat " * 50]
    docs = spark.createDataFrame([(k, t, "en", 1.0) for k, t in enumerate(texts)] + [(100 + k, t, None, 2.0) for k, t in enumerate(new)] + [(100, new[0], None, 2.0), (200, None, "en", 0.0), (201, " \n", "en", 0.0), (None, "the hat", "en", 0.0)], "doc_id long, text string, lang string, perplexity double")
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(None, 1), (100, 0)], "doc_id long, quality int")
    held = {k for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 0}
    want = kneser_ney([t for k, t in enumerate(texts) if k not in held])
    most = max(want(texts[k]) for k in held)
    for hot, part, chunk, slices in ((10_000, 1 << 24, 1 << 22, 1), (20, 40, 30, 3)):  # one slice and nearly none hot; many parts, chunks and hot keys
        for name, value in (("HOT", hot), ("PART", part), ("CHUNK", chunk), ("SLICES", slices)):
            monkeypatch.setattr(perplexity, name, value)
        rows = perplexity.score(docs, labels).collect()
        assert len(rows) == docs.count() and sum(r["doc_id"] == 100 for r in rows) == 2
        got = {r["doc_id"]: r for r in rows}
        for k, t in [*enumerate(texts), *enumerate(new, 100), (None, "the hat")]:
            assert got[k]["perplexity"] == pytest.approx(want(t))
            assert got[k]["kept"] == (got[k]["perplexity"] <= got[k]["threshold"]) and got[k]["threshold"] == pytest.approx(most)
        assert got[200]["perplexity"] is None and got[201]["perplexity"] is None and not got[200]["kept"] and not got[201]["kept"]
    assert perplexity.score(docs.limit(0), labels.limit(0)).count() == 0
    assert all(r["kept"] == (r["doc_id"] not in (200, 201)) and r["perplexity"] is None for r in perplexity.score(docs, labels.limit(0)).collect())


def test_url_parts_and_rules(spark):
    rows = [(1, "http://A.Example.NET/en/x?q=1#z"), (2, "https://example.net/de/"), (3, "x://shop.example.com/de/a"), (4, "http://b.org/fr/"), (5, "http://myexample.net/en/"), (6, None), (7, "no scheme"), (8, "http://h.net?x"), (9, "http://u.com/a://b"), (9, "http://u.com/a://b"), (10, "")]
    pages = spark.createDataFrame([(k, u, None, "clash") for k, u in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(pages).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert got[2][2:] == ("net/", "block") and got[3][2:] == ("example.com/de/", "block") and got[4][2:] == ("org/fr/", "allow") and got[5][2:] == ("net/", "block")
    assert got[6][:3] == got[7][:3] == got[10][:3] == ("", "", None) and got[8][:3] == ("h.net", "", None) and got[9][:3] == ("u.com", "/a://b", None)
    assert url_filter.judge(pages).count() == len(rows) and url_filter.judge(pages.limit(0)).count() == 0


def test_concatenated_hosts_split(spark):
    urls = ["http://free.net/", "http://bets.net/", "http://news.org/fr/", "http://weather.org/fr/", *["http://freebets.com/"] * 40, *["http://newsweather.com/"] * 40]
    page = "<title>Free bets, news</title><p>weather news and free bets at freebets.com or http://newsweather.com/"
    pages = spark.createDataFrame([(k, u, page) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["host"]: r["verdict"] for r in url_filter.judge(pages).collect()}
    assert got["freebets.com"] == "block" and got["newsweather.com"] == "allow"


def test_no_word_is_too_rare_to_count(spark):
    common = spark.range(60_000).select(F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij").alias("word"), F.lit(2).cast("long").alias("count"))
    words = common.unionByName(spark.createDataFrame([("zebra", 1), ("quilt", 1)], "word string, count long"))
    runs = spark.createDataFrame([("zebraquilt", 1), ("quiltzebra", 5000), ("ß", 1)], "run string, n long")
    got = {r["run"]: r["words"] for r in url_filter.splits(runs, words).collect()}
    assert got == {"zebraquilt": ["zebra", "quilt"], "quiltzebra": ["quilt", "zebra"], "ß": ["ß"]}


def test_viterbi_against_all_splits():
    words = {"casino": 5, "win": 9, "free": 4, "bets": 3, "bet": 6, "s": 1, "in": 8}
    s = url_filter.Segmenter(words)
    cost = lambda w: s.cost.get(w, s.rare + 2.3 * len(w))
    for run in ("freebets", "casinowin", "xwinx", "betsin"):
        ways = []
        for mask in range(2 ** (len(run) - 1)):
            cuts = [0, *(i + 1 for i in range(len(run) - 1) if mask >> i & 1), len(run)]
            ways.append(sum(cost(run[i:j]) for i, j in pairwise(cuts)))
        assert sum(map(cost, s.split(run))) == pytest.approx(min(ways))


@pytest.mark.parametrize(("page", "text"), [
    (None, ""), ("", ""), ("just text &amp; more", "just text & more"), ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"), ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa  b\nc   dd"),
    ("x<script>1<2</script><style>p{}</style><span hidden>n</span>y", "xy"), ("<head><title>t</title></head><body>b", "b"), ("<pre>a\n  b</pre>c", "a\n  b\n\nc"),
    ("a<br>b", "a\nb"), ("<details><summary>s</summary>no</details>", "s"), ("<b>un<i>closed", "unclosed"), ("</p>a<", "a<"), ("<!-- c -->a<p title='>'>b", "a\n\nb"),
    ("<div>" * 5000 + "deep", "deep"), ("<table><tr><td>" * 300 + "deep", "deep"),
])
def test_visible_text(page, text):
    assert visible_text(page) == text


def test_extract(spark):
    pages = spark.createDataFrame([(1, "<p>a", "x"), (1, "<p>a", "x"), (2, None, "x")], "page_id long, html string, text string")
    assert sorted((r["page_id"], r["text"]) for r in extract(pages).collect()) == [(1, "a"), (1, "a"), (2, "")]
    assert extract(pages.limit(0)).count() == 0


def test_whole_queries(spark):
    docs, pages = spark.read.parquet(f"{SF}/documents.parquet").count(), spark.read.parquet(f"{SF}/pages.parquet").count()
    assert QUERIES["op7_perplexity"](spark, SF).count() == docs
    assert QUERIES["op6_url_filter"](spark, SF).count() == QUERIES["op8_html_text"](spark, SF).count() == pages


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, SF).cache()
        assert kept.columns == docs.columns and 0.5 * before.count() < kept.count() <= before.count(), name
    rows = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert max(r["offset"] + r["length"] for r in rows) <= packing.SIZE


def test_deep_pages_are_quick():
    import time

    began = time.time()
    assert visible_text("<div>" * 100_000 + "x<p>y").split() == ["x", "y"]
    assert visible_text("<p>a" + "</b>" * 100_000).split() == ["a"]
    assert time.time() - began < 20


def test_pipeline_with_odd_rows(spark, tmp_path):
    """Nulls, empties, repeats and clashing columns through all stages, against the stages' rules by hand."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    clean = {k: " ".join(word() for _ in range(60)) for k in range(1, 60)}
    item = " ".join(word() for _ in range(30))
    toxic = {k: " ".join([*(word() for _ in range(30)), r.choice(["vile", "rotten"]), *(word() for _ in range(30))]) for k in range(100, 220)}
    copies = {300 + k: clean[k] + " end" for k in range(1, 10)}
    leaks = {400 + k: f"{word()} {item} {word()}" for k in range(4)}
    odd = [(500, None), (501, ""), (502, "short"), (503, clean[11]), (503, clean[11])]
    rows = [(k, t, "en", f"h{k % 5}", len(t or "")) for k, t in [*clean.items(), *toxic.items(), *copies.items(), *leaks.items(), *odd]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k in toxic)) for k, *_ in rows if k < 300], "doc_id long, quality int, toxic int").distinct().write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {x["doc_id"] for x in out} == set(clean)
    assert max(x["offset"] + x["length"] for x in out) <= packing.SIZE
