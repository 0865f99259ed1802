"""Cases that once crashed, hung or went wrong."""

import random
import time

import pytest

from tessera.llm import decontaminate, html_text, ngram_join, packing, perplexity, quality_rules

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
HEAVY = ["<a" * 100_000, "<a" * 100_000 + ">", '<a "x>y" ' * 20_000 + "'", "<a '\"> " * 20_000, "</script " * 20_000, "<script>" + "</script " * 20_000, "<!--" * 50_000, "<!" * 50_000, '<a b="' * 30_000, "<a b='c\"" * 30_000, "<" * 200_000, "<p " + "a= " * 60_000 + ">"]


@pytest.mark.parametrize("k", range(len(HEAVY)))
def test_pages_of_odd_tags_are_quick(k):
    began = time.process_time()
    html_text.visible_text(HEAVY[k])
    assert time.process_time() - began < 1


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("a<b", "a<b"), ("<b title='>'>x</b>y", "xy"), ("<b title='>x</b>y", "xy"), ('<i a="b>c" d>e</i>', "e"), ("1 < 2 <3> 4", "1 < 2 <3> 4"), ("<!-- a > b -->c", "c"), ("a<!-- b", "a"), ("<!doctype html>c", "c"),
        ("<script>if (a</b) x</script >y", "y"), ("<textarea>a</textarea", "a</textarea"), ("x<br/>y", "x\ny"),
    ],
)
def test_tags(page, text):
    assert html_text.visible_text(page) == text


def test_packing_of_many_short_pieces():
    for counts in ({1025: 10, 700: 50, 2: 30, 1: 1500}, {1: 2000}, {2047: 3, 1: 5000}, {1365: 7, 683: 7, 1: 4000}):
        plan = packing.pack(counts)
        used = {}
        for bins, has in plan:
            assert sum(n * m for n, m in has) <= packing.SIZE
            for n, m in has:
                used[n] = used.get(n, 0) + bins * m
        assert used == counts


def test_packing_of_empty_texts(spark):
    docs = spark.createDataFrame([(k, None if k % 2 else "") for k in range(2000)] + [(5000 + k, "word " * (500 + k)) for k in range(20)], "doc_id long, text string")
    rows = packing.sequences(docs).collect()
    assert len({r.doc_id for r in rows}) == 2020
    for s in {r.sequence_id for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r.sequence_id == s), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= packing.SIZE


@pytest.mark.parametrize("turned", [False, True])
def test_leaks_of_a_document_of_several_texts(spark, turned):
    item = " ".join(WORDS[:20])
    texts = [(7, "before " + item + " after"), (7, "one two three " + " ".join(WORDS[:19]) + " other"), (8, "one two three " + " ".join(WORDS[:19]) + " other"), (None, item)]
    docs = spark.createDataFrame(texts[::-1] if turned else texts, "doc_id long, text string").coalesce(1)
    found = {r.doc_id: r for r in decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert set(found) == {7, 8} and found[7].similarity == pytest.approx(1.0) and found[7].start_word == 1 and found[8].similarity < 0.99


def test_kept_rows_with_clashing_columns(spark):
    r = random.Random(5)
    text = " ".join(r.choices(WORDS, k=80))
    names = ["_of", "mark", "_mark", "_id", "_failed", "host", "_bad", "_leaking", "label", "stays", "rows"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"{n} long" for n in names)
    rows = [(k, t, "s", *range(len(names))) for k, t in enumerate([text, text, text + " more", " ".join(WORDS), None])]
    docs = spark.createDataFrame(rows, schema)
    benchmark = spark.createDataFrame([(1, " ".join(WORDS[:20]))], "item_id long, text string")
    for out, ids in ((ngram_join.keep(docs), [0, 3, 4]), (quality_rules.keep(docs), [0, 1, 2, 3]), (decontaminate.clean(docs, benchmark), [0, 1, 2, 4])):
        assert out.columns == docs.columns and sorted(x.doc_id for x in out.collect()) == ids


def test_perplexity_of_documents_read_in_any_order(spark, monkeypatch):
    """Rows come in another order and in other chunks each time; copies score alike."""
    monkeypatch.setattr(perplexity, "CHUNK", 200)
    r = random.Random(2)
    rows = [(k, " ".join(r.choices(WORDS, k=r.randint(3, 30))), "en") for k in range(120)]
    rows += [(200 + k, rows[k % 3][1], "en") for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, 1) for k in range(60)], "doc_id long, quality int")

    def any_order(frames):
        for f in frames:
            yield f.sample(frac=1)

    want = {x.doc_id: x for x in perplexity.score(docs.coalesce(1), labels).collect()}
    got = {x.doc_id: x for x in perplexity.score(docs.repartition(3).mapInPandas(any_order, docs.schema), labels).collect()}
    assert set(got) == set(want) == {x[0] for x in rows}
    for k, x in want.items():
        assert got[k].perplexity == pytest.approx(x.perplexity, rel=1e-9) and got[k].kept == x.kept
        if k >= 200:
            assert x.perplexity == pytest.approx(want[(k - 200) % 3].perplexity, rel=1e-9)


def test_whole_texts_go_to_python_in_bounded_batches(spark):
    import pyarrow as pa

    from tessera.operators import storage

    def part(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["bytes", "rows"])

    docs = spark.range(0, 40, 1, 1).selectExpr("repeat(concat(id % 10, 'x'), 500000) AS text")
    before = spark.conf.get(storage.BATCH, None)
    rows = storage.cut(docs.mapInArrow(part, "bytes long, rows long"), "batches").collect()
    assert sum(r["rows"] for r in rows) == 40 and max(r["bytes"] for r in rows) < 2 * storage.BATCH_BYTES
    assert spark.conf.get(storage.BATCH, None) == before


def test_slices_of_a_batch_are_whole_and_bounded(monkeypatch):
    import pyarrow as pa

    from tessera.llm import common

    monkeypatch.setattr(common, "SLICE", 100)
    b = pa.RecordBatch.from_arrays([pa.array(range(50)), pa.array(["x" * 20] * 50)], names=["doc_id", "text"])
    some = list(common.slices(b))
    assert pa.Table.from_batches(some) == pa.Table.from_batches([b]) and max(s.num_rows for s in some) <= 4
    assert list(common.slices(b.slice(0, 0))) == []
