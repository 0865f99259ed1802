"""op11, op12 and op13: against SQL, on rows of odd shape, and on what SQL can't show."""

import gzip
import io
import random
import uuid

import duckdb
import pytest

from tessera.llm import divergence, filter_audit, warc
from tessera.llm.common import shared_dir

SF = "/root/testdata/sf0.001"
WORDS = [f"{a}{b}" for a in ("ba", "ké", "xu", "漢") for b in ("ro", "ß", "tin", "ly")]


def plain(rows, cols):
    return sorted([[None if r[c] is None else str(r[c]) for c in cols] for r in rows], key=repr)


def both(spark, query, sql, tables):
    """What the query and its SQL give for tables: name to (rows, schema)."""
    folder = f"{shared_dir(spark)}/odd-{uuid.uuid4().hex}"
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet/*.parquet')")
    df = query(spark, folder)
    cols = sorted(df.columns)
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = [dict(zip(names, r, strict=True)) for r in rel.fetchall()]
    return plain(df.collect(), cols), plain(want, cols)


def made(n: int, seed: int = 3):
    r = random.Random(seed)
    out = [(k, " ".join(r.choices(WORDS, k=r.randint(0, 60))) + r.choice(["", " #", ".", "\n| x"]), r.choice(["en", "de", None, ""]), r.choice(["a", "b", "ä", None, "c c"]), "x") for k in range(n)]
    out += [out[3], out[3], (n + 5, out[3][1], "en", "b", "x"), (None, out[3][1], "en", "b", "x"), (n + 6, None, "fr", "only", "x"), (n + 7, "", None, None, None), (n + 8, "ABC DEF " * 40, "en", "hot", "x")]
    return out + [(n + 9, "word'word2word_x É e " * 4000, "en", "hot", "x"), (n + 10, " \n\t", "xx", "p", "x"), (n + 11, "12 34", "xx", "q", "x")]


DOCS = "doc_id long, text string, lang string, source string, part string"
LABELS = "doc_id long, quality int, toxic int, source string"
KNOWN = [(k, (k * 7 % 3) - 1 if k % 5 else None, k % 2, "z") for k in range(60)] + [(3, 1, 0, "z"), (None, 1, 1, "z")]


def test_divergence_equals_sql(spark):
    got, want = both(spark, divergence.op11_source_divergence, divergence.SQL, {"documents": (made(200), DOCS)})
    assert got == want and len(got) > 100


def test_divergence_of_no_rows(spark):
    got, want = both(spark, divergence.op11_source_divergence, divergence.SQL, {"documents": ([], DOCS)})
    assert got == want == []


def test_divergence_without_kept_terms(spark):
    rows = [(1, "one", "en", "a", "x"), (2, "two", "en", "b", "x"), (3, "", "en", "c", "x"), (4, "one", "de", "a", "x")]
    got, want = both(spark, divergence.op11_source_divergence, divergence.SQL, {"documents": (rows, DOCS)})
    assert got == want and len(got) == 6


def test_divergence_by_shards(spark, monkeypatch):
    """A vocabulary over its bound, small flushes, blocks of two sources and few pairs at once change nothing."""
    docs = spark.createDataFrame(made(150), DOCS)
    cols = ["lang", "source", "part", "item", "value", "rank"]
    want = plain(divergence.audit(docs).collect(), cols)
    found = divergence.plain(docs)
    kept = divergence.document_frequencies(found).where("n >= 3")
    one = plain(divergence.recount_whole(found, kept).groupBy("lang", "source", "term").sum("n").collect(), ["lang", "source", "term", "sum(n)"])
    many = plain(divergence.recount_sharded(found, kept, 7).groupBy("lang", "source", "term").sum("n").collect(), ["lang", "source", "term", "sum(n)"])
    assert one == many and one
    monkeypatch.setattr(divergence, "BLOCK", 2)
    monkeypatch.setattr(divergence, "PAIRS", 3)
    monkeypatch.setattr(divergence, "RAW", 40)
    monkeypatch.setattr(divergence, "SLAB", 300)
    monkeypatch.setattr(divergence, "COUNTS", 60)
    monkeypatch.setattr(divergence, "HELD", 25)
    assert plain(divergence.audit(docs, vocabulary_bytes=100).collect(), cols) == want


def test_terms_of_bytes():
    assert divergence.padded("É-Az[9]x_y\x7fz q".encode()).split() == ["É".encode(), b"az", b"x", b"y", "z q".encode()]
    a = divergence.automaton([b"a", b"ab", b"b"])
    assert list(divergence.occurrences(a, divergence.padded(b"a a ab,b abb"))) == [0, 0, 1, 2]


PAGES = "page_id long, url string, html string, payload string, digest string"
LONG = "é" * 50
ODD_PAGES = [
    (5, "http://a/ b\r\nX: y", LONG, "p", "d"), (3, None, LONG, "p", "d"), (9, "", LONG, "p", "d"), (3, "u", LONG, "p", "d"), (None, "u", LONG, "p", "d"),
    (7, "u", None, "p", "d"), (8, "u", "", "p", "d"), (11, "u", "x" * 99, "p", "d"), (10, "u", "x" * 99, "p", "d"), (13, "u", "x" * 100, "p", "d"), (12, "u", "x" * 100, "p", "d"),
    (14, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 50_000, "p", "d"), (None, "u", "only null ids " * 20, "p", "d"), (None, "u", "only null ids " * 20, "p", "d"),
]


@pytest.mark.parametrize("rows", [ODD_PAGES, []])
def test_warc_equals_sql(spark, rows):
    got, want = both(spark, warc.op12_warc, warc.SQL, {"pages": (rows, PAGES)})
    assert got == want and len(got) == len(rows)


def test_warc_round_trip(spark):
    pages = spark.createDataFrame(ODD_PAGES, PAGES)
    manifest = warc.write(pages, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}", archive_bytes=700)
    assert manifest.count() > 3
    back = warc.read(manifest, payloads=True)
    assert warc.unresolved(back).count() == 0
    got = sorted((r.page_id or -1, r.payload.decode()) for r in back.where("record_type = 'response'").collect())
    first = {LONG: [3, 3], "x" * 100: [12]}
    want = sorted((p[0] or -1, p[2] or "") for p in ODD_PAGES if p[2] not in first) + [(i, t) for t, ids in first.items() for i in ids]
    assert got == sorted(want)


def archive() -> bytes:
    one = warc.page_member(1, "u", b"payload" * 40, warc.hashlib.sha256(b"payload" * 40).hexdigest(), None)
    return one + warc.page_member(2, "u", b"payload" * 40, warc.hashlib.sha256(b"payload" * 40).hexdigest(), 1)


def test_warc_members_stand_alone():
    assert gzip.decompress(archive()).count(b"WARC/1.1\r\n") == 2
    rows = list(warc.records(io.BytesIO(archive()), payloads=True))
    assert [r[0] for r in rows] == [1, 2] and [r[3] for r in rows] == ["response", "revisit"] and rows[0][5] == b"payload" * 40 and rows[1][1] == 280 and rows[1][4] == 1


def test_warc_reads_in_small_pieces(monkeypatch):
    want = list(warc.records(io.BytesIO(archive()), payloads=True))
    for n in (1, 2, 7, 64):
        monkeypatch.setattr(warc, "PIECE", n)
        assert list(warc.records(io.BytesIO(archive()), payloads=True)) == want


def damaged():
    raw = archive()
    yield raw[:-5], "ends within"
    yield b"no gzip" + raw, "not a gzip member"
    plain = gzip.decompress(raw[: raw.index(b"\x1f\x8b", 4)])
    yield gzip.compress(plain.replace(b"payloadpayload", b"payloadPayload", 1)), "isn't what"
    yield gzip.compress(plain[:-4] + b"x\r\n\r\n"), "Content-Length isn't"
    yield gzip.compress(plain[:-40]), "fewer than"
    yield gzip.compress(plain.replace(b"WARC/1.1", b"HTTP/1.1", 1)), "version"
    yield gzip.compress(plain.replace(b"Content-Length: 3", b"Content-Length: x", 1)), "no number"
    yield gzip.compress(b"WARC/1.1"), "head without end"


@pytest.mark.parametrize(("raw", "why"), list(damaged()))
def test_warc_says_where_it_is_damaged(raw, why):
    with pytest.raises(warc.ArchiveError, match=f"record 1: .*{why}|record 2: .*{why}"):
        list(warc.records(io.BytesIO(raw)))


def test_filter_audit_equals_sql(spark):
    got, want = both(spark, filter_audit.op13_filter_audit, filter_audit.SQL, {"documents": (made(150), DOCS), "labels": (KNOWN, LABELS)})
    assert got == want and len(got) % 600 == 0


def test_filter_audit_of_no_rows(spark):
    got, want = both(spark, filter_audit.op13_filter_audit, filter_audit.SQL, {"documents": ([], DOCS), "labels": ([], LABELS)})
    assert got == want == []


def test_filter_audit_of_other_filters(spark):
    rows = [("p", 0b011, True, False), ("p", 0b001, False, True), ("p", 0, False, False), ("q", 0b100, True, True)]
    out = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(spark.createDataFrame(rows, "part string, fails int, good boolean, toxic boolean"), "xyz").collect()}
    assert len(out) == 2 * 6 * 3
    r = out["p", "yxz", 2]
    assert (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) == (1, 1, 1, 1, 0, 1, 6 + 3)
    assert [out["q", "xyz", k].kept for k in (1, 2, 3)] == [1, 1, 0] and out["q", "zxy", 1].shapley == 6


def test_texts_wait_for_their_language_within_bounds(monkeypatch):
    monkeypatch.setattr(divergence, "SLAB", 40)
    monkeypatch.setattr(divergence, "WAITING", 70)
    rows = [(f"l{k % 5}", b"x" * (k % 13)) for k in range(200)] + [("l1", b"y" * 500)]
    runs = list(divergence.slabs(iter(rows)))
    assert sorted((lang, t) for lang, run in runs for t in run) == sorted(rows)
    assert max(sum(len(t) + 1 for t in run[:-1]) for _, run in runs) < 40
    assert len(runs) < len(rows) / 3


def test_other_tasks_drop_the_automata_of_a_vocabulary(spark):
    class Docs:
        """Takes the tasks' functions of batches."""

        def select(self, *columns):
            return self

        def mapInArrow(self, part, schema):
            self.part = part
            return self

        groupBy = agg = select

    docs = Docs()
    divergence.document_frequencies(docs)
    divergence._built["earlier"] = {"en": divergence.automaton([b"term"])}
    assert list(docs.part(iter([]))) == [] and not divergence._built
