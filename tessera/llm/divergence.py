"""Source divergence audit: which terms a source overuses, and how far sources of a language lie apart.

Two passes over the texts. The first counts exact document frequencies: each
task's distinct terms of each text, summed by language and term, and keeps the
terms in at least MIN_DOCS documents of a language. The second counts all
occurrences of the kept terms with an Aho-Corasick automaton of them, padded
with delimiters on both sides, over the delimiter-padded texts. Where the kept
terms take at most VOCABULARY_BYTES, every task gets them all; where they take
more they are dealt to shards of that size, the texts' terms go to the shards
in delimiter-padded pieces, and each task builds the automata of its shards.

A term's share is p = 1 + floor(10^9 * (count + 1) / (N + V)), for groups
(language and source) and languages, in integers. f(p, q) = floor((p - q)^2 / q).
Summing f over all kept terms for two sources needs only what occurs: with z a
group's p of count 0,

    sum f(p, q) = V f(z, z') + sum over s's terms of f(p, z') - f(z, z')
                + sum over t's terms of f(z, q) - f(z, z')
                + sum over shared terms of f(p, q) - f(p, z') - f(z, q) + f(z, z')

The sums over one source's terms go by its distinct counts; the last meets
postings of a term, by blocks of sources, inside tasks that keep one sum a pair.

Defined results: null text, lang and source are empty; a text without terms adds
nothing but its group; a group without terms still has pairs; without kept terms
all its pairs have value 0 and it has no term rows; ties rank by the item's
bytes; repeated rows count each time; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, giving_back, small, table

MIN_DOCS = 3
TOP_TERMS = 200
UNIT = 1_000_000_000
#: Kept terms of at most so many bytes (8 more for each) go to every task; more are dealt to shards of about so many.
VOCABULARY_BYTES = 16 << 20
#: Bytes of texts whose terms are told apart at once, and of texts that wait for that; rows of a batch; numbers of kept terms, and counts of them, that a task holds before it hands them on.
SLAB, WAITING, HELD, RAW, COUNTS = 8 << 20, 24 << 20, 400_000, 1 << 20, 1 << 21
#: Bytes of a piece on its way to a shard; tasks that share a shard.
PIECE, COPIES = 1 << 16, 4
#: Sources of a block; pairs of postings evaluated at once.
BLOCK, PAIRS = 256, 1 << 18

#: A byte's form in terms: A-Z lower-cased, a-z and bytes of other characters as they are, all else a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def padded(raw: bytes) -> bytes:
    """The terms of a UTF-8 text with spaces between and around them."""
    return b" %b " % raw.translate(TERM_BYTES)


def plain(docs: DataFrame) -> DataFrame:
    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return docs.select(empty("lang"), empty("source"), empty("text").cast("binary").alias("text"))


def terms_of(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """All terms of some texts, one after the other, and the number of each one's text."""
    raw = np.frombuffer(b" ".join(texts), np.uint8)
    raw = np.frombuffer(TERM_BYTES, np.uint8)[raw]
    own = raw != 32
    edge = np.flatnonzero(np.diff(own, prepend=False, append=False))
    start, end = edge[0::2], edge[1::2]
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
    after = np.cumsum([len(t) + 1 for t in texts])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(raw[own])]), np.searchsorted(after, start, "right")


def slabs(rows: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, list[bytes]]]:
    """Texts, each after its language, in runs of one language of about SLAB bytes; those that wait for more of theirs take WAITING bytes at most."""
    runs, sizes, waiting = {}, {}, 0
    for lang, t in rows:
        runs.setdefault(lang, []).append(t)
        sizes[lang] = sizes.get(lang, 0) + len(t) + 1
        waiting += len(t) + 1
        if sizes[lang] >= SLAB or waiting >= WAITING:
            most = max(sizes, key=sizes.get)
            waiting -= sizes.pop(most)
            yield most, runs.pop(most)
    yield from runs.items()


def counted(texts: list[bytes]) -> tuple[pa.BinaryArray, np.ndarray]:
    """The different terms of some texts, and how many of the texts hold each."""
    words, of = terms_of(texts)
    words = words.dictionary_encode()
    kinds = len(words.dictionary)
    # once for each text: all texts' (text, term) pairs sorted as numbers
    pairs = np.sort(of * np.int64(kinds) + words.indices.to_numpy())
    once = pairs[np.diff(pairs, prepend=-1) != 0]
    return words.dictionary, np.bincount(once % max(1, kinds), minlength=kinds)


class Tally:
    """How often each number comes for each key (lang, source). names: the numbers' terms of a language."""

    def __init__(self, names):
        self.names, self.raw, self.n_raw = names, {}, 0
        self.own: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, key: tuple[str, str], numbers: Iterator[int]) -> None:
        numbers = np.fromiter(numbers, np.int32)
        if len(numbers):
            self.raw.setdefault(key, []).append(numbers)
            self.n_raw += len(numbers)
            if self.n_raw >= RAW:
                self.fold()

    def fold(self) -> None:
        for key, parts in self.raw.items():
            number, n = np.unique(np.concatenate(parts), return_counts=True)
            if key in self.own:
                number, of = np.unique(np.concatenate([self.own[key][0], number]), return_inverse=True)
                total = np.zeros(len(number), np.int64)
                np.add.at(total, of, np.concatenate([self.own[key][1], n]))
                n = total
            self.own[key] = number, n
        self.raw, self.n_raw = {}, 0

    def full(self) -> bool:
        return sum(len(n) for _, n in self.own.values()) >= COUNTS

    def batches(self) -> Iterator[pa.RecordBatch]:
        """lang, source, term, n of all so far, which are then forgotten."""
        self.fold()
        for (lang, source), (number, n) in self.own.items():
            for k in range(0, len(n), HELD):
                own, many = self.names(lang).take(pa.array(number[k : k + HELD])), n[k : k + HELD]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(many)), pa.repeat(source, len(many)), own, pa.array(many)], names=["lang", "source", "term", "n"])
        self.own = {}


def document_frequencies(docs: DataFrame) -> DataFrame:
    """lang, term (binary) and n, the number of documents of the language that hold it."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _built.clear()  # the automata of an earlier vocabulary
        rows = ((lang, text.as_py()) for batch in batches for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True))
        for lang, some in slabs(rows):
            terms, n = counted(some)
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(n)), terms, pa.array(n)], names=["lang", "term", "n"])

    return docs.select("lang", "text").mapInArrow(giving_back(part), "lang string, term binary, n long").groupBy("lang", "term").agg(F.sum("n").alias("n"))


def automaton(terms: list[bytes]):
    """Finds each term where it stands between delimiters; the value is its place in terms. Bytes go as the characters of the same numbers."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, t in enumerate(terms):
        a.add_word(f" {t.decode('latin-1')} ", k)
    a.make_automaton()
    return a


second = itemgetter(1)

#: This worker's automata of one vocabulary, by language, kept for the next task that counts with them; other tasks drop them.
_built: dict[str, dict] = {}


def built(vocabulary: str, lang: str, terms) -> object:
    """The automaton of a language's terms (an Arrow array, or None) in a vocabulary of that name."""
    if vocabulary not in _built:
        _built.clear()
    known = _built.setdefault(vocabulary, {})
    if lang not in known:
        known[lang] = automaton(terms.to_pylist()) if terms is not None else None
    return known[lang]


def occurrences(a, text: bytes) -> Iterator[int]:
    """The numbers of the automaton's terms in a padded text, one for each occurrence."""
    return map(second, a.iter(text.decode("latin-1")))


def recount_whole(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """lang, source, term and n for a vocabulary that every task can hold."""
    rows = vocabulary.toArrow().sort_by([("n", "descending")])  # of at most VOCABULARY_BYTES; frequent terms stand together in memory
    by_lang = {lang: rows.filter(pc.equal(rows["lang"], lang))["term"].combine_chunks() for lang in rows["lang"].unique().to_pylist()}
    sent, name = docs.sparkSession.sparkContext.broadcast(by_lang), uuid.uuid4().hex

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(lambda lang: sent.value[lang])
        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                a = built(name, lang, sent.value.get(lang))
                if a:
                    tally.add((lang, source), occurrences(a, padded(text.as_buffer().to_pybytes())))
            if tally.full():
                yield from tally.batches()
        yield from tally.batches()

    return docs.mapInArrow(giving_back(part), "lang string, source string, term binary, n long")


def recount_sharded(docs: DataFrame, vocabulary: DataFrame, n_shards: int) -> DataFrame:
    """The same for any vocabulary: terms of texts meet the kept terms of their shard, which COPIES tasks share (a frequent term's pieces are dealt among them)."""
    from zlib import crc32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, size, turn = {}, 0, TaskContext.get().partitionId()

        def hand_on():
            nonlocal size, turn
            rows = []
            for (lang, shard, source), terms in held.items():
                turn += 1
                rows.append((lang, shard, turn % COPIES, 1, source, b" %b " % b" ".join(terms)))
            held.clear()
            size = 0
            if rows:
                kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["lang", "shard", "copy", "kind", "source", "piece"])

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                for term in text.as_buffer().to_pybytes().translate(TERM_BYTES).split():
                    held.setdefault((lang, crc32(term) % n_shards, source), []).append(term)
                    size += len(term) + 1
                    if size > 64 * PIECE:
                        yield from hand_on()
        yield from hand_on()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, terms, a, tally = None, [], None, None
        for batch in batches:
            for lang, shard, copy, kind, source, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lang, shard, copy) != now:
                    if tally:
                        yield from tally.batches()
                    now, terms, a, tally = (lang, shard, copy), [], None, None
                if kind == 0:  # kept terms come first
                    terms.append(piece)
                elif terms:
                    if not tally:
                        own = pa.array(terms, pa.binary())
                        a, tally = automaton(terms), Tally(lambda lang, own=own: own)
                    tally.add((lang, source), occurrences(a, piece))
            if tally and tally.full():
                yield from tally.batches()
        if tally:
            yield from tally.batches()

    row = "lang string, shard int, copy int, kind int, source string, piece binary"
    shard = F.pmod(F.crc32("term"), F.lit(n_shards)).cast("int")
    kept = vocabulary.select("lang", shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("source"), F.col("term").alias("piece"))
    met = docs.mapInArrow(giving_back(deal), row).unionByName(kept).repartition("lang", "shard", "copy").sortWithinPartitions("lang", "shard", "copy", "kind")
    return met.mapInArrow(giving_back(count), "lang string, source string, term binary, n long")


def postings(docs: DataFrame, vocabulary: DataFrame, most: int = VOCABULARY_BYTES) -> DataFrame:
    """lang, source, term and n, the occurrences of each kept term in each group that has it."""
    size = vocabulary.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    found = recount_whole(docs, vocabulary) if size <= most else recount_sharded(docs, vocabulary, -(-size // most))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(count, total):
    """1 + floor(10^9 * (count + 1) / total)."""
    return F.expr(f"1L + (CAST({count} + 1L AS DECIMAL(20, 0)) * CAST({UNIT} AS DECIMAL(10, 0))) DIV CAST(greatest({total}, 1L) AS DECIMAL(20, 0))")


def apart(p: str, q: str) -> str:
    """f(p, q) as SQL."""
    return f"((({p}) - ({q})) * (({p}) - ({q})) DIV ({q}))"


def shared_terms(placed: DataFrame) -> DataFrame:
    """lang, s, t and value: for pairs of sources, the sum over the terms that both have of f(p, q) - f(p, z') - f(z, q) + f(z, z').

    placed: lang, s (the source's number in its language), term, p, z. A posting goes once to each block of sources.
    """

    def far(p, q):
        return (p - q) ** 2 // q

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums, tail = None, None, None
        _built.clear()

        def hand_on():
            if sums is not None:
                i, j = np.nonzero(sums)
                if len(i):
                    at = np.array([now[1] * BLOCK + np.arange(BLOCK), now[2] * BLOCK + np.arange(BLOCK)]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(i), pa.string()), pa.array(at[i]), pa.array(at[j]), pa.array(sums[i, j])], names=["lang", "s", "t", "value"])

        def meet(place, p, z, ends):
            """place: in the two blocks' numbers; ends: where each term's postings end."""
            starts = np.concatenate([[0], ends[:-1]])
            k = ends - starts
            first = 0
            many = np.cumsum(k * k)
            while first < len(k):
                to = max(first + 1, int(np.searchsorted(many, (many[first - 1] if first else 0) + PAIRS, "right")))
                of = np.repeat(np.arange(first, to), k[first:to])  # each posting's term
                i = np.repeat(np.arange(starts[first], ends[to - 1]), k[of])
                j = np.arange(len(i)) - np.repeat(np.cumsum(k[of]) - k[of], k[of]) + np.repeat(starts[of], k[of])
                other = place[i] // BLOCK != place[j] // BLOCK if now[1] != now[2] else i != j
                i, j = i[other], j[other]
                np.add.at(sums, (place[i], place[j]), far(p[i], p[j]) - far(p[i], z[j]) - far(z[i], p[j]) + far(z[i], z[j]))
                first = to

        def runs(rows):
            """The rows' stretches of one key and the last one's rest, whose last term may go on in the next batch."""
            lang, b1, b2 = rows[0], rows[1], rows[2]
            turn = np.flatnonzero((lang[1:] != lang[:-1]) | (b1[1:] != b1[:-1]) | (b2[1:] != b2[:-1])) + 1
            return list(zip([0, *turn], [*turn, len(lang)], strict=True))

        def work(rows):
            nonlocal now, sums
            for a, b in runs(rows):
                key = (rows[0][a], int(rows[1][a]), int(rows[2][a]))
                if key != now:
                    yield from hand_on()
                    now, sums = key, np.zeros((2 * BLOCK, 2 * BLOCK), np.int64)
                term, s = rows[3][a:b], rows[4][a:b]
                place = np.where(s // BLOCK == key[1], s % BLOCK, BLOCK + s % BLOCK)
                ends = np.append(np.flatnonzero(term[1:] != term[:-1]) + 1, b - a)
                meet(place, rows[5][a:b], rows[6][a:b], ends)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = [np.array(batch.column(k).to_pylist(), object) if k in (0, 3) else batch.column(k).to_numpy() for k in range(7)]
            if tail is not None:
                rows = [np.concatenate(x) for x in zip(tail, rows, strict=True)]
            # the last term's postings wait for the next batch
            last = len(rows[0]) - 1
            while last and all(rows[k][last - 1] == rows[k][-1] for k in range(4)):
                last -= 1
            tail = [x[last:] for x in rows]
            if last:
                yield from work([x[:last] for x in rows])
        if tail is not None:
            yield from work(tail)
        yield from hand_on()

    blocks = (placed.agg(F.max("s")).first()[0] or 0) // BLOCK
    own = F.floor(F.col("s") / BLOCK).cast("int")
    each = placed.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks)))).select("lang", F.least("b", own).alias("b1"), F.greatest("b", own).alias("b2"), "term", "s", "p", "z")
    dealt = each.repartition("lang", "b1", "b2", "term").sortWithinPartitions("lang", "b1", "b2", "term")
    return dealt.mapInArrow(giving_back(part), "lang string, s long, t long, value long")


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """lang, source, part, item, value, rank: the distance of each source to each other of its language (part pair), and the terms that it overuses most (part term)."""
    d = plain(docs)
    vocabulary = cut(document_frequencies(d).where(F.col("n") >= min_docs), "vocabulary")
    found = cut(postings(d, vocabulary, vocabulary_bytes), "postings")

    # a row a group: its total, its language's number of kept terms, and its share z of a term that it lacks
    sizes = vocabulary.groupBy("lang").agg(F.count("*").alias("n_kept"))
    totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = d.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["total", "n_kept"])
    groups = groups.withColumn("s", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - F.lit(1)).withColumn("s", F.col("s").cast("long"))
    groups = cut(groups.withColumn("z", share("0L", "total + n_kept")), "groups")
    by_group = small(groups)
    placed = cut(found.join(by_group, ["lang", "source"]).select("lang", "source", "s", "term", "n", share("n", "total + n_kept").alias("p"), "z"), "placed")

    # terms
    whole = found.groupBy("lang", "term").agg(F.sum("n").alias("all_n"))
    lang_totals = groups.groupBy("lang").agg((F.sum("total") + F.max("n_kept")).alias("all_total"))
    whole = whole.join(small(lang_totals), "lang").select("lang", "term", share("all_n", "all_total").alias("q"))
    over = placed.join(whole, ["lang", "term"]).where("n > 0 and p > q").select("lang", "source", F.col("term").cast("string").alias("item"), F.expr(apart("p", "q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")

    # pairs: of one source's terms by their distinct shares, of shared ones by their postings
    other = groups.select("lang", F.col("s").alias("t"), F.col("z").alias("y"))
    counts = placed.groupBy("lang", "s", "z", "p").agg(F.count("*").alias("m"))
    met = counts.join(small(other), "lang").where("s <> t")
    mine, theirs = f"{apart('p', 'y')} - {apart('z', 'y')}", f"{apart('y', 'p')} - {apart('y', 'z')}"
    met = met.groupBy("lang", "s", "t").agg(F.sum(F.expr(f"m * ({mine})")).alias("mine"), F.sum(F.expr(f"m * ({theirs})")).alias("theirs"))
    base = groups.join(small(other), "lang").where("s <> t").select("lang", "s", "t", F.expr(f"n_kept * {apart('z', 'y')}").alias("value"))
    parts = [base, met.select("lang", "s", "t", F.col("mine").alias("value")), met.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), F.col("theirs").alias("value")), shared_terms(placed)]
    values = parts[0]
    for x in parts[1:]:
        values = values.unionByName(x)
    values = values.groupBy("lang", "s", "t").agg(F.sum("value").alias("value"))
    name = groups.select("lang", "s", "source")
    values = values.join(small(name), ["lang", "s"]).join(small(name.select("lang", F.col("s").alias("t"), F.col("source").alias("item"))), ["lang", "t"])
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = values.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank"))
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS (SELECT id, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term FROM o GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN v USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
k AS (SELECT g.lang, g.source, v.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
s AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source))::HUGEINT AS p FROM k),
l AS (SELECT lang, term, 1 + 1000000000 * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang))::HUGEINT AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM k GROUP BY ALL)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
      UNION ALL SELECT s.lang, source, 'term', s.term, ((p - q) * (p - q) // q)::BIGINT FROM s JOIN l ON l.lang = s.lang AND l.term = s.term WHERE n > 0 AND p > q),
t AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
SELECT lang, source, part, item, value, rank::INT AS rank FROM t WHERE part = 'pair' OR rank <= 200
"""
