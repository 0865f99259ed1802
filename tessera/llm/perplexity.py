"""Quality by the perplexity of an interpolated modified Kneser-Ney model of word pairs.

Trusted documents (label quality 1), but for the fifth of them held out, train
the model: counts of word pairs, a start sign before and an end sign behind each
text; continuation counts of words; what the discounts take from each context.
All of them are Spark tables that grow with the trusted texts. With

    p1(w)    = (c1(w) - D1) / T1 + taken1 / T1 / (V + 1)
    p2(w|h)  = (n(h, w) - D2) / total(h) + weight(h) * p1(w)
    weight(h) = taken(h) / total(h)

the log of a text's probability is a sum over its words of log p1(w) + log
weight(w) and over its pairs seen in training of log(1 + (n - D2) / (taken(h) *
p1(w))). So each word and each pair has one value, and one join of the texts'
keys with those values gives all sums. Texts go to that join in chunks: for each
part of the key space a chunk's distinct keys, how often they occur, and in
which of its texts. Sums come back by the hash of a text, so that a chunk may
hold other texts each time the documents are read; copies of a text add up and
their sum is divided by their number. Pairs are counted and keys joined in slices of the key
space, one after the other, which lessens the disk in use; a slice has as many
parts as the bytes of the texts ask for. In a part keys are told apart by the 40
bits below those that name it (a part's keys are bounded, so about one unseen
key in a million is taken for a seen one). Keys with at least
1/HOT of all training occurrences (so at most 2 * HOT keys) are sent to all
tasks instead, and their hot groups to none. A word that is frequent in other
texts alone still meets in one part, folded by chunk.

A document is kept if its perplexity (over its words and the end sign) is at
most the QUANTILE of its language's held-out trusted documents.

Defined results: a null text and one without words have a null perplexity and
aren't kept; a null language is a language; one with fewer than MIN_TRUSTED
held-out trusted documents takes the quantile of all held-out ones, and of all
trusted ones if there are none held out; without training documents every
perplexity is null and no text is refused but those without words; repeated
rows are scored row by row; an empty table gives an empty table; other columns
are ignored. Words and texts are told apart by 64-bit hashes. docs may come in
any order and partitioning each time it is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, small, table
from .hashing import Words

QUANTILE, MIN_TRUSTED = 0.999, 20
HELD_OUT = 5  # one trusted document of so many sets thresholds
HOT = 10_000
CHUNK, CHUNK_ROWS = 1 << 22, 1 << 15  # characters and texts of a chunk
SLICES, COUNTED = 6, 3  # of the key space, one after the other: in the join and in the counting
PARTS, PART = 8, 16 << 20  # parts of a slice at least; bytes of text for each part of all slices beyond
NEW = np.uint16(1 << 15)  # set in the first place of each key; places are below
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def runs(texts: list[str | None], most: int) -> Iterator[list[str | None]]:
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t or "")
        if size >= most or len(run) >= CHUNK_ROWS:
            yield run
            run, size = [], 0
    if run:
        yield run


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return ((before << np.uint64(21)) | (before >> np.uint64(43))) ^ word


def signed_pairs(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts with words: each sign but the start, the sign before it, and the number of its text."""
    n = np.diff(w.first)
    has = np.flatnonzero(n)
    at = w.first[1:][has]
    word, doc = np.insert(w.hash, at, END), np.insert(w.doc, at, has)
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[w.first[:-1][has] + np.arange(len(has))] = START
    return before, word, doc


def slice_of(x: np.ndarray, slices: int) -> np.ndarray:
    return ((x >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)


def slice_column(name: str):
    return F.shiftrightunsigned(name, 32) % SLICES


def starts(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, which differ from the one before."""
    return np.diff(keys, prepend=keys[:1] + np.uint64(1)) != 0


def pair_counts(texts: DataFrame, k: int, slices: int) -> DataFrame:
    """before, word and n of the pairs of texts whose first sign is of slice k."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in runs(batch.column(0).to_pylist(), CHUNK):
                before, word, _ = signed_pairs(Words(run))
                mine = slice_of(before, slices) == k
                before, word = before[mine], word[mine]
                keys = pair_key(before, word)
                order = np.argsort(keys)
                new = np.flatnonzero(starts(keys[order]))
                first, n = order[new], np.diff(new, append=len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(before[first].view(np.int64)), pa.array(word[first].view(np.int64)), pa.array(n)], names=["before", "word", "n"])

    counts = texts.mapInArrow(part, "before long, word long, n long").groupBy("before", "word").agg(F.sum("n").alias("n"))
    return counts.sortWithinPartitions("before")  # a smaller file


def discounts(counts: DataFrame) -> list[float]:
    """The discounts of counts 1, 2 and more, within their bounds where counts are too few to tell."""
    n = [r or 0 for r in counts.agg(*[F.sum((F.col("n") == i).cast("long")) for i in (1, 2, 3, 4)]).first()]
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.0
    return [min(float(i), max(0.0, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 * i for i in (1, 2, 3)]


def discount(d: list[float]):
    return F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])


class Model:
    """pairs: the counts of each slice; signs: word, n (signs before it), total and taken (as a context); unknown: log2 p1 of an unseen word; edge: of the start's weight and the end."""

    def __init__(self, texts: DataFrame):
        slices = math.gcd(SLICES, COUNTED)  # slice k of the join lies in slice k % slices of these
        self.pairs = [cut(pair_counts(texts, k, slices), f"pairs-{k}") for k in range(slices)]
        pairs = self.every()
        self.d = discounts(pairs)
        contexts = pairs.groupBy(F.col("before").alias("word")).agg(F.sum("n").alias("total"), F.greatest(F.sum(discount(self.d)), F.lit(1e-12)).alias("taken"))
        self.signs = cut(pairs.groupBy("word").agg(F.count("*").alias("n")).join(contexts, "word", "full"), "signs")
        words = self.signs.where("n is not null")
        d1 = discounts(words)
        all1, taken1, kinds, self.total = words.agg(F.sum("n"), F.sum(discount(d1)), F.count("*")).crossJoin(self.signs.agg(F.sum("total"))).first()
        self.trained = bool(all1)
        if not self.trained:
            return
        base = max(taken1, 1e-12) / all1 / (kinds + 1)
        self.unknown = float(np.log2(base))
        self.p1, self.weight = (F.col("n") - discount(d1)) / all1 + base, F.col("taken") / F.col("total")
        self.edge = self.one(START, F.log2(self.weight)) + self.one(END, F.log2(self.p1))

    def every(self) -> DataFrame:
        out = self.pairs[0]
        for p in self.pairs[1:]:
            out = out.unionByName(p)
        return out

    def one(self, sign: np.uint64, column) -> float:
        return self.signs.where(F.col("word") == int(np.array([sign]).view(np.int64)[0])).select(column).first()[0]

    def values(self, pairs: DataFrame, signs: DataFrame) -> DataFrame:
        """key, value and n of the given signs (values are beyond that of an unseen word, which is 0 so) and of pairs that begin with one."""
        value = F.when(F.col("n").isNull(), 0.0).otherwise(F.log2(self.p1) - self.unknown) + F.coalesce(F.log2(self.weight), F.lit(0.0))
        single = signs.select(F.col("word").alias("key"), value.alias("value"), F.coalesce("total", F.lit(0)).alias("n"))
        contexts = signs.where("total is not null").select(F.col("word").alias("before"), "taken")
        words = self.signs.where("n is not null").select("word", self.p1.alias("p1"))
        two = pairs.join(contexts, "before").join(words, "word")
        gain = (F.col("n") - discount(self.d)) / (F.col("taken") * F.col("p1"))
        key = F.shiftleft("before", 21).bitwiseOR(F.shiftrightunsigned("before", 43)).bitwiseXOR(F.col("word"))
        return single.unionByName(two.select(key.alias("key"), F.log2(1 + gain).alias("value"), "n"))

    def sliced(self, k: int) -> DataFrame:
        pairs = self.pairs[k % len(self.pairs)].where(slice_column("before") == k)
        return self.values(pairs, self.signs.where(slice_column("word") == k)).select("key", "value")

    def hot(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys with at least 1/HOT of all occurrences, at most 2 * HOT of them, and their values."""
        least = max(2, self.total // HOT)
        rows = self.values(self.every().where(F.col("n") >= least), self.signs.where(F.col("total") >= least)).where(F.col("n") >= least).select("key", "value").collect()
        keys, value = np.array([r[0] for r in rows], np.int64).view(np.uint64), np.array([r[1] for r in rows], np.float64)
        order = np.argsort(keys)
        return keys[order], value[order]


def found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key its place among the ascending known ones, and whether it is there."""
    if not len(known):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    k = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return k, known[k] == keys


def chunks(batches: Iterator[pa.RecordBatch], column: int, most: int):
    """first row, batch and words of each chunk."""
    for batch in batches:
        row = 0
        for run in runs(batch.column(column).to_pylist(), most):
            yield row, batch, Words(run)
            row += len(run)


def heads(docs: DataFrame, sent, edge: float, unknown: float) -> DataFrame:
    """mark, doc_id, lang, n_signs and the bits of signs, hot keys and unseen words."""

    def part(batches):
        hot, value = sent.value
        for row, batch, w in chunks(batches, 2, CHUNK):
            size = len(w.first) - 1
            n = np.diff(w.first)
            bits = np.where(n > 0, edge + unknown * n, 0.0)
            before, word, doc = signed_pairs(w)
            for keys, of in ((w.hash, w.doc), (pair_key(before, word), doc)):
                k, hit = found(hot, keys)
                bits += np.bincount(of[hit], value[k[hit]], size) if hit.any() else 0.0
            cols = [*(batch.column(c).slice(row, size) for c in (3, 0, 1)), pa.array(n + (n > 0)), pa.array(bits)]
            yield pa.RecordBatch.from_arrays(cols, names=["mark", "doc_id", "lang", "n_signs", "bits"])

    return docs.mapInArrow(part, "mark long, doc_id long, lang string, n_signs long, bits double")


def packed(keys: np.ndarray, bits: int) -> bytes:
    """The 40 bits of each key below its first ones, which name its part."""
    return ((keys << np.uint64(bits)) >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.view(np.uint64)[:, 0]


def compact(places: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts that places name, of `size` in all, and the places as numbers among them (NEW stays)."""
    bare = places & ~NEW
    if len(bare) * 8 < size:
        texts, number = np.unique(bare, return_inverse=True)
    else:
        used = np.zeros(size, bool)
        used[bare] = True
        texts, number = np.flatnonzero(used), (np.cumsum(used) - 1)[bare]
    return texts, number.astype(np.uint16) | (places & NEW)


def postings(docs: DataFrame, sent, bits: int, k: int) -> DataFrame:
    """Of slice k (of words, and of pairs by their first), a row for a chunk and part: its distinct keys, key by key the places of their texts, and the marks of the texts."""

    def part(batches):
        hot, _ = sent.value
        borders = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
        for row, batch, w in chunks(batches, 2, CHUNK):
            size = len(w.first) - 1
            marks = batch.column(3).slice(row, size).to_numpy()
            before, word, doc = signed_pairs(w)
            one, two = slice_of(w.hash, SLICES) == k, slice_of(before, SLICES) == k
            keys = np.concatenate([w.hash[one], pair_key(before[two], word[two])])
            order = np.argsort(keys)
            keys, place = keys[order], np.concatenate([w.doc[one], doc[two]])[order].astype(np.uint16)
            cold = ~found(hot, keys)[1]
            keys, place = keys[cold], place[cold]
            new = starts(keys)
            place |= new * NEW
            i, own = np.append(np.searchsorted(keys, borders), len(keys)), keys[new]
            j = np.append(np.searchsorted(own, borders), len(own))
            rows = []
            for p in range(1 << bits):
                if i[p] < i[p + 1]:
                    texts, places = compact(place[i[p] : i[p + 1]], size)
                    rows.append((p, packed(own[j[p] : j[p + 1]], bits), places.tobytes(), marks[texts].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "keys", "places", "marks"])

    return docs.mapInArrow(part, "part int, keys binary, places binary, marks binary")


def looked_up(texts: pa.Table, values: pa.Table) -> pa.Table:
    """mark and bits: the sums of one part's values over each text's occurrences."""
    known = values.column("key").to_numpy().view(np.uint64)
    order = np.argsort(known)
    known, value = known[order], values.column("value").to_numpy()[order]
    out = [(np.zeros(0, np.int64), np.zeros(0))]
    for batch in texts.to_batches():
        for row in batch.select(["keys", "places", "marks"]).to_pylist():
            k, hit = found(known, unpacked(row["keys"]))
            if not hit.any():
                continue
            own, place = np.where(hit, value[k], 0.0), np.frombuffer(row["places"], np.uint16)
            total = np.bincount(place & ~NEW, own[np.cumsum(place >= NEW) - 1])
            which = np.flatnonzero(total)
            out.append((np.frombuffer(row["marks"], np.int64)[which], total[which]))
    return pa.table({n: np.concatenate(c) for n, c in zip(("mark", "bits"), zip(*out, strict=True), strict=True)})


def trusted_ids(labels: DataFrame) -> DataFrame:
    return labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()


def held_out(doc_id):
    return F.crc32(doc_id.cast("string").cast("binary")) % HELD_OUT == 0


def perplexities(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, n_signs and perplexity of every row of docs (doc_id, lang, text)."""
    docs = docs.select("doc_id", "lang", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    if not model.trained:
        none = heads(docs, docs.sparkSession.sparkContext.broadcast((np.zeros(0, np.uint64), np.zeros(0))), 0.0, 0.0)
        return none.select("doc_id", "lang", "n_signs", F.lit(None).cast("double").alias("perplexity"))
    sent = docs.sparkSession.sparkContext.broadcast(model.hot())
    parts = max(PARTS, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // PART // SLICES)
    bits = math.ceil(math.log2(parts))
    part, key = F.shiftrightunsigned("key", 64 - bits).cast("int"), F.shiftrightunsigned(F.shiftleft("key", bits), 24)
    sums = None
    for k in range(SLICES):
        values = cut(model.sliced(k).select(part.alias("part"), key.alias("key"), "value"), f"values-{k}")
        each = postings(docs, sent, bits, k).groupBy("part").cogroup(values.groupBy("part")).applyInArrow(looked_up, "mark long, bits double")
        own = cut(each.groupBy("mark").agg(F.sum("bits").alias("bits")), f"bits-{k}")
        forget(values)
        sums = own if sums is None else sums.unionByName(own)
    head = cut(heads(docs, sent, model.edge, model.unknown), "heads")
    copies = head.groupBy("mark").agg(F.count("*").alias("copies"))
    sums = sums.groupBy("mark").agg(F.sum("bits").alias("more")).join(copies, "mark").select("mark", (F.col("more") / F.col("copies")).alias("more"))
    out = head.join(sums, "mark", "left")
    bits = F.col("bits") + F.coalesce("more", F.lit(0.0))
    return out.select("doc_id", "lang", "n_signs", F.when(F.col("n_signs") > 0, F.pow(F.lit(2.0), -bits / F.col("n_signs"))).alias("perplexity"))


def score(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, trusted, perplexity, threshold and kept of every row of docs."""
    ids = small(cut(trusted_ids(labels), "trusted"))
    model = Model(docs.where(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).join(ids, "doc_id", "left_semi").select("text"))
    scored = perplexities(docs.select(F.col("doc_id").cast("long"), "lang", "text"), model)
    marked = ids.select(F.col("doc_id").alias("_trusted"))
    scored = scored.join(marked, scored["doc_id"] == marked["_trusted"], "left")
    scored = cut(scored.select("doc_id", "lang", F.col("_trusted").isNotNull().alias("trusted"), "perplexity", "n_signs"), "perplexity")
    trusted = scored.where("trusted and perplexity is not null")
    held = trusted.where(held_out(F.col("doc_id")))
    at = F.percentile_approx("perplexity", quantile, 10_000)
    every = held.agg(at).first()[0] or trusted.agg(at).first()[0]
    by = held.groupBy("lang").agg(at.alias("own"), F.count("*").alias("n")).where(F.col("n") >= MIN_TRUSTED).select(F.col("lang").alias("_lang"), "own")
    out = scored.join(by, F.col("lang").eqNullSafe(F.col("_lang")), "left").withColumn("threshold", F.coalesce("own", F.lit(every).cast("double")))
    kept = (F.col("n_signs") > 0) & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "trusted", "perplexity", "threshold", kept.alias("kept"))


def op7_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
