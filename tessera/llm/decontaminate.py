"""Benchmark decontamination by SimHash windows, in DataFrame expressions only.

An item's words are its lower-cased runs of letters and digits, its shingles the
word 5-grams (the whole sequence where it has fewer words). A window has as many
words as an item, or is the whole of a shorter text; it may start at any word.
Let a window hold the weight h in shingles of any item of its size, wherever they
stand in the item, and the weight u in others: its similarity with an item of
weight i is at most h / (u + i). h and u are running sums over a text, so only
windows where this bound, with the lightest item of the size, reaches 0.8 are
made; no other can match. Each gets a 64-bit SimHash of its weighted shingles.
Fingerprints are cut into 8 blocks of 8 bits. If two of them differ in at most
23 bits, some block differs in at most 2; an index of all items' blocks with
their neighbours within 2 bits therefore finds every item within that radius.
Candidates are then verified exactly: the weighted Jaccard similarity of the
shingles must reach 0.8. A shingle weighs ln(1 + n / items that hold it) among
the n items; one that no item holds weighs as if a single item held it.

Defined results: null and empty texts or items hold no window; items with equal
texts are all reported; an item of fewer than five words matches a document
whose whole text has the same words; a document gives one row for each item it
leaks, at its best window (the earliest of equals); rows that repeat a doc_id
with equal texts are one document, and of different texts each is searched on
its own and the best window of all reported; a null doc_id gives no row; an
empty table or an empty benchmark gives an empty table; other columns are
ignored. Texts are told apart by 64-bit hashes.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, run_hash, small

SHINGLE = 5
MIN_SIMILARITY = 0.8
RADIUS = 23
BLOCKS, BLOCK_BITS, NEAR_BITS = 8, 8, 2


def item_words(text):
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), "")


def shingle_hashes(w):
    """Hash of every word 5-gram of w, in order; of the whole of a shorter w."""
    full = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: run_hash(w, i, SHINGLE))
    return F.when(F.size(w) >= SHINGLE, full).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def simhash(weighted):
    """64-bit SimHash of an array of (h, weight)."""

    def bit(b):
        lean = F.aggregate(weighted, F.lit(0.0), lambda s, x: s + F.when(F.call_function("shiftright", x["h"], b).bitwiseAND(1) == 1, x["weight"]).otherwise(-x["weight"]))
        return F.when(lean > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), b)).otherwise(F.lit(0).cast("bigint"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("bigint"), lambda f, b: f.bitwiseOR(bit(b)))


def block(fingerprint, k):
    return F.shiftright(fingerprint, k * BLOCK_BITS).bitwiseAND(2**BLOCK_BITS - 1).cast("int")


def near_masks() -> list[int]:
    """All changes of at most NEAR_BITS bits of a block."""
    return [sum(1 << b for b in c) for n in range(NEAR_BITS + 1) for c in combinations(range(BLOCK_BITS), n)]


def leaks(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, start_word, n_words (of the window), hamming, similarity for every item that a document leaks."""
    found = leaking_texts(docs, benchmark, min_similarity, radius)
    found = small(cut(found, "leaking-texts"))
    ids = docs.where(F.col("doc_id").isNotNull()).select("doc_id", text_mark().alias("mark")).join(found, "mark")
    best = F.max_by(F.struct("start", "words", "hamming", "similarity"), F.struct(F.round("similarity", 9), -F.col("start"), "words", -F.col("hamming")))
    found = ids.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return found.select("doc_id", "item_id", F.col("b.start").cast("long").alias("start_word"), F.col("b.words").cast("long").alias("n_words"), F.col("b.hamming").cast("int").alias("hamming"), F.col("b.similarity").alias("similarity"))


def text_mark():
    return F.xxhash64(F.coalesce("text", F.lit("")))


def leaking_texts(docs: DataFrame, benchmark: DataFrame, min_similarity: float = MIN_SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """mark (of the text), item_id, start, words, hamming, similarity for every item that a text leaks."""
    items = benchmark.select("item_id", item_words(F.col("text")).alias("w")).where(F.size("w") > 0).dropDuplicates(["item_id"])
    items = cut(items.withColumn("g", shingle_hashes(F.col("w"))).withColumn("n_words", F.size("w")).drop("w"), "items")
    n_items = items.count()
    # a shingle's weight and the sizes of items that hold it
    holders = items.select("item_id", F.explode(F.array_distinct("g")).alias("h")).groupBy("h").count()
    weights = cut(holders.select("h", F.log1p(F.lit(float(n_items)) / F.col("count")).alias("weight")), "weights")
    rare = F.lit(_log1p(n_items))
    sizes = cut(items.select("n_words", F.explode("g").alias("h")).distinct().join(weights, "h"), "sizes")

    def weighted(df, keys):
        """Distinct shingles of g with multiplicity and weight, as an array of (h, weight)."""
        each = df.select(*keys, F.explode_outer("g").alias("h")).where("h is not null").groupBy(*keys, "h").count()
        each = each.join(small(weights), "h", "left").withColumn("weight", F.coalesce("weight", rare) * F.col("count"))
        return each.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("h", "weight"))).alias("s"))

    item_sets = weighted(items, ["item_id", "n_words"]).withColumn("f", simhash(F.col("s"))).withColumnRenamed("s", "item_s").withColumnRenamed("f", "item_f").withColumnRenamed("n_words", "item_words")
    item_sets = cut(item_sets, "item-sets")
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x["weight"])
    lightest = item_sets.groupBy(F.col("item_words").alias("n_words")).agg(F.min(total("item_s")).alias("lightest"))

    # windows: each shingle that items of a size hold counts in all windows of that size over it
    d = docs.select(text_mark().alias("mark"), item_words(F.col("text")).alias("w"))
    d = d.select("mark", F.size("w").alias("doc_words"), shingle_hashes(F.col("w")).alias("g"))
    # the outer form, or a filter on the array's size would compute all hashes once more below
    hits = d.select("mark", "doc_words", F.posexplode_outer("g").alias("p", "h")).where("h is not null").join(small(sizes), "h")
    hits = hits.where((F.col("n_words") >= SHINGLE) | (F.col("doc_words") == F.col("n_words"))).groupBy("mark", "doc_words", "n_words", "p").agg(F.first("weight").alias("weight"))
    held = F.greatest(F.least("n_words", "doc_words") - (SHINGLE - 1), F.lit(1))
    last = F.greatest(F.col("doc_words") - F.col("n_words"), F.lit(0))
    enters = F.struct(F.greatest(F.col("p") - held + 1, F.lit(0)).alias("at"), F.col("weight"), F.lit(1).alias("n"))
    leaves = F.struct((F.least("p", last) + 1).alias("at"), (-F.col("weight")).alias("weight"), F.lit(-1).alias("n"))
    turns = hits.select("mark", "doc_words", "n_words", F.explode(F.array(enters, leaves)).alias("x"))
    turns = turns.groupBy("mark", "n_words", "doc_words", "x.at").agg(F.sum("x.weight").alias("weight"), F.sum("x.n").alias("n"))
    by_start = Window.partitionBy("mark", "n_words", "doc_words").orderBy("at")
    turns = turns.select("mark", "n_words", "doc_words", F.col("at").alias("first"), (F.lead("at").over(by_start) - 1).alias("last"), F.sum("weight").over(by_start).alias("h"), F.sum("n").over(by_start).alias("n"))
    turns = turns.where("n > 0").join(F.broadcast(lightest), "n_words")
    windows = turns.where(F.col("h") >= min_similarity * ((held - F.col("n")) * rare + F.col("lightest")) - 1e-6)
    # once more over the texts that have windows, for the windows' own shingles
    spans = windows.groupBy("mark").agg(F.collect_set(F.struct("first", "last", "n_words", F.least("n_words", "doc_words").alias("words"))).alias("spans"))
    spans = cut(spans, "spans")
    own = docs.select(text_mark().alias("mark"), "text").join(small(spans), "mark").select("mark", "spans", item_words(F.col("text")).alias("w"))
    own = own.select("mark", "spans", shingle_hashes(F.col("w")).alias("g"))
    own = own.select("mark", "g", F.explode_outer("spans").alias("x")).select("mark", "g", "x.n_words", "x.words", F.explode(F.sequence("x.first", "x.last")).alias("start"))
    own = own.dropDuplicates(["mark", "start", "n_words"]).withColumn("g", F.slice("g", F.col("start") + 1, F.greatest(F.col("n_words") - (SHINGLE - 1), F.lit(1))))
    own = weighted(own, ["mark", "start", "n_words", "words"])
    own = cut(own.withColumn("f", simhash(F.col("s"))), "fingerprints")

    # multi-index: items under every near value of each block
    index = item_sets.select("item_id", "item_f", "item_words", F.posexplode(F.array(*[block(F.col("item_f"), k) for k in range(BLOCKS)])).alias("k", "v"))
    index = index.select("item_id", "item_f", "item_words", "k", F.explode(F.transform(F.array(*[F.lit(m) for m in near_masks()]), lambda m: F.col("v").bitwiseXOR(m))).alias("v"))
    keyed = own.select("mark", "start", "n_words", "words", "s", "f", F.posexplode(F.array(*[block(F.col("f"), k) for k in range(BLOCKS)])).alias("k", "v"))
    far = F.bit_count(F.col("f").bitwiseXOR(F.col("item_f")))
    gap = F.col("f").bitwiseXOR(F.col("item_f"))
    first = F.coalesce(*[F.when(F.bit_count(block(gap, k)) <= NEAR_BITS, F.lit(k)) for k in range(BLOCKS)])  # the same pair in several blocks counts once
    index = small(index)
    found = keyed.join(index, ["k", "v"]).where((far <= radius) & (first == F.col("k")) & (F.col("n_words") == F.col("item_words"))).withColumn("hamming", far)
    found = found.select("mark", "start", "words", "hamming", "s", "item_id").join(small(item_sets.select("item_id", "item_s")), "item_id")

    # exact: the sum of the smaller over the sum of the larger weights of each shingle
    mine = F.map_from_entries("item_s")
    both = F.aggregate("s", F.lit(0.0), lambda a, x: a + F.least(x["weight"], F.coalesce(F.element_at(mine, x["h"]), F.lit(0.0))))
    found = found.withColumn("_b", both).withColumn("similarity", F.col("_b") / (total("s") + total("item_s") - F.col("_b"))).where(F.col("similarity") >= min_similarity - 1e-9)
    best = F.max_by(F.struct("start", "words", "hamming", "similarity"), F.struct(F.round("similarity", 9), -F.col("start")))
    return found.groupBy("mark", "item_id").agg(best.alias("b")).select("mark", "item_id", "b.*")


def _log1p(n: int) -> float:
    from math import log1p

    return log1p(n)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text leaks no item, with docs' own columns."""
    leaking = small(cut(leaking_texts(docs.select("text"), benchmark).select("mark").distinct(), "leaking"))
    return docs.join(leaking, F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == leaking["mark"], "left_anti")


def op10_decontaminate(spark, sf_dir):
    from .common import table

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "start_word", "n_words", "similarity")


SQL = r"""
WITH it AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ig AS (SELECT item_id, len(w) AS n_words, unnest(range(0, greatest(len(w) - 4, 1))) AS o, w FROM it WHERE len(w) > 0),
ish AS (SELECT item_id, n_words, o, array_to_string(list_slice(w, o + 1, CASE WHEN n_words < 5 THEN n_words ELSE o + 5 END), ' ') AS h FROM ig),
nn AS (SELECT count(DISTINCT item_id) AS n FROM ish),
wt AS (SELECT h, ln(1 + n::DOUBLE / count(DISTINCT item_id)) AS weight FROM ish, nn GROUP BY h, n),
iset AS (SELECT item_id, n_words, h, count(*) * weight AS weight FROM ish JOIN wt USING (h) GROUP BY item_id, n_words, h, weight),
isum AS (SELECT item_id, sum(weight) AS total FROM iset GROUP BY item_id),
tx AS (SELECT row_number() OVER () AS doc_id, text FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM tx),
ds AS (SELECT doc_id, len(w) AS doc_words, p, array_to_string(list_slice(w, p + 1, CASE WHEN len(w) < 5 THEN len(w) ELSE p + 5 END), ' ') AS h
       FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS p FROM d WHERE len(w) > 0)),
sz AS (SELECT DISTINCT h, n_words FROM ish),
win AS (SELECT DISTINCT doc_id, n_words, unnest(range(greatest(0, p - greatest(least(n_words, doc_words) - 4, 1) + 1), least(p, greatest(doc_words - n_words, 0)) + 1)) AS start
        FROM ds JOIN sz ON ds.h = sz.h WHERE n_words >= 5 OR doc_words = n_words),
wset AS (SELECT win.doc_id, win.start, win.n_words, ds.h, count(*) AS c FROM win JOIN ds ON ds.doc_id = win.doc_id AND ds.p >= win.start AND ds.p < win.start + greatest(win.n_words - 4, 1) GROUP BY win.doc_id, win.start, win.n_words, ds.h),
ww AS (SELECT doc_id, start, n_words, wset.h, c * coalesce(weight, ln(1 + n::DOUBLE)) AS weight FROM wset LEFT JOIN wt ON wset.h = wt.h, nn),
wsum AS (SELECT doc_id, start, n_words, sum(weight) AS total FROM ww GROUP BY ALL),
pr AS (SELECT ww.doc_id, start, ww.n_words, item_id, sum(least(ww.weight, iset.weight)) AS shared FROM ww JOIN iset ON ww.h = iset.h AND ww.n_words = iset.n_words GROUP BY ALL),
sim AS (SELECT pr.doc_id, pr.start, pr.n_words, pr.item_id, shared / (wsum.total + isum.total - shared) AS similarity
        FROM pr JOIN wsum ON pr.doc_id = wsum.doc_id AND pr.start = wsum.start AND pr.n_words = wsum.n_words JOIN isum ON pr.item_id = isum.item_id)
SELECT doc_id, item_id, start AS start_word, least(n_words, doc_words) AS n_words, similarity
FROM (SELECT sim.*, real_id AS doc_id, doc_words, row_number() OVER (PARTITION BY real_id, item_id ORDER BY round(similarity, 9) DESC, start, least(n_words, doc_words) DESC) AS r
      FROM (SELECT doc_id AS k, * EXCLUDE (doc_id) FROM sim) sim JOIN (SELECT doc_id AS k, max(doc_words) AS doc_words FROM ds GROUP BY doc_id) USING (k)
      JOIN (SELECT DISTINCT documents.doc_id AS real_id, tx.doc_id AS k FROM documents JOIN tx ON tx.text = documents.text WHERE documents.doc_id IS NOT NULL) USING (k)
      WHERE similarity >= 0.8 - 1e-9) WHERE r = 1
"""
