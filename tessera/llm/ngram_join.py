"""Jaccard join of n-gram sets with prefix trees.

1. Every text becomes its set of distinct word n-grams, as 64-bit hashes. Texts
   with the same set are one node from here on. Tasks pack texts into chunk rows
   (compressed), so that later steps meet the same texts together.
2. N-grams are counted over all documents in groups by hash: each chunk sends its
   distinct n-grams once, and gets back a class for each, which grows with its
   count. No task and no driver holds a table of n-grams. The global order puts
   n-grams found fewer than KNOWN times (class 0) first, by hash, then the others
   from the rarest class up. Any fixed order gives all links.
3. Two sets that link share an n-gram among the first ones of both. One of class
   0 is in fewer than KNOWN documents, so its pairs are made at once. For the
   others each node is first paired with one hub of the n-gram; once those links
   are verified and merged, only n-grams that still join several components are
   left. Their nodes are dealt into blocks of bounded bytes, and every two blocks
   meet in one trie.
4. A trie stores ordered sets; all its probes walk it together. What members have
   in common is counted once for each probe, and a probe leaves a subtree as soon
   as the rest of its longest set can't bring the overlap to what its shortest
   needs. A trie gives links that join what it joins, not all pairs.
5. Links are merged into components by passing on smallest labels.

Defined results: without words (or null) a text's set is empty and links with
nothing; a text of fewer than n words has its whole sequence as its only n-gram;
a null doc_id has a null component and links with nothing; rows of one doc_id
are one document of several sets in components(), each row with its own
n_shingles, but rows of their own in keep(); an empty table gives an empty table;
other columns are ignored by components() and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, free, giving_back, small, table
from .hashing import Words, mixed, shingle_sets

SIZE, PERCENT = 5, 80
#: N-grams of fewer documents are paired at once.
KNOWN = 5
#: N-grams of one group, bytes of sets in one block or trie, bytes of tries in one task's group.
GROUP_GRAMS, BLOCK_BYTES, DEAL_BYTES = 1_000_000, 2 << 20, 8 << 20
#: Bytes of texts in a chunk.
CHUNK = 1 << 21
#: Cells (probes times distinct n-grams) of a trie's table of who holds what.
CELLS = 1 << 21
LIGHT = np.uint64(1 << 56)


def packed(texts: list[bytes]) -> bytes:
    raw = np.array([len(texts), *map(len, texts)], "<i8").tobytes() + b"".join(texts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def unpacked(blob: bytes) -> list[str]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    at = 8 + 8 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<i8", n, 8))])
    return [raw[i:j].decode("utf-8", "surrogatepass") for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def sums(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal for equal sets."""
    total = lambda x: np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
    s1, s2 = total(sets), total((sets >> np.uint64(7)) * (sets | np.uint64(1)))
    a, b = at[:-1], at[1:]
    return mixed((s1[b] - s1[a]) ^ mixed((s2[b] - s2[a]) + (b - a).astype(np.uint64)))


def chunked(docs: DataFrame, size: int) -> DataFrame:
    """Chunk rows: a name, and by document its id (and whether it has one), hash of text, size and node; the texts, compressed."""

    def row(run):
        ids, marks, texts = zip(*run, strict=True)
        sets, at = shingle_sets(Words(list(texts)), size)
        cells = [np.array([k or 0 for k in ids], "<i8"), np.array([k is not None for k in ids], np.uint8), np.array(marks, "<i8"), np.diff(at).astype("<i8"), sums(sets, at).astype("<u8")]
        # named by what it holds and where it stands: a chunk written again has the same name
        where = (TaskContext.get().partitionId() << 32) + row.n
        row.n += 1
        names = ["c", "n_grams", "ids", "known", "marks", "sizes", "nodes", "blob"]
        blob = packed([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        return pa.RecordBatch.from_arrays([pa.array([where]), pa.array([len(sets)]), *[pa.array([c.tobytes()], pa.binary()) for c in cells], pa.array([blob], pa.binary())], names=names)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row.n, run, held = 0, [], 0
        for batch in batches:
            for k, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                run.append((k, mark, text.as_py()))
                held += len(run[-1][2] or "") + 16
                if held >= CHUNK:
                    yield row(run)
                    run, held = [], 0
        if run:
            yield row(run)

    from pyspark import TaskContext

    kinds = "c long, n_grams long, ids binary, known binary, marks binary, sizes binary, nodes binary, blob binary"
    return docs.select(F.col("doc_id").cast("long"), mark(F.col("text")), "text").mapInArrow(giving_back(part), kinds)


def mark(text):
    """By this and its doc_id a row is known again."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def rows_of(chunks: DataFrame) -> DataFrame:
    """doc_id, mark, n_shingles and node of every document of the chunks."""

    def part(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                ids, known, marks, sizes, nodes = (np.frombuffer(batch.column(i)[k].as_py(), t) for i, t in enumerate(("<i8", np.uint8, "<i8", "<i8", "<i8")))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64(), mask=known == 0), pa.array(marks), pa.array(sizes), pa.array(nodes)], names=["doc_id", "mark", "n_shingles", "node"])

    return chunks.select("ids", "known", "marks", "sizes", "nodes").mapInArrow(giving_back(part), "doc_id long, mark long, n_shingles long, node long")


def dealt(grams: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of grams by group, the groups that have any and where each begins; the last is the end."""
    group = (grams >> np.uint64(32)).astype(np.int64) % n_groups
    order = np.argsort(group, kind="stable")
    at = np.searchsorted(group[order], np.arange(n_groups + 1))
    return order, np.flatnonzero(np.diff(at)), at


def classes(chunks: DataFrame, size: int, n_groups: int) -> DataFrame:
    """c, g, classes: a byte for each distinct n-gram of a chunk in group g, in ascending order of hash."""

    def deal(batches):
        for batch in batches:
            for c, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                sets, _ = shingle_sets(Words(unpacked(blob.as_py())), size)
                grams, n = np.unique(sets, return_counts=True)
                order, groups, at = dealt(grams, n_groups)
                low, n = grams[order].astype("<u4"), np.minimum(n[order], 255).astype(np.uint8)
                cells = [pa.array([x[at[g] : at[g + 1]].tobytes() for g in groups], pa.binary()) for x in (low, n)]
                yield pa.RecordBatch.from_arrays([pa.array(groups), pa.array(np.full(len(groups), c)), *cells], names=["g", "c", "low", "n"])

    def count(df: pd.DataFrame) -> pd.DataFrame:
        low, n = np.frombuffer(b"".join(df["low"]), "<u4"), np.frombuffer(b"".join(df["n"]), np.uint8)
        value, where = np.unique(low, return_inverse=True)
        total = np.bincount(where, n, len(value))
        kind = np.where(total < KNOWN, 0, np.minimum(255, 1 + 8 * np.log2(np.maximum(total, 1)))).astype(np.uint8)[where]
        at = np.concatenate([[0], np.cumsum(df["n"].map(len))])
        return pd.DataFrame({"c": df["c"], "g": df["g"], "classes": [kind[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)]})

    sent = chunks.select("c", "blob").mapInArrow(giving_back(deal), "g long, c long, low binary, n binary")
    return sent.groupBy("g").applyInPandas(count, "c long, g long, classes binary")


def needs(a, b, percent: int):
    """The overlap that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))


def needs_own(n, percent: int):
    """The overlap that a set of size n needs with any partner."""
    return -(-percent * n // 100)


def first_grams(chunks: DataFrame, classed: DataFrame, size: int, percent: int, n_groups: int) -> DataFrame:
    """doc_id, node, n, rare (share of the set of class 0) and its first n-grams in the global order, as a class above 56 bits of hash."""

    def firsts(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left):
            sets, at = shingle_sets(Words(unpacked(left["blob"].iloc[0])), size)
            ids, known, nodes = (np.frombuffer(left[c].iloc[0], t) for c, t in (("ids", "<i8"), ("known", np.uint8), ("nodes", "<i8")))
            grams, where = np.unique(sets, return_inverse=True)
            order = dealt(grams, n_groups)[0]
            kind = np.zeros(len(grams), np.uint64)
            kind[order] = np.frombuffer(b"".join(right.sort_values("g")["classes"]), np.uint8)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            keys = (kind[where] << np.uint64(56)) | (sets >> np.uint64(8))
            keys = keys[np.lexsort((keys, doc))]
            rare = np.bincount(doc[keys < LIGHT], minlength=len(n)) / np.maximum(1, n)
            last = at[:-1] + n - needs_own(n, percent) + 1
            for k in np.flatnonzero((n > 0) & (known == 1)).tolist():
                out.append((ids[k], nodes[k], n[k], rare[k], keys[at[k] : last[k]].tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "node", "n", "rare", "keys"])

    some = chunks.select("c", "ids", "known", "nodes", "blob")
    return some.groupBy("c").cogroup(classed.groupBy("c")).applyInPandas(firsts, "doc_id long, node long, n long, rare double, keys binary")


def light_pairs(firsts: DataFrame, percent: int, n_groups: int) -> DataFrame:
    """a < b: nodes that share an n-gram of class 0 among the first of both."""

    def deal(batches):
        for batch in batches:
            keys = [np.frombuffer(k, "<u8") for k in batch.column(2).to_pylist()]
            each = np.array([len(k) for k in keys])
            key, node, of = np.concatenate(keys), np.repeat(batch.column(0).to_numpy(), each), np.repeat(batch.column(1).to_numpy(), each)
            light = key < LIGHT
            key, node, of = key[light] << np.uint64(8), node[light], of[light].astype("<i4")
            order, groups, at = dealt(key, n_groups)
            cols = [key[order].astype("<u4"), node[order].astype("<i8"), of[order]]
            yield pa.RecordBatch.from_arrays([pa.array(groups)] + [pa.array([c[at[g] : at[g + 1]].tobytes() for g in groups], pa.binary()) for c in cols], names=["g", "key", "node", "of"])

    def pair(df: pd.DataFrame) -> pd.DataFrame:
        key, node, of = (np.frombuffer(b"".join(df[c]), t) for c, t in (("key", "<u4"), ("node", "<i8"), ("of", "<i4")))
        order = np.lexsort((node, key))
        key, node, of = key[order], node[order], of[order].astype(np.int64)
        found, step = [np.zeros((2, 0), np.int64)], 1
        while step < len(key) and (same := key[step:] == key[:-step]).any():  # fewer than KNOWN documents have a key
            i = np.flatnonzero(same)
            j = i + step
            ok = (np.minimum(of[i], of[j]) >= needs(of[i], of[j], percent)) & (node[i] != node[j])
            found.append(np.stack([node[i[ok]], node[j[ok]]]))
            step += 1
        a, b = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"a": a, "b": b})

    sent = firsts.select("node", "n", "keys").mapInArrow(giving_back(deal), "g long, key binary, node binary, of binary")
    return sent.groupBy("g").applyInPandas(pair, "a long, b long").distinct()


def heavy_places(firsts: DataFrame) -> DataFrame:
    """key, node, n, rare of the n-grams of higher classes among the first of each node."""

    def part(batches):
        for batch in batches:
            keys = [np.frombuffer(k, "<u8") for k in batch.column(3).to_pylist()]
            key, row = np.concatenate(keys), np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            key, row = key[key >= LIGHT], row[key >= LIGHT]
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *[batch.column(i).take(pa.array(row)) for i in range(3)]], names=["key", "node", "n", "rare"])

    return firsts.select("node", "n", "rare", "keys").mapInArrow(giving_back(part), "key long, node long, n long, rare double")


class Trie:
    """Ascending sets as a prefix tree: a subtree is a range of the sorted sets and a depth."""

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        self.universe = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
        self.sets = [np.searchsorted(self.universe, sets[k]) for k in self.order]
        self.size = np.array([len(s) for s in self.sets])

    def walk(self, probes: list[np.ndarray], percent: int) -> Iterator[tuple[np.ndarray, int]]:
        """For each member that some probe links with: which probes, and the member's number."""
        step = max(1, CELLS // max(1, len(self.universe)))
        for k in range(0, len(probes), step):
            for who, member in self._walk(probes[k : k + step], percent):
                yield who + k, member

    def _walk(self, probes, percent):
        n = np.array([len(p) for p in probes])
        holds = np.zeros((len(probes), len(self.universe)), bool)
        below = np.empty((len(probes), len(self.universe) + 1), np.int32)  # a probe's n-grams below each of the universe
        for k, p in enumerate(probes):
            at = np.searchsorted(p, self.universe)
            below[k, :-1], below[k, -1] = at, len(p)
            if len(p):
                holds[k] = p[np.minimum(at, len(p) - 1)] == self.universe
        stack = [(0, len(self.sets), 0, np.arange(len(probes)), np.zeros(len(probes), np.int64))] if self.sets else []
        while stack:
            low, high, depth, who, overlap = stack.pop()
            first, last = self.sets[low], self.sets[high - 1]
            m = min(len(first), len(last))
            differ = np.flatnonzero(first[depth:m] != last[depth:m])
            end = depth + int(differ[0]) if len(differ) else m
            edge = first[depth:end]
            if len(edge):
                overlap = overlap + holds[np.ix_(who, edge)].sum(axis=1)
            past = below[who, first[end - 1]] + holds[who, first[end - 1]] if end else 0
            longest, shortest = int(self.size[low:high].max()), int(self.size[low:high].min())
            stay = overlap + np.minimum(n[who] - past, longest - end) >= needs(n[who], shortest, percent)
            who, overlap = who[stay], overlap[stay]
            if not len(who):
                continue
            k = low
            while k < high and self.size[k] == end:  # whole sets that end here
                link = 100 * overlap >= percent * (n[who] + end - overlap)
                if link.any():
                    yield who[link], self.order[k]
                k += 1
            if k < high:
                heads = np.array([s[end] for s in self.sets[k:high]])
                edges = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), high - k]
                stack += [(k + i, k + j, end, who, overlap) for i, j in zip(edges, edges[1:], strict=False)]


def joined(nodes: np.ndarray, sets: list[np.ndarray], probe: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between the probes (a mask) and all of the nodes, as few as join what they join."""
    up = list(range(len(nodes)))

    def root(k):
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    links, own = [], np.flatnonzero(probe)
    for who, member in Trie(sets).walk([sets[k] for k in own], percent):
        for k in own[who].tolist():
            x, y = root(k), root(member)
            if x != y:
                up[max(x, y)] = min(x, y)
                links.append((int(nodes[k]), int(nodes[member])))
    return links


def sets_of(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """node, keys: the ordered sets of the documents (doc_id, mark) wanted."""

    def part(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            at_once = [0, *(np.flatnonzero(np.diff(np.cumsum([len(t or "") for t in texts]) // CHUNK)) + 1).tolist(), len(texts)]
            for i, j in zip(at_once, at_once[1:], strict=False):
                sets, at = shingle_sets(Words(texts[i:j]), size)
                yield pa.RecordBatch.from_arrays([pa.array(sums(sets, at).view(np.int64)), pa.array([sets[x:y].astype("<u8").tobytes() for x, y in zip(at[:-1], at[1:], strict=True)], pa.binary())], names=["node", "keys"])

    named = docs.select(F.col("doc_id").cast("long").alias("_id"), mark(F.col("text")).alias("_mark"), "text")
    some = named.join(small(wanted), (F.col("_id") == F.col("doc_id")) & (F.col("_mark") == F.col("mark")), "left_semi").select("text")
    return some.mapInArrow(giving_back(part), "node long, keys binary")


def verified(tries: DataFrame, docs: DataFrame, reps: DataFrame, size: int, percent: int) -> DataFrame:
    """Links found in tries: rows of trie, node, probe. In each trie the probes meet all nodes."""

    def group(df: pd.DataFrame) -> pd.DataFrame:
        links = []
        for _, d in df.groupby("trie", sort=False):
            d = d.sort_values("probe", ascending=False).drop_duplicates("node")
            links += joined(d["node"].to_numpy(), [np.frombuffer(k, "<u8") for k in d["keys"]], d["probe"].to_numpy(bool), percent)
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    tries = cut(tries, "tries")
    wanted = cut(reps.join(tries.select("node").distinct(), "node").select("node", "doc_id", "mark", "n_shingles"), "wanted")
    total = tries.join(wanted.select("node", "n_shingles"), "node").agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    n_groups = max(64, -(-8 * total // DEAL_BYTES))
    dealt_to = tries.withColumn("g", F.pmod(F.xxhash64("trie"), F.lit(n_groups)))
    full = sets_of(docs, wanted.select("doc_id", "mark"), size).join(small(dealt_to), "node")
    return full.groupBy("g").applyInPandas(group, "a long, b long").distinct()


def stars(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sizes that can link as tries: a is the probe, its partners are dealt into tries of BLOCK_BYTES at most."""
    sized = pairs.join(sizes.withColumnRenamed("node", "b"), "b").join(sizes.select(F.col("node").alias("a"), F.col("n_shingles").alias("n_a")), "a")
    sized = sized.where(F.least("n_a", "n_shingles") * (100 + percent) >= percent * (F.col("n_a") + F.col("n_shingles")))
    tries = sized.groupBy("a").agg(F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES).alias("tries"))
    members = sized.join(tries, "a").select("a", F.pmod(F.xxhash64("b"), F.col("tries")).alias("k"), F.col("b").alias("node"), F.lit(False).alias("probe"))
    heads = tries.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tries") - 1)).alias("k"), F.col("a").alias("node"), F.lit(True).alias("probe"))
    return members.unionByName(heads).select(F.struct("a", "k").alias("trie"), "node", "probe").withColumn("trie", F.xxhash64("trie"))


def blocks(places: DataFrame) -> DataFrame:
    """Rows (main, node, n, stray) as tries: the nodes of each main component and the strays in blocks of BLOCK_BYTES, and a trie for every two."""
    n_bytes = lambda rows: F.greatest(F.lit(1), F.ceil(F.sum(rows) * 8 / BLOCK_BYTES))
    per = places.groupBy("main").agg(n_bytes(F.col("n")).alias("all"), n_bytes(F.when(F.col("stray"), F.col("n")).otherwise(0)).alias("probes"))
    own = places.join(per, "main")
    other = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    members = own.select("main", "node", F.pmod(F.xxhash64("node"), F.col("all")).alias("i"), other("probes").alias("j"), F.lit(False).alias("probe"))
    probes = own.where("stray").select("main", "node", other("all").alias("i"), F.pmod(F.xxhash64("node"), F.col("probes")).alias("j"), F.lit(True).alias("probe"))
    return members.unionByName(probes).select(F.xxhash64("main", "i", "j").alias("trie"), "node", "probe")


def merge(links: DataFrame) -> DataFrame:
    """node, label: the smallest node that links lead to, for every node that has a link."""
    both = cut(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near, "a").select("a", F.least("label", "near").alias("new"), F.col("label").alias("old"))
        up = labels.select(F.col("a").alias("new"), F.col("label").alias("up"))  # a label's own label is as good
        step = cut(step.join(up, "new", "left").select("a", F.least("new", "up").alias("label"), "old"), "labels")
        labels = step.drop("old")
        if step.where(F.col("label") < F.col("old")).isEmpty():
            return labels.select(F.col("a").alias("node"), "label")


def labelled(docs: DataFrame, size: int, percent: int, one_document: bool) -> DataFrame:
    """doc_id, mark, n_shingles and label (of the component) of every row. one_document: rows of one doc_id link without more."""
    chunks = cut(chunked(docs, size), "chunks")
    rows = cut(rows_of(chunks), "rows")
    n_grams = chunks.agg(F.coalesce(F.sum("n_grams"), F.lit(0))).first()[0]
    n_groups = max(64, -(-n_grams // GROUP_GRAMS))
    whole = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    reps = cut(whole.groupBy("node").agg(F.min(F.struct("doc_id", "mark")).alias("r"), F.first("n_shingles").alias("n_shingles")).select("node", "r.doc_id", "r.mark", "n_shingles"), "reps")
    sizes = reps.select("node", "n_shingles")
    firsts = first_grams(chunks, cut(classes(chunks, size, n_groups), "classes"), size, percent, n_groups)
    firsts = cut(firsts.join(small(reps.select("node", "doc_id")), ["node", "doc_id"], "left_semi"), "firsts")

    light = light_pairs(firsts, percent, n_groups)
    heavy = cut(heavy_places(firsts), "heavy")
    # n-grams of the very same nodes, as of one passage, count once
    alike = heavy.groupBy("key").agg(F.min(F.struct("rare", "node"))["node"].alias("hub"), F.min("node").alias("low"), F.max("node").alias("high"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("all"), F.count("*").alias("n"))
    alike = alike.where("low <> high").groupBy("all", "n").agg(F.min(F.struct("key", "hub")).alias("k")).select("k.key", "k.hub")
    heavy = cut(heavy.join(alike, "key"), "heavy-once")
    to_hub = heavy.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    pairs = cut(light.unionByName(to_hub).distinct(), "pairs")
    links = verified(stars(pairs, sizes, percent), docs, reps, size, percent)
    if one_document:
        same = whole.groupBy("doc_id").agg(F.collect_set("node").alias("nodes")).where(F.size("nodes") > 1)
        same = same.select(F.col("nodes")[0].alias("a"), F.explode("nodes").alias("b")).where("a <> b")
        links = links.unionByName(same)
    links = cut(links, "first-links")
    labels = merge(links)

    # n-grams that still stand between components
    of = heavy.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    main = F.min(F.struct("rare", "label"))["label"]
    mixed_keys = of.groupBy("key").agg(main.alias("main"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key", "main")
    left = of.join(mixed_keys, "key").select("main", "node", "n", (F.col("label") != F.col("main")).alias("stray"))
    left = cut(left.groupBy("main", "node").agg(F.first("n").alias("n"), F.first("stray").alias("stray")), "mixed")
    if not left.isEmpty():
        labels = merge(links.unionByName(verified(blocks(left), docs, reps, size, percent)))
    return rows.join(small(labels), "node", "left").select("doc_id", "mark", "n_shingles", F.coalesce("label", "node").alias("label"))


def components(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of docs."""
    rows = cut(labelled(docs, size, percent, one_document=True), "labelled")
    linked = rows.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    lowest = linked.groupBy("label").agg(F.min("doc_id").alias("lowest"))
    # a doc_id with an empty and another text is one document all the same
    by_id = linked.join(small(lowest), "label").groupBy(F.col("doc_id").alias("_id")).agg(F.min("lowest").alias("component_id"))
    out = rows.join(by_id, rows["doc_id"] == by_id["_id"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep(docs: DataFrame, size: int = SIZE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest doc_id, then hash of text, then the smallest row. Rows without words or doc_id stay."""
    rows = cut(labelled(docs, size, percent, one_document=False).where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()), "labelled")
    best = rows.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("best"))
    judged = rows.join(small(cut(best, "best").select("label", "best.doc_id", "best.mark").withColumnsRenamed({"doc_id": "_id", "mark": "_mark"})), "label").groupBy("doc_id", "mark").agg(F.count("*").alias("rows"), F.first((F.col("doc_id") == F.col("_id")) & (F.col("mark") == F.col("_mark"))).alias("stays"))
    touched = cut(judged.where("rows > 1 or not stays").select("doc_id", "mark", "stays"), "touched")
    of = free(docs, "mark")
    marked = docs.withColumn(of, mark(F.col("text")))
    same = lambda t: (marked["doc_id"] == t["doc_id"]) & (marked[of] == t["mark"])
    gone, repeated = small(touched.select("doc_id", "mark")), small(touched.where("stays").select("doc_id", "mark"))
    plain = marked.join(gone, same(gone), "left_anti").drop(of)
    again = marked.join(repeated, same(repeated), "left_semi")
    again = again.groupBy("doc_id", of).agg(F.min(F.struct(*docs.columns)).alias("r")).select("r.*")
    return plain.unionByName(again)


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(table(spark, sf_dir, "documents"), 4, 85)
