"""Pairs of alike sets, met block by block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .recall import sent
from .storage import cut

#: Elements of a block, with ROW more for each set; two blocks stand in a Python worker at a time.
BLOCK, ROW = 3_000_000, 8
#: Counters of pairs, and matches of elements, that a worker goes through at once.
COUNTERS, MATCHES = 1_000_000, 1_000_000
#: Share of a set that pairs of one size must have in common among the rare elements, to be compared as a whole.
SHARED = 0.1


def hashed(rows: DataFrame) -> DataFrame:
    """rows, a table of its own, with their sets s as distinct 64-bit hashes h, and their size n; empty and null sets are left out."""
    h = F.array_distinct(F.transform("s", lambda w: F.xxhash64(w)))
    rows = rows.select(F.col("id").cast("long").alias("id"), *[c for c in rows.columns if c not in ("id", "s")], h.alias("h"))
    return cut(rows.withColumn("n", F.size("h")), "sets").where("n > 0")  # a filter before would work the sets out twice


def dealt(sets: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """sets with their block, of about `block` elements, in their `by`; by, block, lo, hi: the sizes in each. Blocks follow the order of sizes."""
    weight = F.col("sets") * (F.col("n") + ROW)
    before = F.coalesce(F.sum(weight).over(W.partitionBy("by").orderBy("n").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = sets.groupBy("by", "n").agg(F.count("*").alias("sets"))
    sizes = cut(sizes.select("by", "n", F.floor(before / block).alias("first"), F.floor((before + weight - 1) / block).alias("last")), "sizes")
    ranges = sizes.select("by", "n", F.explode(F.sequence("first", "last")).alias("block")).groupBy("by", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    placed = sets.join(sent(sizes), ["by", "n"]).withColumn("block", F.col("first") + F.pmod(F.xxhash64("id"), F.col("last") - F.col("first") + 1))
    return placed, ranges


def sharing(sets: DataFrame, least: float, of_union: bool, block: int = BLOCK) -> DataFrame:
    """a, b, similarity of rows of hashed() with equal `by` whose sets have a similarity of at least `least`.

    The similarity is the overlap over the union, or over the larger set. If sets
    have columns left and right (booleans), a is a left and b a right one; a row may
    be both, and then a pair may come both ways. Else a < b. A null `by` equals none.

    The sets of each `by` stand in blocks in the order of their sizes, and blocks meet
    if their sizes allow such a similarity. Only pairs that have it leave the task.
    """
    two = "left" in sets.columns
    if two:
        (x, of_x), (y, of_y) = dealt(sets.where(F.col("left")), block), dealt(sets.where(F.col("right")), block)
    else:
        x, of_x = y, of_y = dealt(sets, block)
    u, v = of_x.alias("u"), of_y.alias("v")
    fits = (F.col("v.lo") * least <= F.col("u.hi") + 1e-9) & (F.col("u.lo") * least <= F.col("v.hi") + 1e-9)
    once = F.lit(True) if two else F.col("u.block") <= F.col("v.block")
    cells = cut(u.join(v, (F.col("u.by") == F.col("v.by")) & fits & once).select("u.by", F.col("u.block").alias("i"), F.col("v.block").alias("j")), "cells")
    cells = sent(cells)
    side = F.lit(0) if two else F.when(F.col("i") == F.col("j"), 2).otherwise(0)  # within a block all sets are on both sides
    xs = x.withColumnRenamed("block", "i").join(cells, ["by", "i"]).select("by", "i", "j", "id", side.alias("side"), "h")
    ys = y.withColumnRenamed("block", "j").join(cells if two else cells.where("i <> j"), ["by", "j"]).select("by", "i", "j", "id", F.lit(1).alias("side"), "h")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sides, sizes, h = [], [], [], []
        for batch in batches:
            ids.append(batch.column("id").to_numpy())
            sides.append(batch.column("side").to_numpy())
            sizes.append(batch.column("h").value_lengths().to_numpy())
            h.append(batch.column("h").flatten().to_numpy())
        batch = None
        ids, sides, sizes = (np.concatenate(c) for c in (ids, sides, sizes))
        h = np.concatenate(h)
        pa.default_memory_pool().release_unused()
        e, most = ranked(h, sizes)
        del h
        for i, j, similarity in alike(e, most, sizes, sides, least, of_union):
            a, b = ids[i], ids[j]
            if not two:
                a, b = np.minimum(a, b), np.maximum(a, b)
            other = a != b
            yield pa.RecordBatch.from_arrays([pa.array(c[other]) for c in (a, b, similarity)], names=["a", "b", "similarity"])

    return xs.unionByName(ys).groupBy("by", "i", "j").applyInArrow(part, "a long, b long, similarity double")


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """first, end of runs of sizes that sum up to `most`, or of a single one."""
    ends, k = np.cumsum(sizes), 0
    while k < len(sizes):
        end = max(k + 1, int(np.searchsorted(ends, most + (ends[k - 1] if k else 0), "right")))
        yield k, end
        k = end


def ranked(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, int]:
    """The elements h of rows of such sizes as numbers, the rarest lowest, ascending in each row; how many numbers there are."""
    order = np.argsort(h)
    of = h[order]
    new = of[1:] != of[:-1]
    of = np.zeros(len(h), np.int32)
    np.cumsum(new, out=of[1:])
    n = np.bincount(of)
    rank = np.empty(len(n), np.int32)
    rank[np.argsort(n, kind="stable")] = np.arange(len(n), dtype=np.int32)
    key = np.empty(len(h), np.int64)
    key[order] = rank[of]
    del order, of, new
    key += np.repeat(np.arange(len(size)) << 32, size)
    key.sort()
    key &= 0xFFFFFFFF
    return key.astype(np.int32), len(rank)


def alike(e: np.ndarray, most: int, size: np.ndarray, side: np.ndarray, least: float, of_union: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """i, j, similarity of pairs of rows with at least such a similarity: i on side 0 and j on side 1; rows of side 2 are on both, each pair comes once.

    e and `most` are what ranked() gives. Alike sets share one among the first
    size - ceil(least * size) + 1 elements of both, so only such a prefix is matched
    and counted, or a longer one where sets of one size need not share SHARED of it.
    What else a pair shares stands behind the end of that prefix which ends first, so
    the rest of that row bounds it. Pairs that may have the similarity are compared
    as a whole.
    """
    size = size.astype(np.int64)
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size), dtype=np.int32), size)
    rest = max(0, min(least, (2 * least / (1 + least) if of_union else least) - SHARED))
    prefix = np.minimum(size, size - np.ceil(rest * size - 1e-9).astype(np.int64) + 1)
    rest, end = size - prefix, e[start + prefix - 1]
    taken = np.arange(len(e)) - start[row] < prefix[row]
    xs, ys = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(xs) or not len(ys):
        return
    place = np.zeros(len(size), np.int64)
    place[ys] = np.arange(len(ys))
    in_y = taken & (side != 0)[row]
    by_element = np.argsort(e[in_y], kind="stable")
    y_of = place[row[in_y]][by_element].astype(np.int32)
    n = np.bincount(e[in_y], minlength=most).astype(np.int32)
    first = np.cumsum(n, dtype=np.int32) - n
    in_x = taken & (side != 1)[row] & (n[e] > 0)
    ex, x_of = e[in_x], row[in_x]
    at = np.searchsorted(x_of, np.concatenate([xs, [len(size)]]))
    del row, taken, in_x, in_y, by_element, place
    marked = np.zeros(most, bool)
    step = max(1, COUNTERS // len(ys))
    for k in range(0, len(xs), step):
        some = xs[k : k + step]
        counts = np.zeros(len(some) * len(ys), np.int64)
        lo, hi = at[k], at[k + len(some)]
        of, matches = np.searchsorted(some, x_of[lo:hi]) * len(ys), n[ex[lo:hi]]
        for s, t in runs(matches, MATCHES):
            met = y_of[ranges(first[ex[lo + s : lo + t]], matches[s:t])]
            counts += np.bincount(np.repeat(of[s:t], matches[s:t]) + met, minlength=len(counts))
        found = np.flatnonzero(counts)
        i, j = some[found // len(ys)], ys[found % len(ys)]
        small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
        need = (least / (1 + least) * (small + large) if of_union else least * large) - 1e-9
        may = (small >= need) & (counts[found] + np.where(end[i] <= end[j], rest[i], rest[j]) >= need)
        if side[some[0]] == 2:
            may &= i < j
        if not may.any():
            continue
        i, j = i[may], j[may]
        shared = np.empty(len(i), np.int64)
        each, begin = np.unique(i, return_index=True)
        for r, a, b in zip(each, begin, [*begin[1:], len(i)], strict=True):
            own = e[start[r] : start[r] + size[r]]
            marked[own] = True
            for s, t in runs(size[j[a:b]], MATCHES):
                other = j[a + s : a + t]
                shared[a + s : a + t] = np.add.reduceat(marked[e[ranges(start[other], size[other])]], np.cumsum(size[other]) - size[other], dtype=np.int64)
            marked[own] = False
        similarity = shared / (size[i] + size[j] - shared if of_union else np.maximum(size[i], size[j]))
        good = similarity >= least - 1e-12
        if good.any():
            yield i[good], j[good], similarity[good]
