"""Packing token sequences by bin completion over the histogram of piece lengths.

Documents become pieces of at most `size` tokens; pieces of equal length are
interchangeable, so the search needs only how many there are of each length (at
most `size` numbers, whatever the corpus). It goes from the largest length
down: a bin gets a piece of the largest length left and the best of its
undominated fillings (one is dominated if a piece, or two, of it could give way
to a single larger piece that is left). A filling is repeated while pieces for
it last. Best-fit decreasing gives the first incumbent; branches whose waste
shows that they can't use fewer bins than the incumbent are pruned, and the
search ends when the incumbent reaches the lower bound or after DECISIONS (the
incumbent is then the answer). The plan says which numbers of each length go
where; pieces get numbers within their length by counts over salted groups and
are joined with the plan.

Defined results: a null or empty text is the end id alone; repeated rows are
packed one by one; an empty table gives an empty result; pieces of equal length
are numbered by salt, doc_id and piece; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, giving_back, table
from .tokens import MEMO, encoder

SIZE = 2048
#: Steps of one enumeration of fillings, and decisions after the first way down.
FILLING_STEPS, DECISIONS = 4000, 5_000
#: Pieces of one length in one salt, about.
SALT_ROWS = 20_000

Plan = list[tuple[int, list[tuple[int, int]]]]  # bins that are alike, and their (length, how many of it)


def lower_bound(counts: dict[int, int], size: int) -> int:
    """Bins that no packing can do without: by total length, or with each too-large pair apart (bound L2 of Martello and Toth)."""
    best = -(-sum(n * c for n, c in counts.items()) // size)
    for k in sorted({n for n in counts if 2 * n <= size} | {0}):
        big = sum(c for n, c in counts.items() if n > size - k)
        half = {n: c for n, c in counts.items() if size - k >= n and 2 * n > size}
        room = sum(half.values()) * size - sum(n * c for n, c in half.items())
        rest = sum(n * c for n, c in counts.items() if 2 * n <= size and n >= k)
        best = max(best, big + sum(half.values()) + max(0, -(-(rest - room) // size)))
    return best


def best_fit(counts: dict[int, int], size: int) -> Plan:
    """Best-fit decreasing; bins that are alike are held together."""
    open_: dict[int, list[tuple[int, dict[int, int]]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, bins: int, has: dict[int, int]) -> None:
        if bins:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((bins, has))

    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            k = bisect_left(rooms, n)
            if k == len(rooms):
                room, bins, has = size, -(-left // (size // n)), {}
            else:
                room = rooms[k]
                bins, has = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[k]
            each = room // n
            full = min(bins, left // each)
            put(room - each * n, full, has | {n: each})
            left -= full * each
            if full < bins and left:
                put(room - left * n, 1, has | {n: left})
                left, full = 0, full + 1
            put(room, bins - full if has else 0, has)
    return [(bins, sorted(has.items(), reverse=True)) for groups in open_.values() for bins, has in groups]


def fillings(counts: dict[int, int], lengths: list[int], room: int, slack: int, first: bool) -> list[dict[int, int]]:
    """Undominated fillings of room by pieces that are left, the fullest first. lengths: those left, ascending.

    slack: the room that a filling may leave. first: stop at a perfect filling.
    """
    found: list[tuple[int, dict[int, int]]] = []
    steps = 0

    def go(room: int, below: int, more: bool, has: dict[int, int]) -> bool:
        """True to stop: a perfect filling and first, or no steps left. below: only lengths of smaller places follow; more: another piece of the last length fits."""
        nonlocal steps
        steps += 1
        at = min(bisect_left(lengths, room + 1), below) - 1
        while at >= 0:
            n = lengths[at]
            most = min(counts[n], room // n)
            for m in range(most, 0, -1):  # so the depth is bounded by different lengths, not by pieces
                more = True
                if go(room - m * n, at, m < most, has | {n: m}) or steps > FILLING_STEPS:
                    return True
            at -= 1
        if not more and room <= slack:
            found.append((room, has))
        return first and room == 0

    go(room, len(lengths), False, {})
    # the best fit, piece after piece, is a filling too
    has, left = {}, room
    while (at := bisect_left(lengths, left + 1) - 1) >= 0:
        n = next((lengths[k] for k in range(at, -1, -1) if counts[lengths[k]] > has.get(lengths[k], 0)), None)
        if n is None:
            break
        m = min(counts[n] - has.get(n, 0), left // n)
        has[n], left = has.get(n, 0) + m, left - m * n
    found.append((left, has))

    def dominated(waste: int, has: dict[int, int]) -> bool:
        each = sorted(has)
        for i, a in enumerate(each):
            for b in [0, *each[i + (has[a] < 2) :]]:
                k = bisect_left(lengths, a + b + waste + 1) - 1
                if k >= 0 and lengths[k] >= a + b and lengths[k] not in (a, b) and counts[lengths[k]] > has.get(lengths[k], 0):
                    return True
        return False

    out = []
    for waste, has in sorted(found, key=lambda x: (x[0], sum(x[1].values()))):
        if has not in out and (not out or not dominated(waste, has)):
            out.append(has)
    return out


class Search:
    """Depth-first branch-and-bound over fillings, decided from the largest length down.

    A node's branches are its undominated fillings, each repeated while pieces
    last; when those are spent, all fillings that the waste left allows, and each
    of several repeats once alone, so that any mix of fillings can be reached. A
    node is left as soon as its waste shows that it can't use fewer bins than the
    incumbent.
    """

    def __init__(self, counts: dict[int, int], size: int):
        self.counts, self.lengths, self.size = dict(counts), sorted(counts), size
        #: Per decision: the length decided, branches left, branches tried, whether all were listed, the one taken, how often.
        self.made: list[tuple[int, list, list, bool, dict[int, int], int]] = []
        self.waste = self.bins = self.decided = 0

    def take(self, n: int, left: list, tried: list, all_: bool) -> None:
        has, times = left.pop(0)
        tried.append((has, times))
        for k, m in has.items():
            self.counts[k] -= times * m
            if not self.counts[k]:
                self.lengths.remove(k)
        self.made.append((n, left, tried, all_, has, times))
        self.waste += times * (self.size - sum(k * m for k, m in has.items()))
        self.bins += times
        self.decided += 1

    def branches(self, n: int, most_waste: int, first: bool) -> list[tuple[dict[int, int], int]]:
        """The fillings around a piece of the largest length n, and how often each is taken."""
        self.counts[n] -= 1
        found = [x | {n: x.get(n, 0) + 1} for x in fillings(self.counts, self.lengths, self.size - n, most_waste - self.waste, first)]
        self.counts[n] += 1
        often = [(x, min(self.counts[k] // m for k, m in x.items())) for x in found]
        return often if first else often + [(x, 1) for x, times in often if times > 1]

    def forward(self, most_waste: int) -> bool:
        """Goes on with first branches to the end. False as soon as the waste is over most_waste."""
        while self.waste <= most_waste and self.lengths:
            n = self.lengths[-1]
            self.take(n, self.branches(n, most_waste, True), [], False)
        return self.waste <= most_waste

    def back(self, most_waste: int) -> bool:
        """Goes back to the nearest decision with another branch and takes it. False if there is none."""
        while self.made:
            n, left, tried, all_, has, times = self.made.pop()
            for k, m in has.items():
                if not self.counts[k]:
                    insort(self.lengths, k)
                self.counts[k] += times * m
            self.waste -= times * (self.size - sum(k * m for k, m in has.items()))
            self.bins -= times
            if not left and not all_:
                left, all_ = [x for x in self.branches(n, most_waste, False) if x not in tried], True
            if left:
                self.take(n, left, tried, all_)
                return True
        return False

    def plan(self) -> Plan:
        return [(times, sorted(has.items(), reverse=True)) for *_, has, times in self.made]


def pack(counts: dict[int, int], size: int = SIZE) -> Plan:
    """A plan of as few bins as the search finds for so many pieces of each length."""
    counts = {n: c for n, c in counts.items() if c}
    if not counts:
        return []
    total, least = sum(n * c for n, c in counts.items()), lower_bound(counts, size)
    plan = best_fit(counts, size)
    bins = sum(b for b, _ in plan)
    s = Search(counts, size)
    limit = None
    # fewer bins than the incumbent leave at most so much room unused
    while bins > least:
        most_waste = (bins - 1) * size - total
        if s.forward(most_waste):
            plan, bins = s.plan(), s.bins
            more = bins > least and s.back((bins - 1) * size - total)
        else:
            more = s.back(most_waste)
        limit = s.decided + DECISIONS if limit is None else limit  # decisions after the first way down
        if not more or s.decided > limit:
            break
    return plan


def slots(plan: Plan) -> list[tuple[int, int, int, int, int, int]]:
    """length, first number and number after the last of that length, how many to a bin, first bin, offset of the first in its bin."""
    used: dict[int, int] = {}
    out, bin_ = [], 0
    for bins, has in plan:
        offset = 0
        for n, m in has:
            k = used.get(n, 0)
            out.append((n, k, k + bins * m, m, bin_, offset))
            used[n] = k + bins * m
            offset += n * m
        bin_ += bins
    return out


def pieces(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, memo: int = MEMO) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces; all but the first have `size` ids. memo: entries of the encoder's memo; a smaller one than MEMO is dropped at the end of each task."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer, memo)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), own.encode_all(batch.column(1).to_pylist()), strict=True):
                ids = memoryview(ids.tobytes())
                n = len(ids) // 4
                start, end = 0, (n - 1) % size + 1
                for piece in range(-(-n // size)):
                    rows.append((doc_id, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end])))
                    start, end = end, end + size
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
        if memo < MEMO:
            own.clear()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(part), "doc_id long, piece int, start long, length long, ids_crc32 long")


def place(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces with sequence_id and offset: every sequence holds at most `size` tokens, gapless from 0."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `size` rows
    plan = spark.createDataFrame(slots(pack(counts, size)), "length long, low long, high long, each long, bin long, at long")
    n_salts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-sum(counts.values()) // SALT_ROWS))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n_salts)))
    before = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    base = salted.groupBy("length", "salt").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    nth = F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1
    numbered = salted.withColumn("nth", nth).join(base, ["length", "salt"]).withColumn("nth", F.col("nth") + F.col("base"))
    p = F.broadcast(plan)  # its rows are bounded by the lengths, not by the pieces
    placed = numbered.join(p, (numbered["length"] == p["length"]) & (numbered["nth"] >= p["low"]) & (numbered["nth"] < p["high"])).drop(p["length"])
    k = F.col("nth") - F.col("low")
    sequence = F.col("bin") + F.floor(k / F.col("each"))
    offset = F.col("at") + F.pmod(k, F.col("each")) * F.col("length")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))


def sequences(docs: DataFrame, size: int = SIZE, tokenizer: str | None = None, memo: int = MEMO) -> DataFrame:
    return place(cut(pieces(docs, size, tokenizer, memo), "pieces"), size)


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequences(table(spark, sf_dir, "documents"))
