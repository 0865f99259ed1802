"""Records that overlap: keys with a long common substring, shared files, values that others contain."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.substrings import common_lengths, fingerprints

from .recall import spread
from .storage import cut

#: Sizes of runs that keys are indexed by.
RUNS = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64, 96, 128, 192, 256]


def overlapping_keys(records: DataFrame, more_than_percent: int = 60) -> DataFrame:
    """project_id, a, b, shared, n_a, n_b: pairs a < b of a project's different lower-cased keys whose longest common substring has more than such a share of the shorter key; how long it is and how many records have each key.

    A common substring of `need` characters holds need - q + 1 runs of q characters
    in a row. So the shorter key only looks for every (need - q + 1)-th of its
    runs, the longer one offers all; q is the largest of RUNS within `need`, which
    seldom lets other pairs meet. Those that do are measured.
    """
    keys = records.where("key <> ''").groupBy("project_id", F.lower("key").alias("key")).agg(F.count("*").alias("n"))
    keys = cut(keys.withColumn("size", F.length("key")), "keys")
    need = F.floor(F.col("size") * more_than_percent / 100 + 1e-9).cast("int") + 1
    sizes = F.array(*[F.lit(q) for q in RUNS])
    asked = keys.withColumn("need", need).where("need <= size").withColumn("q", F.array_max(F.filter(sizes, lambda q: q <= F.col("need"))))
    run = lambda i, q: F.xxhash64(F.substring("key", i, q))
    # the last run as well, where the stride steps over it
    at = F.sequence(F.lit(1), F.col("size") - F.col("q") + 1, F.col("need") - F.col("q") + 1)
    asked = asked.select("project_id", "size", F.col("key").alias("x"), "q", F.explode(F.transform(at, lambda i: run(i, F.col("q")))).alias("run")).distinct()
    wanted = asked.select("project_id", "q").distinct()
    offered = keys.join(wanted, "project_id").where("q <= size").select("project_id", F.col("size").alias("y_size"), F.col("key").alias("y"), "q", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("q") + 1), lambda i: run(i, F.col("q")))).alias("run")).distinct()
    met = asked.join(offered, ["project_id", "q", "run"]).where("x <> y and size <= y_size").select("project_id", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            shared = common_lengths(a, b)
            least = np.minimum([len(x) for x in a], [len(x) for x in b])
            found = pa.array(100 * shared > more_than_percent * least)
            yield pa.RecordBatch.from_arrays([*batch.filter(found).columns, pa.array(shared).filter(found)], names=["project_id", "a", "b", "shared"])

    pairs = met.mapInArrow(part, "project_id string, a string, b string, shared long")
    many = lambda k: keys.select("project_id", F.col("key").alias(k), F.col("n").alias(f"n_{k}"))
    return pairs.join(many("a"), ["project_id", "a"]).join(many("b"), ["project_id", "b"]).select("project_id", "a", "b", "shared", "n_a", "n_b")


def shared_files(records: DataFrame) -> DataFrame:
    """project_id, type, path, n_records, n_pairs: the files that records of one type with different keys share, and in how many pairs of them. Groups are counted, not paired."""
    each = records.where("path is not null").groupBy("project_id", "type", "path", F.lower("key").alias("key")).agg(F.count("*").alias("n"))
    n, squares = F.sum("n"), F.sum(F.col("n") * F.col("n"))
    out = each.groupBy("project_id", "type", "path").agg(n.alias("n_records"), ((n * n - squares) / 2).cast("long").alias("n_pairs"))
    return out.where("n_pairs > 0")


#: Shorter texts are never dropped for being part of another.
MIN_CONTAINED = 40


def contained(records: DataFrame, order: list, by: str = "project_id") -> DataFrame:
    """id, of: records whose value, trimmed, lower-cased and with single spaces, equals that of a record before them in `order` or, with at least MIN_CONTAINED characters, is part of it; `of` is the first such record.

    What a dropped record contains its own keeper contains too, so it doesn't
    matter in which order records are dropped. Copies meet by their hash. Of other
    texts the rarest fingerprint looks for those that have it; they are compared.
    A null or blank value is neither dropped nor a keeper.
    """
    text = F.regexp_replace(F.lower(F.trim(F.regexp_replace("value", "[ \\t\\n\\x0B\\f\\r]+", " "))), "^ | $", "")
    rows = records.select(F.col("id").alias("id"), F.col(by).alias("by"), F.struct(*order).alias("place"), text.alias("text")).where("text <> ''").withColumn("mark", F.xxhash64("text"))
    first = rows.groupBy("by", "mark").agg(F.min(F.struct("place", "id")).alias("first"))
    copies = rows.select("by", "id", "place", "mark").join(first, ["by", "mark"]).where("id <> first.id")
    texts = cut(rows.groupBy("by", "mark").agg(F.min_by(F.struct("place", "id", "text"), F.struct("place", "id")).alias("t")).select("by", "mark", "t.*"), "texts")

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                some = batch.slice(k, 64)
                prints = fingerprints(some.column(2).to_pylist())
                of = np.repeat(np.arange(some.num_rows), [len(p) for p in prints])
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(of)), some.column(1).take(pa.array(of)), pa.array(np.concatenate(prints)), some.column(3).take(pa.array(of))], names=["by", "mark", "print", "size"])

    prints = cut(spread(texts.select("by", "mark", "text", F.length("text").alias("size"))).mapInArrow(part, f"by {texts.schema['by'].dataType.simpleString()}, mark long, print long, size int"), "fingerprints")
    often = prints.groupBy("by", "print").agg(F.count("*").alias("n"))
    rarest = prints.join(often, ["by", "print"]).groupBy("by", "mark", "size").agg(F.min(F.struct("n", "print")).alias("r")).where("r.n > 1").select("by", "mark", "size", F.col("r.print").alias("print"))
    met = rarest.join(prints.select("by", "print", F.col("mark").alias("in"), F.col("size").alias("in_size")), ["by", "print"]).where("mark <> in and size < in_size").select("by", "mark", "in")
    own, other = texts.select("by", "mark", "place", "id", "text"), texts.select("by", F.col("mark").alias("in"), F.col("place").alias("in_place"), F.col("id").alias("of"), F.col("text").alias("in_text"))
    parts = cut(met.join(own, ["by", "mark"]).join(other, ["by", "in"]).where(F.contains("in_text", "text")).select("by", "mark", "in_place", "of"), "parts")
    # all copies of a contained text are dropped for what stands before them
    whole = rows.select("by", "id", "place", "mark").join(parts, ["by", "mark"]).where("in_place < place").select("id", F.struct(F.col("in_place").alias("place"), F.col("of").alias("id")).alias("first"))
    return copies.select("id", "first").unionByName(whole).groupBy("id").agg(F.min("first").alias("first")).select("id", F.col("first.id").alias("of"))
