"""Toxicity of whole documents by the recurrent network of gru.py.

It is fitted on the driver to a bounded sample: of each label, the MAX_TRAIN
training rows first in the order of a hash of their doc_id. Of texts of more
than TRAIN_CHARS characters the toxic ones are left out (which part is toxic
isn't known), the others train by a part of that size at a place drawn by hash.
Then it is sent to all tasks (its size is bounded
too) and scores every overlapping window of every whole text.

Defined results: a text without words, null or empty scores 0; a null doc_id
counts as held out; repeated rows are scored row by row; of a doc_id's several
labels the highest counts; without training rows of both labels every score is
0; an empty table gives an empty table; other columns are ignored by score()
and kept by keep().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gru
from .common import giving_back, slices, table

FOLDS = 5
MAX_TRAIN, TRAIN_CHARS = 2000, 50_000
LIMIT = 0.5


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> dict[str, np.ndarray] | None:
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train) for k in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # at most 2 * max_train rows
    text, more = F.col("text"), F.length("text") - TRAIN_CHARS
    cut = F.when(more > 0, F.substring(text, (1 + F.pmod(F.xxhash64("doc_id"), more)).cast("int"), F.lit(TRAIN_CHARS))).otherwise(text)
    some = docs.select("doc_id", "text").where(text.isNotNull()).join(chosen, "doc_id").where((more <= 0) | (F.col("toxic") == 0))
    some = some.groupBy("doc_id").agg(F.min(cut).alias("text"), F.max("toxic").alias("toxic"))
    rows = sorted(map(tuple, some.collect()))
    y = np.array([r[2] for r in rows])
    if not len(y) or y.min() == y.max():
        return None
    texts = [r[1] for r in rows]
    del rows
    return gru.fit(texts, y)


def score(docs: DataFrame, model: dict[str, np.ndarray] | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            texts = batch.column(1).to_pylist()
            s = gru.scores(m, texts) if m is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s)], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(giving_back(part), "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= LIMIT).cast("int").alias("predicted"))


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the network doesn't call toxic, with docs' own columns."""
    sent, columns = docs.sparkSession.sparkContext.broadcast(train(docs, labels)), docs.columns

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for some in (some for batch in batches for some in slices(batch)):
            s = gru.scores(m, some.column(columns.index("text")).to_pylist()) if m is not None else np.zeros(some.num_rows)
            yield some.filter(pa.array(s < LIMIT))

    return docs.mapInArrow(giving_back(part), docs.schema)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
