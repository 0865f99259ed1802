"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.storage import cut, shared_dir  # noqa: F401

#: White space of the word contracts: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = "[\\x20\\x09-\\x0D]+"


def open_shared(path: str, mode: str):
    """A file in a shared folder, by its URI or plain path, as a pyarrow stream to read or write."""
    from pyarrow import fs

    files, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return files.open_input_file(inner)
    files.create_dir(inner.rpartition("/")[0], recursive=True)
    return files.open_output_stream(inner, compression=None)


def giving_back(part):
    """part, a function of batches for mapInArrow, whose worker hands memory that it no longer uses back to the system at the end of each task; else the allocator keeps it, and it adds up over stages."""

    def run(batches):
        try:
            yield from part(batches)
        finally:
            import ctypes
            import gc

            import pyarrow as pa

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only some C libraries have it
            if trim:
                trim(0)

    return run


#: Bytes of a batch's rows that are worked on at once where Spark may hand over larger batches.
SLICE = 4 << 20


def slices(batch):
    """An Arrow batch in runs of rows of about SLICE bytes."""
    rows = max(1, SLICE * batch.num_rows // max(1, batch.nbytes))
    for k in range(0, batch.num_rows, rows):
        yield batch.slice(k, rows)


def forget(cut_table: DataFrame) -> None:
    """Remove a cut table's files; nothing may read it any more, retries included."""
    from pyarrow import fs

    for folder in {f.rpartition("/")[0] for f in cut_table.inputFiles()}:
        files, inner = fs.FileSystem.from_uri(folder)
        files.delete_dir(inner)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Tables of at most so many bytes, rows in full, are sent to all executors; larger ones are joined by shuffle.
MAX_BROADCAST_BYTES = 32 << 20


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if its measured bytes are few: of fixed columns 8 each, of texts, binaries and arrays what they hold."""
    size = F.lit(8 * len(df.columns))
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(f.name), F.lit(0))
        elif kind in ("array", "map"):
            size = size + 16 * F.greatest(F.size(f.name), F.lit(0))
    total = df.agg(F.sum(size)).first()[0] or 0
    return F.broadcast(df) if total <= MAX_BROADCAST_BYTES else df


def free(df: DataFrame, name: str) -> str:
    """name, with underscores before it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text):
    """Words of a text column, split at SPACE; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def run_hash(w, i, n: int):
    """Hash of the n words of the array w from place i on. (slice() would copy the whole array each time.)"""
    return F.xxhash64(*[F.get(w, i + k) for k in range(n)])
