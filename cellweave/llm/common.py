"""Helpers shared by the text operators."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import write_stage

WHITE = r"[\x20\x09-\x0D]+"
MAP_BITS = 22


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a narrow table to the shared folder, so that lost executors only re-read it."""
    return write_stage(df, label)


def held_out(doc_id: Column) -> Column:
    """Rows no model may learn from: crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or the first name with it and more underscores that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def maybe_in(df: DataFrame, key: Column, keys: DataFrame, keys_key: Column, bits: int = MAP_BITS, negate: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be among ``keys``: a semi-join ahead of an exact one.

    The filter is a bit map of ``2**bits`` bits, at most ``2**(bits-6)`` rows of two numbers
    (1.5 MB by default) whatever the number of keys, so that it is always safe to broadcast.
    It lets through every true match; the more keys, the more rows it lets through besides,
    and the join that follows decides. Null keys never match. ``negate`` gives the other rows.
    """
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << bits))
    word, bit_set = free_name(df, "cw_word"), free_name(df, "cw_bits")
    used = keys.where(keys_key.isNotNull()).select(slot(keys_key).alias("cw_slot"))
    words = used.groupBy(F.shiftright("cw_slot", 6).alias(word)).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(cw_slot & 63L as int))")).alias(bit_set))
    fits = (F.shiftright(slot(key), 6) == F.col(word)) & (
        F.bit_get(F.col(bit_set), slot(key).bitwiseAND(F.lit(63)).cast("int")) == 1)
    return df.join(F.broadcast(words), fits, "left_anti" if negate else "left_semi")


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``ids``; rows without id stay.

    Texts of documents that can't be meant aren't exchanged.
    """
    name = free_name(docs, "cw_gone")
    gone = stage(ids.select(F.col("doc_id").alias(name)).distinct(), "dropped")
    sure = maybe_in(docs, docs["doc_id"], gone, gone[name], negate=True)
    rest = maybe_in(docs, docs["doc_id"], gone, gone[name])
    return sure.union(rest.join(gone, rest["doc_id"] == gone[name], "left_anti"))


def pieces(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``max_bytes``, one row at least."""
    lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and size + n > max_bytes:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
