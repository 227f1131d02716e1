"""Helpers that several operators share: scratch tables, sampling and text buffers."""

from __future__ import annotations

import contextlib
import ctypes
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.sources.scratch import dropped, scratch, shared_dir, written

__all__ = ["dropped", "scratch", "shared_dir", "written"]
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())

# ASCII white space, as in the word class [^\x20\x09-\x0D]+, and the letters and digits of the class
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z (every byte of a non-ASCII character belongs to a word).
PLAIN_SPACE = b" \t\n\r\x0b\x0c"
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


BROADCAST_ROWS = 1_000_000  # of a few numbers each; a side with more rows is shuffled


def small_side(rows: DataFrame, weight: Column | None = None, beyond: str = "shuffle_hash") -> DataFrame:
    """A written table of a few numbers a row (or as many as the sum of weight), to be broadcast if its counted size allows
    it, so that the texts it is joined with need not be shuffled, else with the join hint beyond. The join gives the same
    rows either way."""
    size = rows.count() if weight is None else rows.agg(F.coalesce(F.sum(weight), F.lit(0))).first()[0]
    return rows.hint("broadcast" if size <= BROADCAST_ROWS else beyond)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo modulus; null for a null id."""
    return F.crc32(doc_id.cast("string")) % modulus


def class_sample(rows: DataFrame, key: str, label: str, per_class: int, most_classes: int | None = None) -> DataFrame:
    """About per_class rows of each label, chosen by a hash of the key, so the same rows each time; of the most_classes most
    frequent labels, if given."""
    rows = rows.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    counts = rows.groupBy(label).agg(F.count("*").alias("rows_of_label"))
    if most_classes is not None:
        counts = counts.orderBy(F.desc("rows_of_label"), label).limit(most_classes)
    chance = F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(1_000_003)) * F.col("rows_of_label") < per_class * 1_000_003
    return rows.join(small_side(written(counts, "labels")), label).where(chance).select(*rows.columns)


def window_of(text: Column, most: int) -> Column:
    """The text, or of a longer one `most` characters from a place that its hash picks: what a sample row may hold at most."""
    place = F.pmod(F.xxhash64(text), F.length(text) - F.lit(most - 1)) + 1
    return F.when(F.length(text) <= most, text).otherwise(F.substring(text, place.cast("int"), F.lit(most)))


def one_text_each(rows: DataFrame, label: str) -> DataFrame:
    """key, label and text for each key of rows, which has one label: of several texts that with the smallest hash."""
    least = rows.groupBy("key", label).agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    return least.select("key", label, F.col("least.text").alias("text"))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches again, cut so that one holds about limit bytes of the column (or a single longer row). At the end of the
    task free memory goes back to the system: workers live on from stage to stage."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.array(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        group = np.concatenate(([0], np.cumsum(sizes)[:-1])) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)
    released()


def released() -> None:
    """Gives a worker's free memory back to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def raw(batch: pa.RecordBatch, column: str) -> list[bytes | None]:
    """The column's UTF-8 bytes."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def as_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def all_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever signs are in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def unused(name: str, df: DataFrame) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name
