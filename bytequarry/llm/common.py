"""Helpers shared by the corpus operators: tables, shared folders, safe checkpoints, text defaults."""

from __future__ import annotations

import contextlib
import ctypes
import gc

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import free_heaps, saved, shared_dir, spread, use_workers

__all__ = ["Index", "crc_mod", "documents", "free_heaps", "kept", "partitions_for", "power_of_two", "sent", "quoted", "saved", "shared_dir", "spread", "texts_of", "trim", "use_workers", "words"]


def words(text: bytes | None) -> list[bytes]:
    """Words (UTF-8) of a text after lower-casing A-Z only: what lies between spaces and U+0009 to U+000D; null is empty.

    Methods of bytes know ASCII only, so they do just that.
    """
    return text.lower().split() if text else []


def trim() -> None:
    """Gives a worker's free memory back to the system, where the C library can."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


_kept: list = [None, None]


def kept(*key, make):
    """An object that a Python worker keeps from task to task. It keeps one at a time, so that operators which share a
    worker don't fill its memory with each other's."""
    if _kept[0] != key:
        if _kept[1] is not None:
            _kept[:] = [None, None]
            gc.collect()
            trim()
        _kept[:] = [key, make()]
    return _kept[1]


class Index(dict):
    """Numbers its keys as they are first asked for, and lists those that are new. (A defaultdict that counts itself
    would hold itself alive.)"""

    def __init__(self):
        super().__init__()
        self.new = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text (0)."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % n


def partitions_for(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def power_of_two(n: int) -> int:
    return 1 << max(0, n - 1).bit_length()


#: Rows of a few numbers up to which a table is broadcast (some 50 bytes each).
BROADCAST_ROWS = 500_000


def sent(table: DataFrame) -> DataFrame:
    """A stored table of few columns of numbers, to be broadcast if it has no more rows than that, so that the texts it is
    joined with needn't be shuffled; else as it is, and both sides are."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def quoted(column: str) -> str:
    """A column's name as Spark takes it whole, dots and all."""
    return "`" + column.replace("`", "``") + "`"


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return df.select(*columns) if columns else df
