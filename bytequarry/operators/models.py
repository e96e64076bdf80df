"""What blocks are made of: histograms, frequency models, their bounds, runs, suffixes, as tables.

A block is counted where it stands; only the non-zero entries become rows. Nothing here shuffles.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import use_workers
from . import kernels


def per_block(blocks: DataFrame, columns: dict[str, pa.DataType], kernel: Callable[[bytes], tuple[np.ndarray, ...]], keys: Sequence[str] = ("file_id", "block_id")) -> DataFrame:
    """Rows made of each block: its keys, and the kernel's arrays side by side."""
    use_workers(blocks.sparkSession)
    names = {pa.int64(): "long", pa.int32(): "int"}
    schema = blocks.select(*keys, *[F.lit(0).cast(names[t]).alias(c) for c, t in columns.items()]).schema

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                made = [kernel(x or b"") for x in part.column("block").to_pylist()]
                sizes = [len(m[0]) for m in made]
                at = pa.array(np.repeat(np.arange(len(made)), sizes))
                arrays = [pa.array(np.concatenate([m[k] for m in made]), t) for k, t in enumerate(columns.values())]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(at) for c in keys), *arrays], schema.names)

    return blocks.select(*keys, "block").mapInArrow(run, schema)


def _nonzero(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sym = np.flatnonzero(freq)
    return sym, freq[sym]


def byte_histogram(blocks: DataFrame) -> DataFrame:
    return per_block(blocks, {"sym": pa.int32(), "cnt": pa.int64()}, lambda b: _nonzero(kernels.histogram(b)))


def normalized(blocks: DataFrame, limit: int = kernels.WHOLE) -> DataFrame:
    """(keys, sym, freq): order-0 model, frequencies that sum up to limit."""
    return per_block(blocks, {"sym": pa.int32(), "freq": pa.int64()}, lambda b: _nonzero(kernels.scaled(kernels.histogram(b), limit)))


def bounds(blocks: DataFrame, limit: int = kernels.WHOLE) -> DataFrame:
    """(keys, sym, low, high): the part of [0, limit) that each symbol has."""

    def kernel(b):
        sym, freq = _nonzero(kernels.scaled(kernels.histogram(b), limit))
        high = np.cumsum(freq)
        return sym, high - freq, high

    return per_block(blocks, {"sym": pa.int32(), "low": pa.int64(), "high": pa.int64()}, kernel)


def _pairs(table: np.ndarray) -> tuple[np.ndarray, ...]:
    prev, sym = np.nonzero(table)
    return prev, sym, table[prev, sym]


def pair_counts(blocks: DataFrame) -> DataFrame:
    return per_block(blocks, {"prev": pa.int32(), "sym": pa.int32(), "cnt": pa.int64()}, lambda b: _pairs(kernels.pair_counts(b)))


def order1(blocks: DataFrame) -> DataFrame:
    """(keys, prev, sym, freq): order-1 model; the frequencies after each byte sum up to 2**32-1."""
    return per_block(blocks, {"prev": pa.int32(), "sym": pa.int32(), "freq": pa.int64()}, lambda b: _pairs(kernels.order1(b)))


def run_lengths(blocks: DataFrame) -> DataFrame:
    """(keys, run, sym, len): runs in order, none longer than 255."""

    def kernel(b):
        sym, n = kernels.runs(b)
        return np.arange(len(sym)), sym, n

    return per_block(blocks, {"run": pa.int32(), "sym": pa.int32(), "len": pa.int32()}, kernel)


def expanded(runs: DataFrame, keys: Sequence[str] = ("file_id", "block_id")) -> DataFrame:
    """(keys, n, block_hex): blocks put together again from their runs."""
    parts = F.array_sort(F.collect_list(F.struct("run", F.repeat(F.lpad(F.hex("sym"), 2, "0"), F.col("len")).alias("part"))))
    return runs.groupBy(*keys).agg(F.concat_ws("", F.transform(parts, lambda p: p["part"])).alias("block_hex")).withColumn("n", (F.length("block_hex") / 2).cast("long"))


def suffixes(blocks: DataFrame) -> DataFrame:
    """(keys, rnk, pos): suffix array, ranks from 0."""

    def kernel(b):
        order = kernels.suffix_array(b)
        return np.arange(len(order)), order

    return per_block(blocks, {"rnk": pa.int32(), "pos": pa.int32()}, kernel)


def last_to_first(blocks: DataFrame) -> DataFrame:
    """(keys, pos, sym, occ, lf) of each byte of a last column: its byte, how many equal ones stand before it, and the
    row that begins with it."""

    def kernel(b):
        t = kernels.as_array(b).astype(np.int64)
        lf = kernels.last_to_first(t)
        first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=256))])
        return np.arange(len(t)), t, lf - first[t], lf

    return per_block(blocks, {"pos": pa.int32(), "sym": pa.int32(), "occ": pa.int32(), "lf": pa.int32()}, kernel)
