"""Vectors as bytes and matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import use_workers


def width_of(df: DataFrame, column: str) -> str:
    """float32 if the table holds floats, float64 otherwise: bytes keep the values as they are."""
    return "<f4" if isinstance(df.schema[column].dataType.elementType, T.FloatType) else "<f8"


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, dim, vec) of rows that have an id and a vector that is not null, empty or zero and whose components are
    all there and finite; vec holds the components as bytes."""
    use_workers(df.sparkSession)
    width = width_of(df, vector)

    def pack(batches):
        for batch in batches:
            lists = batch.column("vec")
            n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(width)  # null components become NaN
            ends = np.cumsum(n)
            some = np.flatnonzero(n)
            good, starts = np.zeros(len(n), bool), (ends - n)[some]
            if len(some):
                good[some] = np.logical_and.reduceat(np.isfinite(flat), starts) & np.logical_or.reduceat(flat != 0, starts)
            good &= batch.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            offsets = pa.py_buffer(np.concatenate([[0], ends * flat.itemsize]).astype("<i4"))
            vecs = pa.BinaryArray.from_buffers(pa.binary(), len(n), [None, offsets, pa.py_buffer(flat.tobytes())])
            made = pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(n, pa.int32()), vecs], ["vec_id", "dim", "vec"])
            yield made.filter(pa.array(good))

    return df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("vec")).mapInArrow(pack, "vec_id long, dim int, vec binary")


def matrix(vecs, width: str) -> np.ndarray:
    """Rows of equally long vectors, in double precision."""
    vecs = list(vecs)
    return np.frombuffer(b"".join(vecs), width).reshape(len(vecs), -1).astype(np.float64)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length one. Scaled by the largest component first, so that no square overflows or vanishes."""
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def cosines(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Cosines of unit rows with a unit vector; equal rows give equal values."""
    return (m * v).sum(axis=1)


def sampled(vectors: DataFrame, total: int, most: int, dim: int, width: str, salt: int = 0) -> np.ndarray:
    """Unit vectors of a sample by hash of vec_id, of about `most` rows."""
    million = 1_000_000
    share = million if total <= most else int(million * most / total)
    rows = vectors.where(F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(million)) < share).where(F.col("dim") == dim)
    got = rows.select("vec_id", "vec").toArrow().sort_by("vec_id")  # about `most` rows
    return unit(matrix(got.column("vec").to_pylist(), width)) if got.num_rows else np.zeros((0, dim))
