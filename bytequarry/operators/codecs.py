"""Block transforms as columns, and pipelines of them.

Kernels see one block at a time in Arrow batches; blocks stay rows, so no transform shuffles. Every stage is registered
by name with its bit in the flag word; a pipeline is an order of stages, run in one pass and undone in reverse.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import islice, permutations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import PRESETS, STAGE_BITS
from ..shared import use_workers
from . import kernels

Kernel = Callable[[bytes], bytes]

#: name -> (encode, decode)
STAGES: dict[str, tuple[Kernel, Kernel]] = {
    "BWT": (kernels.bwt, kernels.unbwt),
    "BWT2": (kernels.bwt_cyclic, kernels.unbwt_cyclic),
    "MTF": (kernels.mtf, kernels.unmtf),
    "RLE": (kernels.rle, kernels.unrle),
    "RLE1": (kernels.rle_interleaved, kernels.unrle_interleaved),
    "AC": (kernels.ac, kernels.unac),
    "AC2": (kernels.ac2, kernels.unac2),
}
#: The order in which the flag word's stages run.
ORDER = ("BWT", "BWT2", "MTF", "RLE", "AC", "AC2")


def register(name: str, encode: Kernel, decode: Kernel) -> None:
    """A stage of one's own, for pipelines by name."""
    STAGES[name] = (encode, decode)


def stages_of(spec: str | int | Sequence[str]) -> list[str]:
    """Stages of a preset's number, of names between plus signs, or of a flag word; unknown names are an error."""
    if isinstance(spec, int):
        return [s for s in ORDER if spec >> STAGE_BITS[s] & 1]
    if isinstance(spec, str):
        if spec in PRESETS:
            return [s for s in ORDER if s in PRESETS[spec]]
        spec = spec.split("+") if spec else []
        spec = spec[:-1] if spec and spec[-1] == "" else spec
    if unknown := [s for s in spec if s not in STAGES]:
        raise ValueError(f"stages not known: {unknown}")
    return list(spec)


def _column(chain: list[Kernel]):
    @F.pandas_udf("binary")
    def run(blocks: pd.Series) -> pd.Series:
        made = kernels.through(chain, (x for x in blocks if x is not None))
        return pd.Series([None if x is None else next(made) for x in blocks], dtype=object)

    return run


def encode(block: Column, spec: str | int | Sequence[str]) -> Column:
    """Blocks (binary) through the stages, in one pass; null stays null."""
    return _column([STAGES[s][0] for s in stages_of(spec)])(block)


def decode(block: Column, spec: str | int | Sequence[str]) -> Column:
    return _column([STAGES[s][1] for s in reversed(stages_of(spec))])(block)


def round_trip(blocks: DataFrame, spec: str | int | Sequence[str], keys: Sequence[str] = ("file_id", "block_id")) -> DataFrame:
    """(keys, n, n_coded, same): length of each block before and after the stages, and whether undoing them gives it
    back. Coded blocks never leave the worker."""
    use_workers(blocks.sparkSession)
    forth, back = _both_ways(spec)
    schema = blocks.select(*keys, "n", F.lit(0).cast("long").alias("n_coded"), F.lit(True).alias("same")).schema

    def run(batches):
        sizes = deque()

        def measured(coded):
            for x in coded:
                sizes.append(len(x))
                yield x

        for b, made in _in_turn(batches, lambda own: kernels.through(back, measured(kernels.through(forth, own)))):
            same = [again == x for x, again in zip(b.column("block").to_pylist(), made, strict=True)]
            coded = [sizes.popleft() for _ in same]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("n"), pa.array(coded, pa.int64()), pa.array(same)], schema.names)

    return blocks.select(*keys, "n", "block").mapInArrow(run, schema)


def restored(blocks: DataFrame, spec: str | int | Sequence[str], keys: Sequence[str] = ("file_id", "block_id")) -> DataFrame:
    """(keys, n, block): each block after the stages and their undoing. Coded blocks never leave the worker, which holds
    a few at a time: an order-1 model alone has 256 KiB."""
    use_workers(blocks.sparkSession)
    forth, back = _both_ways(spec)
    rows = blocks.select(*keys, "n", "block")

    def run(batches):
        for b, made in _in_turn(batches, lambda own: kernels.through([*forth, *back], own)):
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(made, pa.binary())], b.schema.names)

    return rows.mapInArrow(run, rows.schema)


def _in_turn(batches: Iterable[pa.RecordBatch], run: Callable[[Iterable[bytes]], Iterator[bytes]]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(batch, what is made of its blocks) of each batch that has any, in order. Blocks are read on over batches, as many as
    the kernels work on side by side."""
    waiting = deque()

    def blocks():
        for b in batches:
            if b.num_rows:
                waiting.append(b)
                yield from b.column("block").to_pylist()

    made = iter(run(blocks()))
    for first in made:
        b = waiting.popleft()
        yield b, [first, *islice(made, b.num_rows - 1)]


def _both_ways(spec: str | int | Sequence[str]) -> tuple[list[Kernel], list[Kernel]]:
    names = stages_of(spec)
    return [STAGES[s][0] for s in names], [STAGES[s][1] for s in reversed(names)]


def stage_orders(blocks: Sequence[str] = ("BWT2", "MTF", "RLE"), ends: Sequence[str] = ("AC", "AC2")) -> list[str]:
    """All orders of any of the first stages, each with either coder at the end."""
    return ["+".join([*p, e]) for k in range(len(blocks) + 1) for p in permutations(blocks, k) for e in ends]


def block_list(blocks: DataFrame, name: str, kernel: Callable[[bytes], Sequence[int]], keys: Sequence[str] = ("file_id", "block_id")) -> DataFrame:
    """(keys, n, an array of numbers that the kernel makes of each block)."""
    use_workers(blocks.sparkSession)
    schema = blocks.select(*keys, "n", F.array(F.lit(0).cast("long")).alias(name)).schema

    def run(batches):
        for b in batches:
            made = [[int(v) for v in kernel(x)] for x in b.column("block").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("n"), pa.array(made, pa.list_(pa.int64()))], schema.names)

    return blocks.select(*keys, "n", "block").mapInArrow(run, schema)
