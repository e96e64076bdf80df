"""Sums over bags of keys: each row holds many keys, each key has a value in a table that may be far larger than memory.

The join of per-row key frequencies with the key table is split by how frequent a key is in the corpus. The most
frequent keys, at most ``core_keys`` of them and CORE_BYTES in all, are broadcast to the workers (a proven bound); they
hold almost all occurrences and all the skew. The remaining keys are rare by construction, so they spread evenly when
they are shuffled to their values. Where keys are joined, a digest stands for a long one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most keys that are broadcast, with about 100 bytes each in a worker's memory, and most bytes of them.
CORE_KEYS, CORE_BYTES = 300_000, 16 << 20
#: Distinct keys, and characters of them, that a map task holds before it passes on its partial counts.
FLUSH_KEYS, FLUSH_LETTERS = 400_000, 16 << 20
#: Longest key that is joined as it is.
LONG_KEY = 64


def joined_key(key: str) -> str:
    """The key, or if it is long, what stands for it: a mark that begins no word or pre-token, and a digest of 128 bits."""
    return key if len(key) <= LONG_KEY else "\1" + xxhash.xxh3_128_hexdigest(key.encode())


def row_key(doc_id, text: bytes) -> int:
    """Tells rows apart by what is in them, wherever and however often they are computed; a signed 64-bit value."""
    h = xxhash.xxh3_64_intdigest(text, 0 if doc_id is None else doc_id & 0xFFFFFFFF)
    return h - (1 << 64) if h >> 63 else h


def count_keys(rows: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[dict]]) -> DataFrame:
    """(key, total) over all rows, pre-aggregated in each map task before the shuffle.

    keys_of yields, for each batch, dictionaries from key to count.
    """

    def partial(batches):
        held: dict[str, int] = {}
        letters = 0
        for batch in batches:
            for bag in keys_of(batch):
                for k, n in bag.items():
                    if k in held:
                        held[k] += n
                    else:
                        held[k] = n
                        letters += len(k)
                if len(held) >= FLUSH_KEYS or letters >= FLUSH_LETTERS:
                    yield flush(held)
                    held, letters = {}, 0
        if held:
            yield flush(held)

    def flush(held):
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["key", "total"])

    return rows.mapInArrow(partial, "key string, total long").groupBy("key").agg(F.sum("total").alias("total"))


def core_of(table: DataFrame, value: str, core_keys: int = CORE_KEYS) -> tuple[dict, int]:
    """The most frequent keys with their values, at most core_keys of CORE_BYTES in all, and the total from which a key
    belongs to them.

    The threshold comes from a histogram of totals on a fine logarithmic scale, so no sort of the table is needed.
    """
    step = F.floor(F.log2(F.col("total").cast("double")) * 8)
    bins = table.groupBy(step.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.octet_length("key")).alias("size"), F.min("total").alias("least")).collect()  # at most 8*64 rows
    least, n, size = None, 0, 0
    for b in sorted(bins, key=lambda b: -b["bin"]):
        n, size = n + b["n"], size + b["size"]
        if n > core_keys or size > CORE_BYTES:
            break
        least = b["least"]
    if least is None:
        return {}, 1 << 62
    kept = table.where(F.col("total") >= least).select("key", value).toArrow()  # at most core_keys rows
    return dict(zip(kept.column("key").to_pylist(), kept.column(value).to_pylist(), strict=True)), least


def bag_sums(rows: DataFrame, columns: dict[str, str], bag_of: Callable, table: DataFrame, value: str, least: int, sums: dict[str, str], term: dict) -> DataFrame:
    """One row for each input row: its own columns, and sums over its keys.

    bag_of(batches) yields for each row of them (row_key of it, values of the columns, sums over core keys, {rare key:
    count}). columns and sums map names to Spark types; the first column is the row's id. term maps each sum to a Column
    made of `n` (the count in the row) and the table's value; it is applied to the rare keys after the join. Rows are
    told apart by id and row_key, not by place, so that they may come in any order whenever a lost part of them is
    computed again; rows of equal id and content are summed as one and given back as often as they came.
    """
    fields = ", ".join(f"{k} {v}" for k, v in {**columns, **sums}.items())
    schema = f"rid long, key string, n long, own int, {fields}"
    names, first = [*columns, *sums], next(iter(columns))

    def split(batches):
        blank = {k: [] for k in ("rid", "key", "n", "own", *names)}
        empty = [k for k in names if k != first]
        out = {k: [] for k in blank}
        for rid, own, known, rare in bag_of(batches):
            out["rid"].append(rid)
            out["key"].append(f"\0{rid}")  # no word or pre-token looks like this: it finds no partner, and spreads evenly
            out["n"].append(0)
            out["own"].append(1)
            for k, v in zip(columns, own, strict=True):
                out[k].append(v)
            for k, v in zip(sums, known, strict=True):
                out[k].append(v)
            m = len(rare)
            if m:
                out["rid"] += [rid] * m
                out["key"] += map(joined_key, rare)
                out["n"] += rare.values()
                out["own"] += [None] * m
                out[first] += [own[0]] * m
                for k in empty:
                    out[k] += [None] * m
            if len(out["rid"]) >= 50_000:
                yield build(out)
                out = {k: [] for k in blank}
        if out["rid"]:
            yield build(out)

    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "int": pa.int32()}
    types = {"rid": pa.int64(), "key": pa.string(), "n": pa.int64(), "own": pa.int32(), **{k: kinds[v] for k, v in {**columns, **sums}.items()}}

    def build(out):
        return pa.RecordBatch.from_arrays([pa.array(v, types[k]) for k, v in out.items()], list(out))

    parts = rows.mapInArrow(split, schema)
    rare = table.where(F.col("total") < least).select("key", F.col(value).alias("_value"))
    joined = parts.join(rare, "key", "left")
    summed = (
        joined.select("rid", "own", *columns, *[F.coalesce(F.col(k), term[k](F.col("n"), F.col("_value"))).alias(k) for k in sums])
        .groupBy(first, "rid")
        .agg(F.sum("own").cast("int").alias("own"), *[F.max(c).alias(c) for c in columns if c != first], *[F.sum(k).alias(k) for k in sums])
    )
    share = {k: (F.col(k) / F.col("own")).cast(v) for k, v in sums.items()}  # equal parts, so integers divide evenly
    one = [F.when(F.col("own") == 1, F.col(k)).otherwise(x).alias(k) for k, x in share.items()]
    return summed.select(*columns, *one, F.explode(F.sequence(F.lit(1), F.col("own"))).alias("own")).select(*columns, *sums)
