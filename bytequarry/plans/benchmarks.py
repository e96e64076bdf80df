"""Reports on runs of packing programs.

runs: program, mode, file, time_pack_us, time_unpack_us, size_base, size_packed, ram_pack_kb, ram_unpack_kb; any number
of rows for each (program, mode, file), of which the least time and memory count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["program", "mode", "file"]
TIMES = ["time_pack_us", "time_unpack_us", "ram_pack_kb", "ram_unpack_kb"]

#: Measures by name; more can be added.
MEASURES: dict[str, Column] = {}


def least(runs: DataFrame) -> DataFrame:
    """The least time and memory of each program, mode and file, with its sizes."""
    return runs.groupBy(*KEYS).agg(*[F.min(c).alias(c) for c in TIMES], F.max("size_base").alias("size_base"), F.min("size_packed").alias("size_packed"))


def measures() -> dict[str, Column]:
    """Packed size by original size; bytes by microsecond of packing and unpacking; memory by 1000 bytes."""
    size = F.col("size_base").cast("double")
    return {
        "effectiveness": F.col("size_packed") / size,
        "speed": size / (F.col("time_pack_us") + F.col("time_unpack_us")),
        "ram_use": (F.col("ram_pack_kb") + F.col("ram_unpack_kb")) * 1000 / size,
        **MEASURES,
    }


def wide(runs: DataFrame, value: Column, files: Sequence[str]) -> DataFrame:
    """A row for each program and mode, a column for each file."""
    return least(runs).withColumn("value", value).groupBy("program", "mode").pivot("file", list(files)).agg(F.first("value"))


def raw(runs: DataFrame, files: Sequence[str]) -> DataFrame:
    """A row for each program and mode, five columns for each file."""
    aggs = [F.first(c).alias(c) for c in ("size_packed", *TIMES)]
    return least(runs).groupBy("program", "mode").pivot("file", list(files)).agg(*aggs)


def sizes(runs: DataFrame) -> DataFrame:
    """Each file's original size, and how many runs there are of it."""
    return runs.groupBy("file").agg(F.max("size_base").alias("size_base"), F.count("*").alias("n_runs"))
