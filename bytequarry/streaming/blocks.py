"""Files that keep arriving, as a stream of coded blocks. Blocks know nothing of each other, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import checksum
from ..operators.codecs import encode
from ..shared import use_workers
from ..sources.blocks import split_blocks


def coded_stream(spark: SparkSession, path: str, spec: str, block_size: int = 1 << 24, kind: str = "SHA-256") -> DataFrame:
    """(path, checksum, block_id, n, coded) of files as they appear in a folder."""
    use_workers(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path)
    blocks = split_blocks(files.select("path", checksum(F.col("content"), kind).alias("checksum"), "content"), block_size)
    return blocks.select("path", "checksum", "block_id", "n", encode(F.col("block"), spec).alias("coded"))
