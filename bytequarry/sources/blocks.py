"""Files and their blocks as tables. A block is the unit of work: one row, never spread over rows by byte."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spread


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def files_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(file_id, content): texts as files of UTF-8 bytes; null text is an empty file."""
    return spread(docs.select(F.col(doc_id).alias("file_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("content")))


def split_blocks(files: DataFrame, block_size: int, content: str = "content") -> DataFrame:
    """The files' columns with block_id (int), n (long) and the block's bytes in place of the content.

    All but a file's last block have block_size bytes; an empty file has one empty block. No shuffle: a file's row
    gives its blocks' rows.
    """
    size = F.length(content)
    last = F.greatest(F.lit(0), F.ceil(size / block_size).cast("int") - 1)
    own = [c for c in files.columns if c != content]
    made = files.withColumn("block_id", F.explode(F.sequence(F.lit(0), last)))
    made = made.withColumn("block", F.substring(F.col(content), F.col("block_id") * block_size + 1, F.lit(block_size)))
    return made.select(*own, "block_id", F.length("block").cast("long").alias("n"), "block")


def join_blocks(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): blocks put together again in order. A file is one value, so its blocks must meet in one row."""
    return blocks.groupBy(*keys).agg(F.expr("coalesce(listagg(block) within group (order by block_id), cast('' as binary))").alias("content"))
