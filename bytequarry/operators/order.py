"""Places and running sums over a whole table in order, without one task that sees it all."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shared import saved, use_workers


def in_order(df: DataFrame, order: Sequence[Column], amount: Column | None = None, partitions: int | None = None) -> DataFrame:
    """The columns with pos (place in the order, from 0) and before (sum of amount, a long, over all rows before).

    Rows are dealt out by ranges of the order and written; each part numbers its own rows, and the parts' sizes, a few
    numbers each, are summed up. order should tell all rows apart.
    """
    spark = df.sparkSession
    use_workers(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.withColumn("amount_", (F.lit(0) if amount is None else F.coalesce(amount, F.lit(0))).cast("long"))
    schema = T.StructType([*rows.schema.fields, T.StructField("part_", T.IntegerType()), T.StructField("pos_", T.LongType()), T.StructField("sum_", T.LongType())])

    def number(batches):
        part, pos, total = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            amounts = b.column("amount_").to_numpy(zero_copy_only=False)
            upto = total + np.cumsum(amounts, dtype=np.int64)
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(k, part, np.int32)), pa.array(pos + np.arange(k)), pa.array(upto - amounts)], [*b.schema.names, "part_", "pos_", "sum_"])
            pos, total = pos + k, int(upto[-1]) if k else total

    made = saved(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(number, schema))
    parts = made.groupBy("part_").agg(F.count("*").alias("rows_"), F.sum("amount_").alias("all_"))  # a row a part
    ahead = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part_", F.coalesce(F.sum("rows_").over(ahead), F.lit(0)).alias("first_"), F.coalesce(F.sum("all_").over(ahead), F.lit(0)).alias("start_"))
    out = made.join(parts, "part_")
    return out.select(*df.columns, (F.col("first_") + F.col("pos_")).cast("long").alias("pos"), (F.col("start_") + F.col("sum_")).cast("long").alias("before"))


def ranked(df: DataFrame, groups: Sequence[str], order: Sequence[Column], name: str = "rnk") -> DataFrame:
    """The columns with each row's place in its group (from 1). A group may span any number of tasks."""
    placed = in_order(df, [*map(F.col, groups), *order])
    first = placed.groupBy(*[F.col(g).alias(f"{g}_") for g in groups]).agg(F.min("pos").alias("first_"))
    condition = F.lit(True)
    for g in groups:
        condition &= F.col(g).eqNullSafe(F.col(f"{g}_"))
    return placed.join(first, condition).select(*df.columns, (F.col("pos") - F.col("first_") + 1).cast("long").alias(name))
