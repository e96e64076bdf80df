"""Connected components of a graph given as links between 64-bit nodes, without gathering the graph anywhere.

Each round lets every node point to the linked node of smallest random priority, if that is smaller than its own,
shortens these pointers by jumping, and replaces the links' ends by what they point to. Random priorities keep the
pointers' chains short, so each round leaves a fraction of the links. Rounds are written to the shared folder.
Once at most FINISH links are left, one task ends the work with a union-find of that bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, use_workers

FINISH = 20_000
JUMPS = 3


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes with at most one link a node: each node to the smallest node of its component."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        la, lb = label[a], label[b]
        if (la == lb).all():
            break
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while (label[label] != label).any():
            label = label[label]
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[label[own]], nodes[own]


def as_links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _forests(batches):
    """Forest of each stretch of links."""
    held, n = [], 0
    for x in batches:
        held.append((x.column("a").to_numpy(zero_copy_only=False), x.column("b").to_numpy(zero_copy_only=False)))
        n += x.num_rows
        if n >= 1_000_000:
            a, b = forest(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held, n = [(a, b)], len(a)
            if n >= 500_000:
                yield as_links(a, b)
                held, n = [], 0
    if held:
        yield as_links(*forest(*(np.concatenate(c) for c in zip(*held, strict=True))))


def connected_components(links: DataFrame, dense: bool = False) -> DataFrame:
    """(id, root) of every node with a link to another; root is a node of its component, the same for all of it.

    links: columns a, b (long, not null); loops and repeated links don't matter. dense: many links between few nodes,
    so that each task first reduces its own to a forest.
    """
    use_workers(links.sparkSession)
    links = links.where("a <> b")
    links = saved((links.mapInArrow(_forests, "a long, b long") if dense else links).distinct())
    left, maps, turn = links.count(), [], 0
    while left > FINISH:
        turn += 1
        rank = lambda c, turn=turn: F.struct(F.xxhash64(c, F.lit(turn)).alias("p"), c.alias("id"))
        both = links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select(F.col("b"), F.col("a")))
        best = both.groupBy("id").agg(F.min(rank(F.col("to"))).alias("best"))
        to = saved(best.where(F.col("best") < rank(F.col("id"))).select("id", F.col("best.id").alias("to")))
        for _ in range(JUMPS):
            step = to.select(F.col("id").alias("to"), F.col("to").alias("next"))
            to = to.join(step, "to", "left").select("id", F.coalesce("next", "to").alias("to"))
        to = saved(to)
        maps.append(to)
        for c in ("a", "b"):
            links = links.join(to.select(F.col("id").alias(c), F.col("to").alias("new")), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        links = saved(links)
        left = links.count()
    last = links.coalesce(1).mapInArrow(_forests, "a long, b long")  # at most FINISH links
    out = last.select(F.col("b").alias("id"), F.col("a").alias("root"))
    for to in reversed(maps):
        moved = to.join(out.select(F.col("id").alias("to"), "root"), "to", "left").select("id", F.coalesce("root", "to").alias("root"))
        out = moved.union(out.join(to, "id", "left_anti"))
    out = saved(out)
    return out.union(out.select("root", "root").distinct())
