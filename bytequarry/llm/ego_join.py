"""Operator 5: near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned to their principal axes and sorted by the cells, as wide as the greatest distance of a link,
of a grid on the leading axes. The sorted sequence is cut into blocks; intervals of the sequence are joined from the
whole downwards, and a pair of intervals is dropped as soon as their boxes lie further apart than a link can reach.
Pairs of blocks that remain are dealt out in tiles, the pairs of two stretches of blocks, so that a block goes once to a
tile however many pairs it has there; they are joined by the same recursion down to small leaves, which are compared
with each other by one matrix product. A task gives back how many links each vector has and a spanning forest of
them, never the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, saved
from .components import as_links, connected_components, forest
from .vectors import cosines, matrix, sampled, unit, usable, width_of

#: Vectors of a block, of a leaf, and blocks or intervals of an interval one level up.
BLOCK, LEAF, FAN = 2048, 256, 8
#: Leading axes that the grid's cells are on, and rows of which the axes are made.
AXES, AXES_SAMPLE = 6, 20_000
#: Most blocks of a stretch; a tile's two stretches stand in a task's memory.
STRETCH = 32
#: Room for rounding in distances between boxes; cosines this close to the bound are computed again, row by row.
SLACK, CLOSE = 1e-9, 1e-11


def boxes(turned: np.ndarray, lo: int, hi: int) -> dict:
    """Boxes of all intervals that halving lo:hi down to leaves gives."""
    out = {}

    def make(a, b):
        if b - a <= LEAF:
            out[a, b] = turned[a:b].min(0), turned[a:b].max(0)
        else:
            m = (a + b) // 2
            (l1, h1), (l2, h2) = make(a, m), make(m, b)
            out[a, b] = np.minimum(l1, l2), np.maximum(h1, h2)
        return out[a, b]

    make(lo, hi)
    return out


def apart(a, b) -> float:
    """Squared distance of two boxes."""
    gap = np.maximum(0, np.maximum(a[0] - b[1], b[0] - a[1]))
    return float(gap @ gap)


def join_intervals(a, b, boxes_a, boxes_b, same: bool, reach: float, leaf) -> None:
    """Recursive join of two intervals; leaf(a, b) is called for pairs of leaves that are not provably distant."""
    if apart(boxes_a[a], boxes_b[b]) > reach:
        return
    cut_a, cut_b = a[1] - a[0] > LEAF, b[1] - b[0] > LEAF
    if not cut_a and not cut_b:
        leaf(a, b)
        return
    halves = lambda x, cut: [(x[0], (x[0] + x[1]) // 2), ((x[0] + x[1]) // 2, x[1])] if cut else [x]
    for i, x in enumerate(halves(a, cut_a)):
        for j, y in enumerate(halves(b, cut_b)):
            if not (same and a == b and j < i):
                join_intervals(x, y, boxes_a, boxes_b, same, reach, leaf)


def _blocks(vectors: DataFrame, axes: np.ndarray, eps: float, width: str, dim: int) -> DataFrame:
    """One row a block of the sorted sequence: seq (its place), rids, copies, vecs, lo, hi (its box)."""
    spark = vectors.sparkSession
    leading = min(AXES, dim)
    cells = [f"c{i}" for i in range(leading)]

    def cell(batches):
        for b in batches:
            if b.num_rows:
                turned = unit(matrix(b.column("vec").to_pylist(), width)) @ axes[:, :leading]
                grid = np.floor(turned / eps).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(grid[:, i]) for i in range(leading))], [*b.schema.names, *cells])

    schema = "rid long, copies long, vec binary, " + ", ".join(f"{c} int" for c in cells)
    order = [*cells, F.xxhash64("rid")]
    dealt = vectors.mapInArrow(cell, schema).repartitionByRange(partitions_for(spark), *order).sortWithinPartitions(*order)

    def pack(batches):
        part, k, held = TaskContext.get().partitionId(), 0, None
        for b in batches:
            t = pa.Table.from_batches([b]).select(["rid", "copies", "vec"])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= BLOCK:
                yield block(part, k, held.slice(0, BLOCK))
                held, k = held.slice(BLOCK).combine_chunks(), k + 1
        if held is not None and held.num_rows:
            yield block(part, k, held)

    def block(part, k, t):
        vecs = t.column("vec").to_pylist()
        turned = unit(matrix(vecs, width)) @ axes
        row = {"part": part, "k": k, "rids": np.array(t.column("rid").to_pylist(), "<i8").tobytes(), "copies": np.array(t.column("copies").to_pylist(), "<i8").tobytes(), "vecs": b"".join(vecs), "lo": turned.min(0).tolist(), "hi": turned.max(0).tolist()}
        kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), kinds, strict=True)], list(row))

    made = saved(dealt.mapInArrow(pack, "part int, k int, rids binary, copies binary, vecs binary, lo array<double>, hi array<double>"))
    counts = made.groupBy("part").count()  # a row a partition
    first = counts.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return made.join(first, "part").withColumn("seq", F.col("first") + F.col("k")).drop("part", "k", "first")


def _pairs(blocks: DataFrame, reach: float) -> DataFrame:
    """(a, b), a <= b: pairs of blocks whose boxes are near enough, found from the whole sequence downwards."""
    levels = [saved(blocks.select(F.col("seq").alias("node"), "lo", "hi"))]
    n = levels[0].count()
    if not n:
        return blocks.select(F.col("seq").alias("a"), F.col("seq").alias("b"))
    dims = len(levels[0].first()["lo"])
    while n > 1:
        up = levels[-1].groupBy(F.expr(f"node div {FAN}").alias("node"))
        lows = [F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(dims)]
        highs = [F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(dims)]
        up = up.agg(*lows, *highs)
        levels.append(saved(up.select("node", F.array(*[f"l{i}" for i in range(dims)]).alias("lo"), F.array(*[f"h{i}" for i in range(dims)]).alias("hi"))))
        n = math.ceil(n / FAN)
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    gap = F.aggregate(F.zip_with(F.zip_with("la", "hb", lambda x, y: x - y), F.zip_with("lb", "ha", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x * x)
    for level in reversed(levels[:-1]):
        children = lambda c, level=level: level.select(F.expr(f"node div {FAN}").alias(c), F.col("node").alias(f"next_{c}"), F.col("lo").alias(f"l{c}"), F.col("hi").alias(f"h{c}"))
        near = pairs.join(children("a"), "a").join(children("b"), "b").where("next_a <= next_b").where(gap <= reach)
        pairs = saved(near.select(F.col("next_a").alias("a"), F.col("next_b").alias("b")))
    return pairs


def _join_blocks(blocks: DataFrame, pairs: DataFrame, axes: np.ndarray, least: float, reach: float, width: str) -> DataFrame:
    """(a, b, n): links of a spanning forest (n null), and how many vectors each is linked with in a tile (b null)."""
    parts = partitions_for(blocks.sparkSession)
    stretch = min(STRETCH, max(1, math.ceil(blocks.count() / math.ceil(math.sqrt(2 * parts)))))
    tile = [F.expr(f"{c} div {stretch}").alias(f"t{c}") for c in ("a", "b")]
    dealt = saved(pairs.select(*tile, "a", "b"))
    jobs = dealt.groupBy("ta", "tb").agg(F.array_sort(F.collect_list(F.struct("b", "a"))).alias("pairs"))  # stretch squared at most
    needed = dealt.select("ta", "tb", F.explode(F.array("a", "b")).alias("seq")).distinct()
    data = needed.join(blocks.select("seq", "rids", "copies", "vecs"), "seq")
    none = lambda t, c: F.lit(None).cast(t).alias(c)
    rows = jobs.select("ta", "tb", F.lit(-1).cast("long").alias("seq"), "pairs", none("binary", "rids"), none("binary", "copies"), none("binary", "vecs"))
    rows = rows.union(data.select("ta", "tb", F.col("seq").cast("long"), F.lit(None).cast(jobs.schema["pairs"].dataType).alias("pairs"), "rids", "copies", "vecs"))
    rows = rows.repartition(parts, "ta", "tb").sortWithinPartitions("ta", "tb", "seq")

    def load(row):
        rids, copies = (np.frombuffer(row[c], "<i8") for c in ("rids", "copies"))
        m = unit(np.frombuffer(row["vecs"], width).reshape(len(rids), -1).astype(np.float64))
        return rids, copies, m, boxes(m @ axes, 0, len(rids)), np.zeros(len(rids), np.int64)

    def counts(tile):
        for rids, _, _, _, n in tile.values():
            at = np.flatnonzero(n)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(rids[at]), pa.nulls(len(at), pa.int64()), pa.array(n[at])], ["a", "b", "n"])

    def links_of(own, other):
        same, links, size = own is other, [], 0

        def leaf(x, y):
            nonlocal links, size
            m, v = own[2][slice(*x)], other[2][slice(*y)]
            products = m @ v.T
            near = products >= least
            for i, j in zip(*np.nonzero(np.abs(products - least) <= CLOSE), strict=True):
                near[i, j] = cosines(m[i : i + 1], v[j])[0] >= least
            if same and x == y:
                near &= np.tri(*near.shape, -1, dtype=bool)
            if near.any():
                i, j = np.nonzero(near)
                np.add.at(own[4], i + x[0], other[1][j + y[0]])
                np.add.at(other[4], j + y[0], own[1][i + x[0]])
                links.append(forest(own[0][i + x[0]], other[0][j + y[0]]))
                size += len(links[-1][0])
                if size > 500_000:
                    links = [forest(*(np.concatenate(c) for c in zip(*links, strict=True)))]
                    size = len(links[0][0])

        whole = lambda b: (0, len(b[0]))
        join_intervals(whole(own), whole(other), own[3], other[3], same, reach, leaf)
        return links

    def run(batches):
        todo, held, at = [], {}, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["pairs"] is not None:  # a new tile: its pairs by their later block, then its blocks in order
                    yield from counts(held)
                    todo, held, at = [(p["a"], p["b"]) for p in row["pairs"]], {}, 0
                    continue
                held[row["seq"]] = load(row)
                links = []
                while at < len(todo) and todo[at][1] <= row["seq"]:
                    links += links_of(held[todo[at][0]], held[todo[at][1]])
                    at += 1
                if links:
                    found = as_links(*forest(*(np.concatenate(c) for c in zip(*links, strict=True))))
                    yield found.append_column("n", pa.nulls(found.num_rows, pa.int64()))
        yield from counts(held)

    return rows.mapInArrow(run, "a long, b long, n long")


def near_vectors(table: DataFrame, least: float = 0.9, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.

    Two vectors of equal dimension link if their cosine in double precision is at least `least` (0 < least < 1). Rows
    whose vector is null, empty, zero or holds null or non-finite components link with nothing; so do rows without id,
    which have no component and aren't kept. n_links: other rows linked directly (a row of the same vector counts);
    component_id: the smallest vec_id reachable, its own included; kept: vec_id is its component_id. An empty table
    gives an empty result. Equal vectors are joined as one, with their number.
    """
    width = width_of(table, vector)
    rows = saved(usable(table, vec_id, vector))
    distinct = saved(rows.groupBy("dim", "vec").agg(F.min("vec_id").alias("rid"), F.count("*").alias("copies")))
    sizes = [(r["dim"], r["n"]) for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).collect()]  # a row a dimension
    eps = math.sqrt(2 - 2 * least)
    reach = (eps + SLACK) ** 2
    found = None
    for dim, n in sorted(sizes):
        own = distinct.where(F.col("dim") == dim)
        sample = sampled(own.withColumnRenamed("rid", "vec_id"), n, AXES_SAMPLE, dim, width)
        axes = np.linalg.eigh(np.cov(sample.T).reshape(dim, dim) if len(sample) > 1 else np.eye(dim))[1][:, ::-1].copy()
        blocks = saved(_blocks(own.select("rid", "copies", "vec"), axes, eps, width, dim))
        made = _join_blocks(blocks, _pairs(blocks, reach), axes, least, reach, width)
        found = made if found is None else found.union(made)
    every = table.select(F.col(vec_id).cast("long").alias("vec_id"))
    if found is None:
        return every.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.coalesce(F.col("vec_id").isNotNull(), F.lit(False)).alias("kept"))
    found = saved(found)
    links = found.where("n is not null").groupBy(F.col("a").alias("rid")).agg(F.sum("n").alias("links"))
    roots = connected_components(found.where("n is null").select("a", "b")).withColumnRenamed("id", "rid")
    reps = distinct.select("dim", "vec", "rid", "copies").join(links, "rid", "left").join(roots, "rid", "left").withColumn("root", F.coalesce("root", "rid"))
    least_id = reps.groupBy("root").agg(F.min("rid").alias("component_id"))
    reps = reps.join(least_id, "root").select("dim", "vec", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    with_links = rows.join(reps, ["dim", "vec"]).select("vec_id", "n_links", "component_id")
    # Rows that take no part: all of an id's rows less those that do, so that an id may have several rows.
    marked = every.groupBy("vec_id").agg(F.count("*").alias("n")).join(rows.groupBy("vec_id").agg(F.count("*").alias("m")), "vec_id", "left")
    rest = marked.withColumn("k", F.col("n") - F.coalesce("m", F.lit(0))).where("k > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("k"))))
    rest = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return with_links.union(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
