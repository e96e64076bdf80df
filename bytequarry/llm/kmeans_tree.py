"""Operator 6: approximate nearest neighbours in a hierarchical k-means tree.

The tree's upper part is made of a bounded sample; every vector is then filed in the leaf that the nearest centres lead
to. A leaf that still holds many vectors gets a tree of its own, of a bounded sample of these, and so on: leaves follow
the number of vectors. A query walks down to its nearest leaf and puts the branches it passes by in a priority queue,
from which it takes the nearest one again and again: best bin first. How many leaves a query visits is widened, on
sampled queries with known answers, until their recall is reached. Leaves that lie side by side in the tree form a
group; vectors stand in blocks of their group, a query goes once to a group with the list of leaves it visits there, and
each leaf takes one matrix product with the queries that visit it.
"""

from __future__ import annotations

import heapq
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions_for, saved
from .vectors import matrix, sampled, unit, usable, width_of

#: Rows of which a tree is made; children of a node; vectors meant for a leaf, and for a leaf of a sample at least.
SAMPLE, FAN, LEAF_ROWS, LEAST = 20_000, 8, 32, 8
#: A leaf of more than so many times the vectors meant for it is split by a tree of its own.
SPLIT = 16
#: Queries on which visits are calibrated, and the recall at which widening stops.
TRIALS, RECALL = 200, 0.97
#: Leaves of a group; vectors and queries of a block.
GROUP, BLOCK, QUERIES = 64, 4096, 1024
#: Room for the numbers of a tree's leaves in those of the next one down.
SPAN = 1 << 15
#: Scores this close are computed again, row by row.
CLOSE = 1e-11


class Tree:
    """Centres of nodes, children of inner nodes, numbers of leaves."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 0):
        self.rng = np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [np.zeros(sample.shape[1])], [[]], [-1]
        least = max(LEAST, len(sample) / max(1, leaves))
        self.n_leaves = 0
        self._split(0, sample, least)
        self.centres = np.array(self.centres)
        del self.rng

    def _split(self, node: int, rows: np.ndarray, least: float) -> None:
        if len(rows) <= least * 1.5 or not (rows != rows[:1]).any():
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return
        k = int(min(FAN, max(2, round(len(rows) / least))))
        centres = rows[self.rng.choice(len(rows), k, replace=False)]
        for _ in range(8):
            near = (rows @ centres.T).argmax(1)
            sums = np.stack([rows[near == i].sum(0) if (near == i).any() else rows[self.rng.integers(len(rows))] for i in range(k)])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-300)
        near = (rows @ centres.T).argmax(1)
        parts = [i for i in range(k) if (near == i).any()]
        if len(parts) < 2:
            self.leaf[node] = self.n_leaves
            self.n_leaves += 1
            return
        for i in parts:
            child = len(self.centres)
            self.centres.append(centres[i])
            self.children.append([])
            self.leaf.append(-1)
            self.children[node].append(child)
        for i, child in zip(parts, list(self.children[node]), strict=True):
            self._split(child, rows[near == i], least)

    def file(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row: down the nearest centres."""
        out = np.zeros(len(rows), np.int64)
        todo = [(0, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            if self.leaf[node] >= 0:
                out[at] = self.leaf[node]
                continue
            own = np.array(self.children[node])
            near = (rows[at] @ self.centres[own].T).argmax(1)
            todo += [(c, at[near == i]) for i, c in enumerate(own) if (near == i).any()]
        return out

    def visits(self, query: np.ndarray, most: int) -> list[int]:
        """The first leaves of a best-bin-first walk."""
        far = -(self.centres @ query)
        queue, out = [(-2.0, 0)], []
        while queue and len(out) < most:
            node = heapq.heappop(queue)[1]
            while self.leaf[node] < 0:  # to the nearest leaf below; the branches passed by wait in the queue
                own = sorted((far[c], c) for c in self.children[node])
                for x in own[1:]:
                    heapq.heappush(queue, x)
                node = own[0][1]
            out.append(self.leaf[node])
        return out


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, trials: int = TRIALS) -> int:
    """Leaves to visit: widened until sampled queries find `recall` of their k nearest in the sample."""
    if len(sample) < 2 or tree.n_leaves == 1:
        return tree.n_leaves
    filed = tree.file(sample)
    at = np.linspace(0, len(sample) - 1, min(trials, len(sample))).astype(int)
    needed = []
    for q in at:
        s = sample @ sample[q]
        s[q] = -2
        best = np.argpartition(-s, min(k, len(s) - 1) - 1)[:k]
        turn = {leaf: i for i, leaf in enumerate(tree.visits(sample[q], tree.n_leaves))}
        needed += [turn[filed[b]] + 1 for b in best]
    needed, most = np.array(needed), 1
    while most < tree.n_leaves and (needed <= most).mean() < recall:
        most = min(tree.n_leaves, max(most + 1, math.ceil(most * 1.15)))
    return most


def nearest_in(q: np.ndarray, q_ids: np.ndarray, asked: np.ndarray, asked_leaf: np.ndarray, v: np.ndarray, ids: np.ndarray, leaf: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score): the k nearest of each query among unit vectors v of the leaves that it visits, ties to
    smaller ids. leaf: of each vector, ascending; asked, asked_leaf: place of a query and a leaf that it visits, by leaf."""
    found = []
    first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    for lo, hi in zip(first, np.append(first[1:], len(leaf)), strict=True):
        who = asked[np.searchsorted(asked_leaf, leaf[lo]) : np.searchsorted(asked_leaf, leaf[lo], "right")]
        if len(who):
            scores = q[who] @ v[lo:hi].T
            scores[q_ids[who][:, None] == ids[lo:hi]] = -3.0
            bar = np.partition(scores, hi - lo - k, axis=1)[:, hi - lo - k : hi - lo - k + 1] if hi - lo > k else -2.0
            i, j = np.nonzero(scores >= np.maximum(bar, -2.0) - CLOSE)
            found.append((who[i], lo + j))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = q_ids[a] != ids[b]
    a, b = a[keep], b[keep]
    exact = (q[a] * v[b]).sum(axis=1)
    order = np.lexsort((ids[b], -exact, a))
    a, b, exact = a[order], b[order], exact[order]
    start = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
    best = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a)))) < k
    return q_ids[a[best]], ids[b[best]], exact[best]


def nearest(table: DataFrame, queries: Column, k: int = 5, recall: float = RECALL, vec_id: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by cosine in double precision.

    queries: condition on column vec_id that picks the queries. Candidates are all other rows; ties go to the smaller
    vec_id. Rows without id, and vectors that are null, empty, zero or hold null or non-finite components take no part;
    vectors of another dimension than the query's aren't candidates. Rows of one id and one vector count once. sample:
    rows of which the tree is made; all rows are filed in it. An empty table gives an empty result.
    """
    spark = table.sparkSession
    width = width_of(table, vector)
    rows = saved(usable(table, vec_id, vector).distinct())
    sizes = [(r["dim"], r["n"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect()]  # a row a dimension
    out = None
    for dim, n in sorted(sizes):
        made = _nearest(rows.where(F.col("dim") == dim), queries, n, dim, k, recall, width, sample, leaf_rows)
        out = made if out is None else out.union(made)
    if out is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _nearest(rows: DataFrame, queries: Column, n: int, dim: int, k: int, recall: float, width: str, most: int, leaf_rows: int) -> DataFrame:
    spark = rows.sparkSession
    parts = partitions_for(spark)
    sample = sampled(rows, n, most, dim, width)
    if not len(sample):
        sample = np.eye(1, dim)
    tree = Tree(sample, math.ceil(n / leaf_rows))
    visits = calibrate(tree, sample, k, recall)
    shared = spark.sparkContext.broadcast((tree, visits))  # of a sample of `most` rows
    filed_schema, asked_schema = "vec_id long, vec binary, leaf long", "vec_id long, vec binary, group long, leaves array<long>"

    def matrix_of(b):
        return unit(matrix(b.column("vec").to_pylist(), width))

    def filed_in(tree, b, above=0):
        return b.set_column(b.schema.get_field_index("leaf"), "leaf", pa.array(tree.file(matrix_of(b)) + above, pa.int64()))

    def asked_of(tree, visits, b, above=0):
        """A row for each query and group of leaves that it visits."""
        at, leaves = [], []
        for i, x in enumerate(matrix_of(b)):
            own = np.sort(np.array(tree.visits(x, visits), np.int64) + above)
            groups = own // GROUP
            for part in np.split(own, np.flatnonzero(groups[1:] != groups[:-1]) + 1) if len(own) else ():
                at.append(i)
                leaves.append(part)
        rows, group = pa.array(at, pa.int64()), pa.array([int(x[0]) // GROUP for x in leaves], pa.int64())
        return pa.RecordBatch.from_arrays([b.column("vec_id").take(rows), b.column("vec").take(rows), group, pa.array(leaves, pa.list_(pa.int64()))], ["vec_id", "vec", "group", "leaves"])

    def filed_in_own(own, b, above):
        return filed_in(own[0], b, above)

    def asked_of_own(own, b, above):
        return asked_of(*own, b, above)

    def by_top(f):
        def run(batches):
            for b in batches:
                if b.num_rows:
                    yield f(shared.value, b)

        return run

    begun = rows.select("vec_id", "vec", F.lit(0).cast("long").alias("leaf"))
    held = saved(begun.mapInArrow(by_top(lambda top, b: filed_in(top[0], b)), filed_schema))
    asked = saved(begun.where(queries).mapInArrow(by_top(lambda top, b: asked_of(*top, b)), asked_schema))

    def made(batches):
        """Rows of sampled vectors, a leaf's together: a tree of each leaf, with how many leaves to visit."""
        now, vecs, total = None, [], 0
        for b in batches:
            for leaf, vec, count in zip(*(b.column(c).to_pylist() for c in ("leaf", "vec", "count")), strict=True):
                if leaf != now:
                    if vecs:
                        yield one(now, vecs, total)
                    now, vecs, total = leaf, [], count
                vecs.append(vec)
        if vecs:
            yield one(now, vecs, total)

    def one(leaf, vecs, count):
        own = unit(matrix(vecs, width))
        tree = Tree(own, math.ceil(count / leaf_rows))
        return pa.RecordBatch.from_arrays([pa.array([leaf], pa.int64()), pa.array([pickle.dumps((tree, calibrate(tree, own, k, recall)))], pa.binary())], ["leaf", "tree"])

    def descended(df, trees, salts, f, schema, placed):
        """Rows whose leaf has a tree go down in it; each part of a leaf's rows follows a copy of the leaf's tree."""
        laid = lambda d, kind, vec_id, vec, tree: d.select("leaf", "salt", F.lit(kind).alias("kind"), vec_id.alias("vec_id"), vec.alias("vec"), tree.alias("tree"))
        none, ids = F.lit(None).cast("binary"), F.lit(None).cast("long")
        own = df.join(salts, "leaf").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
        copies = trees.join(salts, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)))
        both = laid(copies, 0, ids, none, F.col("tree")).union(laid(own, 1, F.col("vec_id"), F.col("vec"), none))
        both = both.repartition(parts, "leaf", "salt").sortWithinPartitions("leaf", "salt", "kind")

        def run(batches):
            tree = None
            for b in batches:
                kinds, leaves = b.column("kind").to_numpy(), b.column("leaf").to_numpy()
                cuts = [0, *(np.flatnonzero((kinds[1:] != kinds[:-1]) | (leaves[1:] != leaves[:-1]) | (kinds[1:] == 0)) + 1).tolist(), b.num_rows]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if j == i:
                        continue
                    if kinds[i] == 0:
                        tree = pickle.loads(b.column("tree")[i].as_py())
                    else:
                        yield f(tree, b.slice(i, j - i).select(["vec_id", "vec", "leaf"]), (int(leaves[i]) + 1) * SPAN)

        rest = df.join(salts.select("leaf"), "leaf", "left_anti").select("vec_id", "vec", *placed((F.col("leaf") + 1) * SPAN))
        return saved(both.mapInArrow(run, schema).union(rest))

    for _ in range(3):  # each turn divides a leaf by a thousand or more
        counts = held.groupBy("leaf").count().where(F.col("count") > SPLIT * leaf_rows)
        big = saved(counts.select("leaf", "count", F.ceil(F.col("count") / (16 * BLOCK)).alias("salts")))
        if not big.head(1):
            break
        share = F.least(F.lit(1.0), F.lit(float(most)) / F.col("count"))
        picked = held.join(big, "leaf").where(F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(1_000_000)) < share * 1_000_000)
        picked = picked.select("leaf", "vec", "count").repartition(parts, "leaf").sortWithinPartitions("leaf", "vec")
        trees = saved(picked.mapInArrow(made, "leaf long, tree binary"))
        salts = big.join(trees.select("leaf"), "leaf").select("leaf", "salts")
        held = descended(held, trees, salts, filed_in_own, filed_schema, lambda leaf: [leaf])
        each = asked.select("vec_id", "vec", F.explode("leaves").alias("leaf"))
        asked = descended(each, trees, salts, asked_of_own, asked_schema, lambda leaf: [F.expr(f"(leaf + 1) * {SPAN} div {GROUP}"), F.array(leaf)])

    def blocks(size, extra):
        """Rows of one group, dealt to the same partition, in blocks of at most `size`."""

        def pack(batches):
            group, held = None, None
            for b in batches:
                t, groups = pa.Table.from_batches([b]), b.column("group").to_numpy()
                cuts = [0, *(np.flatnonzero(groups[1:] != groups[:-1]) + 1).tolist(), b.num_rows]
                for i, j in zip(cuts, cuts[1:], strict=False):
                    if j == i:
                        continue
                    if held is not None and groups[i] != group:
                        yield from whole(group, held)
                        held = None
                    group = groups[i]
                    held = t.slice(i, j - i) if held is None else pa.concat_tables([held, t.slice(i, j - i)])
                    while held.num_rows >= size:
                        yield from whole(group, held.slice(0, size))
                        held = held.slice(size).combine_chunks() if held.num_rows > size else None
                        if held is None:
                            break
            if held is not None:
                yield from whole(group, held)

        def whole(group, t):
            columns = {"group": [int(group)], "ids": [np.array(t.column("vec_id").to_pylist(), "<i8").tobytes()], "vecs": [b"".join(t.column("vec").to_pylist())], **extra(t)}
            yield pa.RecordBatch.from_arrays([pa.array(columns["group"], pa.int64()), *(pa.array(v, pa.binary()) for c, v in columns.items() if c != "group")], list(columns))

        return pack

    def leaf_of_each(t):
        return {"leaf": [np.array(t.column("leaf").to_pylist(), "<i8").tobytes()]}

    def leaves_of_each(t):
        lists = t.column("leaves").to_pylist()
        at, leaf = np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.array([x for own in lists for x in own], "<i8")
        order = np.argsort(leaf, kind="stable")
        return {"leaf": [leaf[order].tobytes()], "at": [at[order].astype("<i8").tobytes()]}

    def in_blocks(df, size, extra, schema):
        """Each group's rows in blocks. A group of many rows is spread over as many salts as it fills blocks."""
        counts = df.groupBy("group").agg(F.ceil(F.count("*") / size).alias("salts"))
        salted = df.join(counts, "group").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")))
        dealt = salted.repartition(parts, "group", "salt").sortWithinPartitions("group", "salt", *(["leaf"] if "leaf" in df.columns else []), "vec_id").drop("salts", "salt")
        return saved(dealt.mapInArrow(blocks(size, extra), schema))

    group = F.expr(f"leaf div {GROUP}").alias("group")
    rows_in = in_blocks(held.select("vec_id", "vec", "leaf", group), BLOCK, leaf_of_each, "group long, ids binary, vecs binary, leaf binary")
    asked_in = in_blocks(asked, QUERIES, leaves_of_each, "group long, ids binary, vecs binary, leaf binary, at binary")
    pairs = rows_in.join(asked_in.select("group", *[F.col(c).alias(f"q_{c}") for c in ("ids", "vecs", "leaf", "at")]), "group").repartition(parts)

    def search(batches):
        for b in batches:
            for row in b.to_pylist():
                ids, leaf, q_ids, q_leaf, q_at = (np.frombuffer(row[c], "<i8") for c in ("ids", "leaf", "q_ids", "q_leaf", "q_at"))
                v, q = (unit(np.frombuffer(row[c], width).reshape(-1, dim).astype(np.float64)) for c in ("vecs", "q_vecs"))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in nearest_in(q, q_ids, q_at, q_leaf, v, ids, leaf, k)], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(search, "query_id long, vec_id long, score double")
