import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from bytequarry.llm import components, ego_join, kmeans_tree, queries
from test_text_operators import components as by_hand


def hard_vectors(n=700, dim=8, seed=0):
    """Clusters of near copies, exact copies, scaled ones, and vectors that take no part."""
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, dim))
    near = base[rng.integers(0, len(base), n // 2)] + 0.12 * rng.normal(size=(n // 2, dim))
    rows = [*base, *near, *[base[0]] * 60, *(base[1:20] * 3)]
    out = [(i, [float(x) for x in r], 0) for i, r in enumerate(rows)]
    k = len(out)
    out += [(k, None, 0), (k + 1, [0.0] * dim, 0), (k + 2, [float("nan")] * dim, 0), (k + 3, [None] + [1.0] * (dim - 1), 0), (k + 4, [1.0] * 3, 0), (k + 5, [1.0] * 3, 0), (k + 6, [], 0), (k + 7, [1e-300] * dim, 0), (None, [1.0] * dim, 0), (0, out[0][1], 0), (k, None, 0)]
    return out


def usable(x):
    return x is not None and len(x) > 0 and all(c is not None and np.isfinite(c) for c in x) and any(x)


def cosine(a, b):
    a, b = (np.array(x) / max(map(abs, x)) for x in (a, b))
    return float(a @ b / np.sqrt((a @ a) * (b @ b)))


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(hard_vectors(), "vec_id long, embedding array<double>, label int")
    return df.withColumn("n", F.lit("clash")).withColumn("vec", F.lit(1)).repartition(3)


@pytest.mark.parametrize("sizes", [(2048, 256, 32), (64, 16, 32), (32, 16, 2)])
def test_near_vectors(table, monkeypatch, sizes):
    monkeypatch.setattr(ego_join, "BLOCK", sizes[0])
    monkeypatch.setattr(ego_join, "LEAF", sizes[1])
    monkeypatch.setattr(ego_join, "STRETCH", sizes[2])
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    part = [r for r in rows if r[0] is not None and usable(r[1])]
    link = lambda i, j: len(part[i][1]) == len(part[j][1]) and cosine(part[i][1], part[j][1]) >= 0.9
    label = by_hand([r[0] for r in part], link)
    links = [sum(link(i, j) for j in range(len(part)) if j != i) for i in range(len(part))]
    want = sorted([(i, n, c, i == c) for (i, _), n, c in zip(part, links, label, strict=True)] + [(i, 0, i, i is not None) for i, x in rows if i is None or not usable(x)], key=str)
    assert sorted((tuple(r) for r in ego_join.near_vectors(table, 0.9).collect()), key=str) == want
    assert ego_join.near_vectors(table.where("false")).count() == 0
    assert ego_join.near_vectors(table.where("embedding is null")).count() == 2


def test_ego_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = queries.op5_ego_join(spark, sf_dir).orderBy("vec_id").collect()
    assert [tuple(r) for r in got] == con.execute(queries.EGO_SQL + " ORDER BY vec_id").fetchall()


def exact(rows, query, k):
    own = [(i, cosine(x, rows[query])) for i, x in rows.items() if i != query and len(x) == len(rows[query])]
    return sorted(own, key=lambda r: (-r[1], r[0]))[:k]


def test_nearest_small(table):
    """A recall of 1 on so few rows that all are in the sample: every answer is exact."""
    rows = {r.vec_id: r.embedding for r in table.collect() if r.vec_id is not None and usable(r.embedding)}
    got = kmeans_tree.nearest(table, F.col("vec_id") % 50 == 0, recall=2.0).orderBy("query_id", "rank").collect()
    for q in [i for i in rows if i % 50 == 0]:
        mine = [(r.vec_id, r.score) for r in got if r.query_id == q]
        want = exact(rows, q, 5)
        assert np.allclose([s for _, s in mine], [s for _, s in want], rtol=0, atol=1e-12)
        assert [r.rank for r in got if r.query_id == q] == list(range(1, len(want) + 1))
    assert kmeans_tree.nearest(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0


@pytest.mark.parametrize("sample", [20_000, 300])
@pytest.mark.parametrize("source", ["clusters", "table"])
def test_recall(spark, source, sample):
    """With a sample of 300 the first tree's leaves are split by trees of their own."""
    if source == "table":
        df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    else:
        rng = np.random.default_rng(2)
        x = rng.normal(size=(40, 16))[rng.integers(0, 40, 4000)] + 0.4 * rng.normal(size=(4000, 16))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    df = df.cache()
    rows = df.orderBy("vec_id").collect()
    m = np.array([r.embedding for r in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = kmeans_tree.nearest(df, F.col("vec_id") % 50 == 0, sample=sample, leaf_rows=32 if sample > 300 else 8).collect()
    hit = n = 0
    for q in range(0, len(m), 50):
        s = m @ m[q]
        s[q] = -2
        want = set(np.argsort(-s, kind="stable")[:5].tolist())
        mine = {r.vec_id for r in got if r.query_id == q}
        assert len(mine) == 5
        hit, n = hit + len(want & mine), n + 5
    assert hit / n >= 0.9


@pytest.mark.parametrize("n", [500, 2000])
def test_tree_at_the_smallest_sizes(n):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 64))
    tree = kmeans_tree.Tree(x / np.linalg.norm(x, axis=1, keepdims=True), math.ceil(n / kmeans_tree.LEAF_ROWS))
    assert tree.n_leaves > 10


def test_tree_visits_all_leaves():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = kmeans_tree.Tree(x, 40)
    assert sorted(tree.visits(x[0], 10_000)) == list(range(tree.n_leaves)) and tree.n_leaves > 10
    assert tree.visits(x[5], 1)[0] == tree.file(x[5:6])[0]


@pytest.mark.parametrize("finish", [20_000, 5])
def test_connected_components(spark, monkeypatch, finish):
    monkeypatch.setattr(components, "FINISH", finish)
    rng = np.random.default_rng(5)
    links = [(i, i + 1) for i in range(500) if i % 11] + [(-7, i) for i in range(1000, 1300)] + [(int(a), int(b)) for a, b in rng.integers(2000, 2300, (200, 2))] + [(9, 9), (1, 2)]
    at = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        if a != b:
            at[find(a)] = find(b)
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(r.id for r in got) == sorted(at)
    pairs = {(r.root, find(r.id)) for r in got}
    assert len({a for a, _ in pairs}) == len({b for _, b in pairs}) == len(pairs)
