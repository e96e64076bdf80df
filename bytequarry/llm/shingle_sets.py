"""Near-duplicates by the Jaccard similarity of texts' sets of word shingles, checked exactly.

Candidates come from MinHash: each set has BANDS keys of ROWS minima each, and sets with a common key are candidates. A
pair of similarity J has none with probability (1 - J^ROWS)^BANDS, at 0.8 some 3e-8. Candidates' connected components
hold all links, so each text goes once to its component (large ones are dealt out by pairs of blocks), where sets are
made again and compared in full. Equal sets take part once; no table holds the sets, which are larger than the texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom_lm import mixed
from .common import free_heaps, kept, saved, sent, spread, use_workers, words
from .components import as_links, connected_components, forest

#: Sets of a similarity of 0.5 have a common key with probability 0.75, of 0.35 with 0.2: candidates' groups stay near those of links.
BANDS, ROWS = 44, 5
#: Sets of a component that one task compares with each other; components with more are dealt out by pairs of blocks.
BLOCK = 512
#: Texts, and shingles but for a longer text, whose minima are taken at a time.
TEXTS, STRETCH = 500, 200_000


def shingle_set(text: bytes | None, width: int) -> np.ndarray:
    """Hashes of the text's distinct word shingles, in order; a text of fewer words has one, without words none."""
    w = words(text)
    rows = zip(*(w[k:] for k in range(width)), strict=False) if len(w) >= width else [w] if w else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.array([digest(join(x)) for x in rows], np.uint64))


def digest_of(s: np.ndarray) -> int:
    """Stands for the set; a signed 64-bit value."""
    return int(np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS keys for each set; no set may be empty."""
    h = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    keys = np.zeros((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sets), band, np.uint64)
        for k in range(ROWS):
            seed = mixed(np.array([band * ROWS + k + 1], np.uint64))
            key = mixed(key + np.minimum.reduceat(mixed(h ^ seed), starts))
        keys[:, band] = key
    return keys


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, digest, keys) of each text with words."""

    def made(batches):
        kept("sketches", make=list)  # lets go of what other operators keep
        for b in batches:
            ids, sets, n = [], [], 0
            for i, x in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                if len(s := shingle_set(x, width)):
                    ids.append(i)
                    sets.append(s)
                    n += len(s)
                if n >= STRETCH or len(ids) >= TEXTS:
                    yield batch(ids, sets)
                    ids, sets, n = [], [], 0
            if ids:
                yield batch(ids, sets)

    def batch(ids, sets):
        keys = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * BANDS, pa.int32()), pa.array(band_keys(sets).view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(list(map(digest_of, sets)), pa.int64()), keys], ["doc_id", "digest", "keys"])

    return spread(docs).mapInArrow(made, "doc_id long, digest long, keys array<long>")


def _chains(batches):
    """Links between neighbours of equal key (rows stand together)."""
    key, node = np.empty(0, np.int64), np.empty(0, np.int64)
    for b in batches:
        key = np.concatenate([key[-1:], b.column("key").to_numpy()])
        node = np.concatenate([node[-1:], b.column("digest").to_numpy()])
        same = key[1:] == key[:-1]
        if same.any():
            yield as_links(*forest(node[:-1][same], node[1:][same]))


def similar_links(sets: list[np.ndarray], least: float) -> tuple[list[int], list[int]]:
    """Links of sets at least so similar, by place: as many as join all that such links join."""
    sizes = np.array([len(s) for s in sets])
    units, at = np.unique(np.concatenate(sets), return_inverse=True)
    starts, found = np.cumsum(sizes) - sizes, np.zeros(len(units), bool)
    left, a, b = np.arange(1, len(sets)), [], []
    todo = [0]
    while len(left):
        if not todo:
            todo, left = [int(left[0])], left[1:]
            continue
        p = todo.pop()
        own = at[starts[p] : starts[p] + sizes[p]]
        found[own] = True
        common = np.add.reduceat(found[at], starts, dtype=np.int64)[left]
        found[own] = False
        near = common / (sizes[left] + sizes[p] - common) >= least
        hit = left[near].tolist()
        a += [p] * len(hit)
        b += hit
        todo += hit
        left = left[~near]
    return a, b


def _compare(width: int, least: float):
    def run(batches):
        now, nodes, sets = None, [], []

        def links():
            a, b = similar_links(sets, least)
            node = np.array(nodes, np.int64)
            return as_links(node[a], node[b])

        for batch in batches:
            for root, i, j, node, x in zip(*(batch.column(c).to_pylist() for c in ("root", "i", "j", "digest", "text")), strict=True):
                if now != (root, i, j):
                    if len(sets) > 1:
                        yield links()
                    now, nodes, sets = (root, i, j), [], []
                if digest_of(s := shingle_set(x, width)) == node:  # else another text of the same id
                    nodes.append(node)
                    sets.append(s)
        if len(sets) > 1:
            yield links()

    return run


def jaccard_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5, least: float = 0.8, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of each text with words; component_id is the smallest doc_id reachable over links between
    texts whose sets of shingles of width words have a Jaccard similarity of at least `least` (0.8 or more).

    docs: any table with an id, not null, and a text.
    """
    if least < 0.8:
        raise ValueError("these keys find similarities of 0.8 and more")
    use_workers(docs.sparkSession)
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))
    rows = saved(sketches(docs, width))
    distinct = saved(rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")))
    keyed = distinct.select("digest", F.explode("keys").alias("key")).repartition("key").sortWithinPartitions("key")
    near = connected_components(keyed.mapInArrow(_chains, "a long, b long")).withColumnRenamed("id", "digest")
    near = saved(near.join(distinct.select("digest", "doc_id"), "digest"))
    free_heaps(docs.sparkSession)
    full = near.groupBy("root").count().where(F.col("count") > block).select("root", F.ceil(F.col("count") / block).cast("int").alias("s"))
    dealt = near.join(full, "root", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("digest"), F.col("s")).cast("int"))
    texts = docs.join(sent(saved(dealt.select("doc_id", "root", "digest", "s", "block"))), "doc_id").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    cells = texts.select("root", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "digest", "text")
    cells = cells.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j")
    joined = connected_components(cells.mapInArrow(_compare(width, least), "a long, b long")).withColumnRenamed("id", "digest")
    labels = distinct.select("digest", F.col("doc_id").alias("least")).join(joined, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    named = labels.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "digest").join(labels.join(named, "root").select("digest", "component_id"), "digest").select("doc_id", "component_id")
