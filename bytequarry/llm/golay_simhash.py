"""Operator 9: SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints of 64 bits link at three or fewer differing bits. Four stretches of 16 bits: at most three of them hold
an error, so one is equal in both fingerprints. With stretch i as it is goes a segment of 23 bits, the next stretch and
7 bits of the one after it; for one i with an equal stretch, that segment holds at most two errors (three in it would
leave another i: if all are in one stretch, the equal stretches on its far side see none of them; if they are in two,
the stretch before the equal one sees at most two). Of the perfect binary Golay code of length 23, each segment takes
the indices of the codewords nearest to it and to its 23 neighbours, one to six of them; segments at distance two or
less have a common neighbour, and so a common index. Rows with the same stretch and index are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_heaps, kept, saved, spread, use_workers, words
from .components import as_links, connected_components, forest
from .shingle_sets import jaccard_components

MAX_BITS = 3
#: Generator of the code, x^11+x^9+x^7+x^6+x^5+x+1 (a fixed value).
GENERATOR = 0b101011100011
#: Rows of a key that one task compares with each other; keys with more are dealt out by pairs of blocks of about so many.
BLOCK = 2048
#: Shingles hashed at a time.
STRETCH = 200_000


def _lanes() -> np.ndarray:
    """For each byte its bits, the highest first, as the eight bytes of one number: adding those counts eight bits at once."""
    return np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(np.uint64)[:, 0]


LANES = _lanes()


def bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the 64-bit values (big-endian) have each bit, the highest first."""
    lanes = LANES[h.view(np.uint8).reshape(-1, 8)]
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0)  # 255 at a time, as much as a byte holds
    return sums.view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)


def fingerprint(text: bytes | None, shingle_words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over the text's word shingles, repeats included; 0 without words."""
    w = words(text)
    if not w:
        return 0
    n = max(1, len(w) - shingle_words + 1)
    ones = np.zeros(64, np.int64)
    digest, join = xxhash.xxh64_intdigest, b" ".join
    for i in range(0, n, STRETCH):
        part = w[i : i + STRETCH + shingle_words - 1]
        rows = zip(*(part[k:] for k in range(shingle_words)), strict=False) if len(w) >= shingle_words else [w]
        h = np.array([digest(join(x), seed) for x in rows], dtype=">u8")
        ones += bit_counts(h)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp) of each row; fp holds the 64 bits as a signed long."""
    use_workers(docs.sparkSession)

    def made(batches):
        kept("fingerprints", make=list)  # lets go of what other operators keep
        for b in batches:
            fp = [fingerprint(x, shingle_words) for x in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(fp, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").cast("binary").alias("text"))).mapInArrow(made, "doc_id long, fp long")


class Golay:
    """Indices of the codewords near 23-bit vectors."""

    _one: Golay | None = None

    def __init__(self):
        def remainder(v: np.ndarray) -> np.ndarray:
            v = v.copy()
            for k in range(22, 10, -1):
                v ^= np.where(v >> k & 1, GENERATOR << (k - 11), 0)
            return v

        low, mid, high = (remainder(np.arange(n, dtype=np.int64) << s) for n, s in ((256, 0), (256, 8), (128, 16)))
        self.parts = low, mid, high
        one = 1 << np.arange(23, dtype=np.int64)
        two = np.array([one[i] | one[j] for i in range(23) for j in range(i)])
        three = np.array([one[i] | one[j] | one[k] for i in range(23) for j in range(i) for k in range(j)])
        errors = np.concatenate([[0], one, two, three])
        self.error = np.zeros(2048, np.int64)
        self.error[self.syndrome(errors)] = errors
        self.flips = np.concatenate([[0], one])

    @classmethod
    def one(cls) -> Golay:
        cls._one = cls._one or cls()
        return cls._one

    def syndrome(self, v: np.ndarray) -> np.ndarray:
        low, mid, high = self.parts
        return low[v & 255] ^ mid[v >> 8 & 255] ^ high[v >> 16]

    def nearest(self, v: np.ndarray) -> np.ndarray:
        """Index (12 bits) of the one codeword within distance 3."""
        return (v ^ self.error[self.syndrome(v)]) >> 11

    def indices(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, index): for each vector the codewords nearest to it and its neighbours, each once."""
        near = np.sort(self.nearest(v[:, None] ^ self.flips), axis=1)
        first = np.concatenate([np.ones((len(v), 1), bool), near[:, 1:] != near[:, :-1]], axis=1)
        row, k = np.nonzero(first)
        return row, near[row, k]


def keys_of(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of each fingerprint's keys: which stretch, its 16 bits, an index of 12 bits."""
    u, code = fp.view(np.uint64), Golay.one()
    part = [(u >> np.uint64(48 - 16 * k) & np.uint64(0xFFFF)).astype(np.int64) for k in range(4)]
    rows, keys = [], []
    for k in range(4):
        row, index = code.indices(part[(k + 1) % 4] << 7 | part[(k + 2) % 4] >> 9)
        rows.append(row)
        keys.append(k << 28 | part[k][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches):
    for b in batches:
        fp = b.column("fp").to_numpy()
        for i in range(0, len(fp), 20_000):
            row, key = keys_of(fp[i : i + 20_000])
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp[i : i + 20_000][row], pa.int64())], ["key", "fp"])


def close_pairs(cell: np.ndarray, fp: np.ndarray, block: np.ndarray, across: np.ndarray, max_bits: int):
    """Yields arrays of linked fingerprints among rows of equal cell (rows stand together); across: only of different blocks."""
    u = fp.view(np.uint64)
    end = np.append(np.flatnonzero(cell[1:] != cell[:-1]) + 1, len(cell))
    end = np.repeat(end, np.diff(np.concatenate([[0], end])))
    at, d = np.arange(len(cell)), 1
    while len(at := at[at + d < end[at]]):
        ok = np.bitwise_count(u[at] ^ u[at + d]) <= max_bits
        ok &= ~across[at] | (block[at] != block[at + d])
        if ok.any():
            yield fp[at[ok]], fp[at[ok] + d]
        d += 1


def _compare(max_bits: int):
    def forest_of(parts):
        cell, fp, block, across = (np.concatenate(x) for x in zip(*parts, strict=True))
        a, b, n = [], [], 0
        for x, y in close_pairs(cell, fp, block, across, max_bits):
            a.append(x)
            b.append(y)
            n += len(x)
            if n > 2_000_000:
                x, y = forest(np.concatenate(a), np.concatenate(b))
                a, b, n = [x], [y], len(x)
        if a:
            yield as_links(*forest(np.concatenate(a), np.concatenate(b)))

    def run(batches):
        held = []
        for batch in batches:
            key, i, j, block, fp = (batch.column(c).to_numpy() for c in ("key", "i", "j", "block", "fp"))
            cell = (key << 32) | (i.astype(np.int64) << 16) | j
            if not len(cell):
                continue
            last = np.flatnonzero(cell != cell[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            new = (cell, fp, block, i != j)
            if cut:
                yield from forest_of([*held, tuple(x[:cut] for x in new)])
                held = [tuple(x[cut:] for x in new)]
            else:
                held.append(new)  # the same cell may go on in the next batch
        if held:
            yield from forest_of(held)

    return run


def linked(distinct: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(a, b): links that join all fingerprints (distinct values in column fp) which links of max_bits or fewer bits join.

    Pairs inside a cell are reduced to a spanning forest before they leave a task, so no group is ever spelt out in pairs.
    """
    if max_bits > MAX_BITS:
        raise ValueError("these keys find up to three differing bits")
    use_workers(distinct.sparkSession)
    keyed = distinct.mapInArrow(_keyed, "key long, fp long")
    full = saved(keyed.groupBy("key").count().where(F.col("count") > block))  # at most rows/block keys
    blocks = full.select("key", F.ceil(F.col("count") / block).cast("int").alias("s"))
    dealt = keyed.join(blocks, "key", "left").withColumn("s", F.coalesce("s", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("fp"), F.col("s")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    cells = dealt.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "fp")
    cells = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return cells.mapInArrow(_compare(max_bits), "a long, b long")


def _labels(rows: DataFrame, max_bits: int, block: int) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints in rows (doc_id, fp)."""
    distinct = saved(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(linked(distinct.select("fp"), max_bits, block)).withColumnRenamed("id", "fp")
    roots = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return roots.join(named, "root").select("fp", "component_id")


def simhash_components(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle_words: int = 3, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row; component_id is the smallest doc_id reachable through links.

    docs: any table with an id and a text. A text without words (null too) has fingerprint zero and links like any
    other. A row without id gets the component of its fingerprint, null if no row of it has an id. Repeated rows give
    repeated results; an empty table an empty result. Only distinct fingerprints are compared, so exact copies cost nothing.
    """
    rows = saved(fingerprints(docs, text, doc_id, shingle_words))
    labels = _labels(rows, max_bits, block)
    return rows.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def near_duplicates(docs: DataFrame, widths: tuple[int, ...] = (3, 5), text: str = "text", doc_id: str = "doc_id", max_bits: int = MAX_BITS, block: int = BLOCK, set_words: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, component_id), a row for each doc_id that has a smaller one reachable through links; rows without id take
    no part.

    Two documents link if their sets of shingles of set_words words have a Jaccard similarity of at least `least`, or if
    their fingerprints over shingles of any of the widths differ in max_bits bits or fewer.
    """
    docs = docs.where(F.col(doc_id).isNotNull())
    links = jaccard_components(docs, text, doc_id, set_words, least).where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    for width in widths:
        free_heaps(docs.sparkSession)
        rows = saved(fingerprints(docs, text, doc_id, width))
        own = rows.join(_labels(rows, max_bits, block), "fp").where("doc_id <> component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
        links = links.union(own)
    free_heaps(docs.sparkSession)
    roots = saved(connected_components(links))
    named = roots.groupBy("root").agg(F.min("id").alias("component_id"))
    return roots.join(named, "root").where("id <> component_id").select(F.col("id").alias("doc_id"), "component_id")
