"""Operator 10: token ids in binary files that can be read at any document.

A file is a row of independent Zstandard frames, each holding a fixed number of ids (little-endian unsigned 32-bit
integers) with Zstandard's own content checksum, then a skippable frame with the documents' ids and lengths, then the
seek table of the public Zstandard seekable format: per frame its compressed size, its plain size and the low 32 bits
of the XXH64 of its plain bytes. A reader opens the tail, finds a document's place and decompresses only the frames
that hold it.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import partitions_for, saved, shared_dir, texts_of, use_workers
from .pretokens import TextEncoder

# Fixed values of the public seekable format, and a skippable frame of our own for the documents.
SEEK_MAGIC, SEEK_FOOTER_MAGIC, DOCS_MAGIC = 0x184D2A5E, 0x8F92EAB1, 0x184D2A50
CHECKSUMS = 1 << 7
#: Ids in a frame (256 KiB of plain bytes).
FRAME_IDS = 65_536
NULL_ID = np.iinfo(np.int64).min


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system and path of a URI; file:, hdfs:, s3: and whatever else pyarrow opens."""
    if "://" not in uri and not uri.startswith("/"):
        scheme, _, path = uri.partition(":")
        uri = f"{scheme}://{path}" if path else uri
    return fs.FileSystem.from_uri(uri)


class TokenFileWriter:
    """Writes one file; documents come in ascending order. close() returns (documents, ids, bytes)."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = 1):
        self.out, self.size = out, 4 * frame_ids
        self.zip = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.held, self.n_held = [], 0
        self.frames, self.doc_ids, self.lengths, self.at = [], [], [], 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(NULL_ID if doc_id is None else doc_id)
        self.lengths.append(len(ids) // 4)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.size:
            plain = b"".join(self.held)
            full = len(plain) // self.size * self.size
            for i in range(0, full, self.size):
                self._frame(plain[i : i + self.size])
            self.held, self.n_held = [plain[full:]], len(plain) - full

    def _frame(self, plain: bytes) -> None:
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.at += len(packed)
        self.frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))

    def _skippable(self, magic: int, body: bytes) -> None:
        self.out.write(struct.pack("<II", magic, len(body)) + body)
        self.at += 8 + len(body)

    def close(self) -> tuple[int, int, int]:
        if self.n_held:
            self._frame(b"".join(self.held))
        table = np.array([self.doc_ids, self.lengths], dtype="<i8").reshape(2, -1)
        table[0] = np.diff(table[0], prepend=table[0][:1] * 0)  # ascending ids: small numbers; wraps round and back
        body = self.zip.compress(table.tobytes())
        self._skippable(DOCS_MAGIC, struct.pack("<QI", len(self.doc_ids), zlib.crc32(body)) + body)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self._skippable(SEEK_MAGIC, entries + struct.pack("<IBI", len(self.frames), CHECKSUMS, SEEK_FOOTER_MAGIC))
        return len(self.doc_ids), int(table[1].sum()), self.at


class TokenFile:
    """Reads one file; raises ValueError if a part is damaged."""

    def __init__(self, source):
        """source: a seekable binary file."""
        self.source = source
        size = source.seek(0, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or not flags & CHECKSUMS:
            raise ValueError("no seek table")
        seek = size - 9 - 12 * n - 8
        kind, length = struct.unpack("<II", self._at(seek, 8))
        if kind != SEEK_MAGIC or length != 12 * n + 9:
            raise ValueError("damaged seek table")
        entries = np.frombuffer(self._at(seek + 8, 12 * n), "<u4").reshape(-1, 3)
        self.packed, self.plain, self.sums = entries[:, 0].astype(np.int64), entries[:, 1].astype(np.int64), entries[:, 2]
        self.offsets = np.concatenate([[0], np.cumsum(self.packed)])
        self.starts = np.concatenate([[0], np.cumsum(self.plain)])
        docs = int(self.offsets[-1])
        kind, length = struct.unpack("<II", self._at(docs, 8))
        count, crc = struct.unpack("<QI", self._at(docs + 8, 12))
        body = self._at(docs + 20, length - 12)
        if kind != DOCS_MAGIC or zlib.crc32(body) != crc:
            raise ValueError("damaged table of documents")
        table = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), "<i8").reshape(2, count)
        self.doc_ids, self.lengths = np.cumsum(table[0]), table[1]
        self.ends = np.cumsum(self.lengths)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def frame(self, k: int) -> bytes:
        plain = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(self.packed[k])))
        if len(plain) != self.plain[k] or xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} is damaged")
        return plain

    def ids(self, i: int) -> np.ndarray:
        """The ids of the i-th document; only the frames that hold them are decompressed."""
        lo, hi = 4 * int(self.ends[i] - self.lengths[i]), 4 * int(self.ends[i])
        if lo == hi:
            return np.empty(0, "<u4")
        a, b = (int(np.searchsorted(self.starts, x, "right")) - 1 for x in (lo, hi - 1))
        plain = b"".join(self.frame(k) for k in range(a, b + 1))
        base = int(self.starts[a])
        return np.frombuffer(plain[lo - base : hi - base], "<u4")

    def find(self, doc_id: int) -> list[int]:
        """Places of the documents of this id."""
        return list(range(*(int(np.searchsorted(self.doc_ids, doc_id, side)) for side in ("left", "right"))))

    def all_ids(self):
        """(doc_id or None, ids as bytes) of every document in order, holding a frame and a document at a time."""
        held, k = b"", 0
        for d, n in zip(self.doc_ids.tolist(), self.lengths.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < 4 * n:
                parts.append(self.frame(k))
                have += len(parts[-1])
                k += 1
            plain = b"".join(parts) if len(parts) > 1 else held
            yield None if d == NULL_ID else d, plain[: 4 * n]
            held = plain[4 * n :]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, text: str = "text", doc_id: str = "doc_id", end_id: int | None = 0, frame_ids: int = FRAME_IDS, files: int | None = None) -> DataFrame:
    """Encode every whole text and write its ids, in ascending doc_id order over the files part-00000, part-00001 and so on.

    Returns the manifest (part, file, n_docs, n_ids, n_bytes, start), already stored; start counts the ids of all files
    before it. docs: any table with an id and a text. Null text counts as empty (only the end id). Null ids come first;
    rows of one id follow each other by text. An empty table gives files of no documents or none.
    path: a folder URI that every executor can write to. A task writes under a name of its own and renames at the end,
    and a repeated task writes the same bytes, so lost executors do no harm.
    """
    spark = docs.sparkSession
    use_workers(spark)
    store, root = store_of(path)
    store.create_dir(root, recursive=True)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    rows = rows.repartitionByRange(files or partitions_for(spark), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches):
        part = TaskContext.get().partitionId()
        store, root = store_of(path)
        name, own = f"{root}/part-{part:05d}.ids.zst", f"{root}/.{uuid.uuid4().hex}"
        encode, end = TextEncoder.at(tokenizer).encode, b"" if end_id is None else struct.pack("<I", end_id)
        with store.open_output_stream(own) as out:
            file = TokenFileWriter(out, frame_ids)
            for batch in batches:
                for d, x in zip(batch.column("doc_id").to_pylist(), texts_of(batch), strict=True):
                    file.add(d, encode(x) + end)
            n_docs, n_ids, n_bytes = file.close()
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "file": [name.rpartition("/")[2]], "n_docs": [n_docs], "n_ids": [n_ids], "n_bytes": [n_bytes]})

    made = saved(rows.mapInArrow(write, "part int, file string, n_docs long, n_ids long, n_bytes long"))
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row for each file
    return made.withColumn("start", F.coalesce(before, F.lit(0)).cast("long"))


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read back from the files with all checksums checked."""
    use_workers(spark)
    kinds = {"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if with_ids else {})
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                store, root = store_of(path)
                at, out = row["start"], []
                with store.open_input_file(f"{root}/{row['file']}") as source:
                    for d, ids in TokenFile(source).all_ids():
                        n = len(ids) // 4
                        out.append((d, at, n, zlib.crc32(ids), ids)[: len(kinds)])
                        at += n
                        if len(out) >= (64 if with_ids else 20_000):
                            yield table(out)
                            out = []
                if out:
                    yield table(out)

    def table(out):
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds.values(), strict=True)], list(kinds))

    files = max(1, manifest.count())
    return manifest.where("n_docs > 0").select("file", "start").repartition(files).mapInArrow(read, schema)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, **options) -> DataFrame:
    """Write the files (to a new folder in the shared folder, if no path is given) and read them back."""
    spark = docs.sparkSession
    path = path or f"{shared_dir(spark)}/ids-{uuid.uuid4().hex}"
    return read_token_files(spark, path, write_token_files(docs, tokenizer, path, **options))


def fetch(path: str, manifest_rows: list[dict], doc_id: int) -> list[np.ndarray]:
    """The ids of one document, from the files that may hold it; no other frame is decompressed."""
    store, root = store_of(path)
    found = []
    for row in manifest_rows:
        if row["n_docs"]:
            with store.open_input_file(f"{root}/{row['file']}") as source:
                file = TokenFile(source)
                found += [file.ids(i) for i in file.find(doc_id)]
    return found
