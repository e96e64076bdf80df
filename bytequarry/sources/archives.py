"""Work on whole containers: packing files with their blocks coded in parallel, and adding and removing in place."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..shared import saved, use_workers
from .container import BLOCK, SUFFIX, Container, ContainerWriter, block_size_of, checksum_of, coders, store_of


def _checksum(uri: str, kind: str) -> bytes:
    """Checksum of a file as text, read a MiB at a time."""
    store, path = store_of(uri)
    crc, digest = 0, None if kind == "CRC-32" else hashlib.new({"SHA-1": "sha1", "SHA-256": "sha256"}[kind])
    with store.open_input_stream(path) as source:
        while part := source.read(1 << 20):
            if digest:
                digest.update(part)
            else:
                crc = zlib.crc32(part, crc)
    return digest.hexdigest().encode() if digest else b"0x%08x" % crc


def _written(archive: str, writer: ContainerWriter) -> None:
    """The container appears whole or not at all."""
    store, path = store_of(archive)
    folder = path.rpartition("/")[0]
    store.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{uuid.uuid4().hex}{SUFFIX}.tmp"
    try:
        with store.open_output_stream(temporary) as out:
            writer.write(out)
        store.move(temporary, path)
    except BaseException:
        store.delete_file(temporary)
        raise


def pack(spark: SparkSession, files: Iterable[tuple[str, str]], archive: str, flags: int = 0, stages: str | None = None) -> None:
    """One container of files, given as (path in the container, URI that all executors can read).

    Blocks of all files are coded in parallel, wherever they lie; their coded forms are stored, and stream into the
    container in its order. The driver holds the files' records and a few blocks at a time.
    """
    use_workers(spark)
    size, kind = block_size_of(flags), checksum_of(flags)
    uris = dict(files)
    sizes = {p: store.get_file_info(at).size for p, (store, at) in ((p, store_of(u)) for p, u in uris.items())}
    if missing := [p for p, n in sizes.items() if n is None]:
        raise FileNotFoundError(f"no such file: {missing}")
    order = sorted(uris)
    table = spark.createDataFrame([(k, uris[p], sizes[p]) for k, p in enumerate(order)], "place long, uri string, size long")
    last = F.greatest(F.lit(0).cast("long"), F.ceil(F.col("size") / size) - 1)
    blocks = table.withColumn("block_id", F.explode(F.sequence(F.lit(0).cast("long"), last))).select("place", "uri", "block_id")
    n = sum(max(1, -(-x // size)) for x in sizes.values())

    def code(batches):
        chain = [c[0] for c in coders(flags, stages)]
        for b in batches:
            for place, uri, k in zip(*(b.column(c).to_pylist() for c in ("place", "uri", "block_id")), strict=True):
                store, path = store_of(uri)
                with store.open_input_file(path) as source:
                    source.seek(k * size)
                    block = source.read(size)
                for f in chain:
                    block = f(block)
                yield pa.RecordBatch.from_pydict({"place": [place], "block_id": [k], "coded": [block]}, schema)

    def sums(batches):
        for b in batches:
            for place, uri in zip(b.column("place").to_pylist(), b.column("uri").to_pylist(), strict=True):
                yield pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int64()), "sum": pa.array([_checksum(uri, kind)], pa.binary())})

    schema = pa.schema([("place", pa.int64()), ("block_id", pa.int64()), ("coded", pa.binary())])
    parts = min(n, 4 * spark.sparkContext.defaultParallelism) or 1
    coded = saved(blocks.repartition(parts).mapInArrow(code, "place long, block_id long, coded binary"))
    packed = {r["place"]: r["n"] for r in coded.groupBy("place").agg(F.sum(F.length("coded") + BLOCK.size).alias("n")).collect()}  # a row a file, as its record
    checks = {r["place"]: bytes(r["sum"]) for r in table.repartition(min(len(order), parts) or 1).mapInArrow(sums, "place long, sum binary").collect()} if kind else {}

    def data(k: int) -> Iterator[bytes]:
        for row in coded.where(F.col("place") == k).select("block_id", "coded").orderBy("block_id").toLocalIterator():
            yield BLOCK.pack(row["block_id"], len(row["coded"])) + bytes(row["coded"])
        yield checks.get(k, b"")

    writer = ContainerWriter(archive.rpartition("/")[2])
    for k, p in enumerate(order):
        writer.add_coded(p, flags, packed[k], sizes[p], lambda k=k: data(k))
    _written(archive, writer)


def edit(archive: str, add: dict[str, bytes] | None = None, remove: Iterable[str] = (), flags: int = 0, stages: str | None = None) -> None:
    """Adds files (path: content) to a container and removes files and folders with all in them, by path.

    What stays is copied as it is, block for block and without decoding; no gaps stay. Files are removed before others
    are added, so a file can be replaced. A path to remove that isn't there is an error, as is one to add that is.
    """
    store, path = store_of(archive)
    gone = {r.strip("/") for r in remove}

    def out(p: str) -> bool:
        parts = p.split("/")
        return any("/".join(parts[: k + 1]) in gone for k in range(len(parts)))

    with store.open_input_file(path) as source:
        old = Container(source)
        folders, files = [p.strip("/") for p, _, _ in old.folders()], list(old.files())
        if missing := gone - set(folders) - {f["path"] for f in files}:
            raise ValueError(f"not in the container: {sorted(missing)}")
        writer = ContainerWriter(old.name())
        for p in folders:
            if p and not out(p):
                writer.folder(p)
        for f in files:
            if not out(f["path"]):
                writer.add_coded(f["path"], f["flags"], f["compressed_size"], f["original_size"], lambda f=f: old.chunks(f))
        for p, content in (add or {}).items():
            writer.add(p, content, flags, stages)
        _written(archive, writer)
