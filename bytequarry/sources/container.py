"""The container format: one file that holds a tree of folders and files with coded blocks, as a Spark data source.

Layout (little-endian): one zero byte, so that offset 0 means none; the root folder's record at offset 1.
Folder: name length u8, name, parent u64, first subfolder u64, next sibling u64, first file u64.
File: name length u8, name, parent u64, next sibling u64, flags u16, data location u64, coded size u64, original size u64;
then its data: for each block part u32, size u32, payload; then its checksum as text (SHA-1 40, CRC-32 10, SHA-256 64).
The coded size counts block headers and payloads. Folders are written each with its siblings, then its files, then its
subfolders.

spark.read.format("bytecontainer").load(folder) gives a row for each file; the option decode=false leaves contents out
and reads records only; the option stages names an order of stages of one's own, for writing and reading. df.write.format("bytecontainer").save(folder) takes (path, content[, flags]) and writes one
container for each task. A container stays whole or absent: tasks write under other names, and only the commit renames.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from operator import or_

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..functions.scalars import CHECKSUM_BITS, LARGEST_BLOCK

FOLDER, FILE = struct.Struct("<QQQQ"), struct.Struct("<QQHQQQ")
BLOCK = struct.Struct("<II")
CHECKSUM_SIZES = {"SHA-256": 64, "CRC-32": 10, "SHA-1": 40}
SUFFIX = ".arc"


def store_of(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("/"):
        scheme, _, path = uri.partition(":")
        uri = f"{scheme}://{path}"
    return fs.FileSystem.from_uri(uri)


def checksum_of(flags: int) -> str | None:
    kinds = [k for k, bit in CHECKSUM_BITS.items() if flags >> bit & 1]
    if len(kinds) > 1:
        raise ValueError("only one kind of checksum can be set")
    return kinds[0] if kinds else None


def checksum(content: bytes, kind: str) -> bytes:
    if kind == "CRC-32":
        return b"0x%08x" % zlib.crc32(content)
    return hashlib.new({"SHA-1": "sha1", "SHA-256": "sha256"}[kind], content).hexdigest().encode()


def block_size_of(flags: int) -> int:
    return LARGEST_BLOCK >> (flags >> 9 & 15)


def coders(flags: int, stages: str | None = None) -> list[tuple]:
    """(encode, decode) of the stages that the flags name in their order, or of names between plus signs in theirs."""
    from ..operators.codecs import STAGES, stages_of

    return [STAGES[s] for s in stages_of(stages if stages else flags & 0xFF)]


def coded_blocks(content: bytes, flags: int, stages: str | None = None) -> bytes:
    """A file's data: its blocks, each through its stages."""
    size = block_size_of(flags)
    chain, out = [c[0] for c in coders(flags, stages)], []
    for k in range(max(1, -(-len(content) // size))):
        block = content[k * size : (k + 1) * size]
        for f in chain:
            block = f(block)
        out += [BLOCK.pack(k, len(block)), block]
    return b"".join(out)


def decoded(data: bytes, flags: int, stages: str | None = None) -> bytes:
    chain, at, out = [c[1] for c in reversed(coders(flags, stages))], 0, []
    while at < len(data):
        _, n = BLOCK.unpack_from(data, at)
        block = data[at + BLOCK.size : at + BLOCK.size + n]
        for f in chain:
            block = f(block)
        out.append(block)
        at += BLOCK.size + n
    return b"".join(out)


class ContainerWriter:
    """Takes files by path and writes one container. Only sizes are needed before it is written; data can come from
    elsewhere while it is."""

    def __init__(self, name: str):
        self.root = {"name": name, "folders": {}, "files": {}}

    def folder(self, path: str) -> dict:
        """The folder of this path, made with those above it where it isn't there."""
        node = self.root
        for f in filter(None, path.split("/")):
            node = node["folders"].setdefault(f, {"name": f, "folders": {}, "files": {}})
        return node

    def add(self, path: str, content: bytes, flags: int, stages: str | None = None) -> None:
        kind = checksum_of(flags)
        data = coded_blocks(content, flags, stages) + (checksum(content, kind) if kind else b"")
        self.add_coded(path, flags, len(data) - (CHECKSUM_SIZES[kind] if kind else 0), len(content), lambda: [data])

    def add_coded(self, path: str, flags: int, coded_size: int, size: int, chunks: Callable[[], Iterable[bytes]]) -> None:
        """A file whose data (blocks, then checksum) chunks() gives when its turn comes."""
        above, _, name = path.rpartition("/")
        node, kind = self.folder(above), checksum_of(flags)
        if name in node["files"]:
            raise ValueError(f"two files of one path: {path}")
        node["files"][name] = (flags, coded_size, size, CHECKSUM_SIZES[kind] if kind else 0, chunks)

    @staticmethod
    def _name(name: str) -> bytes:
        raw = name.encode()
        if len(raw) > 255:
            raise ValueError(f"a name has 255 bytes at most: {name[:40]}...")
        return bytes([len(raw)]) + raw

    def write(self, out) -> None:
        """Two passes: places of all records first, then records and data in the same order."""
        todo, order, at = [("folder", self.root, 0)], [], 1
        place, siblings = {}, {}
        while todo:  # the last in is the first out: siblings, then files, then subfolders
            what, node, parent = todo.pop()
            if what == "folder":
                place[id(node)] = at
                order.append((what, node, parent))
                at += len(self._name(node["name"])) + FOLDER.size
                subs = list(node["folders"].values())
                siblings |= {id(a): b for a, b in zip(subs, subs[1:], strict=False)}
                if subs:
                    todo.append(("folder", subs[0], id(node)))
                todo.append(("files", node, id(node)))
                if id(node) in siblings:
                    todo.append(("folder", siblings[id(node)], parent))
            else:
                order.append((what, node, parent))
                for name, f in node["files"].items():
                    place[id(node), name] = at
                    at += len(self._name(name)) + FILE.size + f[1] + f[3]
        out.write(b"\0")
        for what, node, parent in order:
            if what == "folder":
                subs, names = list(node["folders"].values()), list(node["files"])
                out.write(self._name(node["name"]) + FOLDER.pack(place.get(parent, 0), place[id(subs[0])] if subs else 0, place[id(siblings[id(node)])] if id(node) in siblings else 0, place[id(node), names[0]] if names else 0))
                continue
            names = list(node["files"])
            for k, name in enumerate(names):
                flags, coded, size, n_check, chunks = node["files"][name]
                own = self._name(name)
                after = place[id(node), names[k + 1]] if k + 1 < len(names) else 0
                out.write(own + FILE.pack(place[id(node)], after, flags, place[id(node), name] + len(own) + FILE.size, coded, size))
                left = coded + n_check
                for chunk in chunks():
                    out.write(chunk)
                    left -= len(chunk)
                if left:
                    raise ValueError(f"{name} has other data than its record tells")


class Container:
    """Reads one container from a seekable file; records only, until a file's content is asked for."""

    def __init__(self, source):
        self.source = source

    def _name(self, at: int) -> tuple[str, int]:
        self.source.seek(at)
        n = self.source.read(1)[0]
        return self.source.read(n).decode(), at + 1 + n

    def folders(self) -> Iterator[tuple[str, str, int]]:
        """(path of the folder, its name, offset of its first file); the root's path is empty."""
        todo = [(1, "")]
        while todo:
            at, above = todo.pop()
            name, after = self._name(at)
            _, child, sibling, first = FOLDER.unpack(self.source.read(FOLDER.size))
            path = "" if at == 1 else f"{above}{name}/"
            yield path, name, first
            if sibling:
                todo.append((sibling, above))
            if child:
                todo.append((child, path))

    def files(self) -> Iterator[dict]:
        for path, _, at in self.folders():
            while at:
                name, after = self._name(at)
                _, sibling, flags, where, coded, size = FILE.unpack(self.source.read(FILE.size))
                yield {"path": path + name, "flags": flags, "data_location": where, "compressed_size": coded, "original_size": size}
                at = sibling

    def name(self) -> str:
        """The root folder's name."""
        return self._name(1)[0]

    def chunks(self, file: dict) -> Iterator[bytes]:
        """A file's data as they stand, blocks and checksum, a MiB at a time."""
        kind = checksum_of(file["flags"])
        at, left = file["data_location"], file["compressed_size"] + (CHECKSUM_SIZES[kind] if kind else 0)
        while left:
            self.source.seek(at)
            part = self.source.read(min(left, 1 << 20))
            if not part:
                raise ValueError(f"{file['path']} is cut short")
            yield part
            at, left = at + len(part), left - len(part)

    def content(self, file: dict, verify: bool = True, stages: str | None = None) -> tuple[bytes, str]:
        """(bytes, checksum) of a file; raises ValueError if they don't agree and verify is set."""
        self.source.seek(file["data_location"])
        data = self.source.read(file["compressed_size"])
        kind = checksum_of(file["flags"])
        check = self.source.read(CHECKSUM_SIZES[kind]).decode() if kind else ""
        content = decoded(data, file["flags"], stages)
        if verify and (len(content) != file["original_size"] or kind and checksum(content, kind).decode() != check):
            raise ValueError(f"{file['path']} is damaged")
        return content, check


class _One(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.options = options["path"], options

    def partitions(self):
        store, root = store_of(self.root)
        info = store.get_file_info(root)
        if info.type == fs.FileType.File:
            return [_One(root)]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [_One(f.path) for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and f.path.endswith(SUFFIX)] or [_One("")]

    def read(self, partition):
        if not partition.path:
            return
        store, _ = store_of(self.root)
        whole = self.options.get("decode", "true").lower() != "false"
        verify = self.options.get("verify", "true").lower() != "false"
        with store.open_input_file(partition.path) as source:
            container = Container(source)
            for f in list(container.files()):
                content, check = container.content(f, verify, self.options.get("stages")) if whole else (None, None)
                yield partition.path.rpartition("/")[2], f["path"], f["flags"], f["data_location"], f["compressed_size"], f["original_size"], check, content


class _Done(WriterCommitMessage):
    def __init__(self, name: str):
        self.name = name


class _Writer(DataSourceWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.root, self.flags, self.overwrite = options["path"], int(options.get("flags", "0")), overwrite
        self.columns, self.stages = schema.fieldNames(), options.get("stages")
        if not {"path", "content"} <= set(self.columns):
            raise ValueError("columns path and content are needed")

    def write(self, rows):
        writer, n = ContainerWriter("root" + SUFFIX), 0
        for row in rows:
            flags = row["flags"] if "flags" in self.columns and row["flags"] is not None else self.flags
            writer.add(row["path"], bytes(row["content"] or b""), flags, self.stages)
            n += 1
        if not n:
            return _Done("")
        store, root = store_of(self.root)
        store.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}{SUFFIX}"
        with store.open_output_stream(f"{root}/.{name}.tmp") as out:
            writer.write(out)
        return _Done(name)

    def commit(self, messages):
        store, root = store_of(self.root)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(root)):
                if f.path.endswith(SUFFIX):
                    store.delete_file(f.path)
        for m in messages:
            if m is not None and m.name:
                store.move(f"{root}/.{m.name}.tmp", f"{root}/{m.name}")

    def abort(self, messages):
        store, root = store_of(self.root)
        for m in messages:
            if m is not None and m.name:
                store.delete_file(f"{root}/.{m.name}.tmp")


class ContainerSource(DataSource):
    @classmethod
    def name(cls):
        return "bytecontainer"

    def schema(self):
        return "archive string, path string, flags int, data_location long, compressed_size long, original_size long, checksum string, content binary"

    def reader(self, schema):
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite):
        return _Writer(dict(self.options), schema, overwrite)


def register(spark: SparkSession) -> None:
    from ..shared import use_workers

    use_workers(spark)
    spark.dataSource.register(ContainerSource)


def empty_container(path: str, name: str = "new" + SUFFIX) -> str:
    """An empty container of this name in a folder; the extension is added where there is none."""
    name = name if "." in name else name + SUFFIX
    store, root = store_of(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/{name}") as out:
        ContainerWriter(name).write(out)
    return f"{path.rstrip('/')}/{name}"


def unpack(df, target: str, stem: bool = False, chosen: tuple[str, ...] = (), flat: bool = False) -> None:
    """Write the files of (path, content) rows below a folder that all executors share.

    chosen: only these files and what lies in these folders. flat: all go to the folder itself, under their last names
    (two of one name are an error). stem: below a folder named as the container (column archive) less its extension.
    """
    if chosen:
        own = [F.col("path").isin(list(chosen)), *(F.col("path").startswith(c.rstrip("/") + "/") for c in chosen)]
        df = df.where(reduce(or_, own))
    path = F.regexp_extract("path", "([^/]*)$", 1) if flat else F.col("path")
    if stem:
        path = F.concat(F.regexp_replace("archive", "(?<=.)\\.[^.]*$", ""), F.lit("/"), path)
    df = df.select(path.alias("path"), "content")
    if flat and (twice := df.groupBy("path").count().where("count > 1").first()):
        raise ValueError(f"two files of one name: {twice['path']}")

    def save(rows):
        store, root = store_of(target)
        for row in rows:
            if not set(row["path"].split("/")).isdisjoint(("", ".", "..")):
                raise ValueError(f"a path that leads elsewhere: {row['path']}")
            path = f"{root}/{row['path']}"
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(path) as out:
                out.write(bytes(row["content"] or b""))

    df.foreachPartition(save)
