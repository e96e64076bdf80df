"""The registered queries: each operator over whole test tables. The tables stand for the archive's model like this.

files: documents (doc_id, UTF-8 bytes of text) in a folder for each source and language; folders: root, sources, languages.
A second tree, of regions and nations with customers and suppliers as files, serves the operators on trees.
bench runs: events, one program for each event_type, a file for each user_id modulo 8, a mode for even and odd event_id.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import catalog as C
from ..operators import codecs, kernels
from ..operators import models as M
from ..operators.order import ranked
from ..shared import shared_dir, spread, use_workers
from ..sources import container
from ..sources.blocks import files_of, join_blocks, split_blocks
from ..sources.settings import parse_settings
from . import benchmarks as B

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Block sizes: the format's smallest for transforms, more for models, the largest for coding.
SMALL, MIDDLE, LARGE = 512, 65_536, 1 << 24
FILES = [f"f{i}" for i in range(8)]
#: Folder of documents without a source or language.
NO_NAME = "-"


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def named(name: str, f: Query) -> None:
    QUERIES[name] = f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    use_workers(spark)
    return files_of(table(spark, sf_dir, "documents"))


def blocks(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    return split_blocks(doc_files(spark, sf_dir), size)


def hexed(column: str) -> Column:
    return F.lower(F.hex(column))


# The two trees.
def doc_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, sf_dir, "documents").withColumns({c: F.coalesce(c, F.lit(NO_NAME)) for c in ("source", "lang")})
    pairs = docs.select("source", "lang").distinct()  # as many as there are folders
    sources = pairs.select("source").distinct().withColumn("i", F.row_number().over(Window.orderBy("source")).cast("long"))
    langs = pairs.withColumn("j", F.row_number().over(Window.orderBy("source", "lang")).cast("long")).join(sources, "source")
    root = spark.createDataFrame([(0, None, "corpus.arc", 1)], "folder_id long, parent_id long, name string, ord long")
    first = sources.select(F.col("i").alias("folder_id"), F.lit(0).cast("long").alias("parent_id"), F.col("source").alias("name"), F.col("i").alias("ord"))
    second = langs.select((F.col("j") + 1_000_000).alias("folder_id"), F.col("i").alias("parent_id"), F.col("lang").alias("name"), F.col("j").alias("ord"))
    size = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    files = docs.select("doc_id", "source", "lang", size.alias("original_size")).join(langs.select("source", "lang", (F.col("j") + 1_000_000).alias("folder_id")), ["source", "lang"])
    packed = F.col("original_size") + 8 * S.block_count(F.col("original_size"), F.lit(LARGE))
    files = files.select(F.col("doc_id").alias("file_id"), "folder_id", F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("name"), F.lit(0).alias("flags"), "original_size", packed.alias("compressed_size"), F.col("doc_id").alias("ord"))
    return root.union(first).union(second), files


def nation_tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    root = spark.createDataFrame([(0, None, "world.arc", 1)], "folder_id long, parent_id long, name string, ord long")
    first = region.select((F.col("r_regionkey") + 1).cast("long").alias("folder_id"), F.lit(0).cast("long").alias("parent_id"), F.col("r_name").alias("name"), (F.col("r_regionkey") + 1).cast("long").alias("ord"))
    second = nation.select((F.col("n_nationkey") + 100).cast("long").alias("folder_id"), (F.col("n_regionkey") + 1).cast("long").alias("parent_id"), F.col("n_name").alias("name"), (F.col("n_nationkey") + 1).cast("long").alias("ord"))

    def file(df, key, nation_key, name, balance, base):
        size = F.floor(F.abs(balance) * 100).cast("long")
        return df.select((F.col(key) + base).cast("long").alias("file_id"), (F.col(nation_key) + 100).cast("long").alias("folder_id"), F.concat(name, F.lit(".rec")).alias("name"), (F.col(key) % 8).cast("int").alias("flags"), size.alias("original_size"), (F.floor(size / 2) + 8).cast("long").alias("compressed_size"), (F.col(key) + base).cast("long").alias("ord"))

    files = file(customer, "c_custkey", "c_nationkey", "c_name", "c_acctbal", 0).union(file(supplier, "s_suppkey", "s_nationkey", "s_name", "s_acctbal", 1_000_000_000))
    return root.union(first).union(second), files


# Sources, blocks, sinks.
@query
def blk_split(spark, sf):
    return blocks(spark, sf, SMALL).select("file_id", "block_id", "n", F.sha2("block", 256).alias("sha256"))


@query
def blk_join(spark, sf):
    made = join_blocks(blocks(spark, sf, SMALL), ["file_id"])
    return made.select("file_id", F.length("content").cast("long").alias("n"), F.sha2("content", 256).alias("sha256"))


@query
def compressed_size(spark, sf):
    made = blocks(spark, sf, SMALL).groupBy("file_id").agg(F.sum(F.col("n") + 8).alias("compressed_size"), F.count("*").alias("n_blocks"))
    return made.select("file_id", "compressed_size", "n_blocks")


def _contained(spark, sf, flags):
    container.register(spark)
    path = f"{shared_dir(spark)}/containers-{uuid.uuid4().hex}"
    docs = table(spark, sf, "documents")
    rows = docs.select(F.concat_ws("/", *[F.coalesce(c, F.lit(NO_NAME)) for c in ("source", "lang")], F.concat(F.lit("doc_"), "doc_id", F.lit(".txt"))).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    spread(rows).write.format("bytecontainer").mode("append").option("flags", str(flags)).save(path)
    return path


@query
def archive_scan(spark, sf):
    """Records only: no file is decoded."""
    path = _contained(spark, sf, 1 << 15)
    return spark.read.format("bytecontainer").option("decode", "false").load(path).select("path", "flags", "original_size", "compressed_size")


@query
def archive_roundtrip(spark, sf):
    """Cyclic Burrows-Wheeler, move-to-front and run lengths in blocks of 4 KiB, checked by SHA-1 on reading."""
    path = _contained(spark, sf, 1 << 7 | 1 << 1 | 1 << 2 | 12 << 9 | 1 << 15)
    made = spark.read.format("bytecontainer").load(path)
    return made.select("path", "original_size", F.col("checksum").alias("sha1"), F.sha2("content", 256).alias("sha256"))


@query
def config_parse(spark, sf):
    """One settings file for each turn of each conversation: a comment with its number and role, and its text as one line."""
    turns = table(spark, sf, "conversations")
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[\\r\\n]+", " ")
    lines = F.array(F.concat(F.lit("## "), F.col("turn").cast("string"), F.lit(" "), F.coalesce("role", F.lit(""))), F.lit(""), line)
    return parse_settings(turns.select("conv_id", "turn", F.posexplode(lines).alias("no", "line")), ("conv_id", "turn"))


@query
def path_depth(spark, sf):
    made = table(spark, sf, "pages").select("page_id", F.length(F.regexp_replace("url", "[^/]", "")).cast("long").alias("depth"))
    return ranked(made.withColumn("all", F.lit(1)), ["all"], [F.col("depth"), F.col("page_id")]).select("page_id", "depth", "rnk")


# Catalog.
@query
def list_entries(spark, sf):
    return C.entries(*doc_tree(spark, sf)).select("is_file", "id", "name", "size", "packed", "ratio")


@query
def human_size_scaled(spark, sf):
    o = table(spark, sf, "orders")
    size = F.col("o_orderkey") * F.col("o_custkey") * (F.col("o_orderkey") % 1000)
    return o.select("o_orderkey", size.alias("size"), S.scaled_size(size).alias("shown"))


@query
def human_size_exact(spark, sf):
    o = table(spark, sf, "orders")
    size = F.col("o_orderkey") * F.col("o_custkey") * (F.col("o_orderkey") % 1000)
    return o.select("o_orderkey", size.alias("size"), S.exact_size(size).alias("shown"))


@query
def add_folder(spark, sf):
    return C.add_folder(doc_tree(spark, sf)[0], 0, "new folder")


@query
def add_file(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") + 1_000_000_000).alias("file_id"), F.concat(F.lit("in/"), "page_id", F.lit(".html")).alias("path"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("original_size"))
    return C.add_files(doc_tree(spark, sf)[1], pages, 1).select("file_id", "folder_id", "name", "original_size", "compressed_size", "ord")


@query
def select_subtree(spark, sf):
    return C.select_subtree(*nation_tree(spark, sf), F.col("folder_id").isin(2, 103))


@query
def folder_paths(spark, sf):
    return C.folder_paths(doc_tree(spark, sf)[0]).select("folder_id", "path")


@query
def file_paths(spark, sf):
    return C.file_paths(*nation_tree(spark, sf))


@query
def find_by_name(spark, sf):
    return C.find_by_name(C.file_paths(*nation_tree(spark, sf)))


@query
def find_folder(spark, sf):
    return C.find_folder(nation_tree(spark, sf)[0], 0, 3).select("folder_id", "parent_id", "name")


@query
def ancestors(spark, sf):
    return C.ancestors(*nation_tree(spark, sf), F.lit(True))


@query
def flat_paths(spark, sf):
    return C.flat_paths(doc_tree(spark, sf)[1], "out")


@query
def remove_subtree(spark, sf):
    _, files = C.remove_subtree(*nation_tree(spark, sf), F.col("folder_id") == 3)
    return C.with_offsets(files).select("file_id", "folder_id", "name", "compressed_size", "data_location")


@query
def dedup_names(spark, sf):
    """Names that meet in each folder, some of them numbered already."""
    _, files = doc_tree(spark, sf)
    n = F.col("file_id") % 7
    name = F.when(n == 0, "a (1).txt").when(n == 1, "a (3).txt").otherwise(F.concat(F.element_at(F.array(F.lit("a"), F.lit("b")), (n % 2 + 1).cast("int")), F.lit(".txt")))
    return C.unique_names(files.withColumn("name", name)).select("file_id", "folder_id", "name", "new_name")


def _sorted(by, descending):
    return lambda spark, sf: C.sorted_entries(C.entries(*nation_tree(spark, sf)), by, descending).select("parent", "is_file", "id", "rnk")


for _by in ("name", "size", "packed", "ratio"):
    named(f"sort_by_{_by}", _sorted(_by, False))
    named(f"sort_by_{_by}_desc", _sorted(_by, True))


@query
def catalog_print(spark, sf):
    return C.printed(*nation_tree(spark, sf))


# Transforms of blocks.
def _coded(stage, size=SMALL):
    return lambda spark, sf: (b := blocks(spark, sf, size)).select("file_id", "block_id", "n", codecs.encode(b.block, [stage]).alias("coded")).select("file_id", "block_id", "n", hexed("coded").alias("coded_hex"))


def _undone(spec, size=SMALL):
    """SHA-256 of each block after coding and decoding, and what coding made of its size."""

    return lambda spark, sf: codecs.restored(blocks(spark, sf, size), spec).select("file_id", "block_id", "n", F.sha2("block", 256).alias("sha256"))


for _name, _stage in {"bwt_sentinel": "BWT", "bwt_cyclic": "BWT2", "mtf": "MTF", "rle_split": "RLE", "rle_interleaved": "RLE1"}.items():
    named(_name, _coded(_stage))
    named(f"{_name}_inv", _undone([_stage]))
for _name, _spec in {"ac_order0_roundtrip": "AC", "ac_order1_roundtrip": "AC2", "pipeline_default": "1", "pipeline_order1": "2", "pipeline_cyclic": "BWT2+MTF+RLE+AC"}.items():
    named(_name, _undone(_spec, LARGE))


@query
def pipeline_sizes(spark, sf):
    return codecs.round_trip(blocks(spark, sf, LARGE), "BWT2+MTF+RLE")


def _listed(name, kernel):
    return lambda spark, sf: codecs.block_list(blocks(spark, sf, SMALL), "made", kernel).select("file_id", "block_id", "n", F.array_join("made", ",").alias(name))


named("suffix_array", _listed("positions", kernels.suffix_array))
named("lf_mapping", _listed("rows", lambda b: kernels.last_to_first(kernels.as_array(b))))
named("alphabet_bitmap", lambda spark, sf: codecs.block_list(blocks(spark, sf, SMALL), "made", kernels.present).select("file_id", "block_id", "n", F.array_join("made", ",").alias("bitmap")))


@query
def rle_runs(spark, sf):
    return M.run_lengths(blocks(spark, sf, MIDDLE)).groupBy("file_id", "block_id", "len").agg(F.count("*").alias("n_runs"), F.sum("sym").alias("sum_sym"), F.sum("run").alias("sum_run"))


@query
def rle_inv(spark, sf):
    return M.expanded(M.run_lengths(blocks(spark, sf, SMALL))).select("file_id", "block_id", "n", F.lower("block_hex").alias("block_hex"))


@query
def split_alg(spark, sf):
    specs = ["BWT+MTF+RLE+AC", "BWT2", "MTF+RLE+", "", "+AC2", "RLE++AC"]
    spec = F.element_at(F.array(*map(F.lit, specs)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", F.concat_ws("|", S.split_stages(spec)).alias("stages"), F.size(S.split_stages(spec)).alias("n_stages"))


# Models.
@query
def byte_histogram(spark, sf):
    return M.byte_histogram(blocks(spark, sf, MIDDLE))


@query
def freq_normalize(spark, sf):
    return M.normalized(blocks(spark, sf, MIDDLE), 4096)


@query
def model_order0(spark, sf):
    return M.normalized(blocks(spark, sf, MIDDLE), kernels.WHOLE)


@query
def model_ans(spark, sf):
    return M.normalized(blocks(spark, sf, MIDDLE), 1 << 32)


@query
def cmf_bounds(spark, sf):
    return M.bounds(blocks(spark, sf, MIDDLE), kernels.WHOLE)


@query
def pair_counts(spark, sf):
    return M.pair_counts(blocks(spark, sf, MIDDLE))


@query
def model_order1(spark, sf):
    return M.order1(blocks(spark, sf, MIDDLE))


# Checksums.
def _checksums(kind, name):
    return lambda spark, sf: doc_files(spark, sf).select("file_id", S.checksum(F.col("content"), kind).alias(name))


named("sha1", _checksums("SHA-1", "sha1"))
named("sha256", _checksums("SHA-256", "sha256"))
named("crc32", _checksums("CRC-32", "crc32"))


@query
def checksum_type(spark, sf):
    text = F.concat(F.lit(""), F.repeat(F.lit("a"), F.element_at(F.array(F.lit(10), F.lit(40), F.lit(64)), (F.col("c_custkey") % 3 + 1).cast("int"))))
    return table(spark, sf, "customer").select("c_custkey", S.checksum_kind(text).alias("kind"))


@query
def verify(spark, sf):
    """Files put together from coded blocks against the checksums of the originals; every 50th original is altered first."""
    files = doc_files(spark, sf)
    b = split_blocks(files, 4096)
    b = b.select("file_id", "block_id", codecs.encode(b.block, "MTF+RLE").alias("coded"))
    again = join_blocks(b.select("file_id", "block_id", codecs.decode(b.coded, "MTF+RLE").alias("block")), ["file_id"])
    altered = F.when(F.col("file_id") % 50 == 0, F.concat("content", F.lit("x").cast("binary"))).otherwise(F.col("content"))
    originals = files.select("file_id", F.sha2(altered, 256).alias("sha256"))
    joined = originals.join(again.select("file_id", F.sha2("content", 256).alias("found")), "file_id", "left")
    return joined.select("file_id", F.coalesce(F.col("sha256") == F.col("found"), F.lit(False)).alias("valid"))


# Scalars, over orders. Columns need a session, so they are made when a query is.
def _pick(values, key):
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def _parts():
    key = F.col("o_orderkey")
    return {
        "flags": ((key % 16) * 512).cast("int"),
        "size": F.floor(F.col("o_totalprice") * 100).cast("long"),
        "mebibytes": _pick(("16", "8", "4", "2", "1", "0.5", "0.25", "0.125"), key),
        "spec": _pick(("1", "2", "", "BWT2+MTF+RLE+AC2", "RLE", "BWT+AC"), key),
        "word": (key % 65_536).cast("int"),
    }


def _orders(columns):
    return lambda spark, sf: table(spark, sf, "orders").select("o_orderkey", *[c.alias(k) for k, c in columns(**_parts()).items()])


named("block_size", _orders(lambda flags, **_: {"flags": flags, "block_size": S.block_size(flags)}))
named("block_count", _orders(lambda size, flags, **_: {"size": size, "blocks": S.block_count(size, S.block_size(flags))}))
named("blocksize_flags", _orders(lambda mebibytes, **_: {"mebibytes": mebibytes, "flags": S.block_size_flags(mebibytes)}))
named("alg_flags", _orders(lambda spec, **_: {"spec": spec, "flags": S.stage_flags(spec)}))
named("decode_flags", _orders(lambda word, **_: {"flags": word, **{k.lower(): S.flag(word, bit) for k, bit in S.STAGE_BITS.items()}, "shift": S.shift_of(word), **{k.lower().replace("-", ""): S.flag(word, bit) for k, bit in S.CHECKSUM_BITS.items()}}))
named("elapsed_fmt", _orders(lambda size, **_: {"ms": size, "shown": S.elapsed(size)}))
named("progress_pct", _orders(lambda **_: {"pct": S.progress(F.col("o_custkey") % 101, F.col("o_orderkey") % 101 + F.col("o_custkey") % 101)}))
named("step_estimate", _orders(lambda size, word, **_: {"steps": S.step_estimate(size * 10, word)}))


@query
def path_parts(spark, sf):
    path = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, sf, "pages").select("page_id", *[c.alias(k) for k, c in S.path_parts(path).items()])


@query
def tsv_line(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", S.tsv([F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey"), F.col("c_mktsegment")]).alias("line"))


@query
def alg_permutations(spark, sf):
    """The stage orders to try with every block size that the command line has."""
    orders = spark.createDataFrame([(s,) for s in codecs.stage_orders()], "alg string")
    sizes = F.array(*map(F.lit, ("16", "8", "4", "2", "1", "0.5", "0.25", "0.125")))
    return orders.select("alg", F.explode(sizes).alias("block_size"))


# Reports.
def runs(spark, sf):
    v = F.col("value")
    whole = lambda c: F.floor(c).cast("long")
    mode = F.when(F.col("event_id") % 2 == 0, "DEFAULT").otherwise("MAX")
    columns = {"program": F.col("event_type"), "mode": mode, "file": F.concat(F.lit("f"), (F.col("user_id") % 8).cast("string")), "time_pack_us": whole(v * 1000) + 1, "time_unpack_us": whole(v * 700) + 1, "size_base": (F.col("user_id") % 8 + 1) * 100_000, "size_packed": whole(v * 300) + 100, "ram_pack_kb": whole(v * 50) + 10, "ram_unpack_kb": whole(v * 20) + 10}
    return table(spark, sf, "events").select(*[c.alias(k) for k, c in columns.items()])


@query
def bench_min(spark, sf):
    return B.least(runs(spark, sf))


def _measure(name):
    return lambda spark, sf: B.least(runs(spark, sf)).select(*B.KEYS, B.measures()[name].alias(name))


named("bench_effectiveness", _measure("effectiveness"))
named("bench_speed", _measure("speed"))
named("bench_ram", _measure("ram_use"))
named("bench_pivot", lambda spark, sf: B.wide(runs(spark, sf), B.measures()["effectiveness"], FILES))
named("bench_raw", lambda spark, sf: B.raw(runs(spark, sf), FILES))
named("bench_sizes", lambda spark, sf: B.sizes(runs(spark, sf)))
