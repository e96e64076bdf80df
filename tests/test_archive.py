"""Containers, blocks, catalog operations, settings, streams."""

import io
import itertools

import pytest
from pyspark.sql import functions as F

from bytequarry import cli
from bytequarry.functions import scalars as S
from bytequarry.operators import catalog as C
from bytequarry.operators import codecs
from bytequarry.operators.order import in_order, ranked
from bytequarry.sources import archives
from bytequarry.sources import container as A
from bytequarry.sources.blocks import join_blocks, split_blocks
from bytequarry.sources.settings import parse_settings, read_settings, settings_text, write_report
from bytequarry.streaming.blocks import coded_stream

FILES = {"a.txt": b"hello", "d/b.txt": b"x" * 9000, "d/e/c.bin": bytes(range(256)) * 40, "d/e/empty": b"", "f/g.txt": b"g"}


def packed(files, flags):
    writer = A.ContainerWriter("root.arc")
    for path, content in files.items():
        writer.add(path, content, flags)
    out = io.BytesIO()
    writer.write(out)
    return out.getvalue()


@pytest.mark.parametrize("flags", [0, 1 << 15, 1 << 14 | 1 << 2, 1 << 13 | 1 << 7 | 1 << 1 | 1 << 2 | 12 << 9, 1 | 2 | 8 | 12 << 9])
def test_container(flags):
    raw = packed(FILES, flags)
    reader = A.Container(io.BytesIO(raw))
    found = {f["path"]: f for f in reader.files()}
    assert set(found) == set(FILES)
    for path, f in found.items():
        assert reader.content(f)[0] == FILES[path] and f["original_size"] == len(FILES[path])


def test_container_layout():
    raw = packed({"a": b"hi"}, 1 << 15)
    assert raw[0] == 0 and raw[1] == len("root.arc")
    at = 2 + len("root.arc") + 32
    assert raw[at : at + 2] == b"\x01a"
    data = at + 2 + A.FILE.size
    assert int.from_bytes(raw[data : data + 4], "little") == 0 and int.from_bytes(raw[data + 4 : data + 8], "little") == 2
    assert raw[data + 8 : data + 10] == b"hi" and len(raw) == data + 10 + 40


def test_container_damage_and_limits():
    raw = bytearray(packed({"a": b"hi there"}, 1 << 14))
    raw[-12] ^= 1
    reader = A.Container(io.BytesIO(bytes(raw)))
    with pytest.raises(ValueError, match="damaged"):
        reader.content(next(reader.files()))
    with pytest.raises(ValueError, match="255"):
        packed({"n" * 256: b""}, 0)
    with pytest.raises(ValueError, match="one kind"):
        packed({"a": b""}, 1 << 14 | 1 << 15)


def test_container_source(spark, tmp_path):
    A.register(spark)
    path = f"file://{tmp_path}/c"
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in FILES.items()], "path string, content binary")
    rows.repartition(2).write.format("bytecontainer").mode("append").option("flags", 6).save(path)
    back = spark.read.format("bytecontainer").load(path)
    assert {r.path: bytes(r.content) for r in back.collect()} == FILES
    bare = spark.read.format("bytecontainer").option("decode", "false").load(path).collect()
    assert all(r.content is None for r in bare) and len(bare) == len(FILES)
    A.unpack(back, f"file://{tmp_path}/out")
    assert (tmp_path / "out/d/e/c.bin").read_bytes() == FILES["d/e/c.bin"]
    rows.limit(1).write.format("bytecontainer").mode("overwrite").save(path)
    assert spark.read.format("bytecontainer").load(path).count() == 1
    assert A.empty_container(path, "x").endswith("x.arc")
    assert spark.read.format("bytecontainer").load(path + "/x.arc").count() == 0


def test_adding_and_removing_in_a_container(tmp_path):
    path = tmp_path / "root.arc"
    path.write_bytes(packed(FILES, 1 << 15 | 1 << 2))
    uri = f"file://{path}"
    archives.edit(uri, {"d/new": b"n" * 5000, "a.txt": b"other"}, ["d/e", "a.txt"], 1 << 14)
    with path.open("rb") as source:
        reader = A.Container(source)
        found = {f["path"]: reader.content(f)[0] for f in reader.files()}
        assert found == {"a.txt": b"other", "d/b.txt": FILES["d/b.txt"], "d/new": b"n" * 5000, "f/g.txt": b"g"}
        assert {p for p, _, _ in reader.folders()} == {"", "d/", "f/"}
    before = path.read_bytes()
    for bad in ({"remove": ["none"]}, {"add": {"a.txt": b""}}):
        with pytest.raises(ValueError):
            archives.edit(uri, **bad)
    assert path.read_bytes() == before and [p.name for p in tmp_path.iterdir()] == ["root.arc"]
    archives.edit(uri, remove=["f/g.txt"])
    with path.open("rb") as source:  # an empty folder stays
        assert {p for p, _, _ in A.Container(source).folders()} == {"", "d/", "f/"}


def test_packing_in_parallel_is_the_same_container(spark, tmp_path):
    flags = 1 << 13 | 1 << 7 | 1 << 1 | 1 << 2 | 14 << 9
    for name, content in FILES.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    archives.pack(spark, [(p, f"file://{tmp_path}/in/{p}") for p in FILES], f"file://{tmp_path}/root.arc", flags)
    assert (tmp_path / "root.arc").read_bytes() == packed(dict(sorted(FILES.items())), flags)
    with pytest.raises(FileNotFoundError):
        archives.pack(spark, [("x", f"file://{tmp_path}/none")], f"file://{tmp_path}/x.arc")


@pytest.mark.parametrize("alg", [[], ["--alg=1", "--blockSize=0.125"], ["--alg=BWT2+RLE+MTF+AC"]])
def test_command_line(spark, tmp_path, alg):
    content = b"abracadabra " * 900
    (tmp_path / "t.txt").write_bytes(content)
    cli.main(["--mode=compress", f"--archive={tmp_path}/x.arc", f"--fileToAdd={tmp_path}/t.txt", *alg], spark)
    assert ((tmp_path / "x.arc").stat().st_size < len(content) / 2) == bool(alg)
    cli.main(["--mode=decompress", f"--archive={tmp_path}/x.arc", f"--output={tmp_path}/out", *alg], spark)
    assert (tmp_path / "out/x/t.txt").read_bytes() == content


@pytest.mark.parametrize("argv", [["--archive=a"], ["--mode=compress", "--archive=a"], ["--mode=decompress", "--archive=", "--output=o"], ["--mode=compress", "--archive=a", "--fileToAdd=f", "--blockSize=3"], ["--mode=compress", "--archive=a", "--fileToAdd=f", "--alg=NONE"]])
def test_command_line_errors(argv):
    with pytest.raises(SystemExit):
        cli.main(argv)


def test_unpacking_a_part(spark, tmp_path):
    rows = spark.createDataFrame([("r.arc", k, bytearray(v)) for k, v in FILES.items()], "archive string, path string, content binary")
    out = lambda d: {str(p.relative_to(tmp_path / d)) for p in (tmp_path / d).rglob("*") if p.is_file()}
    A.unpack(rows, f"file://{tmp_path}/a", stem=True, chosen=("d/e", "a.txt"))
    assert out("a") == {"r/a.txt", "r/d/e/c.bin", "r/d/e/empty"}
    A.unpack(rows, f"file://{tmp_path}/b", flat=True)
    assert out("b") == {p.rpartition("/")[2] for p in FILES}
    with pytest.raises(ValueError, match="one name"):
        A.unpack(rows.union(rows), f"file://{tmp_path}/c", flat=True)
    bad = spark.createDataFrame([("../x", bytearray(b""))], "path string, content binary")
    with pytest.raises(Exception, match="leads elsewhere"):
        A.unpack(bad, f"file://{tmp_path}/d")


def test_blocks(spark):
    sizes = [0, 1, 511, 512, 513, 1024, 1025]
    files = spark.createDataFrame([(n, bytearray(b"z" * n)) for n in sizes], "file_id long, content binary")
    blocks = split_blocks(files, 512)
    assert {n: sorted((r.block_id, r.n) for r in blocks.where(F.col("file_id") == n).collect()) for n in (0, 512, 513)} == {0: [(0, 0)], 512: [(0, 512)], 513: [(0, 512), (1, 1)]}
    assert {r.file_id: len(r.content) for r in join_blocks(blocks, ["file_id"]).collect()} == {n: n for n in sizes}
    assert all(r.same for r in codecs.round_trip(blocks, "2").collect())
    with pytest.raises(ValueError, match="not known"):
        codecs.stages_of("BWT+NONE")
    assert codecs.stages_of(15) == ["BWT", "MTF", "RLE", "AC"] and codecs.stages_of("MTF+RLE+") == ["MTF", "RLE"]
    assert len(codecs.stage_orders()) == 32


def tree(spark):
    folders = spark.createDataFrame([(0, None, "r.arc", 1), (1, 0, "a", 1), (2, 0, "b", 2), (3, 1, "c", 1), (4, 3, "d", 1), (5, 4, "e", 1), (6, 2, "f", 1)], "folder_id long, parent_id long, name string, ord long")
    files = spark.createDataFrame([(10, 0, "x.txt", 0, 5, 9, 1), (11, 5, "x.txt", 0, 5, 0, 1), (12, 5, "x.txt", 0, 6, 3, 2), (13, 5, "x (1).txt", 0, 7, 7, 3), (14, 6, ".h", 0, 7, 7, 1)], "file_id long, folder_id long, name string, flags int, original_size long, compressed_size long, ord long")
    return folders, files


def test_tree(spark):
    folders, files = tree(spark)
    assert {r.file_id: r.path for r in C.file_paths(folders, files).collect()} == {10: "r/x.txt", 11: "r/a/c/d/e/x.txt", 12: "r/a/c/d/e/x.txt", 13: "r/a/c/d/e/x (1).txt", 14: "r/b/f/.h"}
    assert {r.folder_id for r in C.subtree(folders, F.col("folder_id") == 1).collect()} == {1, 3, 4, 5}
    assert C.find_file(files, 5, 12).count() == 1 and C.find_file(files, 0, 12).count() == 0
    assert C.find_folder(folders, 0, 2).first().name == "b" and C.find_folder(folders, 1, 2).count() == 0
    assert {(r.kind, r.id) for r in C.select_subtree(folders, files, F.col("folder_id") == 2).collect()} == {("folder", 2), ("folder", 6), ("file", 14)}
    assert {r.folder_id for r in C.ancestors(folders, files, F.col("file_id") == 13).collect()} == {0, 1, 3, 4, 5}
    left, kept = C.remove_subtree(folders, files, F.col("folder_id") == 3)
    assert {r.folder_id for r in left.collect()} == {0, 1, 2, 6} and {r.file_id for r in kept.collect()} == {10, 14}
    assert {r.file_id: r.new_name for r in C.unique_names(files).collect()} == {10: "x.txt", 11: "x.txt", 12: "x (2).txt", 13: "x (1).txt", 14: ".h"}
    assert [r.line.strip().split(" ")[0] for r in C.printed(folders, files).orderBy("rnk").collect()] == ["r.arc/", "x.txt", "a/", "b/", "f/", ".h", "c/", "d/", "e/", "x.txt", "x.txt", "x"]
    entries = C.entries(folders, files)
    assert [r.id for r in C.sorted_entries(entries, "size", True).where("parent = 0").orderBy("rnk").collect()] == [2, 1, 10]
    new = C.add_folder(folders, 2, "n").where("name = 'n'").first()
    assert (new.folder_id, new.parent_id, new.ord) == (7, 2, 2)
    more = spark.createDataFrame([(20, "in/q.txt", 3)], "file_id long, path string, original_size long")
    assert C.add_files(files, more, 5).where("file_id = 20").first()[:7] == (20, 5, "q.txt", 0, 3, 0, 4)
    offsets = {r.file_id: r.data_location for r in C.with_offsets(files).collect()}
    assert offsets[10] == 1 + 43 + 5 and offsets[11] == offsets[10] + 9 + 43 + 5


def test_order(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 1000).alias("k"))
    rows = in_order(df, [F.col("k")], F.col("id"), 7).orderBy("pos").collect()
    assert [r.k for r in rows] == list(range(1000)) and [r.pos for r in rows] == list(range(1000))
    assert [r.before for r in rows] == [0, *itertools.accumulate(r.id for r in rows)][:-1]
    for r in ranked(df, ["g"], [F.col("k").desc()]).where("rnk = 1").collect():
        assert r.k == df.where(F.col("g") == r.g).agg(F.max("k")).first()[0]
    assert in_order(df.where("false"), [F.col("k")]).count() == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(S.block_size(F.lit(15 << 9))) == 512 and one(S.block_size(F.lit(0))) == 1 << 24
    for text, shift in {"16": 0, "0.125": 7, "0.5": 5}.items():
        assert one(S.block_size_flags(F.lit(text))) == shift << 9
    with pytest.raises(Exception, match="not supported"):
        one(S.block_size_flags(F.lit("3")))
    with pytest.raises(Exception, match="not known"):
        one(S.stage_flags(F.lit("BWT+X")))
    for size, shown in {999: "999 B", 1000: "1,000 B", 1001: "1.0 KB", 1500: "1.5 KB", 999_950: "1000.0 KB", 1_234_567_890: "1.2 GB", 16_777_217: "16.8 MB", 0: "0 B"}.items():
        assert one(S.scaled_size(F.lit(size).cast("long"))) == shown
    assert one(S.exact_size(F.lit(16_777_217).cast("long"))) == "16,777,216 B"
    assert one(S.elapsed(F.lit(3_725_950))) == "1:02:05.9"
    assert {k: one(c) for k, c in S.path_parts(F.lit("a/b.tar.gz")).items()} == {"name": "b.tar.gz", "stem": "b.tar", "ext": ".gz"}
    assert one(S.checksum(F.lit(b"123456789"), "CRC-32")) == "0xcbf43926"
    with pytest.raises(Exception, match="no checksum"):
        one(S.checksum_kind(F.lit("abc")))


def test_settings(spark, tmp_path):
    path = tmp_path / "s.ini"
    path.write_text(settings_text({"dark_mode": "0", "extraction_path": "/x"}))
    assert {r.setting: r.value for r in read_settings(spark, str(path)).collect()} == {"extraction_path": "/x", "filesize_scaling": "1", "dark_mode": "0"}
    many = spark.createDataFrame([(i, "v") for i in range(4)], "no int, line string")
    with pytest.raises(Exception, match="more settings"):
        parse_settings(many).collect()
    write_report(spark.createDataFrame([("a", 1)], "p string, n int").coalesce(1), str(tmp_path / "rep"))
    assert next((tmp_path / "rep").glob("*.csv")).read_text() == "p\tn\na\t1\n"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.bin").write_bytes(b"ab" * 700)
    made = coded_stream(spark, str(tmp_path / "in"), "BWT2+MTF+RLE", 512)
    q = made.writeStream.format("memory").queryName("coded").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("coded").orderBy("block_id")
    again = rows.select(codecs.decode(F.col("coded"), "BWT2+MTF+RLE").alias("b")).collect()
    assert b"".join(bytes(r.b) for r in again) == b"ab" * 700


def test_documents_without_source_or_language(spark, tmp_path):
    """They stand in folders of their own, and no file is lost."""
    import duckdb

    from bytequarry.plans.oracles import oracles
    from bytequarry.plans.queries import QUERIES

    rows = [(1, "a", None, "s"), (2, "b", "en", None), (3, None, None, None), (4, "d", "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("list_entries", "flat_paths", "folder_paths", "archive_scan"):
        made = QUERIES[name](spark, str(tmp_path))
        want = con.execute(f"SELECT {', '.join(made.columns)} FROM ({oracles()[name]})").fetchall()
        assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want))
    assert QUERIES["flat_paths"](spark, str(tmp_path)).count() == 4


def test_rotations_as_the_doubled_text_has_them():
    import random

    from bytequarry.operators import kernels

    r = random.Random(1)
    for b in [b"a" * 50, b"ab" * 30, b"abc" * 9, *(bytes(r.choices(b"ab\xff", k=r.randint(1, 14))) for _ in range(500))]:
        order = kernels.suffix_array(b + b)
        assert (kernels.rotations(b) == order[order < len(b)]).all()


def test_shared_folder_needs_a_name_on_a_cluster():
    from types import SimpleNamespace

    from bytequarry.shared import shared_dir

    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda *a: None)))
