"""Every registered query of the archive model against DuckDB on the smallest tables."""

import duckdb
import pytest

from bytequarry.plans.oracles import oracles
from bytequarry.plans.queries import QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = oracles()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    mine = rows(got.columns, [tuple(r) for r in got.collect()])
    if name not in SQL:
        assert mine
        return
    want = duck.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert mine == rows(columns, want.fetchall())


def test_without_sql(spark, sf_dir):
    """What DuckDB lacks or takes too long for, against Python on the same tables."""
    import zlib

    from bytequarry.operators import kernels

    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["crc32"](spark, sf_dir).collect():
        assert r.crc32 == f"0x{zlib.crc32(texts[r.file_id]):08x}"
    for r in QUERIES["mtf"](spark, sf_dir).collect():
        assert kernels.unmtf(bytes.fromhex(r.coded_hex)) == texts[r.file_id][512 * r.block_id : 512 * r.block_id + 512]
    assert set(QUERIES) - set(SQL) == {"crc32", "pipeline_sizes"}
