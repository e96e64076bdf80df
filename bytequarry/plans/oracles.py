"""DuckDB SQL for the registered queries: the same rows, said independently in SQL. Byte-wise queries go byte by byte here."""

from __future__ import annotations

from ..functions.scalars import CHECKSUM_BITS, STAGE_BITS

WHOLE = (1 << 32) - 1


def _blocks(size: int) -> str:
    """bl: file_id, block_id, n, h (the block in hex); bt: file_id, block_id, pos, b."""
    return f"""
f AS (SELECT doc_id AS file_id, encode(coalesce(text, '')) AS c FROM documents),
g AS (SELECT file_id, c, unnest(range(0, greatest(1, (octet_length(c) + {size - 1}) // {size})))::INT AS block_id FROM f),
s AS (SELECT file_id, block_id, array_slice(c, block_id * {size} + 1, block_id * {size} + {size}) AS block FROM g),
bl AS (SELECT file_id, block_id, octet_length(block)::BIGINT AS n, block, lower(hex(block)) AS h FROM s),
bt_ AS (SELECT file_id, block_id, n, h, unnest(range(0, n))::INT AS pos FROM bl WHERE n > 0),
bt AS (SELECT file_id, block_id, n, h, pos, substr(h, 2 * pos + 1, 2) AS x, ('0x' || substr(h, 2 * pos + 1, 2))::INT AS b FROM bt_)"""


_U32 = "substr({0}, 7, 2) || substr({0}, 5, 2) || substr({0}, 3, 2) || substr({0}, 1, 2)"


def _le(expr: str) -> str:
    return _U32.format(f"lpad(lower(hex({expr})), 8, '0')")


_RUNS = """
i1 AS (SELECT file_id, block_id, pos, b, x, CASE WHEN lag(b) OVER w = b THEN 0 ELSE 1 END AS new FROM bt WINDOW w AS (PARTITION BY file_id, block_id ORDER BY pos)),
i2 AS (SELECT *, sum(new) OVER (PARTITION BY file_id, block_id ORDER BY pos) AS isl FROM i1),
i3 AS (SELECT *, (row_number() OVER (PARTITION BY file_id, block_id, isl ORDER BY pos) - 1) // 255 AS k FROM i2),
r AS (SELECT file_id, block_id, isl, k, min(b) AS sym, min(x) AS x, count(*) AS len FROM i3 GROUP BY ALL),
rr AS (SELECT *, row_number() OVER (PARTITION BY file_id, block_id ORDER BY isl, k) - 1 AS run FROM r)"""

_FLAGGED = "SELECT bl.file_id, bl.block_id, n, CASE WHEN n = 0 THEN '' WHEN (1 + 2 * r) * 3 > n * 2 THEN '00' || h ELSE 'ff' || body END AS coded_hex FROM bl LEFT JOIN z USING (file_id, block_id)"

_C0 = """
c AS (SELECT file_id, block_id, n, b AS sym, count(*) AS cnt FROM bt GROUP BY ALL)"""


def _model0(limit: int) -> str:
    return f"""{_C0},
m1 AS (SELECT *, CASE WHEN n = {limit} THEN cnt ELSE cnt * {limit} // n END AS f FROM c),
m2 AS (SELECT *, {limit} - sum(f) OVER (PARTITION BY file_id, block_id) AS gap, row_number() OVER (PARTITION BY file_id, block_id ORDER BY f DESC, sym) AS p FROM m1),
m AS (SELECT file_id, block_id, sym, (f + CASE WHEN p = 1 THEN gap ELSE 0 END)::BIGINT AS freq FROM m2)"""


_PAIRS = """
p1 AS (SELECT file_id, block_id, lag(b) OVER (PARTITION BY file_id, block_id ORDER BY pos) AS prev, b AS sym FROM bt),
p AS (SELECT file_id, block_id, prev, sym, count(*)::BIGINT AS cnt FROM p1 WHERE prev IS NOT NULL GROUP BY ALL)"""

#: Codes of move-to-front without its list: how many distinct bytes came since the byte before of the same value; where there
#: is none, how many came at all, and those of lesser value that are still to come. Then which values occur, as 256 bits.
_MTF = f"""WITH {_blocks(512)},
p AS (SELECT file_id, block_id, pos, b, lag(pos) OVER (PARTITION BY file_id, block_id, b ORDER BY pos) AS prev FROM bt),
q AS (SELECT file_id, block_id, list(coalesce(prev, -1)::SMALLINT ORDER BY pos) AS prevs FROM p GROUP BY ALL),
c AS (SELECT p.file_id, p.block_id, pos, b, prev, CASE WHEN prev IS NOT NULL THEN len(list_filter(list_slice(prevs, prev + 2, pos), lambda x: x <= prev)) ELSE len(list_filter(list_slice(prevs, 1, pos), lambda x: x < 0)) END AS code FROM p JOIN q USING (file_id, block_id)),
fo AS (SELECT file_id, block_id, b, pos FROM c WHERE prev IS NULL),
un AS (SELECT x.file_id, x.block_id, x.pos, count(*) AS unseen FROM fo x JOIN fo y ON x.file_id = y.file_id AND x.block_id = y.block_id AND y.b < x.b AND y.pos > x.pos GROUP BY ALL),
z AS (SELECT c.file_id, c.block_id, string_agg(lpad(lower(hex(code + coalesce(unseen, 0))), 2, '0'), '' ORDER BY pos) AS codes FROM c LEFT JOIN un USING (file_id, block_id, pos) GROUP BY ALL),
v AS (SELECT file_id, block_id, b // 8 AS j, sum(1 << (7 - b % 8))::INT AS v FROM fo GROUP BY ALL),
w AS (SELECT z.file_id, z.block_id, string_agg(lpad(lower(hex(coalesce(v, 0))), 2, '0'), '' ORDER BY i) AS bitmap FROM z CROSS JOIN range(32) r(i) LEFT JOIN v ON v.file_id = z.file_id AND v.block_id = z.block_id AND j = i GROUP BY ALL)
SELECT bl.file_id, bl.block_id, n, coalesce(codes || bitmap, '') AS coded_hex FROM bl LEFT JOIN z USING (file_id, block_id) LEFT JOIN w USING (file_id, block_id)"""

DOC_TREE = f"""
docs AS (SELECT * REPLACE (coalesce(source, '-') AS source, coalesce(lang, '-') AS lang) FROM documents),
d AS (SELECT DISTINCT source, lang FROM docs),
so AS (SELECT source, row_number() OVER (ORDER BY source) AS i FROM (SELECT DISTINCT source FROM d)),
la AS (SELECT d.source, d.lang, row_number() OVER (ORDER BY d.source, d.lang) AS j, i FROM d JOIN so USING (source)),
folders AS (SELECT 0::BIGINT AS folder_id, NULL::BIGINT AS parent_id, 'corpus.arc' AS name, 1::BIGINT AS ord UNION ALL SELECT i, 0, source, i FROM so UNION ALL SELECT j + 1000000, i, lang, j FROM la),
files AS (SELECT doc_id AS file_id, j + 1000000 AS folder_id, 'doc_' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS original_size, (octet_length(encode(coalesce(text, ''))) + 8 * greatest(1, (octet_length(encode(coalesce(text, ''))) + {(1 << 24) - 1}) // {1 << 24}))::BIGINT AS compressed_size, doc_id AS ord FROM docs JOIN la USING (source, lang))"""

NATION_TREE = """
folders AS (SELECT 0::BIGINT AS folder_id, NULL::BIGINT AS parent_id, 'world.arc' AS name, 1::BIGINT AS ord UNION ALL SELECT r_regionkey + 1, 0, r_name, r_regionkey + 1 FROM region UNION ALL SELECT n_nationkey + 100, n_regionkey + 1, n_name, n_nationkey + 1 FROM nation),
ff AS (SELECT c_custkey AS file_id, c_nationkey + 100 AS folder_id, c_name || '.rec' AS name, c_custkey % 8 AS flags, floor(abs(c_acctbal) * 100)::BIGINT AS original_size FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_nationkey + 100, s_name || '.rec', s_suppkey % 8, floor(abs(s_acctbal) * 100)::BIGINT FROM supplier),
files AS (SELECT *, original_size // 2 + 8 AS compressed_size, file_id AS ord FROM ff)"""

_ENTRIES = """
entries AS (SELECT parent_id AS parent, 0 AS is_file, folder_id AS id, name, NULL::BIGINT AS size, NULL::BIGINT AS packed, NULL::DOUBLE AS ratio FROM folders UNION ALL SELECT folder_id, 1, file_id, name, original_size, compressed_size, CASE WHEN compressed_size > 0 THEN original_size::DOUBLE / compressed_size END FROM files)"""

_RUN_ROWS = """
runs AS (SELECT event_type AS program, CASE WHEN event_id % 2 = 0 THEN 'DEFAULT' ELSE 'MAX' END AS mode, 'f' || (user_id % 8) AS file, floor(value * 1000)::BIGINT + 1 AS time_pack_us, floor(value * 700)::BIGINT + 1 AS time_unpack_us, (user_id % 8 + 1) * 100000 AS size_base, floor(value * 300)::BIGINT + 100 AS size_packed, floor(value * 50)::BIGINT + 10 AS ram_pack_kb, floor(value * 20)::BIGINT + 10 AS ram_unpack_kb FROM events),
best AS (SELECT program, mode, file, min(time_pack_us) AS time_pack_us, min(time_unpack_us) AS time_unpack_us, min(ram_pack_kb) AS ram_pack_kb, min(ram_unpack_kb) AS ram_unpack_kb, max(size_base) AS size_base, min(size_packed) AS size_packed FROM runs GROUP BY ALL)"""


def _sort(by: str, descending: bool) -> str:
    way = "DESC NULLS LAST" if descending else "ASC NULLS FIRST"
    keys = f"name {way}" if by == "name" else f"CASE WHEN is_file = 0 THEN name END {way}, {by} {way}, name ASC"
    return f"WITH {NATION_TREE}, {_ENTRIES} SELECT parent, is_file, id, row_number() OVER (PARTITION BY parent ORDER BY is_file, {keys}, id) AS rnk FROM entries"


def _inverse(size: int) -> str:
    return f"WITH {_blocks(size)} SELECT file_id, block_id, n, sha256(block) AS sha256 FROM bl"


def _coded(expr: str, extra: str = "", group: str = "bt", size: int = 512) -> str:
    return f"WITH {_blocks(size)}{extra}, z AS (SELECT file_id, block_id, {expr} AS coded_hex FROM {group} GROUP BY file_id, block_id) SELECT bl.file_id, bl.block_id, n, coalesce(coded_hex, '') AS coded_hex FROM bl LEFT JOIN z USING (file_id, block_id)"


_MANTISSA = "o_orderkey * o_custkey * (o_orderkey % 1000)"
_F = "CAST({} AS FLOAT)"


def _scaled() -> str:
    steps = f"s0 AS (SELECT o_orderkey, {_MANTISSA} AS size, CAST({_MANTISSA} AS FLOAT) AS v, 0 AS u FROM orders)"
    for k in range(4):
        steps += f", s{k + 1} AS (SELECT o_orderkey, size, CASE WHEN v > 1000 THEN CAST(CAST(v AS DOUBLE) / 1000 AS FLOAT) ELSE v END AS v, CASE WHEN v > 1000 THEN u + 1 ELSE u END AS u FROM s{k})"
    return f"""WITH {steps}, t AS (SELECT *, CAST(round(CAST(CAST(CAST(v AS DOUBLE) * 10 AS FLOAT) AS DOUBLE)) AS BIGINT)::VARCHAR AS tenths FROM s4)
SELECT o_orderkey, size, CASE WHEN u = 0 THEN format('{{:,}}', CAST(v AS BIGINT)) || ' B' ELSE substr(tenths, 1, length(tenths) - 1) || '.' || substr(tenths, length(tenths), 1) || ' ' || (['B', 'KB', 'MB', 'GB', 'TB'])[u + 1] END AS shown FROM t"""


_FLAGS = "((o_orderkey % 16) * 512)"
_SIZE = "floor(o_totalprice * 100)::BIGINT"
_SPECS = "(['1', '2', '', 'BWT2+MTF+RLE+AC2', 'RLE', 'BWT+AC'])[o_orderkey % 6 + 1]"
_MEB = "(['16', '8', '4', '2', '1', '0.5', '0.25', '0.125'])[o_orderkey % 8 + 1]"
_WORD = "(o_orderkey % 65536)"
_FILES = [f"f{i}" for i in range(8)]
_ORDERS = ["", "BWT2+", "MTF+", "RLE+", "BWT2+MTF+", "BWT2+RLE+", "MTF+BWT2+", "MTF+RLE+", "RLE+BWT2+", "RLE+MTF+", "BWT2+MTF+RLE+", "BWT2+RLE+MTF+", "MTF+BWT2+RLE+", "MTF+RLE+BWT2+", "RLE+BWT2+MTF+", "RLE+MTF+BWT2+"]


def oracles() -> dict[str, str]:
    out = {
        "blk_split": _inverse(512),
        "blk_join": f"WITH {_blocks(512)} SELECT file_id, octet_length(c)::BIGINT AS n, sha256(c) AS sha256 FROM f",
        "compressed_size": f"WITH {_blocks(512)} SELECT file_id, sum(n + 8)::BIGINT AS compressed_size, count(*) AS n_blocks FROM bl GROUP BY file_id",
        "archive_scan": "SELECT coalesce(source, '-') || '/' || coalesce(lang, '-') || '/doc_' || doc_id || '.txt' AS path, 32768 AS flags, octet_length(encode(coalesce(text, '')))::BIGINT AS original_size, (octet_length(encode(coalesce(text, ''))) + 8)::BIGINT AS compressed_size FROM documents",
        "archive_roundtrip": "SELECT coalesce(source, '-') || '/' || coalesce(lang, '-') || '/doc_' || doc_id || '.txt' AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS original_size, sha1(encode(coalesce(text, ''))) AS sha1, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents",
        "config_parse": """WITH l AS (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g') AS line FROM conversations),
s AS (SELECT * FROM (VALUES ('extraction_path', ''), ('filesize_scaling', '1'), ('dark_mode', '1')) t(setting, value))
SELECT conv_id, turn, setting, CASE WHEN setting = 'extraction_path' AND trim(line) <> '' AND NOT starts_with(line, '##') THEN line ELSE value END AS value FROM l CROSS JOIN s""",
        "mtf": _MTF,
        "path_depth": "WITH d AS (SELECT page_id, length(regexp_replace(url, '[^/]', '', 'g'))::BIGINT AS depth FROM pages) SELECT page_id, depth, row_number() OVER (ORDER BY depth, page_id) AS rnk FROM d",
        "list_entries": f"WITH {DOC_TREE}, {_ENTRIES} SELECT is_file, id, name, size, packed, ratio FROM entries",
        "human_size_scaled": _scaled(),
        "human_size_exact": f"SELECT o_orderkey, {_MANTISSA} AS size, format('{{:,}}', CAST(CAST({_MANTISSA} AS FLOAT) AS BIGINT)) || ' B' AS shown FROM orders",
        "add_folder": f"WITH {DOC_TREE} SELECT folder_id, parent_id, name, ord FROM folders UNION ALL SELECT max(folder_id) + 1, 0, 'new folder', max(ord) FILTER (WHERE parent_id = 0) + 1 FROM folders",
        "add_file": f"WITH {DOC_TREE}, o AS (SELECT coalesce(max(ord), 0) AS o FROM files WHERE folder_id = 1) SELECT file_id, folder_id, name, original_size, compressed_size, ord FROM files UNION ALL SELECT page_id + 1000000000, 1, page_id || '.html', octet_length(encode(coalesce(html, ''))), 0, o + row_number() OVER (ORDER BY page_id) FROM pages, o",
        "select_subtree": f"WITH RECURSIVE {NATION_TREE}, t AS (SELECT folder_id FROM folders WHERE folder_id IN (2, 103) UNION SELECT f.folder_id FROM folders f JOIN t ON f.parent_id = t.folder_id) SELECT 'folder' AS kind, folder_id AS id FROM t UNION ALL SELECT 'file', file_id FROM files WHERE folder_id IN (SELECT folder_id FROM t)",
        "folder_paths": f"WITH RECURSIVE {DOC_TREE}, t AS (SELECT folder_id, 'corpus' AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, t.path || '/' || f.name FROM folders f JOIN t ON f.parent_id = t.folder_id) SELECT folder_id, path FROM t",
        "file_paths": f"WITH RECURSIVE {NATION_TREE}, t AS (SELECT folder_id, 'world' AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, t.path || '/' || f.name FROM folders f JOIN t ON f.parent_id = t.folder_id) SELECT file_id, path || '/' || name AS path FROM files JOIN t USING (folder_id)",
        "find_by_name": f"WITH RECURSIVE {NATION_TREE}, t AS (SELECT folder_id, 'world' AS path FROM folders WHERE parent_id IS NULL UNION ALL SELECT f.folder_id, t.path || '/' || f.name FROM folders f JOIN t ON f.parent_id = t.folder_id) SELECT name, min(path || '/' || name) AS path FROM files JOIN t USING (folder_id) GROUP BY name",
        "find_folder": f"WITH {NATION_TREE} SELECT folder_id, parent_id, name FROM folders WHERE parent_id = 0 AND folder_id = 3",
        "ancestors": f"WITH RECURSIVE {NATION_TREE}, t AS (SELECT DISTINCT folder_id FROM files UNION SELECT f.parent_id FROM folders f JOIN t ON f.folder_id = t.folder_id WHERE f.parent_id IS NOT NULL) SELECT folder_id FROM t",
        "flat_paths": f"WITH {DOC_TREE} SELECT file_id, 'out/' || name AS path FROM files",
        "remove_subtree": f"WITH RECURSIVE {NATION_TREE}, t AS (SELECT 3::BIGINT AS folder_id UNION SELECT f.folder_id FROM folders f JOIN t ON f.parent_id = t.folder_id), k AS (SELECT * FROM files WHERE folder_id NOT IN (SELECT folder_id FROM t)) SELECT file_id, folder_id, name, compressed_size, (1 + coalesce(sum(43 + octet_length(encode(name)) + compressed_size) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 43 + octet_length(encode(name)))::BIGINT AS data_location FROM k",
        "dedup_names": f"""WITH {DOC_TREE}, n AS (SELECT file_id, folder_id, ord, CASE file_id % 7 WHEN 0 THEN 'a (1).txt' WHEN 1 THEN 'a (3).txt' ELSE (['a', 'b'])[file_id % 7 % 2 + 1] || '.txt' END AS name FROM files),
t AS (SELECT *, row_number() OVER (PARTITION BY folder_id, name ORDER BY ord, file_id) AS turn, replace(name, '.txt', '') AS stem FROM n),
free AS (SELECT s.folder_id, s.stem, i, row_number() OVER (PARTITION BY s.folder_id, s.stem ORDER BY i) AS j FROM (SELECT folder_id, stem, unnest(range(1, max(turn) + 10)) AS i FROM t GROUP BY folder_id, stem) s WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.folder_id = s.folder_id AND n.name = s.stem || ' (' || i || ').txt'))
SELECT file_id, t.folder_id, name, CASE WHEN turn = 1 THEN name ELSE t.stem || ' (' || i || ').txt' END AS new_name FROM t LEFT JOIN free ON free.folder_id = t.folder_id AND free.stem = t.stem AND free.j = t.turn - 1""",
        "catalog_print": f"""WITH {NATION_TREE}, k AS (SELECT folder_id, [0, ord] AS key, 0 AS depth FROM folders WHERE parent_id IS NULL UNION ALL SELECT folder_id, [1, -1, 0, ord], 1 FROM folders WHERE parent_id = 0 UNION ALL SELECT c.folder_id, [1, -1, 1, -p.ord, 0, c.ord], 2 FROM folders c JOIN folders p ON c.parent_id = p.folder_id WHERE p.parent_id = 0),
l AS (SELECT key, 0 AS sub, repeat('  ', depth) || name || '/' AS line FROM folders JOIN k USING (folder_id) UNION ALL SELECT key, ord, repeat('  ', depth + 1) || name || ' ' || original_size || ' -> ' || compressed_size || ' flags ' || flags FROM files JOIN k USING (folder_id))
SELECT row_number() OVER (ORDER BY key, sub, line) AS rnk, line FROM l""",
        "bwt_sentinel": f"""WITH {_blocks(512)}, q AS (SELECT file_id, block_id, h, unnest(range(0, n + 1))::INT AS pos FROM bl WHERE n > 0),
z AS (SELECT file_id, block_id, string_agg(substr(h, 2 * greatest(pos - 1, 0) + 1, 2), '' ORDER BY substr(h, 2 * pos + 1)) AS l, sum(CASE WHEN substr(h, 2 * pos + 1) < h THEN 1 ELSE 0 END)::BIGINT AS row_ FROM q GROUP BY ALL)
SELECT bl.file_id, bl.block_id, n, coalesce(l || {_le('row_')}, '') AS coded_hex FROM bl LEFT JOIN z USING (file_id, block_id)""",
        "bwt_cyclic": f"""WITH {_blocks(512)}, z AS (SELECT file_id, block_id, string_agg(substr(h, 2 * ((pos + n - 1) % n)::INT + 1, 2), '' ORDER BY substr(h || h, 2 * pos + 1)) AS l, sum(CASE WHEN substr(h || h, 2 * pos + 1) < h || h THEN 1 ELSE 0 END)::BIGINT AS row_ FROM bt GROUP BY ALL)
SELECT bl.file_id, bl.block_id, n, coalesce(l || {_le('row_')}, '') AS coded_hex FROM bl LEFT JOIN z USING (file_id, block_id)""",
        "suffix_array": f"WITH {_blocks(512)}, z AS (SELECT file_id, block_id, string_agg(pos, ',' ORDER BY substr(h, 2 * pos + 1)) AS positions FROM bt GROUP BY ALL) SELECT bl.file_id, bl.block_id, n, coalesce(positions, '') AS positions FROM bl LEFT JOIN z USING (file_id, block_id)",
        "lf_mapping": f"WITH {_blocks(512)}, o AS (SELECT *, row_number() OVER (PARTITION BY file_id, block_id ORDER BY b, pos) - 1 AS lf FROM bt), z AS (SELECT file_id, block_id, string_agg(lf, ',' ORDER BY pos) AS rows FROM o GROUP BY ALL) SELECT bl.file_id, bl.block_id, n, coalesce(rows, '') AS rows FROM bl LEFT JOIN z USING (file_id, block_id)",
        "alphabet_bitmap": f"WITH {_blocks(512)}, u AS (SELECT DISTINCT file_id, block_id, b FROM bt), v AS (SELECT file_id, block_id, b // 8 AS j, sum(1 << (7 - b % 8)) AS v FROM u GROUP BY ALL), w AS (SELECT bl.file_id, bl.block_id, n, j FROM bl, range(0, 32) t(j)) SELECT w.file_id, w.block_id, w.n, string_agg(coalesce(v, 0)::INT, ',' ORDER BY w.j) AS bitmap FROM w LEFT JOIN v USING (file_id, block_id, j) GROUP BY ALL",
        "rle_split": f"WITH {_blocks(512)}, {_RUNS}, z AS (SELECT file_id, block_id, count(*) AS r, string_agg(lpad(lower(hex(len)), 2, '0'), '' ORDER BY run) || string_agg(x, '' ORDER BY run) AS body FROM rr GROUP BY file_id, block_id) {_FLAGGED}",
        "rle_interleaved": f"WITH {_blocks(512)}, {_RUNS}, z AS (SELECT file_id, block_id, count(*) AS r, string_agg(x || lpad(lower(hex(len)), 2, '0'), '' ORDER BY run) AS body FROM rr GROUP BY file_id, block_id) {_FLAGGED}",
        "rle_runs": f"WITH {_blocks(65536)}, {_RUNS} SELECT file_id, block_id, len::INT AS len, count(*) AS n_runs, sum(sym)::BIGINT AS sum_sym, sum(run)::BIGINT AS sum_run FROM rr GROUP BY ALL",
        "rle_inv": f"WITH {_blocks(512)} SELECT file_id, block_id, n, h AS block_hex FROM bl WHERE n > 0",
        "split_alg": "WITH s AS (SELECT o_orderkey, string_split((['BWT+MTF+RLE+AC', 'BWT2', 'MTF+RLE+', '', '+AC2', 'RLE++AC'])[o_orderkey % 6 + 1], '+') AS p FROM orders), t AS (SELECT o_orderkey, CASE WHEN p[-1] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM s) SELECT o_orderkey, array_to_string(p, '|') AS stages, len(p)::INT AS n_stages FROM t",
        "byte_histogram": f"WITH {_blocks(65536)}, {_C0} SELECT file_id, block_id, sym, cnt FROM c",
        "freq_normalize": f"WITH {_blocks(65536)}, {_model0(4096)} SELECT * FROM m WHERE freq <> 0",
        "model_order0": f"WITH {_blocks(65536)}, {_model0(WHOLE)} SELECT * FROM m",
        "model_ans": f"WITH {_blocks(65536)}, {_model0(1 << 32)} SELECT * FROM m",
        "cmf_bounds": f"WITH {_blocks(65536)}, {_model0(WHOLE)}, b AS (SELECT *, sum(freq) OVER (PARTITION BY file_id, block_id ORDER BY sym)::BIGINT AS high FROM m) SELECT file_id, block_id, sym, high - freq AS low, high FROM b",
        "pair_counts": f"WITH {_blocks(65536)}, {_PAIRS} SELECT file_id, block_id, prev, sym, cnt FROM p",
        "model_order1": f"""WITH {_blocks(65536)}, {_PAIRS}, q AS (SELECT *, sum(cnt) OVER (PARTITION BY file_id, block_id, prev)::BIGINT AS r FROM p), f1 AS (SELECT *, (2 * cnt * {WHOLE} + r) // (2 * r) AS f0 FROM q),
g1 AS (SELECT *, {WHOLE} - sum(f0) OVER (PARTITION BY file_id, block_id, prev)::BIGINT AS gap, row_number() OVER (PARTITION BY file_id, block_id, prev ORDER BY sym) AS up, row_number() OVER (PARTITION BY file_id, block_id, prev ORDER BY sym DESC) AS down FROM f1)
SELECT file_id, block_id, prev, sym, f0 + CASE WHEN gap < 0 AND up <= -gap THEN -1 WHEN gap > 0 AND down <= gap THEN 1 ELSE 0 END AS freq FROM g1""",
        "sha1": "SELECT doc_id AS file_id, sha1(encode(coalesce(text, ''))) AS sha1 FROM documents",
        "sha256": "SELECT doc_id AS file_id, sha256(encode(coalesce(text, ''))) AS sha256 FROM documents",
        "checksum_type": "SELECT c_custkey, (['CRC-32', 'SHA-1', 'SHA-256'])[c_custkey % 3 + 1] AS kind FROM customer",
        "verify": "SELECT doc_id AS file_id, doc_id % 50 <> 0 AS valid FROM documents",
        "block_size": f"SELECT o_orderkey, {_FLAGS}::INT AS flags, (16777216 >> (o_orderkey % 16)::INT)::BIGINT AS block_size FROM orders",
        "block_count": f"SELECT o_orderkey, {_SIZE} AS size, greatest(1, ceil({_SIZE} / (16777216 >> (o_orderkey % 16)::INT)))::BIGINT AS blocks FROM orders",
        "blocksize_flags": f"SELECT o_orderkey, {_MEB} AS mebibytes, ((o_orderkey % 8) * 512)::INT AS flags FROM orders",
        "alg_flags": f"SELECT o_orderkey, {_SPECS} AS spec, ([15, 23, 0, 128 + 2 + 4 + 16, 4, 1 + 8])[o_orderkey % 6 + 1]::INT AS flags FROM orders",
        "decode_flags": f"SELECT o_orderkey, {_WORD}::INT AS flags, " + ", ".join(f"({_WORD} >> {b}) & 1 = 1 AS {k.lower().replace('-', '')}" for k, b in (STAGE_BITS | CHECKSUM_BITS).items()) + f", (({_WORD} >> 9) & 15)::INT AS shift FROM orders",
        "elapsed_fmt": f"WITH t AS (SELECT o_orderkey, {_SIZE} AS ms FROM orders) SELECT o_orderkey, ms, (ms // 3600000) || ':' || lpad((ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || (ms // 100 % 10) AS shown FROM t",
        "progress_pct": "WITH t AS (SELECT o_orderkey, o_custkey % 101 AS d, o_orderkey % 101 + o_custkey % 101 AS n FROM orders) SELECT o_orderkey, CASE WHEN n = 0 THEN 100 ELSE round(d * 100 / n)::BIGINT END AS pct FROM t",
        "step_estimate": f"SELECT o_orderkey, (ceil({_SIZE} * 10 / 16777215) * bit_count({_WORD}))::BIGINT AS steps FROM orders",
        "path_parts": "WITH t AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages), u AS (SELECT *, regexp_extract(name, '^.+(\\.[^.]*)$', 1) AS ext FROM t) SELECT page_id, name, substr(name, 1, length(name) - length(ext)) AS stem, ext FROM u",
        "tsv_line": "SELECT c_custkey, concat_ws(chr(9), c_custkey::VARCHAR, coalesce(c_name, ''), c_nationkey::VARCHAR, coalesce(c_mktsegment, '')) AS line FROM customer",
        "alg_permutations": "SELECT o || e AS alg, b AS block_size FROM (SELECT unnest([" + ", ".join(f"'{x}'" for x in _ORDERS) + "]) AS o), (SELECT unnest(['AC', 'AC2']) AS e), (SELECT unnest(['16', '8', '4', '2', '1', '0.5', '0.25', '0.125']) AS b)",
        "bench_min": f"WITH {_RUN_ROWS} SELECT * FROM best",
        "bench_effectiveness": f"WITH {_RUN_ROWS} SELECT program, mode, file, size_packed / size_base::DOUBLE AS effectiveness FROM best",
        "bench_speed": f"WITH {_RUN_ROWS} SELECT program, mode, file, size_base::DOUBLE / (time_pack_us + time_unpack_us) AS speed FROM best",
        "bench_ram": f"WITH {_RUN_ROWS} SELECT program, mode, file, (ram_pack_kb + ram_unpack_kb) * 1000 / size_base::DOUBLE AS ram_use FROM best",
        "bench_pivot": f"WITH {_RUN_ROWS} SELECT program, mode, " + ", ".join(f"max(size_packed / size_base::DOUBLE) FILTER (WHERE file = '{f}') AS {f}" for f in _FILES) + " FROM best GROUP BY program, mode",
        "bench_raw": f"WITH {_RUN_ROWS} SELECT program, mode, " + ", ".join(f"max({c}) FILTER (WHERE file = '{f}') AS {f}_{c}" for f in _FILES for c in ("size_packed", "time_pack_us", "time_unpack_us", "ram_pack_kb", "ram_unpack_kb")) + " FROM best GROUP BY program, mode",
        "bench_sizes": f"WITH {_RUN_ROWS} SELECT file, max(size_base) AS size_base, count(*) AS n_runs FROM runs GROUP BY file",
    }
    for name in ("bwt_sentinel", "bwt_cyclic", "mtf", "rle_split", "rle_interleaved"):
        out[f"{name}_inv"] = _inverse(512)
    for name in ("ac_order0_roundtrip", "ac_order1_roundtrip", "pipeline_default", "pipeline_order1", "pipeline_cyclic"):
        out[name] = _inverse(1 << 24)
    for by in ("name", "size", "packed", "ratio"):
        out[f"sort_by_{by}"], out[f"sort_by_{by}_desc"] = _sort(by, False), _sort(by, True)
    return out
