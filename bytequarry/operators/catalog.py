"""The catalog of folders and files: listing, sorting, subtrees, paths, adding, removing, renaming.

folders: folder_id, parent_id (null for the root), name, ord (place among siblings)
files:   file_id, folder_id, name, flags, original_size, compressed_size, ord

Trees are walked by doubling: each step joins what is known of a node with what is known of the node it has reached,
so a tree of depth d takes log2(d) joins and no loop over nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import saved
from .order import in_order, ranked

#: Bytes of a record besides its name.
FOLDER_RECORD, FILE_RECORD = 33, 43


def _doubled(state: DataFrame, join) -> DataFrame:
    """Repeats state := join(state) until no node has anything above (column up) left."""
    state = saved(state)
    while state.where("up is not null").limit(1).count():
        state = saved(join(state))
    return state


def folder_paths(folders: DataFrame, sep: str = "/") -> DataFrame:
    """(folder_id, path, ords): names and places from the root down. The root gives its stem, the name less its extension."""
    name = F.when(F.col("parent_id").isNull(), F.regexp_replace("name", "(?<=.)\\.[^.]*$", "")).otherwise(F.col("name"))
    start = folders.select("folder_id", F.col("parent_id").alias("up"), name.alias("path"), F.array("ord").alias("ords"))

    def join(s: DataFrame) -> DataFrame:
        above = s.select(F.col("folder_id").alias("up"), F.col("up").alias("up_"), F.col("path").alias("path_"), F.col("ords").alias("ords_"))
        joined = s.join(above, "up", "left")
        path = F.when(F.col("path_").isNull(), F.col("path")).otherwise(F.concat("path_", F.lit(sep), "path"))
        ords = F.when(F.col("ords_").isNull(), F.col("ords")).otherwise(F.concat("ords_", "ords"))
        return joined.select("folder_id", F.col("up_").alias("up"), path.alias("path"), ords.alias("ords"))

    return _doubled(start, join).select("folder_id", "path", "ords")


def file_paths(folders: DataFrame, files: DataFrame, sep: str = "/") -> DataFrame:
    return files.join(folder_paths(folders, sep).select("folder_id", F.col("path").alias("folder_path")), "folder_id").select("file_id", F.concat("folder_path", F.lit(sep), "name").alias("path"))


def flat_paths(files: DataFrame, target: str, sep: str = "/") -> DataFrame:
    """Every file goes to the target folder itself."""
    return files.select("file_id", F.concat(F.lit(target + sep), F.col("name")).alias("path"))


def subtree(folders: DataFrame, chosen: Column) -> DataFrame:
    """(folder_id) of the chosen folders and all below them, each once."""
    start = folders.select("folder_id", F.col("parent_id").alias("up"), F.coalesce(chosen, F.lit(False)).alias("in"))

    def join(s: DataFrame) -> DataFrame:
        above = s.select(F.col("folder_id").alias("up"), F.col("up").alias("up_"), F.col("in").alias("in_"))
        return s.join(above, "up", "left").select("folder_id", F.col("up_").alias("up"), (F.col("in") | F.coalesce("in_", F.lit(False))).alias("in"))

    return _doubled(start, join).where("in").select("folder_id")


def select_subtree(folders: DataFrame, files: DataFrame, chosen: Column) -> DataFrame:
    """(kind, id) of the chosen folders, all below them and their files."""
    own = subtree(folders, chosen)
    inside = files.join(own, "folder_id", "left_semi")
    return own.select(F.lit("folder").alias("kind"), F.col("folder_id").alias("id")).union(inside.select(F.lit("file"), "file_id"))


def ancestors(folders: DataFrame, files: DataFrame, chosen: Column) -> DataFrame:
    """(folder_id) of all folders that a chosen file lies in, directly or not."""
    start = folders.select("folder_id", F.col("parent_id").alias("up"), F.array("folder_id").alias("line"))

    def join(s: DataFrame) -> DataFrame:
        above = s.select(F.col("folder_id").alias("up"), F.col("up").alias("up_"), F.col("line").alias("line_"))
        line = F.when(F.col("line_").isNull(), F.col("line")).otherwise(F.concat("line", "line_"))
        return s.join(above, "up", "left").select("folder_id", F.col("up_").alias("up"), line.alias("line"))

    lines = _doubled(start, join).select("folder_id", "line")
    used = files.where(chosen).select("folder_id").distinct()
    return lines.join(used, "folder_id", "left_semi").select(F.explode("line").alias("folder_id")).distinct()


def find_file(files: DataFrame, folder: int, file_id: int) -> DataFrame:
    """The file of this id if it lies directly in the folder."""
    return files.where((F.col("folder_id") == folder) & (F.col("file_id") == file_id))


def find_folder(folders: DataFrame, parent: int, folder_id: int) -> DataFrame:
    """The folder of this id if its parent is the given one."""
    return folders.where((F.col("parent_id") == parent) & (F.col("folder_id") == folder_id))


def find_by_name(paths: DataFrame) -> DataFrame:
    """(name, path): for every last name the first path, by order, that ends in it."""
    return paths.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("name")).agg(F.min("path").alias("path"))


def entries(folders: DataFrame, files: DataFrame) -> DataFrame:
    """Folders and files in one list: parent, is_file, id, name, size, packed, ratio (null for folders)."""
    ratio = F.when(F.col("compressed_size") > 0, F.col("original_size").cast("double") / F.col("compressed_size"))
    listed = files.select(F.col("folder_id").alias("parent"), F.lit(1).alias("is_file"), F.col("file_id").alias("id"), "name", F.col("original_size").alias("size"), F.col("compressed_size").alias("packed"), ratio.alias("ratio"))
    none = lambda kind: F.lit(None).cast(kind)
    return folders.select(F.col("parent_id").alias("parent"), F.lit(0).alias("is_file"), F.col("folder_id").alias("id"), "name", none("long").alias("size"), none("long").alias("packed"), none("double").alias("ratio")).union(listed)


def sorted_entries(listed: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """Entries with rnk, their place in their folder by name, size, packed or ratio. Folders always stand before files,
    by name in the sort's direction; equal keys follow by name, then id."""
    way = F.desc_nulls_last if descending else F.asc_nulls_first
    key = [way("name")] if by == "name" else [way(by), way("name")]
    if by != "name":
        key[1] = F.when(F.col("is_file") == 1, F.col("name")).asc_nulls_first()
        key.insert(0, F.when(F.col("is_file") == 0, F.col("name")).desc_nulls_last() if descending else F.when(F.col("is_file") == 0, F.col("name")).asc_nulls_first())
    return ranked(listed, ["parent"], [F.col("is_file").asc(), *key, F.col("id").asc()])


def add_folder(folders: DataFrame, parent: int, name: str) -> DataFrame:
    """A new folder at the end of its parent's; its id is one above the greatest."""
    last = folders.agg(F.max("folder_id").alias("id"), F.max(F.when(F.col("parent_id") == parent, F.col("ord"))).alias("o"))
    new = last.select((F.col("id") + 1).alias("folder_id"), F.lit(parent).cast("long").alias("parent_id"), F.lit(name).alias("name"), (F.coalesce("o", F.lit(0)) + 1).alias("ord"))
    return folders.unionByName(new.select(*[F.col(c).cast(folders.schema[c].dataType).alias(c) for c in folders.columns]))


def add_files(files: DataFrame, new: DataFrame, folder: int) -> DataFrame:
    """New files (file_id, path, original_size) at the end of a folder's, in order of file_id, under the paths' last names."""
    end = files.where(F.col("folder_id") == folder).agg(F.coalesce(F.max("ord"), F.lit(0))).first()[0]
    placed = in_order(new, [F.col("file_id")])
    row = {"folder_id": F.lit(folder), "name": F.regexp_extract("path", "([^/]*)$", 1), "flags": F.lit(0), "compressed_size": F.lit(0), "ord": F.lit(end) + F.col("pos") + 1}
    return files.unionByName(placed.select(*[row.get(c, F.col(c) if c in new.columns else F.lit(None)).cast(files.schema[c].dataType).alias(c) for c in files.columns]))


def remove_subtree(folders: DataFrame, files: DataFrame, chosen: Column) -> tuple[DataFrame, DataFrame]:
    """(folders, files) without the chosen subtrees. Blocks are kept as they are; only offsets change (see with_offsets)."""
    gone = subtree(folders, chosen)
    return folders.join(gone, "folder_id", "left_anti"), files.join(gone, "folder_id", "left_anti")


def with_offsets(files: DataFrame, start: int = 1) -> DataFrame:
    """Files with data_location: where a file's data stands if records and data follow each other by file_id from start."""
    record = F.lit(FILE_RECORD) + F.octet_length("name")
    placed = in_order(files, [F.col("file_id")], record + F.col("compressed_size"))
    return placed.select(*files.columns, (F.lit(start) + F.col("before") + record).cast("long").alias("data_location"))


def unique_names(files: DataFrame) -> DataFrame:
    """Files with new_name. Of the files of one name in a folder, the first by ord keeps it; the others become
    `stem (n)ext` with the smallest n, from 1, that no other file's first use of a name has taken."""
    turn = ranked(files, ["folder_id", "name"], [F.col("ord"), F.col("file_id")], "turn")
    ext = F.regexp_extract("name", "^.+(\\.[^.]*)$", 1)
    turn = saved(turn.withColumn("ext", ext).withColumn("stem", F.substring("name", F.lit(1), F.length("name") - F.length("ext"))))
    # Numbers taken by names that are written like that already: the j-th free number is j plus how many of them lie below.
    number = F.regexp_extract("stem", "^(?:.*) \\(([1-9][0-9]{0,8})\\)$", 1)
    own = turn.where("turn = 1").withColumn("number", number).where("number <> ''")
    own = own.select("folder_id", F.regexp_extract("stem", "^(.*) \\([1-9][0-9]{0,8}\\)$", 1).alias("stem"), "ext", F.col("number").cast("long").alias("number"))
    doubled = turn.where("turn > 1").select("folder_id", "stem", "ext").distinct()
    taken = own.join(doubled, ["folder_id", "stem", "ext"], "left_semi").groupBy("folder_id", "stem", "ext").agg(F.array_sort(F.collect_set("number")).alias("taken"))
    gaps = F.transform("taken", lambda t, i: t - i - 1)  # free numbers below each taken one
    joined = turn.join(taken.select("folder_id", "stem", "ext", gaps.alias("gaps")), ["folder_id", "stem", "ext"], "left")
    j = F.col("turn") - 1
    n = j + F.coalesce(F.size(F.filter("gaps", lambda g: g < j)), F.lit(0))
    n = F.when(F.col("gaps").isNull(), j).otherwise(n)
    new = F.when(F.col("turn") == 1, F.col("name")).otherwise(F.concat("stem", F.lit(" ("), n.cast("string"), F.lit(")"), "ext"))
    return joined.select(*files.columns, new.alias("new_name"))


def printed(folders: DataFrame, files: DataFrame) -> DataFrame:
    """(rnk, line): a dump in the order itself, its files, its siblings, its folders.

    All siblings come before any of their folders, and the folders of the last sibling before those of the first.
    """
    ords = F.transform("ords", lambda o: o.cast("long"))
    deep = F.flatten(F.transform(F.slice(ords, 1, F.size("ords") - 1), lambda o: F.array(F.lit(1).cast("long"), -o)))
    key = F.concat(deep, F.array(F.lit(0).cast("long"), F.element_at(ords, -1)))
    placed = folder_paths(folders).select("folder_id", key.alias("key"), F.size("ords").alias("depth"))
    own = folders.join(placed, "folder_id").select("key", F.lit(0).cast("long").alias("sub"), F.concat(F.repeat(F.lit("  "), F.col("depth") - 1), "name", F.lit("/")).alias("line"))
    theirs = files.join(placed, "folder_id").select("key", F.col("ord").cast("long").alias("sub"), F.format_string("%s%s %d -> %d flags %d", F.repeat(F.lit("  "), F.col("depth")), "name", "original_size", "compressed_size", "flags").alias("line"))
    return in_order(own.union(theirs), [F.col("key"), F.col("sub"), F.col("line")]).select((F.col("pos") + 1).alias("rnk"), "line")
