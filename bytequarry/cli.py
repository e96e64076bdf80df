"""Packing and unpacking from the command line.

python -m bytequarry.cli --mode=compress --archive=A --fileToAdd=F [--alg=1] [--blockSize=16]
python -m bytequarry.cli --mode=decompress --archive=A --output=FOLDER [--alg=...]

alg: a preset's number, or stages between plus signs in an order of one's own, which unpacking has to be told again.
blockSize: MiB, from 16 down to 0.125 by halves.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .functions.scalars import PRESETS, STAGE_BITS
from .operators.codecs import stages_of
from .shared import session
from .sources.archives import pack
from .sources.container import register, store_of, unpack


def flags_of(alg: str | None, block_size: str | None) -> int:
    """The flag word of an algorithm's and a block size's text; 0 for what isn't given."""
    names = stages_of(alg) if alg else []
    if unknown := [s for s in names if s not in STAGE_BITS]:
        raise ValueError(f"stages without a flag: {unknown}")
    shifts = {128 >> k: k for k in range(8)}
    eighths = int(float(block_size) * 8) if block_size else 128
    if eighths not in shifts:
        raise ValueError(f"block size not supported: {block_size}")
    return sum(1 << STAGE_BITS[s] for s in set(names)) | shifts[eighths] << 9


def uri_of(path: str) -> str:
    return path if "://" in path else f"file://{os.path.abspath(path)}"


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="bytequarry", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter, allow_abbrev=False)
    parser.add_argument("--mode", required=True, choices=("compress", "decompress"))
    parser.add_argument("--archive", required=True)
    for name in ("fileToAdd", "output", "alg", "blockSize"):
        parser.add_argument(f"--{name}")
    given = parser.parse_args(argv)
    needed = ("archive", "fileToAdd") if given.mode == "compress" else ("archive", "output")
    for name in needed:
        if not getattr(given, name):
            parser.error(f"no {name} given")
    stages = given.alg if given.alg and given.alg not in PRESETS else None
    own, archive = spark is None, uri_of(given.archive)
    try:
        flags = flags_of(given.alg, given.blockSize) if given.mode == "compress" else 0
    except ValueError as e:
        parser.error(str(e))
    spark = spark or session()
    try:
        if given.mode == "compress":
            file = uri_of(given.fileToAdd)
            pack(spark, [(file.rpartition("/")[2], file)], archive, flags, stages)
            return
        register(spark)
        read = spark.read.format("bytecontainer")
        target = uri_of(given.output)
        store, path = store_of(target)
        store.create_dir(path, recursive=True)
        unpack((read.option("stages", stages) if stages else read).load(archive), target, stem=True)
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    main()
