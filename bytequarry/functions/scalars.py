"""Scalar functions of the archive model as Column expressions: block sizes, flags, sizes for people, paths, times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits of the flag word, and the two named algorithm presets.
STAGE_BITS = {"BWT": 0, "MTF": 1, "RLE": 2, "AC": 3, "AC2": 4, "BWT2": 7}
SHIFT_BITS = (9, 10, 11, 12)
CHECKSUM_BITS = {"SHA-256": 13, "CRC-32": 14, "SHA-1": 15}
PRESETS = {"1": ("BWT", "MTF", "RLE", "AC"), "2": ("BWT", "MTF", "RLE", "AC2")}
LARGEST_BLOCK = 1 << 24
UNITS = ("B", "KB", "MB", "GB", "TB")


def shift_of(flags: Column) -> Column:
    """How often the largest block size is halved: bits 9 to 12 of the flag word."""
    return F.shiftright(flags, 9).bitwiseAND(F.lit(15))


def block_size(flags: Column) -> Column:
    return F.element_at(F.array(*[F.lit(LARGEST_BLOCK >> k).cast("long") for k in range(16)]), shift_of(flags) + 1)


def block_count(size: Column, block: Column) -> Column:
    """Blocks of a file; an empty file has one empty block."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(size / block)).cast("long")


def block_size_flags(mebibytes: Column) -> Column:
    """Flag word for a block size given as text in MiB: 16, 8, 4, 2, 1, 0.5, 0.25 or 0.125; null if none is given."""
    eighths = (mebibytes.try_cast("double") * 8).cast("int")
    out = F.when(mebibytes.isNull(), F.lit(0))
    for k in range(8):
        out = out.when(eighths == 128 >> k, F.lit(k << 9))
    return out.otherwise(F.raise_error(F.concat(F.lit("block size not supported: "), mebibytes)).cast("int"))


def split_stages(text: Column) -> Column:
    """Names between plus signs; one empty name at the end is dropped."""
    parts = F.split(text, "\\+")
    last = F.element_at(parts, -1)
    return F.when(last == "", F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(parts)


def stage_flags(text: Column) -> Column:
    """Flag word for a preset's number or stage names between plus signs; an unknown name is an error."""
    bit = F.create_map(*[F.lit(x) for k, v in STAGE_BITS.items() for x in (k, 1 << v)])
    one = lambda s: F.coalesce(bit[s], F.raise_error(F.concat(F.lit("stage not known: "), s)).cast("int"))
    named = F.aggregate(split_stages(text), F.lit(0), lambda a, s: a.bitwiseOR(one(s)))
    out = F.when(F.coalesce(text, F.lit("")) == "", F.lit(0))
    for k, stages in PRESETS.items():
        out = out.when(text == k, F.lit(sum(1 << STAGE_BITS[s] for s in stages)))
    return out.otherwise(named)


def flag(flags: Column, bit: int) -> Column:
    return F.shiftright(flags, bit).bitwiseAND(F.lit(1)) == 1


def _single(size: Column) -> Column:
    """Single precision. The product keeps Spark from merging this cast with a wider one after it, which would skip the rounding."""
    return size.cast("float") * F.lit(1).cast("float")


def exact_size(size: Column) -> Column:
    """Bytes with thousands commas. Sizes go through single precision, as they are shown."""
    return F.concat(F.format_number(_single(size).cast("double"), 0), F.lit(" B"))


def scaled_size(size: Column) -> Column:
    """Divided by 1000 while above it, up to four times, with one digit after the point; bytes as exact_size has them."""
    value, unit = _single(size), F.lit(0)
    for _ in range(len(UNITS) - 1):
        more = value > 1000
        unit = F.when(more, unit + 1).otherwise(unit)
        value = F.when(more, (value.cast("double") / 1000).cast("float")).otherwise(value)
    tenths = F.round((value.cast("double") * 10).cast("float").cast("double")).cast("long").cast("string")
    long = F.concat(F.substring(tenths, F.lit(1), F.length(tenths) - 1), F.lit("."), F.substring(tenths, F.length(tenths), F.lit(1)), F.lit(" "), F.element_at(F.array(*map(F.lit, UNITS)), unit + 1))
    return F.when(unit > 0, long).otherwise(exact_size(size))


def path_parts(path: Column) -> dict[str, Column]:
    """name (after the last slash), stem and extension (from the last dot, if it isn't the name's first character)."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    ext = F.regexp_extract(name, "^.+(\\.[^.]*)$", 1)
    return {"name": name, "stem": F.substring(name, F.lit(1), F.length(name) - F.length(ext)), "ext": ext}


def elapsed(milliseconds: Column) -> Column:
    """H:MM:SS.t"""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    s = F.floor(milliseconds / 1000)
    return F.concat(F.floor(s / 3600).cast("string"), F.lit(":"), two(F.floor(s / 60) % 60), F.lit(":"), two(s % 60), F.lit("."), (F.floor(milliseconds / 100) % 10).cast("string"))


def progress(done: Column, total: Column) -> Column:
    """Percent done, rounded; all of nothing is 100."""
    return F.when(total == 0, F.lit(100)).otherwise(F.round(done * 100 / total)).cast("long")


def step_estimate(size: Column, flags: Column) -> Column:
    """Steps of a file: blocks of 2**24-1 bytes times the number of bits set."""
    return (F.ceil(size / (LARGEST_BLOCK - 1)) * F.bit_count(flags)).cast("long")


def tsv(columns: Sequence[Column]) -> Column:
    return F.concat_ws("\t", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])


def checksum_kind(text: Column) -> Column:
    """Which checksum a text of this length is; other lengths are an error."""
    n = F.length(text)
    return F.when(n == 10, "CRC-32").when(n == 40, "SHA-1").when(n == 64, "SHA-256").otherwise(F.raise_error(F.concat(F.lit("no checksum is so long: "), n.cast("string"))))


def checksum(content: Column, kind: str) -> Column:
    """Checksum of bytes as text: CRC-32 as 0x and eight hex digits, SHA-1 and SHA-256 as hex."""
    if kind == "CRC-32":
        return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(F.crc32(content))), 8, "0"))
    if kind == "SHA-1":
        return F.sha1(content)
    if kind == "SHA-256":
        return F.sha2(content, 256)
    raise ValueError(f"checksum not known: {kind}")
