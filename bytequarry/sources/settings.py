"""Settings by position in a text file: lines that aren't blank and don't begin with ##; three values at most."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The settings in the order of their lines, with what they are unless told.
SETTINGS = (("extraction_path", ""), ("filesize_scaling", "1"), ("dark_mode", "1"))


def parse_settings(lines: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, setting, value) from rows (keys, no, line). A setting without a line has its default; more than three are an error."""
    used = lines.where((F.trim("line") != "") & ~F.col("line").startswith("##"))
    values = F.transform(F.array_sort(F.collect_list(F.struct("no", "line"))), lambda x: x["line"])
    every = lines.select(*keys).distinct() if keys else None
    held = used.groupBy(*keys).agg(values.alias("values"))
    held = every.join(held, list(keys), "left") if keys else held
    n = F.coalesce(F.size("values"), F.lit(0))
    checked = held.withColumn("values", F.when(n > len(SETTINGS), F.raise_error(F.lit("more settings than there are")).cast("array<string>")).otherwise(F.col("values")))
    rows = F.array(*[F.struct(F.lit(k).alias("setting"), F.coalesce(F.try_element_at("values", F.lit(i + 1)), F.lit(default)).alias("value")) for i, (k, default) in enumerate(SETTINGS)])
    return checked.select(*keys, F.inline(rows))


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path, wholetext=True)
    return parse_settings(lines.select(F.posexplode(F.split("value", "\\r?\\n")).alias("no", "line")))


def settings_text(values: dict[str, str] | None = None) -> str:
    """A settings file's text."""
    values = values or {}
    return "".join(f"## {k}\n{values.get(k, default)}\n" for k, default in SETTINGS)


def write_report(report: DataFrame, path: str) -> None:
    """A report as tab-separated values with a header."""
    report.write.mode("overwrite").option("sep", "\t").option("header", "true").csv(path)
