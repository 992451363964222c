"""Which line of which file is wrong, for files that are read in splits.

A split knows how many lines it holds, not how many stand before it. Rows of a split are numbered as
they are read; one aggregate per split (a row for each, whatever the number of lines) gives its line
count, and a running sum over a file's splits, in the order of their first byte, the lines before it. A
line's number is that sum plus its number in the split.

Defined results: blank lines (nothing but white space) are counted but not checked, as in a plain
loop over the lines; a line is wrong when it is not exactly one JSON document; line ends are those of
the text reader (\\n, \\r\\n, \\r). Files are ordered by path. Empty files and no files give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbiter.functions.json import valid_json
from arbiter.functions.text import preview, py_strip
from arbiter.sources.records import RECORD_SCHEMA

REASON = "invalid JSON"


class BadLine(ValueError):
    """A line that is no record: ``file``, ``line`` (from 1) and ``reason``."""

    def __init__(self, file: str, line: int, reason: str):
        super().__init__(f"{file}:{line}: {reason}")
        self.file, self.line, self.reason = file, line, reason


def split_lines(spark: SparkSession, paths) -> DataFrame:
    """(value, file, block, seq): lines with the split they were read in and their order there."""
    return spark.read.text(paths).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("seq"),
    )


def wrong(value: Column) -> Column:
    text = py_strip(value)
    return (text != "") & ~valid_json(text)


def split_table(lines: DataFrame) -> DataFrame:
    """One row per split: file, block, first (seq of its first line), before (lines of the file before
    it) and ``bad``, the seq of its first wrong line."""
    each = lines.groupBy("file", "block").agg(
        F.count("value").alias("n"), F.min("seq").alias("first"),
        F.min(F.when(wrong(F.col("value")), F.col("seq"))).alias("bad"),
    )
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))


def _line(seq: str) -> Column:
    return (F.col("before") + F.col(seq) - F.col("first") + 1).alias("line")


def wrong_lines(spark: SparkSession, paths) -> DataFrame:
    """(file, line, reason, text): every wrong line, ``text`` being its first 80 characters."""
    lines = split_lines(spark, paths)
    bad = lines.where(wrong(F.col("value")))
    return bad.join(split_table(lines).drop("bad", "n"), ["file", "block"]).select(
        "file", _line("seq"), F.lit(REASON).alias("reason"), preview(F.col("value"), 80).alias("text")
    )


def first_wrong_line(spark: SparkSession, paths) -> tuple[str, int] | None:
    """(file, line) of the first wrong line in path order, in one scan; None when all are right."""
    one = split_table(split_lines(spark, paths)).where("bad IS NOT NULL").select("file", _line("bad"))
    found = one.agg(F.min(F.struct("file", "line")).alias("m")).first()["m"]
    return (found["file"], found["line"]) if found else None


def load_records(spark: SparkSession, paths, schema: str = RECORD_SCHEMA) -> DataFrame:
    """Records of JSON lines files; raises ``BadLine`` for the first wrong line before any is used."""
    found = first_wrong_line(spark, paths)
    if found:
        raise BadLine(*found, REASON)
    lines = spark.read.text(paths).where(py_strip(F.col("value")) != "")
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")
