"""Raw lines with a position that follows file order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A position is file number, byte offset of the split and row within the scan, packed in one
# decimal of 9 + 14 + 11 digits. Unlike a struct, a decimal aggregates in the hash aggregate.
_ROW_SPAN = 10**11
_OFFSET_SPAN = 10**14
_ROWS_PER_CHUNK = 65_536


def _packed(file_number, offset, row):
    wide = "decimal(38,0)"
    high = (file_number.cast(wide) * F.lit(_OFFSET_SPAN).cast("decimal(15,0)")).cast(wide) + offset.cast(wide)
    return ((high.cast("decimal(24,0)") * F.lit(_ROW_SPAN).cast("decimal(12,0)")) + row.cast(wide)).cast(wide)


def chunk_of(position):
    """The split a position belongs to. Bounded by the split size, so safe to order within."""
    return F.floor(position / F.lit(_ROW_SPAN).cast("decimal(12,0)"))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(line_pos, line)`` of text files, one row per line, ordered by file name and offset.

    No shuffle and no second scan: Spark hands out the splits of a file in any order, but within
    one split the row counter grows with the line, and the split offset does the rest. The list
    of file names is what the driver holds already to plan the scan.
    """
    raw = spark.read.text(path)
    names = sorted(raw.inputFiles())
    if not names:
        raise FileNotFoundError(f"no input files under {path}")
    scanned = raw.select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("file_path"),
        F.col("_metadata.file_block_start").alias("offset"),
        F.monotonically_increasing_id().alias("row"),
    )
    in_partition = F.col("row").bitwiseAND(F.lit(2**33 - 1))
    if len(names) == 1:
        return scanned.select(_packed(F.lit(0), F.col("offset"), in_partition).alias("line_pos"), "line")
    # The file list writes local paths with more slashes than the scan does.
    same_form = [re.sub("^file:/+", "file:/", name) for name in names]
    numbers = spark.createDataFrame(list(enumerate(same_form)), "file_number int, file_path string")
    number = F.coalesce("file_number", F.raise_error(F.concat(F.lit("unlisted file "), "file_path")).cast("int"))
    return scanned.join(F.broadcast(numbers), "file_path", "left").select(
        _packed(number, F.col("offset"), in_partition).alias("line_pos"), "line"
    )


def first_lines(spark: SparkSession, path: str | list[str], wanted: int, keep) -> list:
    """The first ``wanted`` rows that ``keep(lines)`` lets through, read file by file so that
    only the head of the input is scanned."""
    names = sorted(spark.read.text(path).inputFiles())
    found: list = []
    for name in names:
        head = keep(read_lines(spark, name)).limit(wanted - len(found)).collect()
        found.extend(sorted(head, key=lambda row: row["line_pos"]))
        if len(found) >= wanted:
            break
    return found


def number_lines(df: DataFrame, line_number: str, line: str = "line") -> DataFrame:
    """Give lines that already carry a unique number the same shape as :func:`read_lines`."""
    number = F.col(line_number).cast("bigint")
    offset = F.floor(number / _ROWS_PER_CHUNK).cast("bigint")
    row = F.pmod(number, F.lit(_ROWS_PER_CHUNK))
    return df.select(_packed(F.lit(0), offset, row).alias("line_pos"), F.col(line).alias("line"))
