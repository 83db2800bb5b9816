"""Whole-file compression: raw files to archives and back, under the same relative names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallow.operators.archive import decode_column, encode_column
from tallow.operators.bytestream import split_code_signal
from tallow.sources.raw import read_bytes, write_blobs


def relative_name(path: str) -> Column:
    """What follows the folder that is read, or the last part of a file's path."""
    root = path.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    at = F.instr("path", root)
    return F.when(at > 0, F.expr(f"substring(path, instr(path, '{root}') + {len(root)})")).otherwise(F.element_at(F.split("path", "/"), -1))


def encode_file(spark: SparkSession, path: str, out: str, bits: int = 10, pattern: str | None = None) -> DataFrame:
    """Writes <name>.rc for each file and returns (name, raw, stored)."""
    rows = encode_column(read_bytes(spark, path, pattern), "content", "archive", bits).withColumn("name", relative_name(path))
    write_blobs(rows.select(F.concat("name", F.lit(".rc")).alias("name"), F.col("archive").alias("content")), out)
    return rows.select("name", F.col("length").alias("raw"), F.length("archive").cast("bigint").alias("stored"))


def decode_file(spark: SparkSession, path: str, out: str) -> None:
    rows = decode_column(read_bytes(spark, path, "*.rc"), "content", "data").withColumn("name", relative_name(path))
    write_blobs(rows.select(F.regexp_replace("name", r"\.rc$", "").alias("name"), F.col("data").alias("content")), out)


def write_code_signal(mapped: DataFrame, path: str, per: int = 2048) -> None:
    """The two-file form of mapped groups: code.bin and signal.bin, bytes in order of position, in parts of `per` groups."""
    parts = split_code_signal(mapped).groupBy(F.expr(f"gid div {per}").alias("part")).agg(F.sort_array(F.collect_list(F.struct("gid", "codes", "signals"))).alias("g"))
    for name, column in (("code", "codes"), ("signal", "signals")):
        content = f"unhex(array_join(transform(flatten(g.{column}), x -> lpad(hex(x), 2, '0')), ''))"
        write_blobs(parts.select(F.format_string(f"{name}.bin/%010d", "part").alias("name"), F.expr(content).alias("content")), path)
