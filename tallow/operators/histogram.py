"""Byte histogram: a partial count per Arrow batch or exploded bytes, then one small aggregate."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def symbols(spark: SparkSession) -> DataFrame:
    """The dense 0..255 spine."""
    return spark.range(256).select(F.col("id").cast("int").alias("sym"))


def byte_histogram(df: DataFrame, column: str) -> DataFrame:
    """(sym, cnt) with zero counts, over all bytes of a BINARY or STRING column; null adds nothing.

    Bytes are never exploded into rows: each batch yields at most 256 counts, which are then summed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256, np.int64)
        for b in batches:
            for x in b.column(0):
                if x.is_valid:
                    total += np.bincount(np.frombuffer(x.as_buffer(), np.uint8), minlength=256)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["sym", "cnt"])

    partial = df.select(F.col(column).cast("binary")).mapInArrow(run, "sym int, cnt bigint")
    counts = partial.groupBy("sym").agg(F.sum("cnt").alias("cnt"))
    return symbols(df.sparkSession).join(counts, "sym", "left").select("sym", F.coalesce("cnt", F.lit(0)).cast("bigint").alias("cnt"))
