"""The narrow operators on streams: group rows are coded as they come, and bytes are counted per batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallow.operators.residual import map_groups


def map_stream(groups: DataFrame) -> DataFrame:
    """A stream of (gid, vals) -> a stream of (gid, center, lens, codes, code_bytes); stateless."""
    return map_groups(groups).select("gid", "center", "lens", "codes", F.size("codes").alias("code_bytes"))


def append_archives(stream: DataFrame, column: str, path: str, checkpoint: str, bits: int = 10) -> StreamingQuery:
    """Writes one archive per row to Parquet, once each, and stops when the input is drained."""
    from tallow.operators.archive import encode_column

    return encode_column(stream, column, "archive", bits).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
