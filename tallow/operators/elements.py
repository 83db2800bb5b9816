"""The element relation (pos, gid, lane, slot, val) and the group relation (gid, vals)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.operators.scan import exclusive_scan_two_level
from tallow.schema import GROUP, LANE


def with_positions(df: DataFrame, key: str, value: str, spread: int = 4096) -> DataFrame:
    """(pos, val): rows numbered from 0 by a unique integer key, without one task for all rows.

    Keys are dealt by key div spread; the offsets of the buckets come from a two-level scan. Rows whose key
    or value is null are not elements.
    """
    rows = df.select(F.col(key).cast("bigint").alias("_k"), F.expr(f"CAST({value} AS BIGINT)").alias("val")).where("_k IS NOT NULL AND val IS NOT NULL")
    rows = rows.withColumn("_kb", F.expr(f"CAST(floor(_k / {spread}D) AS BIGINT)"))
    counts = rows.groupBy("_kb").agg(F.count("*").alias("_n"))
    base = exclusive_scan_two_level(counts, "_kb", "_n", "_base").select("_kb", "_base")
    w = Window.partitionBy("_kb").orderBy("_k")
    return rows.join(base, "_kb").select((F.col("_base") + F.row_number().over(w) - 1).alias("pos"), "val")


def with_geometry(elements: DataFrame) -> DataFrame:
    """Adds gid, lane and slot to (pos, val)."""
    return elements.selectExpr("pos", f"pos div {GROUP} AS gid", f"CAST((pos % {GROUP}) div {LANE} AS INT) AS lane", f"CAST(pos % {LANE} AS INT) AS slot", "val")


def to_groups(elements: DataFrame) -> DataFrame:
    """(gid, vals): at most 512 values a row in order of pos; everything after it is narrow."""
    grouped = elements.groupBy(F.expr(f"pos div {GROUP}").alias("gid")).agg(F.sort_array(F.collect_list(F.struct("pos", "val"))).alias("_e"))
    return grouped.selectExpr("gid", "transform(_e, e -> e.val) AS vals")


def to_elements(groups: DataFrame, *arrays: str) -> DataFrame:
    """One row per element from arrays of equal length in a group row, with pos, gid, lane, slot."""
    rest = [c for c in groups.columns if c not in arrays and c != "gid"]
    exploded = groups.selectExpr("gid", *rest, f"posexplode(arrays_zip({', '.join(arrays)})) AS (_i, _z)")
    return exploded.selectExpr(f"gid * {GROUP} + _i AS pos", "gid", f"CAST(_i div {LANE} AS INT) AS lane", f"CAST(_i % {LANE} AS INT) AS slot", *rest, *(f"_z.{a} AS {a}" for a in arrays))


def settled(df: DataFrame) -> DataFrame:
    """The same rows, computed before what follows: a one-row generate, over which the optimiser does not merge
    projections. Without it an array is computed anew for each element of a lambda that refers to it."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def centred(groups: DataFrame, center: int | None = None) -> DataFrame:
    """Adds the truncated mean of the group, or the given centre for all."""
    return settled(groups.withColumn("center", F.expr("aggregate(vals, 0L, (a, v) -> a + v) div size(vals)") if center is None else F.lit(center).cast("bigint")))
