"""Exclusive prefix sums: one window for the few rows at the top, two levels of windows for all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 4096


def exclusive_scan(df: DataFrame, order: str, value: str, out: str = "offset") -> DataFrame:
    """Adds the sum of all earlier values. All rows meet in one task: for bounded inputs, as the top of the scan below."""
    w = Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(w), F.lit(0)).cast("bigint"))


def exclusive_scan_two_level(df: DataFrame, order: str, value: str, out: str = "offset", fanout: int = FANOUT) -> DataFrame:
    """The same sums for an integer order column, without one task for all rows.

    Rows are dealt by order div fanout; only a total per bucket meets in one window, and where even those
    are many the totals are scanned by the same rule one level up. With the default a task meets 4096 rows, and the one
    at the top a row for 16 million.
    """
    bucketed = df.withColumn("_b", F.expr(f"{order} div {fanout}"))
    totals = bucketed.groupBy("_b").agg(F.sum(value).alias("_t"))
    coarse = totals.withColumn("_bb", F.expr(f"_b div {fanout}"))
    top = exclusive_scan(coarse.groupBy("_bb").agg(F.sum("_t").alias("_tt")), "_bb", "_tt", "_o2").select("_bb", "_o2")
    w2 = Window.partitionBy("_bb").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = coarse.join(top, "_bb").select("_b", (F.col("_o2") + F.coalesce(F.sum("_t").over(w2), F.lit(0))).alias("_o"))
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = F.coalesce(F.sum(value).over(w), F.lit(0))
    return bucketed.join(base, "_b").withColumn(out, (F.col("_o") + local).cast("bigint")).drop("_b", "_o")

