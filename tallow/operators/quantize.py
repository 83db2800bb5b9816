"""Integer quantisation of a byte distribution to weights that sum to 2^bits, its cumulative table and decode table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.schema import check_prob_bits


def quantize_counts(counts: np.ndarray, bits: int) -> np.ndarray:
    """Weights for 256 counts; all zero where nothing was counted."""
    total, want = int(counts.sum()), 1 << check_prob_bits(bits)
    if not total:
        return np.zeros(256, np.int64)
    share = counts.astype(np.float32) / np.float32(total)
    q = np.maximum((np.float32(want) * share).astype(np.int64), counts > 0)
    short = want - int(q.sum())
    if short >= 0:
        return q + (np.arange(256) < short)
    # Lower everything above 1 by the largest whole number of rounds, then the lowest-ranked once more.
    room, over = np.maximum(q - 1, 0), -short
    levels = np.minimum(room[None, :], np.arange(want + 1)[:, None]).sum(1)
    rounds = int(np.searchsorted(levels, over, side="right")) - 1
    left, lowered = over - int(levels[rounds]), np.where(q > 0, np.maximum(q - rounds, 1), 0)
    order = np.lexsort((-np.arange(256), -q))  # by weight, then by symbol, both descending
    able = order[lowered[order] > 1]
    if left:
        lowered[able[-left:]] -= 1
    return lowered


def raw_weights(histogram: DataFrame, bits: int) -> DataFrame:
    """(sym, cnt) -> (sym, cnt, q): truncated single-precision shares, at least 1 where a symbol occurs."""
    want = 1 << check_prob_bits(bits)
    total = histogram.agg(F.sum("cnt").alias("_total"))
    share = "CAST(CAST(CAST(cnt AS FLOAT) AS DOUBLE) / CAST(CAST(_total AS FLOAT) AS DOUBLE) AS FLOAT)"
    q = f"CASE WHEN cnt = 0 OR _total = 0 THEN 0L ELSE greatest(1L, CAST(floor({want} * CAST({share} AS DOUBLE)) AS BIGINT)) END"
    return histogram.join(F.broadcast(total)).withColumn("q", F.expr(q)).drop("_total")


def quantize(histogram: DataFrame, bits: int) -> DataFrame:
    """(sym, cnt) of 256 rows -> (sym, cnt, q, pdf), all declarative. The input is 256 rows at any scale."""
    want = 1 << check_prob_bits(bits)
    q = raw_weights(histogram, bits)
    level = f"explode(sequence(0, {want})) AS r"
    rounds = (
        q.where("q > 1").selectExpr("q", level).groupBy("r").agg(F.sum(F.expr("least(q - 1, r)")).alias("c"))
        .join(F.broadcast(q.agg(F.sum("q").alias("_s"))), F.expr(f"c <= _s - {want}"))
        .agg(F.max("r").alias("_r"), F.max("c").alias("_c"))
    )
    facts = q.agg(F.sum("q").alias("_sum")).join(F.broadcast(rounds))
    base = q.join(F.broadcast(facts)).withColumn("_low", F.expr(f"CASE WHEN _sum > {want} AND q > 0 THEN greatest(q - _r, 1L) ELSE q END"))
    w = Window.partitionBy(F.expr("_low > 1")).orderBy(F.col("q").asc(), F.col("sym").asc())
    ranked = base.withColumn("_k", F.row_number().over(w))
    pdf = f"CASE WHEN _sum = 0 THEN 0L WHEN _sum <= {want} THEN q + CAST(sym < {want} - _sum AS BIGINT) ELSE _low - CAST(_low > 1 AND _k <= _sum - {want} - _c AS BIGINT) END"
    return ranked.select("sym", "cnt", "q", F.expr(pdf).alias("pdf"))


def coder_table(weights: DataFrame) -> DataFrame:
    """(sym, pdf) -> (sym, pdf, cdf, magic, shift); magic and shift are null where pdf is 0."""
    w = Window.orderBy("sym").rowsBetween(Window.unboundedPreceding, -1)
    shift = "CASE WHEN pdf = 0 THEN NULL WHEN pdf = 1 THEN 0 ELSE length(bin(pdf - 1)) END"
    rows = weights.select("sym", "pdf", F.coalesce(F.sum("pdf").over(w), F.lit(0)).cast("bigint").alias("cdf"), F.expr(shift).alias("shift"))
    magic = "CASE WHEN pdf = 0 THEN NULL ELSE (4294967296L * (shiftleft(1L, shift) - pdf)) div pdf + 1 END"
    return rows.select("sym", "pdf", "cdf", F.expr(magic).alias("magic"), "shift")


def decode_table(table: DataFrame) -> DataFrame:
    """(slot, sym, pdf, s_minus_cdf, packed): one row per slot of the state's low bits."""
    rows = table.where("pdf > 0").selectExpr("sym", "pdf", "cdf", "explode(sequence(cdf, cdf + pdf - 1)) AS slot")
    return rows.selectExpr("slot", "sym", "pdf", "slot - cdf AS s_minus_cdf", "shiftleft(slot - cdf, 20) | shiftleft(pdf, 8) | sym AS packed")
