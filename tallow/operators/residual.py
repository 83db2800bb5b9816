"""Residual mapping of groups, its inverse, and the bit signal of each lane."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.functions import residual as R
from tallow.operators.elements import centred, settled
from tallow.schema import GROUP, LANE, LANES


def map_groups(groups: DataFrame, center: int | None = None) -> DataFrame:
    """(gid, vals) -> (gid, vals, center, lens, codes); narrow. A supplied centre replaces the group mean."""
    lens, codes = (f"transform(vals, v -> {f('v', 'center')})" for f in (R.signal, R.code))
    return settled(centred(groups, center).selectExpr("gid", "vals", "center", f"{lens} AS lens", f"{codes} AS codes"))


def unmap_groups(mapped: DataFrame) -> DataFrame:
    """(gid, center, lens, codes) -> (gid, vals); narrow."""
    return mapped.select("gid", F.expr(f"zip_with(codes, lens, (k, l) -> {R.value('k', 'l', 'center')})").alias("vals"))


def lanes(mapped: DataFrame, *more: str) -> DataFrame:
    """(gid, lane, lens, bits): one row per lane that has elements; bits is the sum of the lane's signals. `more`: columns
    of the group to keep."""
    lane = f"explode(transform(sequence(0, (size(lens) - 1) div {LANE}), i -> struct(i AS lane, slice(lens, i * {LANE} + 1, {LANE}) AS lens))) AS l"
    return mapped.selectExpr("gid", *more, lane).selectExpr("gid", *more, "l.lane AS lane", "l.lens AS lens", "aggregate(l.lens, 0L, (a, x) -> a + x) AS bits")


#: Bytes that each lane of the group takes.
SIG_LEN = f"(array_max(transform(sequence(0, (size(lens) - 1) div {LANE}), i -> aggregate(slice(lens, i * {LANE} + 1, {LANE}), 0L, (a, x) -> a + x))) + 7) div 8"


def signal_lengths(mapped: DataFrame) -> DataFrame:
    """(gid, sig_len); narrow, no shuffle."""
    return mapped.select("gid", F.expr(SIG_LEN).alias("sig_len"))


#: Bit text of a lane: 1 and len-1 zeros for each element; ones follow to the end of the byte in which the next
#: bit would stand, then zero bytes, so that the zeros of the last element always end at a one or at the end.
LANE_BITS = "array_join(transform(lens, l -> rpad('1', CAST(l AS INT), '0')), '')"


#: How a lane is written to the group's length: ones to the end of the byte where the next bit would stand, then zeros; or
#: ones to the end, as the older form has it, whose last element then ends at a one too.
PADDED = {
    "byte": "rpad(rpad(_bits, CAST(least(bits div 8 + 1, sig_len) * 8 AS INT), '1'), CAST(8 * sig_len AS INT), '0')",
    "ones": "rpad(_bits, CAST(8 * sig_len AS INT), '1')",
}


def lane_hex(mapped: DataFrame, padding: str = "byte") -> DataFrame:
    """(gid, lane, n, hex): the lane's signal bytes, written to the length of the group, and its number of elements; narrow."""
    rows = lanes(settled(mapped.select("gid", "lens", F.expr(SIG_LEN).alias("sig_len"))), "sig_len").withColumn("_bits", F.expr(LANE_BITS))
    rows = settled(rows.withColumn("_full", F.expr(PADDED[padding])).selectExpr("gid", "lane", "size(lens) AS n", "sig_len", "_full"))
    byte = "lpad(conv(substr(_full, 8 * i + 1, 8), 2, 16), 2, '0')"
    return rows.select("gid", "lane", "n", F.expr(f"array_join(transform(sequence(0, CAST(sig_len AS INT) - 1), i -> {byte}), '')").alias("hex"))


def restore_lane(lane_rows: DataFrame) -> DataFrame:
    """(gid, lane, hex, n) -> (gid, lane, lens): the zeros that follow each of the first n ones."""
    bits = "array_join(transform(sequence(0, length(hex) div 2 - 1), i -> lpad(conv(substr(hex, 2 * i + 1, 2), 16, 2), 8, '0')), '')"
    return settled(lane_rows.select("gid", "lane", "n", F.expr(bits).alias("_b"))).select("gid", "lane", F.expr("transform(slice(split(_b, '1'), 2, n), z -> CAST(length(z) + 1 AS BIGINT))").alias("lens"))


def pack(lens: np.ndarray) -> tuple[int, bytes]:
    """Signal length and bytes of a whole group of 32 lanes; lanes without elements are FF then zeros."""
    padded = np.zeros(GROUP, np.int64)
    padded[: len(lens)] = lens
    by_lane = padded.reshape(LANES, LANE)
    total = by_lane.sum(1)
    size = int(-(-total.max() // 8))
    bits = np.zeros((LANES, size * 8), np.uint8)
    starts = np.cumsum(by_lane, 1) - by_lane
    lane, slot = np.nonzero(by_lane)
    bits[lane, starts[lane, slot]] = 1
    column = np.arange(size * 8)
    bits[(column >= total[:, None]) & (column < (total // 8 * 8 + 8)[:, None])] = 1
    return size, np.packbits(bits, axis=1).tobytes()


def unpack(signals: bytes, n: int) -> np.ndarray:
    """The inverse of pack() for n elements."""
    rows = np.unpackbits(np.frombuffer(signals, np.uint8).reshape(LANES, -1), axis=1)
    lens = np.empty(n, np.int64)
    for lane in range(-(-n // LANE)):
        k = min(LANE, n - lane * LANE)
        ones = np.flatnonzero(rows[lane])
        ends = np.append(ones, rows.shape[1])[1 : k + 1]
        lens[lane * LANE : lane * LANE + k] = ends - ones[:k]
    return lens


PACKED = "gid bigint, center bigint, sig_len bigint, n int, codes binary, signals binary"


def pack_groups(mapped: DataFrame) -> DataFrame:
    """Bulk form: (gid, center, lens, codes) -> one row per group with packed bytes; narrow, Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for gid, center, lens, codes in zip(*(b.column(c).to_pylist() for c in ("gid", "center", "lens", "codes")), strict=True):
                size, signals = pack(np.asarray(lens, np.int64))
                out.append((gid, center, size, len(codes), np.asarray(codes, np.uint8).tobytes(), signals))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["gid", "center", "sig_len", "n", "codes", "signals"])

    return mapped.select("gid", "center", "lens", "codes").mapInArrow(run, PACKED)


def unpack_groups(packed: DataFrame) -> DataFrame:
    """(gid, center, n, codes, signals) -> (gid, center, lens, codes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("n", "codes", "signals")), strict=True))
            lens = [unpack(s, n).tolist() for n, _, s in rows]
            codes = [list(c) for _, c, _ in rows]
            yield pa.RecordBatch.from_arrays([b.column("gid"), b.column("center"), pa.array(lens, pa.list_(pa.int64())), pa.array(codes, pa.list_(pa.int64()))], ["gid", "center", "lens", "codes"])

    return packed.select("gid", "center", "n", "codes", "signals").mapInArrow(run, "gid bigint, center bigint, lens array<bigint>, codes array<bigint>")
