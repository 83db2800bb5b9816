"""Residual archive of an integer column: lengths, centres, codes and signals in one self-describing byte string.

Layout, little-endian: int64 element count, int64 group count, int32 offsets[g + 1] in bytes per lane (the last is
the total), uint16 or uint32 centres[g] by the width byte that precedes them, uint8 codes[n], signals.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.operators.residual import pack, unpack
from tallow.schema import GROUP, LANES, RADIX


def assemble(groups: list[tuple[int, int, bytes, bytes]], width: int = 2) -> bytes:
    """(center, sig_len, codes, signals) in order of group -> archive."""
    offsets = np.cumsum([0, *(g[1] for g in groups)]).astype("<i4")
    n = sum(len(g[2]) for g in groups)
    centers = np.array([g[0] for g in groups], f"<u{width}")
    head = struct.pack("<qqB", n, len(groups), width)
    return head + offsets.tobytes() + centers.tobytes() + b"".join(g[2] for g in groups) + b"".join(g[3] for g in groups)


def parse(blob: bytes) -> np.ndarray:
    """Archive -> values."""
    n, g, width = struct.unpack_from("<qqB", blob)
    at = 17
    offsets = np.frombuffer(blob, "<i4", g + 1, at).astype(np.int64) * LANES
    at += 4 * (g + 1)
    centers = np.frombuffer(blob, f"<u{width}", g, at).astype(np.int64)
    at += width * g
    codes, signals = np.frombuffer(blob, np.uint8, n, at).astype(np.int64), blob[at + n :]
    lens = np.concatenate([unpack(signals[offsets[i] : offsets[i + 1]], min(GROUP, n - i * GROUP)) for i in range(g)] or [np.zeros(0, np.int64)])
    center = np.repeat(centers, GROUP)[:n]
    steps = RADIX * (lens - 1)
    return np.where(codes % 2 == 1, center - ((codes - 1) // 2 + steps), center + codes // 2 + steps)


def encode_values(values: np.ndarray, width: int = 2) -> bytes:
    """Values of one piece -> archive; the same rules as the DataFrame form."""
    groups = []
    for i in range(0, len(values), GROUP):
        v = values[i : i + GROUP].astype(np.int64)
        c = int(v.sum()) // len(v)
        d = np.abs(v - c)
        length = np.maximum(1, -(-d // RADIX))
        rest = d - RADIX * (length - 1)
        code = np.where(v == c, 1, np.where(v > c, 2 * rest, 2 * rest + 1)).astype(np.uint8)
        size, signals = pack(length)
        groups.append((c, size, code.tobytes(), signals))
    return assemble(groups, width)


def archive_sections(packed: DataFrame, per: int = 2048) -> DataFrame:
    """(gid, center, sig_len, codes, signals) -> one archive per `per` groups (1 M values): (part, archive).

    A part is of bounded size, so building it in one row is safe at any scale.
    """
    one = F.sort_array(F.collect_list(F.struct("gid", "center", "sig_len", "codes", "signals")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, gs in zip(b.column(0), b.column(1), strict=True):
                blob = assemble([(g["center"], g["sig_len"], g["codes"], g["signals"]) for g in gs.as_py()], 4)
                yield pa.RecordBatch.from_arrays([pa.array([part.as_py()], pa.int64()), pa.array([blob], pa.binary())], ["part", "archive"])

    return packed.groupBy(F.expr(f"gid div {per}").alias("part")).agg(one.alias("_g")).mapInArrow(run, "part bigint, archive binary")
