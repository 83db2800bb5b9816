"""Self-describing archive of a byte string, and its column operators.

Layout, little-endian (fixed values): a header of eight uint32 (magic, blocks, bytes, words, options, three
zeros), 256 uint16 weights, 32 uint32 states per block, one (uint32, uint32) index entry per block padded to an
even count, then 16-bit words with every block at a multiple of 8 words.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.functions.arith import round_up
from tallow.operators.quantize import quantize_counts
from tallow.operators.rans import decode_blocks, encode_blocks, split_blocks
from tallow.schema import BLOCK, HEADER_BYTES, MAGIC, STATES, check_prob_bits

ALIGN = 8
MANY = 256  # blocks coded at once: bounds memory


class Header(NamedTuple):
    magic: int
    blocks: int
    raw_bytes: int
    words: int
    options: int
    checksum: int
    unused0: int
    unused1: int

    @property
    def prob_bits(self) -> int:
        return self.options & 15

    @property
    def has_checksum(self) -> bool:
        return bool(self.options & 16)


def read_header(blob: bytes) -> Header:
    if len(blob) < HEADER_BYTES:
        raise ValueError("too short for an archive header")
    h = Header(*struct.unpack_from("<8I", blob))
    if h.magic != MAGIC:
        raise ValueError(f"wrong magic or version {h.magic:#x}")
    check_prob_bits(h.prob_bits)
    if h.blocks != -(-h.raw_bytes // BLOCK) or len(blob) < archive_size(h.blocks, h.words):
        raise ValueError("sizes in the header do not agree")
    return h


def archive_size(blocks: int, words: int) -> int:
    return HEADER_BYTES + 512 + 4 * STATES * blocks + 8 * round_up(blocks, 2) + 2 * words


def max_block_size(n: int) -> int:
    """A bound for the words of a block of n bytes: a quarter over its size, in steps of 16 bytes."""
    return round_up(n + n // 4, 16)


def max_block_size_with_states(n: int) -> int:
    return 4 * STATES + max_block_size(n)


def max_archive_size(n: int) -> int:
    """A bound for any n bytes."""
    blocks = -(-n // BLOCK)
    return archive_size(blocks, 0) + blocks * max_block_size(BLOCK)


def reserved_size(n: int) -> int:
    """What is set aside for n bytes where the number of blocks is not known beforehand: head and index of BLOCK blocks."""
    return round_up(archive_size(BLOCK, 0) + -(-n // BLOCK) * max_block_size(BLOCK), 16)


def _sql_round_up(n: str, to: int) -> str:
    return f"(({n} + {to - 1}) div {to} * {to})"


def bound_columns(df: DataFrame, n: str = "n") -> DataFrame:
    """Adds the same bounds of a column of sizes, by SQL functions alone."""
    block, blocks = _sql_round_up(f"({n} + {n} div 4)", 16), f"(({n} + {BLOCK - 1}) div {BLOCK})"
    head = f"({HEADER_BYTES + 512} + {4 * STATES} * {blocks} + 8 * {_sql_round_up(blocks, 2)})"
    body = f"{blocks} * {max_block_size(BLOCK)}"
    reserved = _sql_round_up(f"({archive_size(BLOCK, 0)} + {body})", 16)
    return df.selectExpr("*", f"{blocks} AS blocks", f"{block} AS block_bound", f"{4 * STATES} + {block} AS block_bound_with_states", f"{head} + {body} AS bound", f"{reserved} AS reserved")


def _parts(items: list, blocks: list[int]) -> Iterator[list]:
    """Consecutive items of MANY blocks together, or of one item."""
    part, held = [], 0
    for item, n in zip(items, blocks, strict=True):
        if part and held + n > MANY:
            yield part
            part, held = [], 0
        part.append(item)
        held += n
    if part:
        yield part


def compress(data: bytes, bits: int = 10) -> bytes:
    return compress_all([data], bits)[0]


def compress_all(many: list[bytes], bits: int = 10) -> list[bytes]:
    """One archive for each, with its own table. Blocks of several inputs are coded side by side."""
    check_prob_bits(bits)
    return [x for part in _parts(many, [-(-len(d) // BLOCK) for d in many]) for x in _compress_part(part, bits)]


def _compress_part(many: list[bytes], bits: int) -> Iterator[bytes]:
    raws = [np.frombuffer(d, np.uint8) for d in many]
    pdfs = [quantize_counts(np.bincount(r, minlength=256), bits) for r in raws]
    split = [split_blocks(r) for r in raws]
    own = [len(b) for b, _ in split]
    blocks, sizes = (np.concatenate([x[i] for x in split]) for i in (0, 1))
    table = np.repeat(np.arange(len(many)), own)
    weights = np.stack(pdfs)
    states, words = [np.zeros((0, STATES), np.int64)], []
    for i in range(0, len(blocks), MANY):
        s, w = encode_blocks(blocks[i : i + MANY], sizes[i : i + MANY], weights[table[i : i + MANY]], bits)
        states.append(s)
        words += w
    coded, a = np.concatenate(states), 0
    for raw, pdf, n in zip(raws, pdfs, own, strict=True):
        yield _assemble(len(raw), pdf, coded[a : a + n], words[a : a + n], sizes[a : a + n], bits)
        a += n


def _assemble(n_raw: int, pdf: np.ndarray, states: np.ndarray, words: list[np.ndarray], sizes: np.ndarray, bits: int) -> bytes:
    counts = np.array([len(w) for w in words], np.int64)
    room = -(-counts // ALIGN) * ALIGN
    prefix, total = np.cumsum(room) - room, int(room.sum())
    index = np.zeros((round_up(len(words), 2), 2), "<u4")
    index[: len(words), 0], index[: len(words), 1] = sizes << 16 | counts, prefix
    body = np.zeros(total, "<u2")
    for at, w in zip(prefix, words, strict=True):
        body[at : at + len(w)] = w
    head = struct.pack("<8I", MAGIC, len(words), n_raw, total, bits, 0, 0, 0)
    return head + pdf.astype("<u2").tobytes() + states.astype("<u4").tobytes() + index.tobytes() + body.tobytes()


def decompress(blob: bytes) -> bytes:
    return decompress_all([blob])[0]


def decompress_all(blobs: list[bytes]) -> list[bytes]:
    """The bytes of each archive. Blocks of several archives of the same precision are decoded side by side."""
    heads, out = [read_header(b) for b in blobs], {}
    for bits in sorted({h.prob_bits for h in heads}):
        own = [i for i, h in enumerate(heads) if h.prob_bits == bits]
        for part in _parts(own, [heads[i].blocks for i in own]):
            out.update(zip(part, _decompress_part([blobs[i] for i in part], [heads[i] for i in part], bits), strict=True))
    return [out[i] for i in range(len(blobs))]


def _decompress_part(blobs: list[bytes], heads: list[Header], bits: int) -> Iterator[bytes]:
    pdfs, states, index, words = [], [], [], []
    for blob, h in zip(blobs, heads, strict=True):
        pdf = np.frombuffer(blob, "<u2", 256, HEADER_BYTES).astype(np.int64)
        if h.blocks and pdf.sum() != 1 << bits:
            raise ValueError("the weights do not sum to the precision")
        at = HEADER_BYTES + 512
        pdfs.append(pdf)
        states.append(np.frombuffer(blob, "<u4", STATES * h.blocks, at).reshape(-1, STATES))
        at += 4 * STATES * h.blocks
        index.append(own := np.frombuffer(blob, "<u4", 2 * h.blocks, at).reshape(-1, 2).astype(np.int64))
        body = np.frombuffer(blob, "<u2", h.words, at + 8 * round_up(h.blocks, 2))
        words += [body[p : p + c] for p, c in zip(own[:, 1], own[:, 0] & 0xFFFF, strict=True)]
    state, sizes, weights = np.concatenate(states), np.concatenate(index)[:, 0] >> 16, np.stack(pdfs)
    table, rows = np.repeat(np.arange(len(heads)), [h.blocks for h in heads]), []
    for i in range(0, len(words), MANY):
        j = slice(i, i + MANY)
        made = decode_blocks(state[j], words[j], sizes[j], weights[table[j]], bits)
        rows += [r[:n].tobytes() for r, n in zip(made, sizes[j], strict=True)]
    a = 0
    for h in heads:
        yield b"".join(rows[a : a + h.blocks])
        a += h.blocks


def _map(df: DataFrame, column: str, out: str, f) -> DataFrame:
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            given = b.column(b.num_columns - 1).to_pylist()
            found = iter(f([x for x in given if x is not None]))
            made = [None if x is None else next(found) for x in given]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(kept))), pa.array(made, pa.binary())], [*kept, out])

    types = [f"`{n}` {t}" for n, t in df.select(*(F.col(f"`{c}`") for c in kept)).dtypes]
    source = df.select(*(F.col(f"`{c}`") for c in kept), F.col(f"`{column}`").cast("binary").alias("_bytes"))
    return source.mapInArrow(run, ", ".join([*types, f"`{out}` binary"]))


def encode_column(df: DataFrame, column: str, out: str = "archive", bits: int = 10) -> DataFrame:
    """Adds one archive per row, each with its own table; null stays null. Narrow."""
    check_prob_bits(bits)
    return _map(df, column, out, lambda x: compress_all(x, bits))


def decode_column(df: DataFrame, column: str = "archive", out: str = "data") -> DataFrame:
    return _map(df, column, out, decompress_all)


def header_columns(df: DataFrame, column: str = "archive") -> DataFrame:
    """Adds the header's fields, read by SQL functions alone."""

    def le(i: int) -> str:
        parts = " + ".join(f"shiftleft(CAST(conv(hex(substring({column}, {4 * i + k + 1}, 1)), 16, 10) AS BIGINT), {8 * k})" for k in range(4))
        return f"({parts})"

    names = ["magic", "blocks", "raw_bytes", "words", "options"]
    return df.selectExpr("*", *(f"{le(i)} AS {n}" for i, n in enumerate(names)), f"{le(4)} & 15 AS prob_bits")
