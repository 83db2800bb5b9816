"""32-way interleaved range coder over blocks of 4096 bytes, vectorised across blocks.

Lane = position mod 32, step = position div 32. Words of a block stand in order of (step, lane).
"""

from __future__ import annotations

import numpy as np

from tallow.schema import BLOCK, STATE_BITS, STATE_MIN, STATES

STEPS = BLOCK // STATES


def cumulative(pdf: np.ndarray) -> np.ndarray:
    return np.cumsum(pdf, -1) - pdf


def split_blocks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes as [blocks, 128, 32] with zeros at the end, and the true size of each block."""
    n = -(-len(data) // BLOCK)
    padded = np.zeros(n * BLOCK, np.uint8)
    padded[: len(data)] = data
    sizes = np.minimum(BLOCK, len(data) - BLOCK * np.arange(n)) if n else np.zeros(0, np.int64)
    return padded.reshape(n, STEPS, STATES), sizes


def encode_blocks(blocks: np.ndarray, sizes: np.ndarray, pdf: np.ndarray, bits: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Final states [blocks, 32] and the words of each block; pdf has one row of 256 weights per block."""
    n = len(blocks)
    weight, start = pdf.astype(np.int64).ravel(), cumulative(pdf).astype(np.int64).ravel()
    row = 256 * np.arange(n)[:, None]
    state = np.full((n, STATES), STATE_MIN, np.int64)
    words, written = np.zeros((n, STEPS, STATES), np.uint16), np.zeros((n, STEPS, STATES), bool)
    lane = np.arange(STATES)
    for step in range(STEPS):
        valid = step * STATES + lane < sizes[:, None]
        if not valid.any():
            break
        sym = row + blocks[:, step]
        p, c = weight[sym], start[sym]
        emit = valid & (state >= p << (STATE_BITS - bits))
        words[:, step], written[:, step] = state & 0xFFFF, emit
        state = np.where(emit, state >> 16, state)
        safe = np.maximum(p, 1)
        state = np.where(valid, (state // safe << bits) + state % safe + c, state)
    return state, [w[m] for w, m in zip(words, written, strict=True)]


def decode_blocks(states: np.ndarray, words: list[np.ndarray], sizes: np.ndarray, pdf: np.ndarray, bits: int) -> np.ndarray:
    """Bytes [blocks, 4096]; pdf has one row per block. Raises ValueError unless every word is used and every state ends where it began."""
    n = len(states)
    sym_of = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), pdf.ravel())
    weight, start = pdf.astype(np.int64).ravel(), cumulative(pdf).astype(np.int64).ravel()
    counts = np.array([len(w) for w in words], np.int64)
    stream = np.zeros((n, max(1, int(counts.max(initial=0)))), np.int64)
    for row, w in zip(stream, words, strict=True):
        row[: len(w)] = w
    state, left, out = states.astype(np.int64), counts.copy(), np.zeros((n, STEPS, STATES), np.uint8)
    lane, rows = np.arange(STATES), np.arange(n)[:, None]
    for step in range(int(-(-sizes.max(initial=0) // STATES)) - 1, -1, -1):
        valid = step * STATES + lane < sizes[:, None]
        slot = state & ((1 << bits) - 1)
        sym = sym_of[(rows << bits) + slot]
        out[:, step] = np.where(valid, sym, 0)
        sym = 256 * rows + sym
        state = np.where(valid, weight[sym] * (state >> bits) + slot - start[sym], state)
        pull = valid & (state < STATE_MIN)
        used = pull.sum(1)
        if (used > left).any():
            raise ValueError("the block has fewer words than its symbols need")
        at = np.where(pull, left[:, None] - used[:, None] + np.cumsum(pull, 1) - 1, 0)
        state = np.where(pull, (state << 16) + stream[rows, at], state)
        left = left - used
    if left.any() or (state != STATE_MIN).any():
        raise ValueError("the block does not end in its first state: corrupt words or table")
    return out.reshape(n, BLOCK)
