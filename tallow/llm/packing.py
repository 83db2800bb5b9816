"""Harmonic packing of tokenised documents into sequences of at most `capacity` tokens.

A document is cut into whole sequences and pieces of capacity/2, /4, ... down to 32 tokens, and a tail of less than
64. A piece of length s is of class k = capacity div s, the number of its like that surely fit one sequence; the
sequence of a class is full when it holds k pieces. Each worker fills the sequences of each class on its own, by
count alone. What stays open at the end of a worker (fewer than k pieces a class, 4,800 pieces at most) is filled the
same way by groups of FAN_IN workers, what these leave by groups of groups, and so on in a tree, so no task holds more
than FAN_IN times 4,800 pieces; only the last open ones are put together by first fit, longest first. All classes but the
tails' are exact divisors, so they leave no padding.

Token ids come from the tokenizer file; an end id follows each document. In a byte-level vocabulary no token spans a
single space between words, so a word is encoded once and kept in a bounded cache, from which the words used least go, and
the new words of many texts are encoded in one call; words of letters alone go straight to the merges of the model. A text with runs of white space or with the name of a special token is encoded whole, as the
tokenizer does it by default.

Defined cases: null text is empty (one end id); an empty table gives an empty result; repeated rows and null ids
are packed like any other; further columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import give_back, held, materialize

CAPACITY = 1024
SMALLEST = 32
END_ID = 0
CACHE, KEPT = 240_000, 80_000  # words that a worker knows at most, and of these between tasks
LEFT = 60  # percent of the words that stay when these are too many
FAN_IN = 64
#: What a space is called in byte-level vocabularies (fixed value).
SPACE = "\u0120"
MARKS = ".,;:!?)]}\""  # no vocabulary of this kind joins one of these to the letters before it
#: Letters of which every word is one piece for the merges of such a vocabulary; an encoder checks that its file says so.
LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)) if c not in (0xD7, 0xF7)]
_WORD = re.compile(f"[{''.join(LETTERS)}]+")
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]  # bytes that stand for themselves in such a vocabulary
_BYTES = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN))) if b != 0x20}
AT_ONCE = 1024  # words encoded in one call
AT_A_TIME = 1000  # texts with such a cache

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, worker bigint"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def byte_level(text: str) -> str:
    """A text in the characters that byte-level vocabularies have for bytes; its spaces stay."""
    return text if text.isascii() else text.encode().decode("latin-1").translate(_BYTES)


def _strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


class Encoder:
    """Ids of texts as little-endian uint32 bytes, as the tokenizer file gives them with add_special_tokens=False.

    The words of many texts are numbered at once and put together from one pool of ids; only new words are encoded."""

    def __init__(self, path: str, cache: int = CACHE):
        self.cache = cache
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        names = self.tokenizer.get_vocab()
        self.spaced = np.zeros(max(names.values()) + 1, bool)
        self.spaced[[i for t, i in names.items() if t.startswith(SPACE)]] = True
        # Whether a word of LETTERS after a space goes to the merges as it is.
        cut, pieces = self.tokenizer.pre_tokenizer, ["".join(LETTERS), *LETTERS]
        made = cut and [x for x, _ in cut.pre_tokenize_str(" " + " ".join(pieces))]
        self.merges = self.tokenizer.model.tokenize if not self.tokenizer.normalizer and made == [SPACE + byte_level(x) for x in pieces] else None
        self.slots: dict[str, int] = {}  # of words as they are after a space
        self.bare: dict[str, int] = {}  # of words and marks as they are alone
        self.pool, self.start, self.size = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)  # by how many lots of texts, those longer ago for less

    def keep(self, n: int) -> None:
        """Forgets all but the n strings used most, of equals those met first."""
        if n < len(self.start):
            kept = np.sort(np.argsort(-self.used, kind="stable")[:n])
            slot = np.full(len(self.start), -1)
            slot[kept] = np.arange(n)
            to = slot.tolist()
            self.slots, self.bare = ({w: to[s] for w, s in known.items() if to[s] >= 0} for known in (self.slots, self.bare))
            self.pool, self.size = self._gather(kept)
            self.start, self.used = np.cumsum(self.size) - self.size, self.used[kept] // 2

    def _ids(self, text: str) -> np.ndarray:
        # The fast form leaves out offsets, which are not used here.
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> range:
        """Slots of so many strings, whose ids follow each other."""
        n = len(self.start)
        self.start = np.concatenate((self.start, len(self.pool) + np.cumsum(sizes) - sizes))
        self.size, self.pool = np.concatenate((self.size, sizes)), np.concatenate((self.pool, ids))
        self.used = np.concatenate((self.used, np.ones(len(sizes), np.int64)))
        return range(n, n + len(sizes))

    def _gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these strings one after another, and how many each has."""
        sizes = self.size[slots]
        at = np.repeat(self.start[slots] - (np.cumsum(sizes) - sizes), sizes)
        return self.pool[at + np.arange(len(at))], sizes

    def _encode(self, words: list[str], known: dict[str, int], space: bool) -> None:
        """Words without white space at either end and without a space."""
        parts, sizes = [], []
        if space and self.merges and words:
            letters = [_WORD.fullmatch(w) is not None for w in words]
            plain = list(itertools.compress(words, letters))
            words = [w for w, x in zip(words, letters, strict=True) if not x]
            made = [[t.id for t in self.merges(SPACE + w)] for w in byte_level(" ".join(plain)).split(" ")] if plain else []
            size = np.fromiter(map(len, made), np.int64, len(made))
            ids = np.fromiter(itertools.chain.from_iterable(made), "<u4", int(size.sum()))
            known.update(zip(plain, self._add(ids, size), strict=True))
        for o in range(0, len(words), AT_ONCE):
            some = words[o : o + AT_ONCE]
            ids = self._ids(" " + " ".join(some)) if space else None
            first = np.flatnonzero(self.spaced[ids]) if space else None
            if first is None or len(first) != len(some):  # alone, or in a vocabulary that joins words
                made = self.tokenizer.encode_batch_fast([" " + w if space else w for w in some], add_special_tokens=False)
                alone = [np.array(x.ids, "<u4") for x in made]
                ids, size = np.concatenate(alone), np.array([len(x) for x in alone])
            else:
                size = np.diff(np.append(first, len(ids)))
            parts.append(ids)
            sizes.append(size)
        if words:
            known.update(zip(words, self._add(np.concatenate(parts), np.concatenate(sizes)), strict=True))

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Slots of new words. Letters and the marks that end them are split, so a word is encoded once whatever mark follows it."""
        heads = pc.utf8_rtrim(words, characters=MARKS)
        ended = pc.and_(pc.not_equal(heads, words), pc.utf8_is_alpha(heads))
        parts = pc.if_else(ended, heads, words).dictionary_encode()
        distinct = _strings(parts.dictionary)
        self._encode([w for w in distinct if w not in self.slots], self.slots, True)
        slots = np.fromiter(map(self.slots.__getitem__, distinct), np.int64, len(distinct))[parts.indices.to_numpy()]
        at = np.flatnonzero(ended.to_numpy(zero_copy_only=False))
        if len(at):
            with_marks, length = _strings(words.take(pa.array(at))), pc.utf8_length(heads).to_numpy()[at].tolist()
            marks = [w[n:] for w, n in zip(with_marks, length, strict=True)]
            self._encode([m for m in dict.fromkeys(marks) if m not in self.bare], self.bare, False)
            pairs = np.array([slots[at], list(map(self.bare.__getitem__, marks))]).T.ravel()
            self.used += np.bincount(pairs, minlength=len(self.used))
            ids, sizes = self._gather(pairs)
            made = self._add(ids, sizes.reshape(-1, 2).sum(1))
            self.slots.update(zip(with_marks, made, strict=True))
            slots[at] = np.arange(made.start, made.stop)
        return slots

    def __call__(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        if len(self.slots) > self.cache:
            self.keep(self.cache * LEFT // 100)
        lists = pc.split_pattern(pa.array(texts, pa.string()), " ")
        numbered = lists.flatten().dictionary_encode()
        words, number = _strings(numbered.dictionary), numbered.indices.to_numpy(zero_copy_only=False)
        edge = lists.offsets.to_numpy()
        counts = np.diff(edge)
        # A text in which a space meets other white space or an end, or with a special token, is encoded whole.
        trimmed = pc.utf8_trim_whitespace(numbered.dictionary)
        odd = pc.or_(pc.not_equal(trimmed, numbered.dictionary), pc.equal(trimmed, "")).to_numpy(zero_copy_only=False)
        whole = np.add.reduceat(odd[number], edge[:-1]) > 0
        whole |= np.array([any(x in t for x in self.special) for t in texts], bool)
        slot = np.fromiter(map(self.slots.get, words, itertools.repeat(-1)), np.int64, len(words))
        self.used[slot[slot >= 0]] += 1
        new = np.flatnonzero((slot < 0) & ~odd)
        slot[new] = self._learn(numbered.dictionary.take(pa.array(new)))
        firsts = [words[i] for i in number[edge[:-1]][~whole].tolist()]
        self._encode([w for w in dict.fromkeys(firsts) if w not in self.bare], self.bare, False)
        taken, slots = ~np.repeat(whole, counts), slot[number]
        slots[edge[:-1][~whole]] = [self.bare[w] for w in firsts]
        ids, sizes = self._gather(slots[taken])
        made = iter(np.split(ids, np.cumsum(np.add.reduceat(sizes, np.cumsum(c := counts[~whole]) - c))[:-1]) if len(sizes) else ())
        return [(self._ids(t) if w else next(made)).tobytes() for t, w in zip(texts, whole.tolist(), strict=True)]


def cuts(n: int, capacity: int = CAPACITY, smallest: int = SMALLEST) -> list[int]:
    """Lengths of a document's pieces: what is left after a cut is never shorter than `smallest`, unless it was."""
    out, left = [capacity] * (n // capacity), n % capacity
    size = capacity // 2
    while size >= smallest:
        if left == size or left - size >= smallest:
            out.append(size)
            left -= size
        size //= 2
    return [*out, left] if left else out


class Filler:
    """Open sequences by class; a full one gets the next id."""

    def __init__(self, first_id: int, capacity: int = CAPACITY):
        self.next, self.capacity, self.open = first_id, capacity, {}

    def add(self, row: list) -> list[list]:
        """The rows of a sequence that this piece completes, placed."""
        k = self.capacity // row[2]
        held = self.open.setdefault(k, [])
        held.append(row)
        return self.close(self.open.pop(k)) if len(held) == k else []

    def close(self, rows: list[list]) -> list[list]:
        at = 0
        for r in rows:
            r[5], r[6] = self.next, at
            at += r[2]
        self.next += 1
        return rows

    def rest(self) -> list[list]:
        return [r for rows in self.open.values() for r in rows]

    def first_fit(self) -> list[list]:
        """Places all that is open: longest first, into the fullest sequence that has room."""
        bins: list[list[list]] = []
        room: list[tuple[int, int]] = []
        for r in sorted(self.rest(), key=lambda r: (-r[2], r[0] or 0, r[1])):
            aside = []
            while room and room[0][0] < r[2]:
                aside.append(heapq.heappop(room))
            if room:
                left, i = heapq.heappop(room)
                bins[i].append(r)
                heapq.heappush(room, (left - r[2], i))
                for x in aside:
                    heapq.heappush(room, x)
            else:
                for x in aside:
                    heapq.heappush(room, x)
                bins.append([r])
                heapq.heappush(room, (self.capacity - r[2], len(bins) - 1))
        return [r for b in bins for r in self.close(b)]


def _batch(rows: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in (zip(*rows, strict=True) if rows else [()] * len(NAMES))], NAMES)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, cache: int = CACHE) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset). `cache`: words that a worker
    knows at most; fewer take less memory and more time."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        encode, worker = held(f"encoder {tokenizer} {cache}", lambda: Encoder(tokenizer, cache)), TaskContext.get().partitionId()
        fill, end = Filler(worker << 32, capacity), np.array([END_ID], "<u4").tobytes()
        some = max(1, AT_A_TIME * cache // CACHE)
        for b in (x.slice(o, some) for x in batches for o in range(0, x.num_rows, some)):
            out: list[list] = []
            for doc, ids in zip(b.column(0).to_pylist(), encode.many([t or "" for t in b.column(1).to_pylist()]), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                for size in cuts(n, capacity):
                    out += fill.add([doc, at, size, zlib.crc32(ids[4 * at : 4 * (at + size)]), n, None, None, worker])
                    at += size
            yield _batch(out)
        yield _batch(fill.rest())
        encode.keep(min(KEPT, cache * 6 // 10))
        give_back()

    def merge(level: int, last: bool):
        import pandas as pd  # here, so that the workers of the first step need not hold it

        def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            fill = Filler(1 << 61 if last else 1 << 60 | level << 56 | int(key[0]) << 32, capacity)
            # Fixed order: a lost task that runs again places the same pieces.
            rows = rows.sort_values(["worker", "doc_id", "start", "length"], kind="stable")
            out: list[list] = []
            for r in rows[NAMES].itertuples(index=False):
                out += fill.add([None if pd.isna(r[0]) else int(r[0]), *map(int, r[1:5]), None, None, int(r[7])])
            out += fill.first_fit() if last else fill.rest()
            return _batch(out).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

        return run

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("_text"))
    made = [materialize(rows.mapInArrow(local, PIECE))]
    level, workers = 0, (made[0].where("sequence_id IS NULL").agg(F.max("worker")).first()[0] or 0) + 1
    while workers > FAN_IN:
        level += 1
        group = F.expr(f"worker div {FAN_IN**level}L")
        made.append(materialize(made[-1].where("sequence_id IS NULL").groupBy(group).applyInPandas(merge(level, False), PIECE)))
        workers = -(-workers // FAN_IN)
    last = made[-1].where("sequence_id IS NULL").groupBy(F.lit(0).alias("_all")).applyInPandas(merge(0, True), PIECE)
    placed = last
    for part in made:
        placed = placed.unionAll(part.where("sequence_id IS NOT NULL"))
    return placed.drop("worker").withColumnRenamed("doc_id", id_col)
