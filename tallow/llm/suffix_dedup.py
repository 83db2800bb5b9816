"""Removal of every byte covered by a string of `length` bytes that also starts elsewhere, by blockwise suffix sorting.

Buckets. A window is a start from which `length` bytes remain in its document. Its anchor is the gram of smallest hash
within it (leftmost of equals), a function of the window's bytes alone, so equal windows share anchor and place in it:
the anchor is the splitter that deals suffixes into buckets without any global text. Consecutive windows with one anchor
are a run; its bytes are a segment. Runs that follow each other with equal segments (periodic text) are one row with a
count, so a constant text is one row.

Choice. An anchor that occurs once has no equal windows and its bucket is not sorted. Of a segment that occurs many
times two occurrences are sorted, the first and the last; the verdict on its windows is joined back to all of them.

Sorting. A worker takes whole buckets in blocks of bounded size, one after another. Within a block the ranks of a
difference cover sample (start mod 3 in {1, 2}) are computed first, by doubling; then the windows are sorted by
their first bytes and, where these tie, by the ranks of the sampled suffixes that follow: for any two starts there
is a shift of at most 2 that takes both into the sample, so no comparison reads on through a long tie. Only the
first `length` bytes count, so ranks stop at half of them; two of them and the bytes at the ends span a window.

A bucket of more than MOST segments is dealt once more, by a finer splitter: its windows are taken in groups by their
place to the anchor, 64 at a time, and a group goes by the hash of the bytes that its windows have in common, which equal
windows share. What has no partner stops there. What is still too large is dealt by groups of 16, 4 and 1; a group of 1 is
the window itself. So no block and no task holds a bucket that grows with the data, and every repeat is found by the sort.

Occurrences of one segment, or of one string of a finer bucket, are told by 128 bits of hash (64 of the bucket's key).

`keep_first` leaves the first occurrence of what repeats, in order of id (null first), hash of text and start: a byte goes
if a window over it equals one that starts earlier. So of a text that repeats itself the first period stays.

Defined cases: null text is empty; texts shorter than `length` lose nothing; overlapping repeats within one document
count; null ids are allowed; an empty table gives an empty result; further columns are ignored or, in `drop_repeats`,
kept. Repeated rows (same id and text) are separate occurrences and each loses its text; with `keep_first` they count as
one document and each keeps what it would keep alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import discard, free_shuffles, give_back, materialize

LENGTH = 400
GRAM = 64
CHUNK = 1 << 18  # bytes hashed at once
BLOCK = 1 << 18  # bytes sorted at once
MOST = 512  # segments of a bucket that is sorted whole

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE, _INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_TABLE = np.random.default_rng(2024).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, b, np.uint64))), dtype=np.uint64) for b in (_BASE, _INV)]
    return _POWERS[0], _POWERS[1]


def gram_hashes(a: np.ndarray, k: int = GRAM) -> np.ndarray:
    """Mixed 64-bit hash of every k-gram."""
    up, down = _powers(len(a) + 1)
    total = np.empty(len(a) + 1, np.uint64)
    total[0] = 0
    np.cumsum(_TABLE[a] * up[: len(a)], out=total[1:])
    h = (total[k:] - total[:-k]) * down[: len(a) - k + 1]
    h ^= h >> np.uint64(32)
    h *= _MUL
    h ^= h >> np.uint64(29)
    return h


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    n = len(v)
    rows = -(-n // w)
    full = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = v
    blocks = full.reshape(rows, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def runs(a: np.ndarray, ends: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """Runs of windows in concatenated texts. ends: for each byte the end of its text.

    Arrays (start, count, anchor offset from start, anchor hash), starts in the concatenation.
    """
    empty = np.zeros(0, np.int64)
    if len(a) < length:
        return empty, empty, empty, np.zeros(0, np.uint64)
    h = gram_hashes(a, gram)
    low = np.uint64((1 << 24) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    at = (least & low).astype(np.int64)
    start = np.arange(len(at))
    valid = start + length <= ends[: len(at)]
    at[~valid] = -1 - start[~valid]
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    count = np.diff(np.append(first, len(at)))
    ok = valid[first]
    first, count = first[ok], count[ok]
    anchor = at[first]
    return first, count, anchor - first, h[anchor]


def _chunks(keys: list, texts: Iterator[bytes], length: int, size: int) -> Iterator[tuple[list, list[int], list[bytes]]]:
    """Texts gathered to about `size` bytes: (row index, offset in its text, bytes); longer texts overlap by length - 1."""
    rows: list[int] = []
    offs: list[int] = []
    parts: list[bytes] = []
    held = 0
    for i, t in zip(keys, texts, strict=True):
        for o in range(0, max(1, len(t) - length + 1), size):
            p = t[o : o + size + length - 1]
            if len(p) < length:
                continue
            rows.append(i)
            offs.append(o)
            parts.append(p)
            held += len(p)
            if held >= size:
                yield rows, offs, parts
                rows, offs, parts, held = [], [], [], 0
    if parts:
        yield rows, offs, parts


def _keyed(docs: DataFrame, id_col: str, text_col: str, payload: bool = False) -> DataFrame:
    """(_id, _th, _bytes[, _row]): a row is known by its id and the hash of its text."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = [F.struct("*").alias("_row")] if payload else []
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.xxhash64(text).alias("_th"), text.cast("binary").alias("_bytes"), *row)


def anchored(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(_id, _th, start, n, times, lead, anchor, seg): one row per run of n windows that follows itself so often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        give_back(all_held=True)
        for b in batches:
            size = b.num_rows
            for rows, offs, parts in _chunks(list(range(size)), (x.as_py() for x in b.column(2)), length, CHUNK):
                lens = np.array([len(p) for p in parts])
                ends = np.cumsum(lens)
                text = b"".join(parts)
                first, count, lead, anchor = runs(np.frombuffer(text, np.uint8), np.repeat(ends, lens), length, gram)
                part = np.searchsorted(ends, first, side="right")
                seg = np.fromiter((digest(text[s : s + c + length - 1], x) for s, c, x in zip(first.tolist(), count.tolist(), lead.tolist(), strict=True)), np.uint64, len(first))
                new = np.ones(len(first), bool)
                new[1:] = (part[1:] != part[:-1]) | (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1]) | (count[1:] != count[:-1])
                head = np.flatnonzero(new)
                times = np.diff(np.append(head, len(first)))
                first, count, lead, anchor, seg, part = (x[head] for x in (first, count, lead, anchor, seg, part))
                row = pa.array(np.array(rows, np.int64)[part])
                start = first - (ends - lens)[part] + np.array(offs, np.int64)[part]
                cols = [b.column(0).take(row), b.column(1).take(row), pa.array(start), pa.array(count.astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(lead.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(seg.view(np.int64))]
                yield pa.RecordBatch.from_arrays(cols, ["_id", "_th", "start", "n", "times", "lead", "anchor", "seg"])
        give_back()

    return keyed.select("_id", "_th", "_bytes").mapInArrow(run, "_id bigint, _th bigint, start bigint, n int, times int, lead int, anchor bigint, seg bigint")


def _dense(keys: np.ndarray) -> np.ndarray:
    """Ranks of the values, equal where they are equal."""
    order = np.argsort(keys)
    s = keys[order]
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], (s[1:] != s[:-1]).astype(np.int64)))) if len(s) else 0
    return rank


def _depths(length: int) -> tuple[int, int, int]:
    """(bytes under the two ranks of a window, depth of a rank, place of the second): all multiples of 3."""
    if length < 16:
        raise ValueError("a window has 16 bytes at least")
    span = (length - 4) // 3 * 3
    depth = -(-span // 6) * 3
    return span, depth, span - depth


def cover_ranks(a: np.ndarray, depth: int) -> np.ndarray:
    """For starts s with s mod 3 in {1, 2}: the rank of the `depth` bytes from s on (zeros past the end)."""
    n = len(a)
    wide = np.zeros(n + 2 * depth + 8, np.uint64)
    wide[:n] = a
    sample = np.flatnonzero(np.arange(n) % 3)
    key = np.zeros(len(sample), np.uint64)
    for i in range(6):
        key = (key << np.uint64(8)) | wide[sample + i]
    rank = np.zeros(n + 2 * depth + 8, np.int64)
    rank[sample] = _dense(key) + 1
    now = 6
    while now < depth:
        step = min(now, depth - now)
        rank[sample] = _dense(rank[sample] << 32 | rank[sample + step]) + 1
        now += step
    return rank


def sorted_windows(a: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For each of these windows: whether another equals it, and whether one that does comes earlier in `order`."""
    span, depth, second = _depths(length)
    rank = cover_ranks(a, depth)
    wide = np.zeros(len(a) + length + 8, np.uint64)
    wide[: len(a)] = a
    edge = np.zeros(len(starts), np.uint64)
    for i in (0, 1, *range(span, length)):  # what a shift leaves uncovered: at most 8 bytes
        edge = (edge << np.uint64(8)) | wide[starts + i]
    edge = _dense(edge)
    repeated, later, phase = np.zeros(len(starts), bool), np.zeros(len(starts), bool), starts % 3
    for shift, other in ((0, 0), (1, 2), (2, 1)):  # the class left out: with it no such shift reaches the sample
        own = np.flatnonzero(phase != other)
        if not len(own):
            continue
        s = starts[own] + shift
        kind = _dense(_dense(rank[s] << 32 | rank[s + second]) << 32 | edge[own])
        count = np.bincount(kind)
        least = np.full(len(count), np.iinfo(np.int64).max)
        np.minimum.at(least, kind, order[own])
        repeated[own] |= count[kind] > 1
        later[own] |= order[own] > least[kind]
    return repeated, later


def _spans(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [{"s": i, "n": j - i} for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]


SPANS = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())]))
VERDICT = "k1 bigint, k2 bigint, rep array<struct<s:int,n:int>>, own array<struct<s:int,n:int>>"
_SORTED = ["bucket", "k1", "k2", "copy", "_id", "_th", "start", "n", "bytes"]


def sorted_buckets(segments: DataFrame, length: int = LENGTH) -> DataFrame:
    """(bucket, k1, k2, copy, _id, _th, start, n, bytes) dealt by bucket and ordered by it -> (k1, k2, rep, own): of each
    string (k1, k2) the windows that repeat, and those of its first occurrence (copy 0) that repeat earlier ones."""

    def block(rows: list[tuple]) -> list[tuple]:
        parts = [r[8] for r in rows]
        offs = np.cumsum([0, *map(len, parts)])
        counts = np.array([r[7] for r in rows])
        firsts = np.concatenate(([0], np.cumsum(counts)))
        inner = np.arange(firsts[-1]) - np.repeat(firsts[:-1], counts)
        docs = {d: i for i, d in enumerate(sorted({(r[4] is not None, r[4] or 0, r[5]) for r in rows}))}
        place = np.array([docs[r[4] is not None, r[4] or 0, r[5]] << 40 | r[6] for r in rows], np.int64)
        repeated, later = sorted_windows(np.frombuffer(b"".join(parts), np.uint8), np.repeat(offs[:-1], counts) + inner, np.repeat(place, counts) + inner, length)
        out = []
        for r, i, j in zip(rows, firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
            if not r[3] and repeated[i:j].any():
                out.append((r[1], r[2], _spans(repeated[i:j]), _spans(later[i:j])))
        return out

    def made(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), SPANS, SPANS), strict=True)], ["k1", "k2", "rep", "own"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            out: list[tuple] = []
            for r in zip(*(b.column(i).to_pylist() for i in range(9)), strict=True):
                if size >= BLOCK and held[-1][0] != r[0]:
                    out += block(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[8])
            yield made(out)
        yield made(block(held) if held else [])
        held.clear()
        give_back()

    dealt = segments.select(*_SORTED).repartition("bucket").sortWithinPartitions("bucket", "k1", "k2", "copy")
    return dealt.mapInArrow(run, VERDICT)


def _finer(strings: DataFrame, length: int, step: int) -> DataFrame:
    """Strings of large buckets cut into groups of windows: (k1, k2, copy, i, sub1, sub2, place, bytes)."""
    groups = strings.select("*", F.explode(F.expr(f"sequence((lead - n + 1) div {step}, lead div {step})")).alias("g"))
    first, last = f"greatest(0, lead - (g + 1) * {step} + 1)", f"least(n - 1, lead - g * {step})"
    groups = groups.selectExpr("*", f"CAST({first} AS INT) AS i", f"CAST({last} - {first} + 1 AS INT) AS _n", f"substring(bytes, CAST(lead - g * {step} + 1 AS INT), {length - step + 1}) AS _core")
    groups = groups.selectExpr("*", f"substring(bytes, i + 1, _n + {length - 1}) AS _bytes", "CAST(lead - i AS INT) AS _lead")
    place = F.struct("_id", "_th", (F.col("start") + F.col("i")).alias("start"), F.col("_n").alias("n"), F.col("_lead").alias("lead"))
    return groups.select("k1", "k2", "copy", "i", F.xxhash64("bucket", "g", "_core").alias("sub1"), F.xxhash64(F.lit(step), "_n", "_bytes").alias("sub2"), place.alias("place"), F.col("_bytes").alias("bytes"))


def _verdicts(strings: DataFrame, crowded: bool, length: int, step: int) -> DataFrame:
    """(bucket, k1, k2, copy, _id, _th, start, n, lead, bytes, hot) -> (k1, k2, rep, own)."""
    small = materialize(sorted_buckets(strings.where("NOT hot"), length))
    if not crowded:
        return small
    groups = materialize(_finer(strings.where("hot"), length, step))
    ends = groups.groupBy("sub1", "sub2").agg(F.min(F.struct("place", "bytes")).alias("a"), F.max(F.struct("place", "bytes")).alias("b"), F.count("*").alias("_c"))
    ends = materialize(ends)
    sizes = ends.groupBy("sub1").agg(F.sum("_c").alias("_all"), F.count("*").alias("_k")).where("_all > 1")
    met = materialize(sizes.select("sub1", F.expr(f"_k > {MOST}" if step > 1 else "false").alias("hot")))
    two = ends.join(met, "sub1").select("sub1", "sub2", "hot", F.posexplode(F.expr("CASE WHEN _c > 1 THEN array(a, b) ELSE array(a) END")).alias("copy", "p"))
    finer = two.select(F.col("sub1").alias("bucket"), F.col("sub1").alias("k1"), F.col("sub2").alias("k2"), "copy", "p.place.*", "p.bytes", "hot")
    found = _verdicts(materialize(finer), not met.where("hot").isEmpty(), length, step // 4)
    found = materialize(found.withColumnsRenamed({"k1": "sub1", "k2": "sub2"}).join(ends.select("sub1", "sub2", "a.place"), ["sub1", "sub2"]).withColumnRenamed("place", "first"))
    back = groups.where("copy = 0").drop("bytes", "copy").join(found, ["sub1", "sub2"])
    shifted = "transform({}, x -> struct(CAST(x.s + i AS INT) AS s, x.n AS n))"
    back = back.selectExpr("k1", "k2", f"{shifted.format('rep')} AS rep", f"CASE WHEN place <=> first THEN {shifted.format('own')} ELSE {shifted.format('rep')} END AS own")
    return small.unionAll(materialize(back.groupBy("k1", "k2").agg(F.flatten(F.collect_list("rep")).alias("rep"), F.flatten(F.collect_list("own")).alias("own"))))


def _with_keys(keyed: DataFrame, small: DataFrame, how: str = "left") -> DataFrame:
    """Texts joined, unsorted, to the few rows gathered for them; the gathered side is the hash table."""
    id_, th = small["_id"].alias("_i"), small["_th"].alias("_t")
    right = small.select(id_, th, *(c for c in small.columns if c not in ("_id", "_th"))).hint("shuffle_hash")
    return keyed.join(right, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_th") == F.col("_t")), how).drop("_i", "_t")


def repeated_ranges(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False) -> DataFrame:
    """(_id, _th, spans): for each row with repeats the ranges of window starts, (s, n) each, that go."""
    keyed = _keyed(docs, id_col, text_col)
    all_runs = materialize(anchored(keyed, length, gram))
    anchors = materialize(all_runs.groupBy("anchor").agg(F.sum("times").alias("_c")).where("_c > 1").select("anchor"))
    met = materialize(all_runs.join(anchors, "anchor"))
    discard(all_runs, anchors)
    free_shuffles(docs.sparkSession)
    # The last occurrence may be the last repetition in the place of the first.
    last = F.struct("_id", "_th", F.expr("start + n * (times - 1)").alias("start"), "n", "lead")
    ends = met.groupBy("anchor", "seg").agg(F.min(F.struct("_id", "_th", "start", "n", "lead")).alias("a"), F.max(last).alias("b"), F.sum("times").alias("_c"))
    segs = materialize(ends.select("anchor", "seg", "a", "b", F.expr("NOT (a <=> b)" if keep_first else "_c > 1").alias("many")))
    hot = materialize(segs.groupBy("anchor").agg(F.count("*").alias("_k")).where(f"_k > {MOST}").select("anchor", F.lit(True).alias("hot")))
    crowded = not hot.isEmpty()
    dealt = segs.join(hot, "anchor", "left") if crowded else segs.withColumn("hot", F.lit(False))
    wanted = dealt.select("anchor", "seg", F.coalesce("hot", F.lit(False)).alias("hot"), F.posexplode(F.expr("CASE WHEN many THEN array(a, b) ELSE array(a) END")).alias("copy", "p"))
    by_doc = wanted.groupBy("p._id", "p._th").agg(F.collect_list(F.struct("anchor", "seg", "hot", "copy", "p.start", "p.n", "p.lead")).alias("parts"))
    if not keyed.groupBy("_id", "_th").agg(F.count("*").alias("_c")).where("_c > 1").isEmpty():  # repeated rows: one gives the bytes
        keyed = keyed.groupBy("_id", "_th").agg(F.first("_bytes").alias("_bytes"))
    bytes_ = F.expr(f"substring(_bytes, CAST(p.start + 1 AS INT), p.n + {length - 1})").alias("bytes")
    strings = _with_keys(keyed, by_doc, "inner").select("_id", "_th", "_bytes", F.explode("parts").alias("p"))
    strings = materialize(strings.select(F.col("p.anchor").alias("bucket"), F.col("p.anchor").alias("k1"), F.col("p.seg").alias("k2"), "p.copy", "_id", "_th", "p.start", "p.n", "p.lead", "p.hot", bytes_))
    free_shuffles(docs.sparkSession)
    verdicts = _verdicts(strings, crowded, length, 64 if length >= 128 else 16)
    # Written on its own, so that a segment with very many occurrences is a skewed join that Spark splits.
    verdicts = materialize(verdicts.select(F.col("k1").alias("anchor"), F.col("k2").alias("seg"), "rep", "own").join(segs.select("anchor", "seg", "a"), ["anchor", "seg"]))
    shifted = "transform({}, x -> struct(CAST(start + x.s AS BIGINT) AS s, CAST(x.n AS BIGINT) AS n))"
    again = "CASE WHEN times > 1 THEN array(struct(CAST(start + {0} * n AS BIGINT) AS s, CAST(n AS BIGINT) * (times - {0}) AS n)) ELSE {1} END"
    every = again.format(0, shifted.format("rep"))
    if keep_first:
        rest = again.format(1, "CAST(array() AS array<struct<s:bigint,n:bigint>>)")
        every = f"CASE WHEN struct(_id, _th, start, n, lead) <=> a THEN concat({shifted.format('own')}, {rest}) ELSE {every} END"
    found = materialize(met.join(verdicts, ["anchor", "seg"]).select("_id", "_th", F.expr(every).alias("spans")).where("size(spans) > 0"))
    discard(met, segs, hot, strings, verdicts)
    free_shuffles(docs.sparkSession)
    return found.groupBy("_id", "_th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def removed_spans(starts, counts, size: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed byte ranges from ranges of window starts."""
    out: list[list[int]] = []
    for s, n in sorted(zip(map(int, starts), map(int, counts), strict=True)):
        e = min(size, s + n - 1 + length)
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _kept(data: bytes, cut: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for c in cut for x in c), len(data)]
    return b"".join(data[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True))


def _read(kept: bytes) -> str:
    """A cut inside a character takes the rest of that character too."""
    return kept.decode("utf-8", "ignore")


def _marked(docs: DataFrame, id_col: str, text_col: str, payload: bool, **how) -> DataFrame:
    """The keyed rows with their spans, and in `_touched` the bytes of those that have some."""
    rows = _with_keys(_keyed(docs, id_col, text_col, payload), repeated_ranges(docs, id_col, text_col, **how))
    return rows.withColumn("_touched", F.when(F.col("spans").isNotNull(), F.col("_bytes")))


def repeat_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, text).

    The digest is of the bytes left, `text` is what they read: as in `drop_repeats`, but empty for a null text.
    """

    @F.arrow_udf("struct<n_removed: bigint, n_spans: bigint, kept_sha256: string, text: string>")
    def cut(data: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        out = []
        for d, s, n in zip(data, starts, counts, strict=True):
            if not d.is_valid:
                out.append((0, 0, None, None))
                continue
            d = d.as_py()
            gone = removed_spans(s.as_py(), n.as_py(), len(d), length)
            kept = _kept(d, gone)
            out.append((sum(j - i for i, j in gone), len(gone), hashlib.sha256(kept).hexdigest(), _read(kept)))
        cols = list(zip(*out, strict=True)) or [()] * 4
        names = ["n_removed", "n_spans", "kept_sha256", "text"]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names)

    rows = _marked(docs, id_col, text_col, False, length=length).withColumn("_cut", cut.asNondeterministic()("_touched", "spans.s", "spans.n"))
    sha = F.coalesce("_cut.kept_sha256", F.sha2("_bytes", 256)).alias("kept_sha256")
    text = F.coalesce("_cut.text", F.col("_bytes").cast("string")).alias("text")
    return rows.select(F.col("_id").alias(id_col), F.octet_length("_bytes").cast("bigint").alias("n_bytes"), "_cut.n_removed", "_cut.n_spans", sha, text)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, keep_first: bool = True) -> DataFrame:
    """The documents with all their columns and the repeats cut out of the text; n_chars, if there, follows it.

    A cut inside a character takes the rest of that character too. A null text stays null.
    """

    @F.arrow_udf("string")
    def cut(data: pa.Array, starts: pa.Array, counts: pa.Array) -> pa.Array:
        kept = (None if not d.is_valid else _read(_kept(x := d.as_py(), removed_spans(s.as_py(), n.as_py(), len(x), length))) for d, s, n in zip(data, starts, counts, strict=True))
        return pa.array(kept, pa.string())

    rows = _marked(docs, id_col, text_col, True, length=length, gram=gram, keep_first=keep_first).withColumn("_kept", cut.asNondeterministic()("_touched", "spans.s", "spans.n"))
    text = F.coalesce("_kept", F.col(f"_row.`{text_col}`"))
    new = {text_col: text} | ({"n_chars": F.coalesce(F.char_length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*(new[c].alias(c) if c in new else F.col(f"_row.`{c}`").alias(c) for c in docs.columns))
