"""Links between texts whose word shingles have a Jaccard similarity of `similarity` or more, beyond the few bits that
fingerprints can be searched by: at 0.8 two fingerprints of 64 bits differ in 4 to 14 bits, where pigeonring filtering
finds no chain longer than one segment of 4 bits and so prunes nothing.

Links are sought twice. First by leaders: 16 bands of 9 minimum hashes give each text 32 keys, one of the first 5 of
each band and one of all 9, and texts of a key are held against up to 5 leaders of it (the smallest text key in each of
4 classes of a hash, and the largest). That joins crowds of near copies at a fixed number of pairs per text, but it is
no proof that other pairs are below `similarity`.

Then exactly, between the groups so found: shingles are put in one order, rarest first, and two sets can only reach
`similarity` if the head of the smaller (a ninth of it at 0.8) and the head of the larger (a fifth) share a shingle. Pairs
that do, that are of different groups and that size and place of the shingle allow are candidates too. The order takes
frequencies from a sample; any order gives the same links, a good one keeps a crowd's common shingles out of the heads.
Every candidate of either sort is decided by the exact similarity of its whole sets of shingles.

Nothing is gathered per key but the leaders, in aggregates that combine before the shuffle; a hot key is a skewed join,
both of whose sides are exchanged, that Spark splits. A shingle common to one group only is dropped before any pair is
formed, and pairs are formed only between groups. What two sets do not share flips bits of a parity map, so a pair whose
maps differ in more bits than `similarity` allows shingles to differ is dropped before sets are made.

Defined cases: A-Z count as a-z; one to four words are one shingle; a null or empty text, or one without words, has no
keys and no links here; rows with a null id are not compared; equal texts have one key and meet nothing of their own;
rows that repeat an id are compared as their texts differ; an empty table gives no links; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import discard, free_shuffles, give_back, materialize
from tallow.llm.components import connected_components
from tallow.llm.fingerprint import fingerprint_of, shingle_hashes, text_key

SIMILARITY = (4, 5)
BANDS = 16
SHORT, LONG = 5, 9
LEADERS = 4
BLOCK = 1024
SAMPLE = 32
MARK = "xxhash64(CAST(CAST({} AS string) AS binary))"  # of a text, to tell rows that repeat an id apart
MOST_COMMON = 1 << 18
PARITY_BITS = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)
_RNG = np.random.default_rng(42)
FACTORS = (_RNG.integers(0, 1 << 32, (BANDS * LONG, 1), np.uint32) | np.uint32(1)).astype(np.uint32)
MASKS = _RNG.integers(0, 1 << 32, (BANDS * LONG, 1), np.uint32)


def minimum_hashes(hashes: np.ndarray) -> np.ndarray:
    """uint64 hashes of a text's shingles, at least one -> uint32[BANDS * LONG]."""
    low = np.full(BANDS * LONG, 0xFFFFFFFF, np.uint32)
    top = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(0, len(top), BLOCK):
        np.minimum(low, ((top[i : i + BLOCK] ^ MASKS) * FACTORS).min(1), out=low)
    return low


def band_keys(minima: np.ndarray) -> np.ndarray:
    """uint32[n, BANDS * LONG] -> int64[n, 2 * BANDS]: keys of the first SHORT minima of each band, then of all."""
    rows = minima.reshape(-1, BANDS, LONG).astype(np.uint64)
    acc, out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * MIX, rows.shape[:2]).copy(), []
    for j in range(LONG):
        acc = (acc ^ rows[:, :, j]) * MIX
        acc ^= acc >> np.uint64(29)
        if j + 1 in (SHORT, LONG):
            out.append(acc.copy())
    return np.concatenate(out, axis=1).view(np.int64)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("_text"))


def sketches(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(_id, mark BIGINT, fp BIGINT, key BIGINT, bands ARRAY<BIGINT>, n, short, head ARRAY<BIGINT>, odd ARRAY<BIGINT>).

    bands is null for a text without words. n is the number of distinct shingles, head the rarest of them in the common
    order, of which the first `short` are the head as the smaller of a pair; odd tells which of PARITY_BITS classes of
    shingles the text holds an odd number of."""
    kinds_known, often = _common(_texts(docs, id_col, text_col), shingle)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(all_held=True)
        for b in (x.slice(o, 1024) for x in batches for o in range(0, x.num_rows, 1024)):
            fps, keys, minima, sizes, short, head, odd = [], [], [], [], [], [], []
            for t in b.column(1):
                hashes = shingle_hashes(t.as_py(), shingle)
                fps.append(fingerprint_of(hashes))
                kinds = np.unique(hashes)
                keys.append(text_key(kinds, fps[-1]))
                sizes.append(len(kinds))
                if not len(kinds):
                    short.append(0)
                    head.append(None)
                    odd.append(None)
                    continue
                minima.append(minimum_hashes(kinds))
                signed = kinds.view(np.int64)
                rank = np.zeros(len(kinds), np.int64)
                if len(kinds_known):
                    at = np.minimum(np.searchsorted(kinds_known, signed), len(kinds_known) - 1)
                    rank = np.where(kinds_known[at] == signed, often[at], 0)
                least, most = heads(len(kinds), similarity)
                short.append(least)
                head.append(signed[np.lexsort((signed, rank))[:most]])
                odd.append(np.packbits((np.bincount(signed & (PARITY_BITS - 1), minlength=PARITY_BITS) & 1).astype(np.uint8)).view(np.int64))
            found = iter(band_keys(np.array(minima)).tolist() if minima else [])
            bands = pa.array([next(found) if s else None for s in sizes], pa.list_(pa.int64()))
            lists = [pa.array(x, pa.list_(pa.int64())) for x in (head, odd)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps, pa.int64()), pa.array(keys, pa.int64()), bands, pa.array(sizes, pa.int32()), pa.array(short, pa.int32()), *lists], ["_id", "mark", "fp", "key", "bands", "n", "short", "head", "odd"])
        give_back()

    marked = _texts(docs, id_col, text_col).withColumn("mark", F.expr(MARK.format("_text")))
    return marked.mapInArrow(run, "_id bigint, mark bigint, fp bigint, key bigint, bands array<bigint>, n int, short int, head array<bigint>, odd array<bigint>")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(_id, _text) -> (key, fp, kinds ARRAY<BIGINT>), each key once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                hashes = shingle_hashes(t.as_py(), shingle)
                fp, kinds = fingerprint_of(hashes), np.unique(hashes)
                row = [pa.array([text_key(kinds, fp)], pa.int64()), pa.array([fp], pa.int64()), pa.array([kinds.view(np.int64)], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(row, ["key", "fp", "kinds"])
        give_back()

    return texts.mapInArrow(run, "key bigint, fp bigint, kinds array<bigint>").dropDuplicates(["key"])


def candidate_pairs(sketched: DataFrame) -> DataFrame:
    """(a, b), a < b: keys of texts that share a band key with a leader of it."""
    rows = sketched.where("_id IS NOT NULL").select("key", F.explode("bands").alias("bucket"))
    parts = rows.groupBy("bucket", F.expr(f"pmod(xxhash64(key, bucket), {LEADERS})").alias("_class")).agg(F.min("key").alias("_low"), F.max("key").alias("_high"))
    leads = parts.groupBy("bucket").agg(F.collect_set("_low").alias("leads"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    leads = materialize(leads.where("_low < _high").select("bucket", F.array_distinct(F.concat("leads", F.array("_high"))).alias("leads")))
    met = rows.join(leads, "bucket").select("key", F.explode("leads").alias("lead")).where("key <> lead")
    return met.select(F.least("key", "lead").alias("a"), F.greatest("key", "lead").alias("b")).distinct()


def _common(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles met more than once in a sample of the texts, sorted, and how often. They only set the order of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                kinds = np.unique(shingle_hashes(t.as_py(), shingle))
                yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64))], ["kind"])

    some = texts.where(f"pmod(xxhash64(_text), {SAMPLE}) = 0").mapInArrow(run, "kind bigint")
    counts = some.groupBy("kind").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "kind").limit(MOST_COMMON).orderBy("kind").toArrow()
    return counts.column("kind").to_numpy(), counts.column("n").to_numpy()


def heads(n: int, similarity: tuple[int, int]) -> tuple[int, int]:
    """Length of the head of a set of n as the smaller and as the larger of a pair."""
    part, whole = similarity
    return n + (-2 * part * n // (part + whole)) + 1, n + (-part * n // whole) + 1


def remaining_pairs(sketched: DataFrame, links: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """(a, b), a < b: keys of all pairs that may reach the similarity and that `links` do not put in one group."""
    part, whole = similarity
    spark, texts = sketched.sparkSession, sketched.where("_id IS NOT NULL AND n > 0")
    exploded = texts.select("key", "short", F.posexplode("head").alias("pos", "kind"))
    # Of use are shingles of two texts, one of them with the shingle in the head of a smaller set: few, found by narrow rows.
    counts = exploded.groupBy("kind").agg(F.count("*").alias("_n"), F.max(F.expr("pos < short")).alias("_some"))
    shared = materialize(counts.where("_n > 1 AND _some").select("kind"))
    free_shuffles(spark)
    # Repeated rows and texts of one key give the same row here.
    few = materialize(exploded.select("key", "pos", "kind").join(shared, "kind").distinct())
    labels = connected_components(links).select(F.col("node").alias("fp"), "label")
    sizes = materialize(texts.select("key", "fp", "n", "short").distinct().join(labels, "fp", "left").select("key", F.coalesce("label", "fp").alias("own"), "n", "short"))
    rows = materialize(few.join(sizes, "key"))
    discard(shared, few)
    free_shuffles(spark)
    # And of these, shingles of two groups.
    across = rows.groupBy("kind").agg(F.min("own").alias("_low"), F.max("own").alias("_high"), F.min(F.expr("pos - short")).alias("_least"))
    old, across = rows, materialize(across.where("_low < _high AND _least < 0").select("kind"))
    rows = materialize(old.join(across, "kind"))
    discard(old, across)
    owners = rows.groupBy("kind", "own").agg(F.min(F.expr("pos - short")).alias("_least"))
    x, y = (owners.select("kind", F.col("own").alias(o), F.col("_least").alias(f"_least_{o}")) for o in ("own_x", "own_y"))
    groups = x.where("_least_own_x < 0").join(y, "kind").where("own_x <> own_y").select("kind", "own_x", "own_y")
    x = rows.where("pos < short").select("kind", F.col("own").alias("own_x"), F.col("key").alias("key_x"), F.col("n").alias("n_x"), F.col("pos").alias("pos_x"))
    y = rows.select("kind", F.col("own").alias("own_y"), F.col("key").alias("key_y"), F.col("n").alias("n_y"), F.col("pos").alias("pos_y"))
    met = x.join(groups, ["kind", "own_x"]).join(y, ["kind", "own_y"])
    fits = f"(n_x < n_y OR (n_x = n_y AND key_x < key_y)) AND {whole}L * n_x >= {part}L * n_y"
    reach = f"{part + whole}L * least(n_x - pos_x, n_y - pos_y) >= {part}L * (n_x + n_y)"
    met = materialize(met.where(f"{fits} AND {reach}").select(F.least("key_x", "key_y").alias("a"), F.greatest("key_x", "key_y").alias("b")).distinct())
    discard(rows, sizes)
    free_shuffles(spark)
    sides = met.select(F.col("a").alias("key")).unionAll(met.select(F.col("b").alias("key"))).distinct()
    maps = materialize(texts.select("key", "n", "odd").join(sides, "key").groupBy("key").agg(F.first("n").alias("n"), F.first("odd").alias("odd")))
    side = {s: maps.select(F.col("key").alias(s), F.col("n").alias(f"n_{s}"), F.col("odd").alias(f"odd_{s}")) for s in "ab"}
    apart = "aggregate(zip_with(odd_a, odd_b, (p, q) -> bit_count(p ^ q)), 0, (p, q) -> p + q)"
    near = met.join(side["a"], "a").join(side["b"], "b").where(f"{part + whole}L * {apart} <= {whole - part}L * (n_a + n_b)")
    near = materialize(near.select("a", "b"))
    discard(met, maps)
    free_shuffles(spark)
    return near


def similar_links(docs: DataFrame, sketched: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """(a, b): fingerprints of linked texts. `sketched` is read from files. Rows with a null id are not compared. Not
    every link is given, but enough for the groups of all."""
    free_shuffles(docs.sparkSession)
    crowds = materialize(_decided(candidate_pairs(sketched), docs, sketched, id_col, text_col, shingle, similarity))
    rest = remaining_pairs(sketched, crowds, similarity)
    return materialize(crowds.unionAll(_decided(rest, docs, sketched, id_col, text_col, shingle, similarity)))


def _decided(pairs: DataFrame, docs: DataFrame, sketched: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(a, b): fingerprints of those pairs of keys that have the similarity."""
    pairs = materialize(pairs)
    wanted = pairs.select(F.col("a").alias("key")).unionAll(pairs.select(F.col("b").alias("key"))).distinct()
    ids = sketched.where("_id IS NOT NULL").join(wanted, "key").groupBy("key").agg(F.min("_id").alias("_id")).select(F.col("_id")).distinct()
    sets = materialize(_sets(_texts(docs, id_col, text_col).join(materialize(ids), "_id", "left_semi"), shingle))
    side = {s: sets.select(F.col("key").alias(s), F.col("fp").alias(f"fp_{s}"), F.col("kinds").alias(f"kinds_{s}")) for s in "ab"}
    both = pairs.join(side["a"], "a").join(side["b"], "b").withColumn("_n", F.size(F.array_intersect("kinds_a", "kinds_b")))
    part, whole = similarity
    close = both.where(f"{whole} * _n >= {part} * (size(kinds_a) + size(kinds_b) - _n) AND fp_a <> fp_b")
    return close.select(F.least("fp_a", "fp_b").alias("a"), F.greatest("fp_a", "fp_b").alias("b"))
