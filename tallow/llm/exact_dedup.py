"""Exact deduplication by two passes over a Bloom filter, in DataFrame operations only.

Pass 1 hashes each text to two bits of one 64-bit word (a blocked Bloom filter) and keeps the bits that at least
two rows set. Pass 2 tests every row against that filter: a row with a bit that no other row set is unique and
passes straight through; only the others shuffle, and their group is decided by SHA-256 of the whole text, so a
false positive of the filter costs a shuffled row and never a wrong result.

The filter has BITS_PER_ROW bits for each row of the input, so that about one row in fifty of those without a partner
shuffles, and at most MOST_BITS (2^30, 6e7 rows), which bounds what is broadcast: a word is sent only if two rows set
one of its bits, about a third of 2^24 words, each a row of 16 bytes. Beyond that more rows shuffle (at 1e9 rows about
nine in ten), and the result is the same.

Defined cases: a null text counts as empty; of equal texts the largest doc_id stays; null ids are the smallest; of rows
that repeat the largest id of their group one stays; an empty table gives an empty result; further columns of any name
are ignored by `exact_groups` and kept as they are by `drop_exact_copies`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import ascii_lower, materialize

BITS_PER_ROW = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 30


def filter_size(rows: int) -> int:
    """Bits for so many rows: a power of two."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_PER_ROW * rows - 1).bit_length()))


def _hashed(docs: DataFrame, id_col: str, text_col: str, filter_bits: int, payload: bool) -> DataFrame:
    """(_id, _text, _word, _mask[, _row]). Full lower case is coarser than A-Z alone: it may only add candidates."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    row = [F.struct("*").alias("_row")] if payload else []
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"), *row)
    rows = rows.withColumn("_h", F.xxhash64(F.lower("_text")))
    word = F.expr(f"pmod(_h, {filter_bits // 64})")
    return rows.select("_id", "_text", *(["_row"] if payload else []), word.alias("_word"), F.expr("shiftright(_h, 48) & 63").alias("_b1"), F.expr("shiftright(_h, 56) & 63").alias("_b2"))


def _repeated_bits(hashed: DataFrame) -> DataFrame:
    """The filter: (_word, _bits) of bits set by two rows or more."""
    bits = hashed.select("_word", F.explode(F.array_distinct(F.array("_b1", "_b2"))).alias("_bit"))
    twice = bits.groupBy("_word", "_bit").agg(F.count("*").alias("_n")).where("_n > 1")
    return twice.groupBy("_word").agg(F.expr("bit_or(shiftleft(1L, CAST(_bit AS INT)))").alias("_bits"))


def _parts(docs: DataFrame, id_col: str, text_col: str, filter_bits: int | None, payload: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that pass, candidates with their digest and number, and the decided groups (digest, row that stays, size)."""
    bits = filter_bits or filter_size(docs.count())
    repeated = materialize(_repeated_bits(_hashed(docs, id_col, text_col, bits, False)))
    tested = _hashed(docs, id_col, text_col, bits, payload).join(F.broadcast(repeated), "_word", "left")
    mask = "(shiftleft(1L, CAST(_b1 AS INT)) | shiftleft(1L, CAST(_b2 AS INT)))"
    maybe = F.expr(f"coalesce((_bits & {mask}) = {mask}, false)")
    out = ["_id", *(["_row"] if payload else []), F.sha2(ascii_lower(F.col("_text")), 256).alias("_sha")]
    # The number tells rows apart that repeat an id and a text; once written it does not change.
    candidates = materialize(tested.where(maybe).select(*out, F.monotonically_increasing_id().alias("_no")))
    groups = candidates.groupBy("_sha").agg(F.max(F.struct("_id", "_no")).alias("_top"), F.count("*").alias("_size"))
    return tested.where(~maybe).select(*out), candidates, materialize(groups.select("_sha", F.col("_top._id").alias("_keep"), F.col("_top._no").alias("_stay"), "_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256)."""
    single, candidates, groups = _parts(docs, id_col, text_col, filter_bits, False)
    # Both sides are read from files and exchanged for the join, so a hot digest is a skewed join that Spark splits.
    decided = candidates.join(groups, "_sha").select("_id", "_keep", "_size", F.expr("_no = _stay").alias("kept"), "_sha")
    passed = single.select("_id", F.col("_id").alias("_keep"), F.lit(1).cast("bigint").alias("_size"), F.lit(True).alias("kept"), "_sha")
    return passed.unionAll(decided).toDF(id_col, "keep_id", "group_size", "kept", "text_sha256")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", filter_bits: int | None = None) -> DataFrame:
    """The documents that stay, with all their columns."""
    single, candidates, groups = _parts(docs, id_col, text_col, filter_bits, True)
    stay = candidates.join(groups.select("_sha", "_stay"), "_sha").where("_no = _stay")
    return single.select("_row").unionAll(stay.select("_row")).select("_row.*")


SQL = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}', '{"abcdefghijklmnopqrstuvwxyz"}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)"""
