"""SimHash near-duplicates, with pigeonring filtering of candidate pairs.

A 64-bit fingerprint is a ring of 16 segments of 4 bits. If two fingerprints differ in at most 2 bits, then from
some segment on, every chain of l consecutive segments differs in at most l * 2 / 16 bits (the pigeonring
principle): none in the first 7 segments, at most 1 in the first 15, at most 2 in all. So pairs need only be
sought among fingerprints that, in one of 16 rotations, agree in 28 bits (chains of 1 to 7) and then differ in at
most one of the next 32 bits (chains of 8 to 15); a full Hamming check follows.

The first budget is a count per key in one shuffle of distinct fingerprints; what has no partner stops there. The
second is equality with one of the 32 bits struck out. A group of such a key has at most 2 * 2^4 = 32 distinct
fingerprints, so no group grows with the data and no bucket's pairs are all formed. Copies never meet: only
distinct fingerprints are compared, and documents get their component by a join on the fingerprint.

Defined cases: null text counts as empty; no word gives fingerprint zero, linked like any other; one or two words
are one shingle; null ids are ignored when the smallest id is chosen (null if a component has no other); repeated
rows get the same component, and `drop_near_copies` keeps all rows that equal the one that stays in id and text, which is
exact deduplication's to mend; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import materialize
from tallow.llm.components import connected_components
from tallow.llm.fingerprint import fingerprint_of, shingle_hashes
from tallow.llm.similarity import MARK, SIMILARITY, similar_links, sketches

SHINGLE = 3
NEAR_SHINGLE = 5
MAX_BITS = 2
SEGMENTS = 16
SEGMENT_BITS = 4
EXACT_BITS = 28  # 7 segments: 7 * 2 / 16 < 1
ONE_OFF_BITS = 32  # 8 more: 15 * 2 / 16 < 2


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp BIGINT)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = [fingerprint(t.as_py(), shingle) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["_id", "fp"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("_text"))
    return rows.mapInArrow(run, "_id bigint, fp bigint")


def pigeonring_links(distinct: DataFrame) -> DataFrame:
    """(fp) of distinct rows -> (a, b), a < b: pairs at most 2 bits apart, each once."""
    turned = "(shiftleft(fp, CAST(4 * i AS INT)) | shiftrightunsigned(fp, CAST(64 - 4 * i AS INT)))"
    rings = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SEGMENTS - 1))).alias("i")).selectExpr("fp", "i", f"CASE WHEN i = 0 THEN fp ELSE {turned} END AS r")
    keyed = rings.selectExpr("fp", f"shiftleft(CAST(i AS BIGINT), {EXACT_BITS}) | shiftrightunsigned(r, {64 - EXACT_BITS}) AS ring", f"shiftrightunsigned(r, {SEGMENT_BITS}) & 4294967295 AS mid")
    met = keyed.selectExpr("*", "count(*) OVER (PARTITION BY ring) AS _n").where("_n > 1").drop("_n")
    struck = met.select("ring", "fp", "mid", F.explode(F.sequence(F.lit(0), F.lit(ONE_OFF_BITS - 1))).alias("bit"))
    struck = struck.selectExpr("ring", "fp", "bit", "mid & ~shiftleft(1L, bit) AS rest")
    groups = struck.groupBy("ring", "bit", "rest").agg(F.array_sort(F.collect_set("fp")).alias("fps")).where("size(fps) > 1")
    partners = f"filter(slice(fps, i + 2, size(fps)), y -> bit_count(x ^ y) <= {MAX_BITS})"
    pairs = f"flatten(transform(fps, (x, i) -> transform({partners}, y -> struct(x AS a, y AS b))))"
    return groups.select(F.explode(F.expr(pairs)).alias("p")).select("p.a", "p.b").distinct()


def components_of(printed: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(_id, fp), read from files -> (fp, component_id) for each distinct fingerprint. `more`: further links (a, b)."""
    first = materialize(printed.groupBy("fp").agg(F.min("_id").alias("_first")))
    links = pigeonring_links(first.select("fp"))
    labels = connected_components(links if more is None else links.unionAll(more))
    linked = materialize(first.join(labels.withColumnRenamed("node", "fp"), "fp"))
    lowest = materialize(linked.groupBy("label").agg(F.min("_first").alias("component_id")))
    joined = linked.join(lowest, "label").select("fp", "component_id")
    alone = first.join(labels.select(F.col("node").alias("fp")), "fp", "left_anti").selectExpr("fp", "_first AS component_id")
    return materialize(joined.unionAll(alone))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row per document: (doc_id, fingerprint, component_id)."""
    printed = materialize(fingerprints(docs, id_col, text_col, shingle))
    rows = printed.join(components_of(printed), "fp")
    return rows.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """One row per document: (_id, component_id). Linked are fingerprints at most 2 bits apart, and texts whose sets of
    shingles have the similarity (a fraction) or more. Texts without words are linked by their fingerprint alone."""
    return _grouped(docs, id_col, text_col, shingle, similarity).select("_id", "component_id")


def _grouped(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: tuple[int, int]) -> DataFrame:
    """(_id, mark, component_id)."""
    sketched = materialize(sketches(docs, id_col, text_col, shingle, similarity))
    links = similar_links(docs, sketched, id_col, text_col, shingle, similarity)
    printed = sketched.select("_id", "mark", "fp")
    return printed.join(components_of(printed.select("_id", "fp"), links), "fp").select("_id", "mark", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = NEAR_SHINGLE, similarity: tuple[int, int] = SIMILARITY) -> DataFrame:
    """The documents that stay, with all their columns: the one of smallest id in each component, and null ids. A row is
    told by its id and a hash of its text, so another row of the same id stays."""
    rows = _grouped(docs, id_col, text_col, shingle, similarity)
    gone = materialize(rows.where("_id <> component_id").select(F.col("_id").alias("_gone"), F.col("mark").alias("_mark")).distinct())
    d, g = docs.alias("_docs"), gone.alias("_gone")  # qualified: the table may have columns of any name
    return d.join(g, (F.col(f"_docs.`{id_col}`") == F.col("_gone._gone")) & (F.expr(MARK.format(f"_docs.`{text_col}`")) == F.col("_gone._mark")), "left_anti")
