"""Language identification by rank-order profiles (out-of-place distance of the most frequent n-grams).

Grams are 1 to 3 characters of lower-cased letters, words padded with one space on either side. A profile is the
ranking of a language's PROFILE most frequent grams; a document is ranked the same way over its whole text, and
the language with the smallest sum of rank differences wins (a gram that a profile lacks counts PROFILE).

Profiles are learned from at most `per_language` documents of each language, those with the smallest hash of the
id, so the sample is bounded whatever the input. What is broadcast is languages * PROFILE grams.

Defined cases: null text, and text without a letter, give `und` with score 0; ties go to the language first in
order; equal counts rank by code point; rows with null language or null id are not learned from, and null ids are
not held out; with nothing to learn from every document is `und`.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import materialize, split_of

PROFILE = 300
PER_LANGUAGE = 1000
HELD_OUT = 5
UNKNOWN = "und"
MIN_SCORE = 0.05

_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1))
    return _LETTER[0]


def grams(text: str) -> np.ndarray | None:
    """All grams of a text as 63-bit codes, repeats included; None where it has no letter."""
    a = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    a = np.where(letters()[a], a, 32).astype(np.uint64)
    a = np.concatenate(([np.uint64(32)], a, [np.uint64(32)]))
    space = a == 32
    keep = ~(space[1:] & space[:-1])
    a, space = np.append(a[:1], a[1:][keep]), np.append(space[:1], space[1:][keep])
    if space.all():
        return None
    two = (a[:-1] << np.uint64(21)) | a[1:]
    three = ((a[:-2] << np.uint64(42)) | (two[1:]))[~space[1:-1]]
    return np.concatenate((a[~space], two, three))


def top(codes: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The k most frequent of distinct ascending codes, equal counts by code."""
    if len(codes) > 4 * k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        codes, counts = codes[counts >= least], counts[counts >= least]
    return codes[np.argsort(-counts, kind="stable")[:k]]


def rank(text: str | None, k: int = PROFILE) -> np.ndarray | None:
    g = grams(text) if text else None
    return None if g is None else top(*np.unique(g, return_counts=True), k)


class Profiles:
    """Ranks of every gram of every language, in one sorted table."""

    def __init__(self, ranked: dict[str, list[int]], k: int = PROFILE):
        self.names, self.k = sorted(ranked), k
        self.codes = np.array(sorted({g for r in ranked.values() for g in r}), np.uint64)
        self.place = np.full((len(self.codes) + 1, len(self.names)), -1, np.int64)
        for j, name in enumerate(self.names):
            self.place[np.searchsorted(self.codes, np.array(ranked[name], np.uint64)), j] = np.arange(len(ranked[name]))

    def predict(self, text: str | None) -> tuple[str, float]:
        own = rank(text, self.k) if self.names else None
        if own is None:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.codes, own)
        at[(at == len(self.codes)) | (self.codes[np.minimum(at, len(self.codes) - 1)] != own)] = len(self.codes)
        place = self.place[at]
        apart = np.where(place < 0, self.k, np.abs(place - np.arange(len(own))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.names[best], 1.0 - float(apart[best]) / (self.k * len(own))


def learn(docs: DataFrame, per_language: int = PER_LANGUAGE, k: int = PROFILE, held_out: int = HELD_OUT) -> Profiles:
    """Fits profiles on documents with a language whose crc32(doc_id) mod held_out is not 0."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & (split_of("doc_id", held_out) != 0))
    counts = rows.groupBy("lang").agg(F.count("*").alias("_n"))
    # Rows far above the wanted hash never reach the ranking, so no task sorts a whole language.
    near = rows.select("doc_id", "lang", F.xxhash64("doc_id").alias("_h")).join(F.broadcast(counts), "lang")
    near = near.where(F.expr(f"(_h / 18446744073709551616D + 0.5) * _n <= {2 * per_language + 64}"))
    chosen = near.withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(f"_r <= {per_language}")
    sample = rows.join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi").select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if text and (g := grams(text)) is not None:
                    by.setdefault(lang, []).append(g)
            for lang, parts in by.items():
                codes, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "gram", "n"])

    total = sample.mapInArrow(run, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked: dict[str, list[int]] = {}
    for r in total.withColumn("_r", F.row_number().over(order)).where(f"_r <= {k}").orderBy("lang", "_r").collect():
        ranked.setdefault(r.lang, []).append(r.gram)
    return Profiles(ranked, k)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """The rows with all their columns in a struct `_row`, and lang_pred and score. Only the text goes to Python."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def found(texts: pa.Array) -> pa.Array:
        names, scores = zip(*(profiles.predict(t.as_py()) for t in texts), strict=True) if len(texts) else ((), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    source = docs.select(F.struct("*").alias("_row"), F.col("text").cast("string").alias("_text"))
    once = found.asNondeterministic()  # else a filter on the result computes it a second time
    return source.withColumn("_found", once("_text")).select("_row", "_found.lang_pred", "_found.score")


def identify(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document."""
    found = predict(docs.select("doc_id", "text"), learn(docs, per_language)).select("_row.doc_id", "lang_pred", "score")
    return found.select("doc_id", F.coalesce(split_of("doc_id", HELD_OUT) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def drop_unidentified(docs: DataFrame, per_language: int = PER_LANGUAGE, min_score: float = MIN_SCORE) -> DataFrame:
    """The documents with a language, with all their columns: `und` and scores under min_score go."""
    profiles = learn(docs, per_language)
    return predict(docs, profiles).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("_row.*")
