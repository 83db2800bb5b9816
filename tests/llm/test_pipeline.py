"""The corpus pipeline against plain Python, stage after stage."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_dedup import brute_first, brute_similar, exact_dedup_upper
from tests.llm.test_text import ODD, frame, packed

SF = "/root/testdata/sf0.001"
TOP = 300


def ascii_lower(text):
    return (text or "").translate(str.maketrans(exact_dedup_upper, exact_dedup_upper.lower()))


def ranking(texts):
    count = Counter()
    for t in texts:
        for w in "".join(c if c.isalpha() else " " for c in (t or "").lower()).split(" "):
            if w:
                padded = f" {w} "
                count.update(w)
                count.update(padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return sorted(count, key=lambda g: (-count[g], code(g)))[:TOP]


def with_language(rows):
    by = defaultdict(list)
    for r in rows:
        if r["lang"] is not None and r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            by[r["lang"]].append(r["text"])
    places = {lang: {g: i for i, g in enumerate(ranking(texts))} for lang, texts in by.items()}
    kept = []
    for r in rows:
        own = ranking([r["text"]])
        apart = [sum(abs(p[g] - i) if g in p else TOP for i, g in enumerate(own)) for p in places.values()]
        if own and apart and 1 - min(apart) / (TOP * len(own)) >= 0.05:
            kept.append(r)
    return kept


def without_exact_copies(rows):
    best = {}
    for r in rows:
        t = ascii_lower(r["text"])
        best[t] = max(best.get(t, -1), r["doc_id"])
    out, seen = [], set()
    for r in rows:
        t = ascii_lower(r["text"])
        if best[t] == r["doc_id"] and t not in seen:
            seen.add(t)
            out.append(r)
    return out


def without_near_copies(rows):
    component = dict(brute_similar([(r["doc_id"], r["text"]) for r in rows]))
    return [r for r in rows if component[r["doc_id"]] == r["doc_id"]]


def without_repeats(rows):
    left = brute_first([(r["doc_id"], r["text"]) for r in rows], corpus_pipeline.REPEAT_BYTES)
    return [r | {"text": None if r["text"] is None else left[r["doc_id"]], "n_chars": len(left[r["doc_id"]])} for r in rows]


BRUTE = {"language_id": with_language, "exact_dedup": without_exact_copies, "near_dedup": without_near_copies, "suffix_dedup": without_repeats}


def by_id(rows):
    return sorted(rows, key=lambda r: r["doc_id"])


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_each_stage_and_the_whole(spark, documents):
    docs, rows = documents, [r.asDict() for r in documents.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == documents.columns
        got, before = by_id(r.asDict() for r in stage(spark, docs, SF).collect()), len(rows)
        rows = by_id(BRUTE[name](rows))
        assert got == rows, name
        assert 0 < len(rows) <= before
        docs = spark.createDataFrame([tuple(r[c] for c in documents.columns) for r in rows], documents.schema)
    padding, total = packed(docs, corpus_pipeline.run(spark, SF).collect())
    assert padding / total < 0.05


def test_stages_on_odd_rows(spark):
    docs = frame(spark, ODD)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, SF)
        assert docs.columns == columns
    kept = sorted(((r.doc_id, r.text[:8]) for r in docs.collect()), key=str)
    assert kept == sorted([(5, "x"), (6, "same"), (7, "tail spa"), (8, "a  b \n c"), (9, "😀é"), (None, "no id")], key=str)
    packed(docs, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect())
    empty = frame(spark, ODD).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_repeated_rows_keep_their_text_once(spark):
    rng = random.Random(6)
    long = " ".join("".join(rng.choice("aeinorst") for _ in range(rng.randint(2, 9))) for _ in range(500))
    docs = frame(spark, [(1, long), (1, long), (2, long), (None, "some other text here"), (3, None), (3, None)])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted([(2, long), (None, "some other text here")], key=str)
