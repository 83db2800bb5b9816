"""Quality rules with thresholds that follow the data: quantile sketches per language and source, then a joined filter.

Counts of a text come from one narrow projection. Four integer features of the texts that pass the base rules go
into sketches: histograms over buckets of 1/64 relative width (exact below 64), which merge by adding counts, so the
result depends neither on order nor on partitions. A (language, source) with fewer than `min_group` such texts takes
the merged sketch of its language, and a language with fewer that of all. A text is kept if every feature lies within
its fence: the quartile plus or minus SPREAD times the distance of the quartiles, and at least a margin.

DataFrame functions only. Repeated 3-word windows are found by 64-bit hash within one text.

Defined cases: null text has no words and fails the base rules; null language or source is a group of its own; null
ids and repeated rows are judged like any other; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallow.llm.common import materialize

MIN_WORDS = 50
MIN_GROUP = 100
SPREAD = 3
#: Feature -> (SQL expression on the counts, least distance of the fence from the quartile, fenced below too)
FEATURES = {
    "symbols": ("n_symbols * 1000 {div} greatest(word_chars, 1)", 50, False),
    "dup_lines": ("n_dup_lines * 1000 {div} greatest(n_lines, 1)", 300, False),
    "repeats": ("n_repeat_words * 1000 {div} greatest(n_words, 1)", 250, False),
    "word_length": ("word_chars * 100 {div} greatest(n_words, 1)", 200, True),
}
NONE = "\x00"


def _settled(df: DataFrame) -> DataFrame:
    """Computed before what follows: the optimiser does not move expressions across a one-row generate."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_s")).select("_s.*")


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words)."""
    own = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(NONE)).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), *own, F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("t"))
    words = r"filter(split(t, '[ \\t-\\r]+'), w -> w <> '')"
    lines = r"filter(split(t, '\\n'), l -> l rlike '[^ \\t-\\r]')"
    symbols = "CAST(char_length(t) - char_length(regexp_replace(t, '[#*$%&|<>]+', '')) AS BIGINT)"
    rows = _settled(rows.selectExpr("doc_id", "lang", "source", f"{words} AS words", f"{lines} AS lines", f"{symbols} AS n_symbols"))
    grams = "CASE WHEN size(words) < 3 THEN CAST(array() AS array<bigint>) ELSE transform(arrays_zip(slice(words, 1, size(words) - 2), slice(words, 2, size(words) - 2), slice(words, 3, size(words) - 2)), z -> xxhash64(z)) END"
    rows = _settled(
        rows.selectExpr(
            "doc_id", "lang", "source", "n_symbols", "CAST(size(words) AS BIGINT) AS n_words", "CAST(char_length(array_join(words, '')) AS BIGINT) AS word_chars",
            "CAST(size(lines) AS BIGINT) AS n_lines", "CAST(size(lines) - size(array_distinct(lines)) AS BIGINT) AS n_dup_lines", f"{grams} AS g",
        )
    )
    # Windows sorted by hash: those with an equal neighbour repeat; none do in most texts, which stop at the first test.
    ordered = "CASE WHEN size(array_distinct(g)) = size(g) THEN CAST(array() AS array<struct<h:bigint,i:int>>) ELSE array_sort(transform(g, (h, i) -> struct(h AS h, i AS i))) END"
    rows = _settled(rows.selectExpr(*(c for c in rows.columns if c != "g"), f"{ordered} AS s"))
    places = "array_sort(transform(filter(s, (e, k) -> (k > 0 AND s[k - 1].h = e.h) OR (k < size(s) - 1 AND s[k + 1].h = e.h)), e -> e.i))"
    rows = _settled(rows.selectExpr(*(c for c in rows.columns if c != "s"), f"{places} AS p"))
    covered = "CASE WHEN size(p) = 0 THEN 0L ELSE 3L + aggregate(zip_with(slice(p, 2, size(p)), slice(p, 1, size(p) - 1), (b, a) -> CAST(least(3, b - a) AS BIGINT)), 0L, (x, y) -> x + y) END"
    return rows.selectExpr(*(c for c in rows.columns if c != "p"), f"{covered} AS n_repeat_words")


BASE = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words)"
BUCKET = "CASE WHEN v < 64 THEN v ELSE shiftleft(shiftright(v, length(bin(v)) - 6), length(bin(v)) - 6) END"


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, n) of texts that pass the base rules."""
    each = ", ".join(f"struct('{k}' AS feature, CAST({e.format(div='div')} AS BIGINT) AS v)" for k, (e, _, _) in FEATURES.items())
    rows = counts.where(f"NOT {BASE}").selectExpr("lang", "source", f"explode(array({each})) AS f").selectExpr("lang", "source", "f.feature", "f.v AS v")
    return rows.groupBy("lang", "source", "feature", F.expr(BUCKET).alias("bucket")).agg(F.count("*").alias("n"))


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to these keys -> (keys, low_*, high_*, n) per key."""
    merged = sketch.groupBy(*keys, "feature", "bucket").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*keys, "feature")
    rows = merged.withColumn("c", F.sum("n").over(w.orderBy("bucket"))).withColumn("all", F.sum("n").over(w))
    quart = rows.groupBy(*keys, "feature").agg(F.max("all").alias("n"), F.min(F.when(F.expr("4 * c >= all"), F.col("bucket"))).alias("q1"), F.min(F.when(F.expr("4 * c >= 3 * all"), F.col("bucket"))).alias("q3"))
    out = [F.max("n").alias("n")]
    for k, (_, margin, below) in FEATURES.items():
        reach = f"greatest({SPREAD} * (q3 - q1), {margin})"
        out.append(F.max(F.expr(f"CASE WHEN feature = '{k}' THEN q3 + {reach} END")).alias(f"high_{k}"))
        if below:
            out.append(F.max(F.expr(f"CASE WHEN feature = '{k}' THEN q1 - {reach} END")).alias(f"low_{k}"))
    return quart.groupBy(*keys).agg(*out)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_group: int = MIN_GROUP) -> DataFrame:
    """One row per document: (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept)."""
    counts = materialize(text_counts(docs, id_col, text_col, lang_col, source_col))
    sketch = materialize(sketches(counts))
    bounds = [f"high_{k}" for k in FEATURES] + [f"low_{k}" for k, v in FEATURES.items() if v[2]]
    one = fences(sketch, ["lang", "source"])
    two = fences(sketch, ["lang"])
    all_ = fences(sketch.withColumn("_all", F.lit(0)), ["_all"])
    a, b, c = (d.select(*[x for x in d.columns if x not in (*bounds, "n")], F.struct("n", *bounds).alias(name)) for d, name in ((one, "a"), (two, "b"), (all_, "c")))
    level = f"CASE WHEN a.n >= {min_group} THEN a WHEN b.n >= {min_group} THEN b ELSE c END"
    chosen = a.join(b, "lang").withColumn("_all", F.lit(0)).join(F.broadcast(c), "_all").select("lang", "source", F.expr(level).alias("f"))
    chosen = materialize(chosen.select("lang", "source", "f.*"))
    # Both sides come from files, so a source with a third of all rows is a skewed join that Spark splits.
    rows = counts.join(chosen, ["lang", "source"], "left")
    inside = " AND ".join([f"{e.format(div='div')} <= high_{k}" + (f" AND {e.format(div='div')} >= low_{k}" if below else "") for k, (e, _, below) in FEATURES.items()])
    return rows.selectExpr(f"doc_id AS `{id_col}`", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", f"{BASE} AS base_failed", f"NOT {BASE} AND coalesce({inside}, false) AS kept")


def _sql() -> str:
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {e.format(div='//')} AS v FROM m WHERE NOT {BASE}" for k, (e, _, _) in FEATURES.items())
    bucket = BUCKET.replace("shiftleft(shiftright(v, length(bin(v)) - 6), length(bin(v)) - 6)", "(v >> CAST(length(bin(v)) - 6 AS INTEGER)) << CAST(length(bin(v)) - 6 AS INTEGER)")

    def fence(keys: str) -> str:
        picks = ", ".join(f"max(q3 + greatest({SPREAD} * (q3 - q1), {m})) FILTER (WHERE feature = '{k}') AS high_{k}" + (f", max(q1 - greatest({SPREAD} * (q3 - q1), {m})) FILTER (WHERE feature = '{k}') AS low_{k}" if below else "") for k, (_, m, below) in FEATURES.items())
        return f"""SELECT {keys}, max(n) AS n, {picks} FROM (SELECT {keys}, feature, max(al) AS n, min(bucket) FILTER (WHERE 4 * c >= al) AS q1, min(bucket) FILTER (WHERE 4 * c >= 3 * al) AS q3
FROM (SELECT {keys}, feature, bucket, sum(n) OVER (PARTITION BY {keys}, feature ORDER BY bucket) AS c, sum(n) OVER (PARTITION BY {keys}, feature) AS al FROM (SELECT {keys}, feature, bucket, sum(n) AS n FROM sk GROUP BY {keys}, feature, bucket)) GROUP BY {keys}, feature) GROUP BY {keys}"""

    names = [f"high_{k}" for k in FEATURES] + [f"low_{k}" for k, v in FEATURES.items() if v[2]]
    pick = ", ".join(f"CASE WHEN f1.n >= {MIN_GROUP} THEN f1.{x} WHEN f2.n >= {MIN_GROUP} THEN f2.{x} ELSE f3.{x} END AS {x}" for x in names)
    inside = " AND ".join([f"{e.format(div='//')} <= high_{k}" + (f" AND {e.format(div='//')} >= low_{k}" if below else "") for k, (e, _, below) in FEATURES.items()])
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^ \t-\r]+') AS ws, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^ \t-\r]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS k FROM g) WHERE k > 1),
rw AS (SELECT rid, count(DISTINCT i + j) AS n FROM r, (SELECT unnest(range(3)) AS j) GROUP BY rid),
m AS (SELECT doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(rw.n, 0) AS n_repeat_words FROM d JOIN w USING (rid) LEFT JOIN rw USING (rid)),
fe AS ({each}),
sk AS (SELECT lang, source, 0 AS al0, feature, bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT lang, source, feature, {bucket} AS bucket FROM fe) GROUP BY lang, source, feature, bucket),
f1 AS ({fence('lang, source')}), f2 AS ({fence('lang')}), f3 AS ({fence('al0')}),
ch AS (SELECT f1.lang, f1.source, {pick} FROM f1 JOIN f2 USING (lang), f3)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {BASE} AS base_failed, NOT {BASE} AND coalesce({inside}, false) AS kept FROM m LEFT JOIN ch USING (lang, source)"""


SQL = _sql()
