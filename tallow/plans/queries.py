"""The registered queries of the integer operators, each with the same result in ANSI SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallow.functions.arith import truncated_ratio
from tallow.operators import archive as A
from tallow.operators import bytestream as B
from tallow.operators import quantize as Q
from tallow.operators import report as P
from tallow.operators import residual as R
from tallow.operators.elements import to_elements, to_groups, with_geometry, with_positions
from tallow.operators.histogram import byte_histogram
from tallow.operators.scan import exclusive_scan_two_level
from tallow.schema import GROUP

#: name -> (table, unique integer key, integer expression in Spark, the same in ANSI SQL, bytes per value)
COLUMNS = {
    "u16": ("orders", "o_orderkey", "o_custkey % 65536", "o_custkey % 65536", 2),
    "skewed": ("events", "event_id", "CAST(floor(value * 100) AS BIGINT)", "CAST(floor(value * 100) AS BIGINT)", 2),
    "u32": ("orders", "o_orderkey", "CAST(floor(o_totalprice) AS BIGINT) * 8000", "CAST(floor(o_totalprice) AS BIGINT) * 8000", 4),
}
PROB_BITS = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def elements(spark: SparkSession, sf: str, column: str) -> DataFrame:
    name, key, value, _, _ = COLUMNS[column]
    return with_positions(table(spark, sf, name), key, value)


def groups(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return to_groups(elements(spark, sf, column))


def mapped(spark: SparkSession, sf: str, column: str) -> DataFrame:
    return R.map_groups(groups(spark, sf, column))


def histogram(spark: SparkSession, sf: str) -> DataFrame:
    return byte_histogram(table(spark, sf, "documents"), "text")


# --- SQL fragments -------------------------------------------------------------------------------------------


def el_sql(column: str) -> str:
    """CTEs el (pos, gid, lane, slot, val), ce (gid, n, center) and ma (…, center, d, len, code)."""
    name, key, _, value, _ = COLUMNS[column]
    return f"""
WITH ps AS (SELECT row_number() OVER (ORDER BY {key}) - 1 AS pos, CAST({value} AS BIGINT) AS val FROM {name}),
el AS (SELECT pos, pos // 512 AS gid, CAST((pos % 512) // 16 AS INTEGER) AS lane, CAST(pos % 16 AS INTEGER) AS slot, val FROM ps),
ce AS (SELECT gid, count(*) AS n, CAST(sum(val) AS BIGINT) // count(*) AS center FROM el GROUP BY gid),
le AS (SELECT el.*, center, abs(val - center) AS d, greatest(1, (abs(val - center) + 125) // 126) AS len FROM el JOIN ce USING (gid)),
ma AS (SELECT *, CASE WHEN val = center THEN 1 WHEN val > center THEN 2 * (d - 126 * (len - 1)) ELSE 2 * (d - 126 * (len - 1)) + 1 END AS code FROM le),
lb AS (SELECT gid, lane, CAST(sum(len) AS BIGINT) AS bits, string_agg('1' || repeat('0', CAST(len - 1 AS INTEGER)), '' ORDER BY slot) AS txt FROM ma GROUP BY gid, lane),
sl AS (SELECT gid, (max(bits) + 7) // 8 AS sig_len FROM lb GROUP BY gid)"""


def hist_sql(bits: int = 10) -> str:
    return _HIST.replace("1025", str((1 << bits) + 1)).replace("1024", str(1 << bits))


_HIST = """
WITH RECURSIVE hx AS (SELECT hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL),
bt AS (SELECT substr(h, 2 * i + 1, 2) AS x FROM (SELECT h, unnest(range(length(h) // 2)) AS i FROM hx)),
ct AS (SELECT x, count(*) AS cnt FROM bt GROUP BY x),
sp AS (SELECT CAST(i AS INTEGER) AS sym, printf('%02X', i) AS x FROM (SELECT unnest(range(256)) AS i)),
hi AS (SELECT sym, coalesce(cnt, 0) AS cnt FROM sp LEFT JOIN ct USING (x)),
q1 AS (SELECT sym, cnt, CASE WHEN cnt = 0 THEN 0 ELSE greatest(1, CAST(floor(1024 * CAST(CAST(cnt AS FLOAT) / CAST((SELECT sum(cnt) FROM hi) AS FLOAT) AS DOUBLE)) AS BIGINT)) END AS q FROM hi),
lv AS (SELECT r, sum(least(greatest(q - 1, 0), r)) AS c FROM q1, (SELECT unnest(range(1025)) AS r) GROUP BY r),
fa AS (SELECT (SELECT sum(q) FROM q1) AS s, (SELECT max(r) FROM lv WHERE c <= (SELECT sum(q) FROM q1) - 1024) AS r, (SELECT max(c) FROM lv WHERE c <= (SELECT sum(q) FROM q1) - 1024) AS c),
lo AS (SELECT sym, cnt, q, s, c, CASE WHEN s > 1024 AND q > 0 THEN greatest(q - r, 1) ELSE q END AS low FROM q1, fa),
rk AS (SELECT *, row_number() OVER (PARTITION BY low > 1 ORDER BY q, sym) AS k FROM lo),
wt AS (SELECT sym, cnt, CAST(q AS BIGINT) AS q, CAST(CASE WHEN s <= 1024 THEN q + CASE WHEN sym < 1024 - s THEN 1 ELSE 0 END ELSE low - CASE WHEN low > 1 AND k <= s - 1024 - c THEN 1 ELSE 0 END END AS BIGINT) AS pdf FROM rk),
cd AS (SELECT sym, pdf, CAST(coalesce(sum(pdf) OVER (ORDER BY sym ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS cdf,
  CASE WHEN pdf = 0 THEN NULL WHEN pdf = 1 THEN 0 ELSE length(bin(pdf - 1)) END AS shift FROM wt),
tb AS (SELECT sym, pdf, cdf, CASE WHEN pdf = 0 THEN NULL ELSE (4294967296 * ((CAST(1 AS BIGINT) << CAST(shift AS INTEGER)) - pdf)) // pdf + 1 END AS magic, CAST(shift AS INTEGER) AS shift FROM cd)"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# --- residual mapping ----------------------------------------------------------------------------------------

for _c in COLUMNS:
    QUERIES[f"group_center_{_c}"] = lambda s, d, c=_c: R.centred(groups(s, d, c)).selectExpr("gid", "CAST(size(vals) AS BIGINT) AS n", "center")
    SQL[f"group_center_{_c}"] = el_sql(_c) + " SELECT gid, n, center FROM ce"
    QUERIES[f"residual_map_{_c}"] = lambda s, d, c=_c: to_elements(mapped(s, d, c), "vals", "lens", "codes").selectExpr("pos", "gid", "lane", "slot", "vals AS val", "center", "abs(vals - center) AS distance", "lens AS len", "codes AS code")
    SQL[f"residual_map_{_c}"] = el_sql(_c) + " SELECT pos, gid, lane, slot, val, center, d AS distance, len, code FROM ma"
    QUERIES[f"residual_roundtrip_{_c}"] = lambda s, d, c=_c: to_elements(R.unmap_groups(mapped(s, d, c)), "vals").selectExpr("pos", "vals AS val")
    SQL[f"residual_roundtrip_{_c}"] = el_sql(_c) + " SELECT pos, val FROM el"
    if COLUMNS[_c][4] > 2:
        continue  # unary bit signals are for 16-bit values; wide values take the byte form with its literals
    QUERIES[f"packed_roundtrip_{_c}"] = lambda s, d, c=_c: to_elements(R.unmap_groups(R.unpack_groups(R.pack_groups(mapped(s, d, c)))), "vals").selectExpr("pos", "vals AS val")
    SQL[f"packed_roundtrip_{_c}"] = el_sql(_c) + " SELECT pos, val FROM el"


@query("fixed_center_map", el_sql("u16").replace("CAST(sum(val) AS BIGINT) // count(*) AS center", "CAST(700 AS BIGINT) AS center") + " SELECT pos, len, code FROM ma")
def fixed_center(s, d):
    return to_elements(R.map_groups(groups(s, d, "u16"), 700), "lens", "codes").selectExpr("pos", "lens AS len", "codes AS code")


@query("lane_bits", el_sql("u16") + " SELECT gid, lane, bits, bits > 256 AS over_256 FROM lb")
def lane_bits(s, d):
    return R.lanes(mapped(s, d, "u16")).selectExpr("gid", "lane", "bits", "bits > 256 AS over_256")


@query("signal_length", el_sql("u16") + " SELECT gid, sig_len FROM sl")
def signal_length(s, d):
    return R.signal_lengths(mapped(s, d, "u16"))


OFFSETS = el_sql("u16") + " SELECT gid, sig_len, CAST(coalesce(sum(sig_len) OVER (ORDER BY gid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM sl"


@query("signal_offsets", OFFSETS)
def offsets(s, d):
    return exclusive_scan_two_level(R.signal_lengths(mapped(s, d, "u16")), "gid", "sig_len")


@query("signal_offsets_two_level", OFFSETS)
def offsets_two_level(s, d):
    return exclusive_scan_two_level(R.signal_lengths(mapped(s, d, "u16")), "gid", "sig_len", fanout=8)


@query("inclusive_lengths", el_sql("u16") + " SELECT CAST(i AS BIGINT) AS gid, CAST(coalesce((SELECT sum(sig_len) FROM sl WHERE sl.gid < i), 0) AS BIGINT) AS total FROM (SELECT unnest(range((SELECT count(*) FROM sl) + 1)) AS i)")
def inclusive_lengths(s, d):
    """The g + 1 stored offsets: row g holds the total."""
    rows = exclusive_scan_two_level(R.signal_lengths(mapped(s, d, "u16")), "gid", "sig_len")
    last = rows.agg(F.max(F.struct("gid", F.expr("`offset` + sig_len").alias("t"))).alias("m")).where("m IS NOT NULL").selectExpr("m.gid + 1 AS gid", "m.t AS total")
    return rows.selectExpr("gid", "`offset` AS total").unionAll(last)


_BYTES = "substr(rpad(rpad(txt, CAST(least(bits // 8 + 1, sig_len) * 8 AS INTEGER), '1'), CAST(8 * sig_len AS INTEGER), '0')"


@query("signal_stream_hex", el_sql("u16") + f" SELECT gid, lane, upper(string_agg(printf('%02x', CAST(CAST({_BYTES}, CAST(8 * i + 1 AS INTEGER), 8) AS BIT) AS INTEGER)), '' ORDER BY i)) AS hex FROM (SELECT gid, lane, txt, bits, sig_len, unnest(range(sig_len)) AS i FROM lb JOIN sl USING (gid)) GROUP BY gid, lane")
def stream_hex(s, d):
    return R.lane_hex(mapped(s, d, "u16")).drop("n")


@query("signal_stream_ones", el_sql("u16") + " SELECT gid, lane, upper(string_agg(printf('%02x', CAST(CAST(substr(rpad(txt, CAST(8 * sig_len AS INTEGER), '1'), CAST(8 * i + 1 AS INTEGER), 8) AS BIT) AS INTEGER)), '' ORDER BY i)) AS hex FROM (SELECT gid, lane, txt, sig_len, unnest(range(sig_len)) AS i FROM lb JOIN sl USING (gid)) GROUP BY gid, lane")
def stream_ones(s, d):
    """The older padding: ones to the group's length."""
    return R.lane_hex(mapped(s, d, "u16"), "ones").drop("n")


@query("signal_restore", el_sql("u16") + " SELECT gid, lane, slot, len FROM ma")
def restore(s, d):
    back = R.restore_lane(R.lane_hex(mapped(s, d, "u16")))
    return back.selectExpr("gid", "lane", "posexplode(lens) AS (slot, len)")


@query("packed_bytes", el_sql("u16") + " SELECT gid, n, sig_len, 32 * sig_len AS signal_bytes FROM sl JOIN ce USING (gid)")
def packed_bytes(s, d):
    return R.pack_groups(mapped(s, d, "u16")).selectExpr("gid", "CAST(n AS BIGINT) AS n", "sig_len", "CAST(length(signals) AS BIGINT) AS signal_bytes")


@query("code_signal_split", el_sql("u16") + " SELECT pos, code, 2 * (len - 1) AS signal FROM ma")
def code_signal(s, d):
    return to_elements(B.split_code_signal(mapped(s, d, "u16")), "codes", "signals").selectExpr("pos", "codes AS code", "signals AS signal")


@query("size_report", el_sql("u16") + """, t AS (SELECT (SELECT count(*) FROM el) AS n, count(*) AS groups, CAST(sum(sig_len) AS BIGINT) * 32 AS signal_bytes FROM sl),
u AS (SELECT n, groups, n * 2 AS raw_bytes, 4 * (groups + 1) AS length_bytes, 2 * groups AS center_bytes, n AS code_bytes, signal_bytes, 4 * (groups + 1) + 2 * groups + n + signal_bytes AS total_bytes FROM t)
SELECT *, CAST((raw_bytes * 1000) // total_bytes AS DOUBLE) / 1000 AS ratio FROM u""")  # fmt: skip
def size_report(s, d):
    return P.size_report(mapped(s, d, "u16").selectExpr("CAST(size(vals) AS BIGINT) AS n", f"{R.SIG_LEN} AS sig_len"), 2)


@query("global_mean", el_sql("skewed") + " SELECT CAST(trunc(CAST(sum(val) AS DOUBLE) / count(*)) AS BIGINT) AS mean FROM el")
def global_mean(s, d):
    return P.global_mean(elements(s, d, "skewed"))


@query("upper_median", el_sql("skewed") + ", r AS (SELECT val, row_number() OVER (ORDER BY val) - 1 AS i FROM el) SELECT val AS median FROM r WHERE i = (SELECT count(*) // 2 FROM el)")
def upper_median(s, d):
    return P.upper_median(elements(s, d, "skewed"))


@query("lossless_check", el_sql("skewed") + " SELECT count(*) AS n_original, count(*) AS n_decoded, CAST(0 AS BIGINT) AS n_mismatch, CAST(NULL AS BIGINT) AS first_pos, CAST(NULL AS BIGINT) AS first_original, CAST(NULL AS BIGINT) AS first_decoded FROM el")
def lossless(s, d):
    g = groups(s, d, "skewed")
    back = to_elements(R.unmap_groups(R.map_groups(g)), "vals").selectExpr("pos", "vals AS val")
    return P.lossless_check(to_elements(g, "vals").selectExpr("pos", "vals AS val"), back)


@query("first_mismatch", el_sql("skewed") + " SELECT count(*) AS n_original, count(*) - count(*) FILTER (WHERE pos % 1000 = 999) AS n_decoded, count(*) FILTER (WHERE pos % 1000 = 999 OR pos % 700 = 699) AS n_mismatch, min(pos) FILTER (WHERE pos % 1000 = 999 OR pos % 700 = 699) AS first_pos, arg_min(val, pos) FILTER (WHERE pos % 1000 = 999 OR pos % 700 = 699) AS first_original, arg_min(CASE WHEN pos % 1000 = 999 THEN NULL ELSE val + 1 END, pos) FILTER (WHERE pos % 1000 = 999 OR pos % 700 = 699) AS first_decoded FROM el")
def first_mismatch(s, d):
    """A damaged copy: each 1000th row lost, each 700th changed."""
    e = elements(s, d, "skewed")
    bad = e.where("pos % 1000 <> 999").selectExpr("pos", "CASE WHEN pos % 700 = 699 THEN val + 1 ELSE val END AS val")
    return P.lossless_check(e, bad)


# --- byte streams --------------------------------------------------------------------------------------------

for _c, _limit in (("u16", 4), ("u32", 8), ("skewed", 4)):
    _w = COLUMNS[_c][4]
    QUERIES[f"byte_stream_length_{_c}"] = lambda s, d, c=_c: B.encode_lanes(groups(s, d, c), COLUMNS[c][4]).selectExpr("gid", "lane", "CAST(size(bytes) AS BIGINT) AS n_bytes")
    SQL[f"byte_stream_length_{_c}"] = el_sql(_c) + f" SELECT gid, lane, (CAST(sum(CASE WHEN len <= {_limit} THEN len ELSE {_w + 1} END) AS BIGINT) + 7) // 8 * 8 AS n_bytes FROM ma GROUP BY gid, lane"
    QUERIES[f"byte_stream_roundtrip_{_c}"] = lambda s, d, c=_c: B.decode_lanes(B.encode_lanes(groups(s, d, c), COLUMNS[c][4]), COLUMNS[c][4]).selectExpr("gid", "lane", "posexplode(vals) AS (slot, val)")
    SQL[f"byte_stream_roundtrip_{_c}"] = el_sql(_c) + " SELECT gid, lane, slot, val FROM el"

_LIT = "printf('fe%04x', val)"


@query("byte_stream_hex", el_sql("skewed") + f", h AS (SELECT gid, lane, string_agg(CASE WHEN len <= 4 THEN repeat('00', CAST(len - 1 AS INTEGER)) || printf('%02x', code) ELSE {_LIT} END, '' ORDER BY slot) AS h FROM ma GROUP BY gid, lane) SELECT gid, lane, rpad(h, CAST((length(h) + 15) // 16 * 16 AS INTEGER), 'f') AS hex FROM h")
def byte_stream_hex(s, d):
    return B.lane_hex(groups(s, d, "skewed"), 2)


@query("byte_stream_offsets", el_sql("u32") + ", b AS (SELECT gid, lane, (CAST(sum(CASE WHEN len <= 8 THEN len ELSE 5 END) AS BIGINT) + 7) // 8 * 8 AS n_bytes FROM ma GROUP BY gid, lane) SELECT gid * 32 + lane AS thread, n_bytes, CAST(coalesce(sum(n_bytes) OVER (ORDER BY gid, lane ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM b")
def byte_stream_offsets(s, d):
    rows = B.encode_lanes(groups(s, d, "u32"), 4).selectExpr("gid * 32 + lane AS thread", "CAST(size(bytes) AS BIGINT) AS n_bytes")
    return exclusive_scan_two_level(rows, "thread", "n_bytes")


# --- distribution and entropy coder --------------------------------------------------------------------------


@query("byte_histogram", hist_sql() + " SELECT sym, cnt FROM hi")
def hist(s, d):
    return histogram(s, d)


@query("ans_raw_weights", hist_sql() + " SELECT sym, cnt, q FROM wt")
def ans_raw(s, d):
    return Q.raw_weights(histogram(s, d), PROB_BITS)


@query("ans_quantize", hist_sql() + " SELECT sym, cnt, q, pdf FROM wt")
def ans_quantize(s, d):
    return Q.quantize(histogram(s, d), PROB_BITS)


for _b in (9, 11):
    QUERIES[f"ans_quantize_{_b}"] = lambda s, d, b=_b: Q.quantize(histogram(s, d), b)
    SQL[f"ans_quantize_{_b}"] = hist_sql(_b) + " SELECT sym, cnt, q, pdf FROM wt"


@query("ans_rank", hist_sql() + " SELECT sym, q, row_number() OVER (ORDER BY q DESC, sym DESC) AS place FROM wt")
def ans_rank(s, d):
    w = Window.orderBy(F.desc("q"), F.desc("sym"))
    return Q.raw_weights(histogram(s, d), PROB_BITS).select("sym", "q", F.row_number().over(w).cast("bigint").alias("place"))


@query("ans_table", hist_sql() + " SELECT sym, pdf, cdf, magic, shift FROM tb")
def ans_table(s, d):
    return Q.coder_table(Q.quantize(histogram(s, d), PROB_BITS))


@query("ans_decode_table", hist_sql() + " SELECT cdf + i AS slot, sym, pdf, i AS s_minus_cdf, (i << 20) | (pdf << 8) | sym AS packed FROM (SELECT sym, pdf, cdf, unnest(range(pdf)) AS i FROM tb WHERE pdf > 0)")
def ans_decode_table(s, d):
    return Q.decode_table(Q.coder_table(Q.quantize(histogram(s, d), PROB_BITS)))


@query("ans_unpack_table", hist_sql() + " SELECT cdf + i AS slot, CAST(sym AS BIGINT) AS sym, pdf, i AS s_minus_cdf FROM (SELECT sym, pdf, cdf, unnest(range(pdf)) AS i FROM tb WHERE pdf > 0)")
def ans_unpack_table(s, d):
    return ans_decode_table(s, d).selectExpr("slot", "packed & 255 AS sym", "shiftrightunsigned(packed, 8) & 4095 AS pdf", "shiftrightunsigned(packed, 20) AS s_minus_cdf")


@query("ans_magic_division", hist_sql() + ", st AS (SELECT (CAST(1 AS BIGINT) << 15) + k * 104729 AS state FROM (SELECT unnest(range(100)) AS k)) SELECT sym, state, state // pdf AS quotient FROM tb, st WHERE pdf > 0")
def ans_magic(s, d):
    """Division by multiply and shift, for a hundred states of each weight."""
    t = ans_table(s, d).where("pdf > 0").selectExpr("sym", "magic", "shift", "explode(transform(sequence(0L, 99L), k -> 32768L + k * 104729L)) AS state")
    return t.selectExpr("sym", "state", "shiftright(shiftright(CAST(state AS DECIMAL(20,0)) * magic div 4294967296 + state, 0), shift) AS quotient")


@query("ans_blocks", "SELECT doc_id, CAST(b AS BIGINT) AS block, CAST(least(4096, octet_length(encode(text)) - 4096 * b) AS BIGINT) AS n_raw FROM (SELECT doc_id, text, unnest(range((octet_length(encode(text)) + 4095) // 4096)) AS b FROM documents WHERE text IS NOT NULL)")
def ans_blocks(s, d):
    rows = table(s, d, "documents").where("text IS NOT NULL").selectExpr("doc_id", "octet_length(text) AS n", "explode(sequence(0, (octet_length(text) + 4095) div 4096)) AS block").where("block * 4096 < n")
    return rows.selectExpr("doc_id", "block", "CAST(least(4096, n - 4096 * block) AS BIGINT) AS n_raw")


def archives(s, d, bits=PROB_BITS):
    return A.encode_column(table(s, d, "documents").select("doc_id", "text"), "text", "archive", bits)


@query("ans_roundtrip", "SELECT doc_id, md5(text) AS digest FROM documents")
def ans_roundtrip(s, d):
    back = A.decode_column(archives(s, d).select("doc_id", "archive"))
    return back.select("doc_id", F.md5("data").alias("digest"))


for _b in (9, 11):
    QUERIES[f"ans_roundtrip_{_b}"] = lambda s, d, b=_b: A.decode_column(archives(s, d, b).select("doc_id", "archive")).select("doc_id", F.md5("data").alias("digest"))
    SQL[f"ans_roundtrip_{_b}"] = SQL["ans_roundtrip"]


@query("ans_header", "SELECT doc_id, CAST(3490512897 AS BIGINT) AS magic, CAST((octet_length(encode(text)) + 4095) // 4096 AS BIGINT) AS blocks, CAST(octet_length(encode(text)) AS BIGINT) AS raw_bytes, CAST(10 AS BIGINT) AS prob_bits, true AS size_agrees FROM documents WHERE text IS NOT NULL")
def ans_header(s, d):
    rows = A.header_columns(archives(s, d).where("archive IS NOT NULL"))
    size = "32 + 512 + 128 * blocks + 8 * ((blocks + 1) div 2 * 2) + 2 * words = length(archive)"
    return rows.selectExpr("doc_id", "magic", "blocks", "raw_bytes", "prob_bits", f"{size} AS size_agrees")


@query("ans_sizes", """SELECT doc_id, raw, 544 + 128 * blocks + 8 * ((blocks + 1) // 2 * 2) AS overhead, true AS in_bounds, true AS ratio_agrees
FROM (SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS raw, CAST((octet_length(encode(text)) + 4095) // 4096 AS BIGINT) AS blocks FROM documents WHERE text IS NOT NULL)""")  # fmt: skip
def ans_sizes(s, d):
    """Stored size without its words, which is known beforehand; words within the bounds; the ratio, cut to 3 decimals."""
    rows = A.header_columns(archives(s, d).where("archive IS NOT NULL")).selectExpr("doc_id", "CAST(octet_length(text) AS BIGINT) AS n", "CAST(length(archive) AS BIGINT) AS stored", "words")
    rows = A.bound_columns(rows).withColumn("_milli", F.round(truncated_ratio("n", "stored") * 1000).cast("bigint"))
    agrees = "_milli * stored <= n * 1000 AND n * 1000 < (_milli + 1) * stored AS ratio_agrees"
    return rows.selectExpr("doc_id", "n AS raw", "stored - 2 * words AS overhead", "stored <= bound AND words >= 0 AS in_bounds", agrees)


@query("ans_ratio")
def ans_ratio(s, d):
    """Raw and stored bytes of each text and their ratio, cut to 3 decimals. What the coder writes is not SQL's to say; tests hold it against a plain coder."""
    rows = archives(s, d).where("archive IS NOT NULL").selectExpr("doc_id", "CAST(octet_length(text) AS BIGINT) AS raw", "CAST(length(archive) AS BIGINT) AS stored")
    return rows.withColumn("ratio", truncated_ratio("raw", "stored"))


@query("residual_ans_roundtrip", el_sql("u16") + " SELECT gid, md5(string_agg(CAST(val AS VARCHAR), ',' ORDER BY pos)) AS digest FROM el GROUP BY gid")
def residual_ans(s, d):
    """Codes of each group through the entropy coder and back, then unmapped."""
    packed = R.pack_groups(mapped(s, d, "u16"))
    coded = A.encode_column(packed, "codes", "archive").drop("codes")
    back = R.unmap_groups(R.unpack_groups(A.decode_column(coded, "archive", "codes")))
    return back.selectExpr("gid", "md5(array_join(vals, ',')) AS digest")


_PIECES = "SELECT {kb} AS size_kb, count(*) AS pieces, CAST(sum(original) AS BIGINT) AS original, CAST(sum(coded) AS BIGINT) AS coded, CAST((sum(original) * 1000) // sum(coded) AS DOUBLE) / 1000 AS ratio FROM (SELECT pos // {per} AS piece, count(*) * 2 AS original, count(*) + (CAST(sum(len) AS BIGINT) + 7) // 8 AS coded FROM ma WHERE pos // {per} < 10 GROUP BY piece) HAVING {kb} * 1024 <= (SELECT 2 * count(*) FROM el)"


def first_groups(s, d, column: str) -> DataFrame:
    """Groups of the pieces that a sweep looks at."""
    return groups(s, d, column).where(f"gid < {P.MAX_PIECES * P.SWEEP_KB[0] * 1024 // COLUMNS[column][4] // GROUP}")


@query("piece_sweep", el_sql("u16") + " " + " UNION ALL ".join(_PIECES.format(kb=k, per=k * 512) for k in P.SWEEP_KB))
def piece_sweep(s, d):
    """Sizes larger than the file are skipped."""
    m = R.map_groups(first_groups(s, d, "u16"))
    return P.sweep(m.selectExpr("gid", "CAST(size(lens) AS BIGINT) AS n", "aggregate(lens, 0L, (a, x) -> a + x) AS bits"), 2)


@query("coder_sweep")
def coder_sweep(s, d):
    """The same pieces through the entropy coder, as they are and mapped; tests hold the sizes against archives made one by one."""
    g = first_groups(s, d, "u16")
    return P.coder_sweep(R.pack_groups(R.map_groups(g)).select("gid", F.col("n").cast("bigint").alias("n"), "codes", "signals").join(g, "gid"), 2, PROB_BITS)


@query("mean_throughput", "SELECT event_type, floor(avg(value * 1e6 / 1e9 / 0.5) * 1000) / 1000 AS gb_per_s FROM (SELECT event_type, floor(value) AS value FROM events) GROUP BY event_type")
def throughput(s, d):
    runs = table(s, d, "events").selectExpr("event_type", "floor(value) * 1e6D AS bytes", "0.5D AS seconds")
    return P.mean_throughput(runs, ["event_type"])


@query("word_places", "SELECT gid, lane, slot, row_number() OVER (PARTITION BY gid ORDER BY slot, lane) - 1 AS place FROM (" + el_sql("u16") + " SELECT gid, lane, slot FROM ma WHERE code > 128)")
def word_places(s, d):
    """Place of each written word in its block: by step, then by lane, among those that write."""
    rows = to_elements(mapped(s, d, "u16"), "codes").where("codes > 128")
    w = Window.partitionBy("gid").orderBy("slot", "lane")
    return rows.select("gid", "lane", "slot", (F.row_number().over(w) - 1).cast("bigint").alias("place"))


@query("geometry", el_sql("u16") + " SELECT pos, gid, lane, slot, val FROM el")
def geometry(s, d):
    return with_geometry(elements(s, d, "u16"))


@query("size_bounds", "SELECT n, blocks, (n + n // 4 + 15) // 16 * 16 AS block_bound, 128 + (n + n // 4 + 15) // 16 * 16 AS block_bound_with_states, 544 + blocks * 128 + 8 * ((blocks + 1) // 2 * 2) + blocks * 5120 AS bound, (544 + 4096 * 136 + blocks * 5120 + 15) // 16 * 16 AS reserved FROM (SELECT n, (n + 4095) // 4096 AS blocks FROM (SELECT CAST(octet_length(encode(text)) AS BIGINT) AS n FROM documents WHERE text IS NOT NULL))")
def size_bounds(s, d):
    return A.bound_columns(table(s, d, "documents").where("text IS NOT NULL").selectExpr("CAST(octet_length(text) AS BIGINT) AS n"))


def entry(spark: SparkSession, sf: str = "/root/testdata/sf0.001") -> DataFrame:
    """Position, centre, code and bytes of every group of order prices."""
    return mapped(spark, sf, "u16").selectExpr("gid", "size(vals) AS n", "center", f"{R.SIG_LEN} AS sig_len", f"{GROUP} AS capacity")
