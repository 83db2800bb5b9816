import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tallow.llm import exact_dedup, simhash, suffix_dedup
from tallow.llm.components import connected_components
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, _row string, keep_id int, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, len(t or "")) for i, t in rows], SCHEMA)


def test_exact_against_sql(spark):
    assert check(exact_dedup.exact_groups(spark.read.parquet(f"{SF}/documents.parquet")), connect(SF), exact_dedup.SQL) > 0


def test_exact_filter_follows_the_rows():
    sizes = [exact_dedup.filter_size(n) for n in (0, 1, 10**5, 10**7, 10**9)]
    assert sizes == [1 << 16, 1 << 16, 1 << 21, 1 << 28, 1 << 30]


def test_exact_keeps_one_of_rows_equal_in_id_and_text(spark):
    rows = [(1, "t" * 3000)] * 5 + [(None, "u")] * 3 + [(2, "T" * 3000)] * 2
    kept = exact_dedup.drop_exact_copies(frame(spark, rows).repartition(4)).collect()
    assert sorted((str(r.doc_id), r.text[0]) for r in kept) == [("2", "T"), ("None", "u")]


@pytest.mark.parametrize("bits", [64, None])
def test_exact_cases(spark, bits):
    rows = [(1, "Ab"), (2, "aB"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "z" * 100_000), (7, "Z" * 100_000), (None, "ab"), (None, "only")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(frame(spark, rows), filter_bits=bits).collect()}
    assert got == {(1, 2, 3, False), (2, 2, 3, True), (None, 2, 3, False), (3, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 1, True), (7, 7, 2, True), (7, 7, 2, False), (None, None, 1, True)}
    kept = exact_dedup.drop_exact_copies(frame(spark, rows), filter_bits=bits)
    assert kept.columns == ["doc_id", "text", "_row", "keep_id", "n_chars"] and sorted((r.doc_id for r in kept.collect()), key=str) == sorted([2, 4, 5, 6, 7, None], key=str)
    assert exact_dedup.exact_groups(frame(spark, rows).limit(0)).count() == 0


def brute_fingerprint(text, k=3):
    words = (text or "").translate(str.maketrans(exact_dedup_upper, exact_dedup_upper.lower())).encode().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hs = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


exact_dedup_upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def brute_components(ids, fps, bits=2):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


def test_simhash_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = [brute_fingerprint(r.text) for r in rows]
    want = {(r.doc_id, f"{f:016x}", c) for r, f, c in zip(rows, fps, brute_components([r.doc_id for r in rows], fps), strict=True)}
    assert {tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id").collect()} == want


def test_pigeonring_is_complete(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1}
    for _ in range(150):
        f = rng.getrandbits(64)
        for _ in range(6):
            fps.add(f)
            for b in rng.sample(range(64), rng.choice((1, 2, 2, 3))):
                f ^= 1 << b
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    want = {tuple(sorted((a, b))) for i, a in enumerate(signed) for j, b in enumerate(signed) if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2}
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    assert {tuple(r) for r in simhash.pigeonring_links(df).collect()} == want


def test_components_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = [(order[i], order[i + 1]) for i in range(199)] + [(1000, 1001), (1001, 1000)]
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(200)} | {1000: 1000, 1001: 1000}


def test_simhash_cases(spark):
    rows = [(1, None), (2, " \n"), (3, "one"), (4, "ONE"), (None, "two words"), (6, "w " * 50_000), (6, "w " * 50_000)]
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 3), (4, 3), (None, None), (6, 6)}
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert kept.columns[2] == "_row" and sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 6, 6, None]
    assert simhash.near_duplicates(frame(spark, rows).limit(0)).count() == 0


def jaccard_at_least(a, b, part=4, whole=5):
    n = len(a & b)
    return whole * n >= part * (len(a) + len(b) - n)


def brute_similar(rows, k=5):
    words = [(t or "").lower().encode().split() for _, t in rows]
    sets = [{b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set() for w in words]
    fps = [brute_fingerprint(t, k) for _, t in rows]
    ids, root = [i for i, _ in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 2 or (sets[i] and sets[j] and jaccard_at_least(sets[i], sets[j])):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return {(d, low[find(i)]) for i, d in enumerate(ids)}


def edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"new{rng.randint(0, 10**6)}"
    return " ".join(out)


def test_similar_groups_by_brute_force(spark):
    rng = random.Random(11)
    rows, bases = [], [[f"w{rng.randint(0, 5000)}" for _ in range(n)] for n in (60, 120, 250, 600, 1500)]
    for base in bases:
        for share in (0, 0.004, 0.012, 0.018, 0.03, 0.06):
            rows += [edited(rng, base, int(share * len(base))) for _ in range(3)]
    crowd = [f"c{rng.randint(0, 5000)}" for _ in range(300)]
    rows += [edited(rng, crowd, rng.randint(0, 5)) for _ in range(150)]
    rows += [" ".join(f"u{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 200))) for _ in range(60)]
    rows = list(enumerate(rows))
    got = {tuple(r) for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == brute_similar(rows)


def test_similar_groups_in_a_crowd_below_the_similarity(spark):
    rng, rows = random.Random(12), []
    template = [f"t{i}" for i in range(794)]
    for i in range(300):
        own = [f"d{i}_{j}" for j in range(114)]
        rows.append(" ".join([*template, *own]))
        rows.append(" ".join([*template, *own[:30], *(f"e{i}_{j}" for j in range(84))]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_similar(rows)
    sizes = Counter(c for _, c in want)
    assert len(sizes) > 290 and set(sizes.values()) <= {2, 4}
    got = {tuple(r) for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == want


def test_similar_groups_of_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in simhash.similar_groups(frame(spark, rows)).collect()}
    assert got == brute_similar(rows)


def test_similar_cases(spark):
    long = " ".join(f"x{i % 7001}" for i in range(60_000))
    near = " ".join(f"x{i % 7001}" for i in range(59_000)) + " end"
    base = [f"y{i}" for i in range(100)]
    rows = [(9, long), (8, near), (7, " ".join(base)), (7, " ".join(base)), (7, "other words here"), (6, " ".join([*base, "z"])), (None, " ".join(base[12:])), (5, None), (4, "")]
    got = sorted(((r._id, r.component_id) for r in simhash.similar_groups(frame(spark, rows)).collect()), key=str)
    assert got == sorted([(9, 8), (8, 8), (7, 6), (7, 6), (7, 7), (6, 6), (None, None), (5, 4), (4, 4)], key=str)
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "_row", "keep_id", "n_chars"]
    clash = frame(spark, rows).toDF("doc_id", "text", "_gone", "_mark", "_id")
    assert simhash.drop_near_copies(clash).columns == clash.columns and simhash.drop_near_copies(clash).count() == kept.count()
    assert simhash.similar_groups(frame(spark, rows).limit(0)).count() == 0


def test_near_copies_go_by_row_where_ids_repeat(spark):
    base = [f"y{i}" for i in range(100)]
    rows = [(7, " ".join(base)), (7, " ".join(base)), (7, "other words here"), (7, None), (6, " ".join([*base, "z"])), (None, " ".join(base[12:]))]
    kept = simhash.drop_near_copies(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([rows[i] for i in (2, 3, 4, 5)], key=str)


def brute_repeats(texts, length=400):
    seen = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            seen.setdefault(t[i : i + length], []).append((d, i))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d][i : i + length] = b"\1" * length
    out = []
    for t, g in zip(texts, gone, strict=True):
        kept = bytes(c for c, x in zip(t, g, strict=True) if not x)
        out.append((len(t), sum(g), sum(1 for i, x in enumerate(g) if x and (i == 0 or not g[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def repeats_of(spark, rows):
    got = suffix_dedup.repeat_report(frame(spark, rows)).collect()
    return sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)


def made_up(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (30, 90, 100, 140, 400)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 600), (4, "x" * 399), (5, "y" * 400), (6, "y" * 400), (7, "y" * 401)]
    for i in range(8, 60):
        rows.append((i, " ".join(rng.choice([text(rng.randint(0, 120)), rng.choice(shared), rng.choice(shared)[rng.randint(0, 50) :]]) for _ in range(rng.randint(1, 5)))))
    rows += [(60, rows[20][1]), (61, rows[20][1][:-1]), (62, "Q" + rows[21][1])]
    return rows


def test_repeats_brute(spark):
    rows = made_up(3)
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True))
    assert repeats_of(spark, rows) == want


def test_repeats_hot_and_small_blocks(spark, monkeypatch):
    rows = made_up(4)
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True))
    monkeypatch.setattr(suffix_dedup, "MOST", 2)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 5000)
    rng = random.Random(1)
    for i in range(100, 140):  # one passage of 404 bytes in many contexts: large buckets down to single windows
        around = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300))) for _ in range(2)]
        rows.append((i, around[0] + "passage " * 50 + "tail" + around[1]))
    want = sorted((i, *x) for (i, _), x in zip(rows, brute_repeats([(t or "").encode() for _, t in rows]), strict=True))
    assert repeats_of(spark, rows) == want
    got = {r.doc_id: r.text or "" for r in suffix_dedup.drop_repeats(frame(spark, rows), length=120, gram=32).collect()}
    assert got == brute_first(rows, 120)


def brute_first(rows, length):
    """What is left of each text if a window that equals an earlier one goes, in order of id."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        t = (text or "").encode()
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out[i] = bytes(c for c, g in zip(t, gone, strict=True) if not g).decode("utf-8", "ignore")
    return out


@pytest.mark.parametrize(("length", "gram"), [(400, 64), (240, 32), (101, 32), (50, 16)])
def test_first_occurrences_stay(spark, length, gram):
    rows = made_up(length)
    got = {r.doc_id: r.text or "" for r in suffix_dedup.drop_repeats(frame(spark, rows), length=length, gram=gram).collect()}
    assert got == brute_first(rows, length)


def test_constant_and_periodic_texts(spark):
    rows = [(1, "y" * 1_000_000), (2, "z"), (3, "ab" * 300_000), (4, "q" * 399)]
    df = frame(spark, rows)
    assert suffix_dedup.anchored(suffix_dedup._keyed(df, "doc_id", "text")).count() < 20
    got = {(r.doc_id, r.n_removed, r.n_spans) for r in suffix_dedup.repeat_report(df).collect()}
    assert got == {(1, 1_000_000, 1), (2, 0, 0), (3, 600_000, 1), (4, 0, 0)}
    assert {(r.doc_id, r.text) for r in suffix_dedup.drop_repeats(df).collect()} == {(1, "y"), (2, "z"), (3, "ab"), (4, "q" * 399)}


def test_repeats_of_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(hash(t[i : i + 400]) for t in texts for i in range(len(t) - 399))
    want = []
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[hash(t[i : i + 400])] > 1:
                gone[i : i + 400] = b"\1" * 400
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        want.append((d, len(t), sum(gone), sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    assert repeats_of(spark, rows) == sorted(want) and sum(w[2] for w in want) > 0


def test_repeated_windows_shifts():
    rng = np.random.default_rng(0)
    base = rng.integers(97, 100, 450, np.uint8).tobytes()
    for shift in range(7):
        a = b"q" * 500 + base + b"r" * (500 + shift) + base + b"s" * 500
        starts = np.arange(500, len(a) - 899)
        for length in (400, 399, 398, 240, 100):
            repeated, later = suffix_dedup.sorted_windows(np.frombuffer(a, np.uint8), starts, -starts, length)
            seen = {}
            for i in starts:
                seen.setdefault(a[i : i + length], []).append(i)
            assert repeated.tolist() == [len(seen[a[i : i + length]]) > 1 for i in starts]
            assert later.tolist() == [i < max(seen[a[i : i + length]]) for i in starts]


def test_repeat_report_gives_what_is_left(spark):
    rows, rng = made_up(3), random.Random(2)
    tail = "".join(rng.choice("pqrst ") for _ in range(420))
    rows += [(70, "Aé" + tail), (71, "Bĩ" + tail)]  # the last bytes of é and ĩ are the same: both are cut inside
    texts = [(t or "").encode() for _, t in rows]
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    want = {}
    for (d, _), t in zip(rows, texts, strict=True):
        gone = bytearray(len(t))
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = b"\1" * 400
        want[d] = bytes(c for c, g in zip(t, gone, strict=True) if not g)
    got = suffix_dedup.repeat_report(frame(spark, rows))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"]
    assert {r.doc_id: r.text for r in got.collect()} == {d: t.decode("utf-8", "ignore") for d, t in want.items()}
    assert want[0] == b"" and any(0 < len(want[d]) < len(t) for (d, _), t in zip(rows, texts, strict=True))
    assert (want[70], want[71]) == (b"A\xc3", b"B\xc4")


def test_repeats_rows_and_columns(spark):
    t = "".join(random.Random(9).choice("abcdé ") for _ in range(700))
    rows = [(1, t), (1, t), (None, "A" + t), (2, "clean"), (3, None)]
    got = suffix_dedup.drop_repeats(frame(spark, rows), keep_first=False)
    assert got.columns == ["doc_id", "text", "_row", "keep_id", "n_chars"]
    assert sorted(((r.doc_id, r.text, r.n_chars) for r in got.collect()), key=str) == sorted([(1, "", 0), (1, "", 0), (None, "A", 1), (2, "clean", 5), (3, None, 0)], key=str)
    rng = random.Random(9)
    t = "".join(rng.choice("abcdé ") for _ in range(700))
    rows = [(1, t), (1, t), (None, "A" + t), (2, "clean"), (3, None)]
    first = suffix_dedup.drop_repeats(frame(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in first.collect()), key=str) == sorted([(1, ""), (1, ""), (None, "A" + t), (2, "clean"), (3, None)], key=str)
    twice = suffix_dedup.drop_repeats(frame(spark, [(1, t), (1, t), (2, "clean")]))
    assert sorted((r.doc_id, r.text) for r in twice.collect()) == [(1, t), (1, t), (2, "clean")]
    assert suffix_dedup.repeat_report(frame(spark, rows).limit(0)).count() == suffix_dedup.drop_repeats(frame(spark, rows).limit(0)).count() == 0
