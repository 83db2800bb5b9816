import hashlib
import html
import itertools
import math
import os
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tallow.llm import html_extract, language, license_scan, packing, piece_sampling, quality_model, quality_rules
from tests.compare import check, connect

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "no id"), (5, "x" * 120_000), (6, "same"), (6, "same"), (7, "tail space "), (8, "a  b \n c  d's 'll"), (9, "😀é" * 50)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, "en", None) for i, t in rows], "doc_id bigint, text string, _row string, worker int, lang string, source string")


def packed(df, rows=None):
    tok = Tokenizer.from_file(BPE)
    rows = packing.pack(df, BPE).collect() if rows is None else rows
    want = {}
    for r in df.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, []).append([*tok.encode(r.text or "", add_special_tokens=False).ids, 0])
    seqs, cover = {}, {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        ids = next(x for x in want[r.doc_id] if len(x) == r.doc_tokens)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
        cover.setdefault(r.doc_id, []).extend(range(r.start, r.start + r.length))
    assert set(cover) == set(want)
    for d, docs in want.items():
        assert sorted(cover[d]) == sorted(itertools.chain.from_iterable(range(len(x)) for x in docs))
    padding = total = 0
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
        total += at
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    return padding, total


def test_packing(spark):
    padding, total = packed(spark.read.parquet(f"{SF}/documents.parquet"))
    assert padding / total < 0.05
    packed(frame(spark, ODD))
    assert packing.pack(frame(spark, ODD).limit(0), BPE).count() == 0


def test_packing_encoder_is_the_tokenizer():
    tok, enc, rng = Tokenizer.from_file(BPE), packing.Encoder(BPE), random.Random(2)
    bits = ["a", "Word", " ", "  ", "\n", "\t", "'s", "'", "1", "23", "é", "!", " ", " ", "\x1c", "😀", "don't", "\x85", "\xa0", "\u3000", "\u200b", "²", "ǅ", "<|endoftext|>", "\r\n", "\u0120", "\0", ",", ".", "!?", "\")", "naïve", "Word,", "ª"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)] + ["x <|endoftext|> y", " ", "  ", " a"]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    for t, w in zip(texts, want, strict=True):
        assert np.frombuffer(enc(t), "<u4").tolist() == w, repr(t)
    assert [np.frombuffer(x, "<u4").tolist() for x in packing.Encoder(BPE).many(texts)] == want
    few = packing.Encoder(BPE)
    for o in range(0, len(texts), 100):
        few.keep(o % 300)
        assert [np.frombuffer(x, "<u4").tolist() for x in few.many(texts[o : o + 100])] == want[o : o + 100]


def test_packing_keeps_the_words_used_most():
    enc, tok = packing.Encoder(BPE), Tokenizer.from_file(BPE)
    enc.many(["x alpha beta gamma, gamma."])
    for _ in range(5):
        enc.many(["x delta epsilon,"])
    enc.keep(5)
    assert {"delta", "epsilon,"} <= set(enc.slots) and not {"alpha", "beta", "gamma,"} & set(enc.slots) and len(enc.start) == 5
    for t in ("x delta epsilon, alpha gamma, gamma.", "epsilon, x"):
        assert np.frombuffer(enc(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_words_of_letters_go_to_the_merges():
    enc, tok, rng = packing.Encoder(BPE), Tokenizer.from_file(BPE), random.Random(3)
    assert enc.merges
    words = ["".join(rng.choice(packing.LETTERS) for _ in range(rng.randint(1, 12))) for _ in range(3000)] + packing.LETTERS
    text = "x " + " ".join(w + rng.choice(["", "", ",", "×", "ª", "1"]) for w in words)
    assert np.frombuffer(enc(text), "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_packing_in_a_tree_of_workers(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    rng = random.Random(4)
    df = frame(spark, [(i, " ".join(rng.choice(["one", "two", "three"]) for _ in range(rng.randint(0, 900)))) for i in range(90)]).repartition(9)
    padding, total = packed(df)
    assert padding / total < 0.05


def test_cuts():
    for n in range(1, 3000):
        c = packing.cuts(n)
        assert sum(c) == n and all(x <= 1024 for x in c) and all(x >= 32 for x in c[n // 1024 : -1])


def test_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9 and all(0 <= r.score <= 1 for r in rows)


def test_language_rank_by_brute_force():
    text = "Ab, ab! Ça9b"
    words = ["ab", "ab", "ça", "b"]
    count = Counter()
    for w in words:
        count.update(w)
        p = f" {w} "
        count.update(p[i : i + 2] for i in range(len(p) - 1))
        count.update(p[i : i + 3] for i in range(len(p) - 2))
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    want = sorted(count, key=lambda g: (-count[g], code(g)))
    assert language.rank(text).tolist() == [code(g) for g in want]


def test_language_cases(spark):
    got = {(r.doc_id, r.lang_pred) for r in language.identify(frame(spark, ODD)).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (None, "en")} <= got
    kept = language.drop_unidentified(frame(spark, ODD))
    assert kept.columns[2:4] == ["_row", "worker"] and kept.count() == 7
    assert language.identify(frame(spark, ODD).limit(0)).count() == 0


def test_samples_without_replacement():
    sampler, n = piece_sampling.Sampler(PIECES, 2), 3000
    text = "then"
    first, second, mass = Counter(), Counter(), {}
    for row in range(n):
        a, b = sampler(row, text)
        assert a[2] > b[2]
        first[tuple(a[0].tolist())] += 1
        second[tuple(b[0].tolist())] += 1
        mass |= {tuple(x[0].tolist()): np.exp(x[1]) for x in (a, b)}
    for s, p in mass.items():
        assert abs(first[s] / n - p) < 0.04
        q = sum(o * p / (1 - o) for t, o in mass.items() if t != s)
        assert abs(second[s] / n - q) < 0.05


def segmentations(pieces, text):
    """Every way to spell the text: {ids: log weight}, by recursion over the pieces."""
    if not text:
        return {(): 0.0}
    found = {}
    for j in range(1, len(text) + 1):
        state = 0
        for c in text[:j]:
            state = int(pieces.step(np.array([state]), np.array([ord(c)]))[0])
            if not state:
                break
        own = pieces.piece[state] if state else -1
        if own < 0 and j > 1:
            continue
        spelled = text[0].encode()
        head, w = ((int(own),), pieces.mass[state]) if own >= 0 else (tuple(pieces.bytes[b] for b in spelled), pieces.rare * len(spelled))
        for rest, x in segmentations(pieces, text[j:]).items():
            found[head + rest] = w + x
    return found


def test_all_segmentations_by_brute_force():
    sampler = piece_sampling.Sampler(PIECES, 5000)
    for text in ("then", "so it", "\U0001f9a5é", "aaaa", "a", "\x00b"):
        ways = {}
        units = piece_sampling._UNIT.findall("▁" + text.replace(" ", "▁"))
        for parts in itertools.product(*(segmentations(sampler.pieces, u).items() for u in units)):
            ways[tuple(itertools.chain.from_iterable(p[0] for p in parts))] = sum(p[1] for p in parts)
        total = np.logaddexp.reduce(list(ways.values()))
        got = sampler(5, text)
        assert len(got) == len(ways) and {tuple(g[0].tolist()) for g in got} == set(ways)
        assert all(abs(g[1] - (ways[tuple(g[0].tolist())] - total)) < 1e-9 for g in got)
        scores = [g[2] for g in got]
        assert scores == sorted(scores, reverse=True)


def test_lattices_of_long_units_and_of_any_company():
    pieces = piece_sampling.vocabulary(PIECES)
    units = ["▁" + "abcde" * 200, "▁the", "▁" + "é😀" * 40]
    both = piece_sampling.Lattices(pieces, units)
    heads = both.first[:-1]
    assert np.allclose(np.add.reduceat(np.exp(both.log), heads), 1, atol=1e-9)
    sampler, rows = piece_sampling.Sampler(PIECES, 3), [3, 4, 5, 6]
    texts = ["abcde" * 200 + " the end", None, "", "the cat sat"]
    together = list(sampler.many(rows, texts))
    for row, text, got in zip(rows, texts, together, strict=True):
        alone = sampler(row, text)
        assert [(g[0].tolist(), *g[1:]) for g in got] == [(a[0].tolist(), *a[1:]) for a in alone]


def test_branches_that_cannot_lead_are_not_drawn(monkeypatch):
    rng, drawn, uniform = random.Random(6), [], piece_sampling._uniform
    text = " ".join(rng.choice(["then", "the", "quick", "brown", "fox,"]) for _ in range(3000))
    monkeypatch.setattr(piece_sampling, "_uniform", lambda key: drawn.append(len(key)) or uniform(key))
    lazy = piece_sampling.Sampler(PIECES, 30)(3, text)
    assert sum(drawn) < 30 * len(lazy[0][0]) / 4
    monkeypatch.setattr(piece_sampling, "MOST_GUMBEL", math.inf)
    monkeypatch.setattr(piece_sampling, "NEAR", math.inf)
    whole = piece_sampling.Sampler(PIECES, 30)(3, text)
    assert [(x[0].tolist(), *x[1:]) for x in lazy] == [(x[0].tolist(), *x[1:]) for x in whole]
    assert sum(drawn) > 30 * len(lazy[0][0])
    monkeypatch.setattr(piece_sampling, "_hash", lambda key: np.full(len(key), 2**64 - 1, np.uint64))
    assert uniform(np.zeros(2))[0] < 1


def test_units_of_plain_and_odd_texts():
    texts = ["a b a", None, "", " lead", "tail ", "a  b", "x▁y z", " ", "a\nb c\td", "é 😀", "a b"]
    for some in (texts, ["a b", "b c"], [None, ""], [*texts, "half \ud800 pair"]):
        number, size, types = piece_sampling.Sampler._units(some)
        own = iter(np.split(number, np.cumsum(size)[:-1]))
        assert len(set(types)) == len(types) and sum(size) == len(number)
        for t in some:
            want = piece_sampling._UNIT.findall("▁" + t.replace(" ", "▁")) if t else []
            assert [types[i] for i in next(own).tolist()] == want
    pieces = piece_sampling.vocabulary(PIECES)
    ids = piece_sampling.Sampler(PIECES)(1, "é 😀 ok")[0][0]
    assert pieces.gives(ids, "é 😀 ok") and not pieces.gives(ids, "é 😀 o") and pieces.gives(ids[:0], "")


def test_samples_are_distinct_and_decode(spark):
    df = frame(spark, [*ODD, (20, "ab"), (21, "The  quick brown\nfox — ok")])
    rows = piece_sampling.sample_segmentations(df, PIECES, k=4)
    text = {r.doc_id: r.text or "" for r in df.collect()}
    got = piece_sampling.decode_ids(rows, PIECES).collect()
    assert all(r.text == text[r.doc_id] for r in got)
    own = [tuple(r.ids) for r in got if r.doc_id == 21]
    assert len(own) == len(set(own)) == 4
    again = {(r.doc_id, r.sample, tuple(r.ids)) for r in piece_sampling.sample_segmentations(df.repartition(3), PIECES, k=4).collect()}
    assert again == {(r.doc_id, r.sample, tuple(r.ids)) for r in got}
    digest = piece_sampling.sample_segmentations(df, PIECES, digest=True).collect()
    assert all(r.round_trip for r in digest)
    assert piece_sampling.sample_segmentations(df.limit(0), PIECES).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a><li><a>B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 text.<p>Second&nbsp;one.<script>var x = "<p>no</p>";</script><div class="ad">Buy now.</div><aside>Related</aside><form><label>Mail</label></form></article>
<section class="comments"><p>Nice article, I read the whole of it and agree with every word of it.</p></section></main><!-- <p>c</p> --><footer>&copy; Site</footer>"""


def test_html(spark):
    assert html_extract.extract_text(PAGE) == "Title & more\nFirst bold text.\nSecond one."
    assert html_extract.extract_text("just text") == "just text"
    rows = spark.createDataFrame([(1, "u", PAGE), (2, None, None), (None, "v", ""), (1, "u", PAGE), (3, "w", "<p>" * 3000 + "deep text here."), (4, "x", "<nav>" + "<a>l</a>" * 3)], "page_id bigint, url string, html string")
    got = html_extract.extract(rows).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got) and {r.text for r in got if r.page_id in (2, None, 4)} == {""}
    assert html_extract.extract(rows.limit(0)).count() == 0


ARTICLE = "<article><h1>Head line</h1><p>First paragraph of the story, long enough to read.</p><p>Second one.</p></article>"
TEXT = "Head line\nFirst paragraph of the story, long enough to read.\nSecond one."


@pytest.mark.parametrize(
    "wrap",
    [
        "{}", '<div class="layout has-sidebar">{}</div>', '<div class="overflow-hidden">{}</div>', '<div id="page" class="comments-open">{}</div>', '<div class="nav-layout">{}</div>',
        '<form action="/"><div class="footer-fixed header-top">{}</div></form>', '<main>{}</main><div class="thread"><p>I read all of it, and I agree with every word of it, truly.</p></div>',
        '<nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav>{}<section id="comments"><article><p>' + "A very long comment of a reader. " * 30 + "</p></article></section>",
        '<div class="content">{}<div class="cookie-banner">We use cookies.</div></div><footer>Imprint</footer>',
    ],
)
def test_html_wrappers(wrap):
    assert html_extract.extract_text(f"<html><body>{wrap.format(ARTICLE)}</body></html>") == TEXT


def test_html_cut_is_not_a_threshold():
    long = "<p>" + "Words of the story go on and on here. " * 5 + "</p>"
    page = f'<body><div>{long}<p><a href="/x">See the whole table</a></p>{long}</div><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></body>'
    found, nodes = html_extract.blocks(page)
    alone = [a > 0 for a, _ in html_extract.costs(found, nodes)]
    assert alone == [True, False, True, False, False]
    assert html_extract.label(found, nodes) == [True, True, True, False, False]


def cut_cost(found, terms, keep):
    cost, last = sum(b if k else a for (a, b), k in zip(terms, keep, strict=True)), {}
    for i, b in enumerate(found):
        cost += html_extract.NEXT * (i > 0 and keep[i] != keep[i - 1])
        up = b.node
        for weight in (html_extract.SAME_PARENT, html_extract.SAME_GRANDPARENT):
            up = up.up if up is not None else None
            if up is not None and up.tag not in ("", "html", "body"):
                j = last.get((weight, id(up)))
                cost += weight * (j is not None and keep[i] != keep[j])
                last[weight, id(up)] = i
    return cost


def test_html_labels_by_brute_force():
    rng = random.Random(3)
    tags, names = ["div", "p", "section", "article", "aside", "li", "h2", "header"], ["", ' class="ad"', ' class="post"', ' id="comments"', ' class="has-menu"']
    moved = 0
    for _ in range(150):
        page = ""
        for _ in range(rng.randint(1, 9)):
            t = rng.choice(tags)
            text = "word " * rng.randint(1, 30) + rng.choice(["", ".", "<a>link text of it</a>"])
            page += f"<{t}{rng.choice(names)}>" * rng.randint(0, 1) + rng.choice([text, f"<p>{text}</p>", f"<a>{text}</a>"]) + rng.choice(["", f"</{t}>"])
        found, nodes = html_extract.blocks(page)
        if not 0 < len(found) <= 10:
            continue
        terms, keep = html_extract.costs(found, nodes), html_extract.label(found, nodes)
        assert cut_cost(found, terms, keep) == min(cut_cost(found, terms, k) for k in itertools.product((False, True), repeat=len(found)))
        moved += keep != [a > 0 for a, _ in terms]
    assert moved > 5


def test_html_table_by_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub("<br>", " ", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n".join(p for p in parts if p)


def test_html_odd_tables(spark):
    deep = "<div>" * 20_000 + "<p>Deep text of a page.</p>"
    long = "<article>" + "<p>One more paragraph of a long page.</p>" * 20_000 + "</article>"
    rows = spark.createDataFrame([(1, "u", deep, "x", 1), (1, "u", deep, "y", 2), (2, "v", long, None, None)], "page_id bigint, url string, html string, text string, _id int")
    got = html_extract.extract(rows).collect()
    assert [r.n_chars for r in sorted(got, key=lambda r: r.page_id)] == [20, 20, 35 * 20_000 - 1]


def test_min_cut_by_brute_force():
    rng = random.Random(8)
    for _ in range(60):
        n = rng.randint(1, 7)
        up, down = [rng.randint(0, 9) for _ in range(n)], [rng.randint(0, 9) for _ in range(n)]
        ties = [(i, j, rng.randint(0, 6)) for i in range(n) for j in range(i) if rng.random() < 0.5]
        g = html_extract.Flow(n + 2)
        for i in range(n):
            g.edge(n, i, up[i], 0)
            g.edge(i, n + 1, down[i], 0)
        for i, j, w in ties:
            g.edge(i, j, w, w)
        side = g.source_side(n, n + 1)[:n]
        cost = lambda x: sum(down[i] if x[i] else up[i] for i in range(n)) + sum(w for i, j, w in ties if x[i] != x[j])  # noqa: B023, E731
        assert cost(side) == min(map(cost, itertools.product((False, True), repeat=n)))


def test_quality_model(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_model.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted for r in good) / len(good) > 0.95 and sum(r.predicted for r in bad) / len(bad) < 0.3
    got = quality_model.classify(frame(spark, ODD), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert quality_model.classify(frame(spark, ODD), labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality_model.classify(frame(spark, ODD).limit(0), labels).count() == 0
    odd = spark.createDataFrame([(6, 1), (6, 0), (None, 1), (9, None), (5, 1)], "doc_id bigint, quality int")
    assert quality_model.classify(frame(spark, [*ODD, *ODD]), odd).count() == 2 * len(ODD)


def plain_passages(text):
    """The features of a text's passages, without numpy."""
    data = (text or "").encode()
    words = [(m.start(), m.group()) for m in re.finditer(rb"[^ \t\n\r\x0b\x0c]+", data)]
    if not words:
        return [[0.0] * quality_model.FEATURES]
    out = []
    for p in range(0, len(words), quality_model.PASSAGE):
        own = [w for _, w in words[p : p + quality_model.PASSAGE]]
        lo = words[p][0]
        hi = words[p + quality_model.PASSAGE][0] if p + quality_model.PASSAGE < len(words) else len(data)
        part, k = data[lo:hi], len(own)
        row = [sum(c in cls for c in part) / len(part) for cls in quality_model.CLASSES.values()] + [sum(c > 127 for c in part) / len(part)]
        triples = [tuple(w for _, w in words[i : i + 3]) for i in range(p, p + k) if i + 3 <= len(words)]
        row += [math.log1p(k), sum(map(len, own)) / k, len(set(own)) / k, len(set(triples)) / max(1, len(triples)), max(map(len, own)) / 20, sum(w[-1] in quality_model.ENDS for w in own) / k]
        grams, low = [0] * quality_model.GRAMS, part.lower()
        for i in range(len(low) - 2):
            a, b, c = low[i : i + 3]
            x = (a * quality_model.MIX[0] + b * quality_model.MIX[1] + c * quality_model.MIX[2]) % (1 << 32)
            grams[x >> 24] += 1
        out.append(row + [math.sqrt(g / len(part)) for g in grams])
    return out


def plain_score(model, rows):
    w = {k: v.tolist() for k, v in model.w.items()}
    sig = lambda v: 1 / (1 + math.exp(-v))
    dot = lambda u, m, j: sum(a * r[j] for a, r in zip(u, m, strict=True))
    hidden, energy = [], []
    for r in rows:
        x = [min(6, max(-6, (v - m) / s)) for v, m, s in zip(r, model.mean.tolist(), model.scale.tolist(), strict=True)]
        h = [math.tanh(dot(x, w["W"], j) + w["b"][j]) for j in range(quality_model.HIDDEN)]
        hidden.append(h)
        energy.append(sum(math.tanh(dot(h, w["V"], j)) * sig(dot(h, w["U"], j)) * w["a"][j] for j in range(quality_model.GATE)))
    total = sum(map(math.exp, energy))
    z = [sum(math.exp(e) / total * h[j] for e, h in zip(energy, hidden, strict=True)) for j in range(quality_model.HIDDEN)]
    return sig(sum(a * b for a, b in zip(z, w["c"], strict=True)) + w["d"][0])


def test_quality_scores_by_plain_python(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = quality_model.learn(docs, labels)
    table = docs.unionByName(frame(spark, ODD).select("doc_id", "text"), allowMissingColumns=True).where("length(coalesce(text, '')) < 5000")
    texts = [r.text for r in table.collect()]
    for text in texts[::7]:
        got = quality_model.encode_many([(text or "").encode()])[0]
        assert np.allclose(got, np.array(plain_passages(text)), atol=1e-5)
    got = sorted((str(r.doc_id), r.score) for r in quality_model.score(table, model).collect())
    want = sorted((str(r.doc_id), plain_score(model, plain_passages(r.text))) for r in table.collect())
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_attention_gradient():
    rng = np.random.default_rng(0)
    m = quality_model.Model(features=5)
    x, first, y = rng.normal(size=(9, 5)), np.array([0, 2, 6]), np.array([1.0, 0.0, 1.0])
    logit, f = m.forward(x, first)
    assert np.allclose(np.add.reduceat(f["att"], first), 1) and logit.shape == (3,)
    loss = lambda: float((np.logaddexp(0, m.forward(x, first)[0]) - y * m.forward(x, first)[0]).mean())
    grad = m.gradient(x, first, y)
    for name, w in m.w.items():
        for i in np.ndindex(w.shape):
            kept = w[i]
            w[i] = kept + 1e-5
            up = loss()
            w[i] = kept - 1e-5
            down = loss()
            w[i] = kept
            assert abs((up - down) / 2e-5 - grad[name][i]) < 1e-7, (name, i)


def test_attention_finds_the_passage_that_decides():
    rng = random.Random(5)
    common = ["".join(rng.choice("aeiourstln") for _ in range(rng.randint(2, 8))) for _ in range(300)]

    def bag(label):
        parts = [" ".join(rng.choice(common) for _ in range(quality_model.PASSAGE)) for _ in range(rng.randint(6, 14))]
        if not label:
            k = rng.randrange(len(parts))
            parts[k] = " ".join(rng.choice(["zzgqx", "qqwvz", "xkzjq"]) if rng.random() < 0.5 else rng.choice(common) for _ in range(quality_model.PASSAGE))
        return " ".join(parts).encode()

    y = np.array([i % 2 for i in range(400)], float)
    texts = [bag(v) for v in y]
    bags = [quality_model.encode_many([t])[0] for t in texts]
    model = quality_model.Model().fit(bags[:300], y[:300])
    right = lambda: float(((model.scores(bags[300:]) >= 0.5) == y[300:]).mean())
    attended = right()
    model.w["a"] = np.zeros_like(model.w["a"])
    assert attended > 0.95 and right() < attended - 0.1


def test_rules_and_licences(spark):
    con = connect(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert check(quality_rules.judge(docs), con, quality_rules.SQL) > 0
    assert check(license_scan.scan(docs), con, license_scan.SQL) > 0
    long = "w " * 60 + "one two three four five six " * 9 + " ".join(f"v{i}" for i in range(90_000))
    got = {r.doc_id: r for r in quality_rules.judge(frame(spark, [*ODD, (30, long), (31, "a b c a b c x\n\nq\nq")])).collect()}
    words = long.split()
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    assert got[30].n_repeat_words == len({i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)})
    assert (got[31].n_words, got[31].n_repeat_words, got[31].n_dup_lines) == (9, 6, 1) and got[1].n_words == 0 and got[1].base_failed
    assert quality_rules.judge(frame(spark, ODD).limit(0)).count() == 0


def test_licence_cases(spark):
    mit = license_scan.KNOWN["MIT"]
    other = "Copyright (c) 2020 Some One\nAll rights reserved.\n\n" + mit.replace("sublicense", "sub-license").replace('"', "“").upper()
    rows = [(1, mit), (2, other), (3, mit + " More."), (4, None), (5, "licensed under the apache licence, version 2.0")]
    got = {r.doc_id: r.license for r in license_scan.scan(frame(spark, rows)).collect()}
    assert got == {1: "MIT", 2: "MIT", 3: None, 4: None, 5: "Apache-2.0-notice"}
    assert {r.digest for r in license_scan.scan(frame(spark, rows)).collect()} == {hashlib.sha256(license_scan.canonical_text(t or "").encode()).hexdigest() for _, t in rows}
    assert license_scan.scan(frame(spark, rows).limit(0)).count() == 0
    assert license_scan.canonical_text("licence licence of the licences, NON-COMMERCIAL noncommercial") == "license license of the licenses non commercial non commercial"


def wrapped(text, width):
    return "\n".join(line for part in text.split("\n") for line in textwrap.wrap(part, width) or [""])


def test_licences_as_they_are_published(spark):
    known = license_scan.KNOWN
    rows, want = [], {}
    for k, text in known.items():
        for width in (30, 40, 72):
            want[len(rows)] = k
            rows.append((len(rows), "# " + wrapped(text, width).replace("\n", "\n# ")))
    titles = [("MIT", "MIT License\n\nCopyright (c) 2020 Some One\n\n"), ("MIT", "The MIT License (MIT)\n\n© 2011-2020 A. Holder\n"), ("ISC", "ISC License\r\n\r\nCopyright 2020 X\r\n\r\n"), ("BSD-3-Clause", "BSD 3-Clause License\n\nCopyright (c) 2017, Some One\nAll rights reserved.\n\n"), ("BSD-2-Clause", "COPYRIGHT (C) 1999 THE OWNERS\n")]
    for k, head in titles:
        want[len(rows)] = k
        rows.append((len(rows), head + wrapped(known[k], 79)))
    got = license_scan.scan(frame(spark, [*rows, (None, known["MIT"]), (None, known["MIT"]), (900, "w " * 200_000)]))
    assert {r.doc_id: r.license for r in got.where("doc_id < 900").collect()} == want
    assert got.where("doc_id IS NULL AND license = 'MIT'").count() == 2 and got.where("doc_id = 900 AND NOT matched").count() == 1
    table = spark.createDataFrame([(k, t) for k, t in known.items()] + [("empty", " \n"), (None, "x"), ("z-MIT", known["MIT"])], "license string, text string")
    for most in (license_scan.MOST_KNOWN, 2):
        license_scan.MOST_KNOWN, kept = most, license_scan.MOST_KNOWN
        by_table = license_scan.scan(frame(spark, rows), known=table)
        license_scan.MOST_KNOWN = kept
        assert {r.doc_id: r.license for r in by_table.collect()} == want


def test_digests_of_long_licences():
    folder = "/usr/share/common-licenses"
    files = {"Apache-2.0": "Apache-2.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for name, file in files.items():
        if os.path.exists(f"{folder}/{file}"):
            with open(f"{folder}/{file}", encoding="utf-8") as f:
                text = f.read()
            for t in (text, text.lower(), text.replace("\n", "\r\n"), text.replace(" ", "  ")):
                assert hashlib.sha256(license_scan.canonical_text(t).encode()).hexdigest() == license_scan.DIGESTS[name]
