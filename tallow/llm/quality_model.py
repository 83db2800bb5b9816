"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of its text. Each passage is encoded by itself: shares of character
classes, lengths and variety of its words, and its byte 3-grams (A-Z lowered) hashed to GRAMS classes; nothing of the
rest of the document enters. A learned layer, gated attention (tanh and sigmoid branches, as in the published method)
and a score of the weighted passage representation follow. Only document labels are learned from.

The fit is on at most `sample` labelled documents, those with the smallest hash of the id among rows whose
crc32(doc_id) mod 4 is not 2, and on at most `passages` passages of each, spread evenly over it, so it is bounded whatever
the input; it runs on the driver and the weights (a few thousand numbers) go out with the scoring function. Scoring reads
all passages.

Defined cases: null text counts as empty; an empty text has one passage of zeros and gets a score; rows with a null
id are scored and never learned from or held out; a document labelled more than once counts with its smallest label;
without any label every score is 0.5; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallow.llm.common import split_of

PASSAGE = 100
SAMPLE, PASSAGES = 3000, 32
HELD_OUT, HELD = 4, 2
KEEP_AT = 0.7
HIDDEN, GATE = 16, 8
EPOCHS, RATE, DECAY = 150, 0.02, 1e-3
GRAM_WEIGHT = 0.2  # of the many classes of 3-grams against the few other features
CHUNK = 1 << 20  # bytes of text encoded at once

CLASSES = {"symbol": b"#*$%&|<>^~=_+@\\{}[]", "mark": b"!?", "stop": b".,;:", "digit": b"0123456789", "upper": bytes(range(65, 91)), "line": b"\n"}
ENDS = b"#*$%&|!<>"
GRAMS = 256
MIX = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)  # odd multipliers of a byte's place in a 3-gram
FEATURES = len(CLASSES) + 7 + GRAMS


def _flags(of: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[np.frombuffer(of, np.uint8)] = True
    return found


_KINDS = [*(_flags(c) for c in CLASSES.values()), np.arange(256) > 127]
_SPACE, _END = _flags(b" \t\n\r\x0b\x0c"), _flags(ENDS)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_TABLE = np.random.default_rng(11).integers(1, 1 << 63, 256, np.uint64)
_BASE, _INV = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, base, np.uint64))), dtype=np.uint64)


def _distinct(part: np.ndarray, keys: np.ndarray, parts: int) -> np.ndarray:
    """Number of distinct keys in each part."""
    order = np.lexsort((keys, part))
    p, k = part[order], keys[order]
    new = np.ones(len(k), bool)
    new[1:] = (p[1:] != p[:-1]) | (k[1:] != k[:-1])
    return np.bincount(p[new], minlength=parts)


def encode_many(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Passages of all texts, [passages, FEATURES] of float32, and the first row of each text."""
    lens = np.array([len(t) for t in texts], np.int64)
    begin = np.cumsum(lens + 1) - lens - 1  # a space between texts
    a = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    gap = _SPACE[a]
    edge = np.diff(np.concatenate(([1], gap.view(np.int8), [1])))
    head, tail = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)  # of words
    text = np.searchsorted(begin, head, side="right") - 1
    n_words = np.bincount(text, minlength=len(texts))
    place = np.arange(len(head)) - (np.cumsum(n_words) - n_words)[text]
    lead = np.flatnonzero(place % PASSAGE == 0)  # first words of passages
    counts = np.maximum(1, -(-n_words // PASSAGE))
    first = np.cumsum(counts) - counts
    out = np.zeros((int(counts.sum()), FEATURES), np.float32)
    if not len(lead):
        return out, first
    rows = first[text[lead]] + place[lead] // PASSAGE  # texts without words keep a row of zeros
    parts = len(lead)
    lo, hi = head[lead], (begin + lens)[text[lead]]
    same = text[lead][1:] == text[lead][:-1]
    hi[:-1][same] = lo[1:][same]
    size = hi - lo
    made = np.empty((parts, FEATURES), np.float32)
    for c, kind in enumerate(_KINDS):
        total = np.concatenate(([0], np.cumsum(kind[a])))
        made[:, c] = (total[hi] - total[lo]) / size
    c = len(_KINDS)
    part = np.repeat(np.arange(parts), np.diff(np.append(lead, len(head))))  # of words
    k = np.bincount(part, minlength=parts)
    width = tail - head
    sums = np.concatenate(([np.uint64(0)], np.cumsum(_TABLE[a] * _powers(_BASE, len(a))[:-1], dtype=np.uint64)))
    word = (sums[tail] - sums[head]) * _powers(_INV, len(a))[head]
    made[:, c] = np.log1p(k)
    made[:, c + 1] = np.bincount(part, width, parts) / k
    made[:, c + 2] = _distinct(part, word, parts) / k
    whole = np.flatnonzero(text[2:] == text[:-2]) if len(text) > 2 else np.zeros(0, np.int64)
    triple = word[whole] * np.uint64(3) + word[whole + 1] * np.uint64(_BASE) + word[whole + 2] * np.uint64(_INV) if len(whole) else np.zeros(0, np.uint64)
    made[:, c + 3] = _distinct(part[whole], triple, parts) / np.maximum(1, np.bincount(part[whole], minlength=parts))
    made[:, c + 4] = np.maximum.reduceat(width, lead) / 20
    made[:, c + 5] = np.bincount(part, _END[a[tail - 1]], parts) / k
    low = _LOWER[a].astype(np.uint32)
    mixed = ((low[:-2] * np.uint32(MIX[0]) + low[1:-1] * np.uint32(MIX[1]) + low[2:] * np.uint32(MIX[2])) >> np.uint32(24)) if len(low) > 2 else np.zeros(0, np.uint32)
    grams = np.maximum(0, size - 2)
    at = np.repeat(lo, grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    seen = np.bincount(np.repeat(np.arange(parts) * GRAMS, grams) + mixed[at], minlength=parts * GRAMS).reshape(parts, GRAMS)
    made[:, c + 6 :] = np.sqrt(seen / size[:, None])
    out[rows] = made
    return out, first


class Model:
    """Layer, gated attention and score; bags are rows of one matrix, delimited by their first rows."""

    def __init__(self, seed: int = 7, features: int = FEATURES):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.mean, self.scale = np.zeros(features), np.ones(features)
        self.w = {"W": draw(features, HIDDEN), "b": np.zeros(HIDDEN), "V": draw(HIDDEN, GATE), "U": draw(HIDDEN, GATE), "a": draw(GATE), "c": draw(HIDDEN), "d": np.zeros(1)}
        self.fitted = False

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, dict]:
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        bag = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(x))))
        e = np.exp(e - np.maximum.reduceat(e, first)[bag])
        att = e / np.add.reduceat(e, first)[bag]
        z = np.add.reduceat(att[:, None] * h, first)
        return z @ w["c"] + w["d"], {"h": h, "t": t, "g": g, "att": att, "bag": bag, "z": z}

    def gradient(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss."""
        w, (logit, f) = self.w, self.forward(x, first)
        err = (1 / (1 + np.exp(-logit)) - y) / len(y)
        grad = {"c": f["z"].T @ err, "d": np.array([err.sum()])}
        dzb = (err[:, None] * w["c"])[f["bag"]]
        datt = (dzb * f["h"]).sum(1)
        mean = np.add.reduceat(f["att"] * datt, first)[f["bag"]]
        de = f["att"] * (datt - mean)
        grad["a"] = (f["t"] * f["g"]).T @ de
        dt, dg = de[:, None] * w["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * w["a"] * f["t"] * f["g"] * (1 - f["g"])
        grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
        dh = (f["att"][:, None] * dzb + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
        grad["W"], grad["b"] = x.T @ dh, dh.sum(0)
        return grad

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def fit(self, bags: list[np.ndarray], y: np.ndarray) -> Model:
        x = np.concatenate(bags).astype(np.float64)
        first = np.cumsum([0, *map(len, bags)])[:-1]
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.scale[FEATURES - GRAMS :] /= GRAM_WEIGHT
        x = self._scaled(x)
        w = self.w
        m, v = ({k: np.zeros_like(a) for k, a in w.items()} for _ in range(2))
        for step in range(1, EPOCHS + 1):
            grad = self.gradient(x, first, y)
            for k in w:
                q = grad[k] + DECAY * w[k]
                m[k] = 0.9 * m[k] + 0.1 * q
                v[k] = 0.999 * v[k] + 0.001 * q * q
                w[k] = w[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.fitted = True
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        return self.scored(np.concatenate(bags), np.cumsum([0, *map(len, bags)])[:-1]) if bags else np.zeros(0)

    def scored(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(first), 0.5)
        return 1 / (1 + np.exp(-self.forward(self._scaled(x.astype(np.float64)), first)[0]))


def _chunks(texts: Iterator[pa.Scalar]) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append((t.as_py() or "").encode("utf-8", "replace"))
        size += len(held[-1])
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def encoded(docs: DataFrame, passages: int) -> DataFrame:
    """(doc_id, label, text) -> (doc_id, label, passages as bytes), at most so many of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for texts in _chunks(b.column(2)):
                x, first = encode_many(texts)
                for own in np.split(x, first[1:]):
                    some = own if len(own) <= passages else own[np.linspace(0, len(own) - 1, passages).astype(int)]
                    data.append(some.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(data, pa.binary())], ["doc_id", "label", "x"])

    return docs.mapInArrow(run, "doc_id bigint, label int, x binary")


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    ids = labels.where(F.col("quality").isNotNull() & (split_of("doc_id", HELD_OUT) != HELD)).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    chosen = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    own = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Rows that repeat an id count once, so the sample bounds what the driver gets.
    found = encoded(own.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text"), passages)
    rows = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("x").alias("x")).collect()
    rows.sort(key=lambda r: r.doc_id)
    model = Model()
    if not rows:
        return model
    return model.fit([np.frombuffer(r.x, np.float32).reshape(-1, FEATURES) for r in rows], np.array([r.label for r in rows], np.float64))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [model.scored(*encode_many(texts)) for texts in _chunks(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(found) if found else np.zeros(0), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.col("text").cast("string").alias("_text")).mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", F.coalesce(split_of("doc_id", HELD_OUT) == HELD, F.lit(False)).alias("held_out"), "score", (F.col("score") >= KEEP_AT).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    return score(docs, learn(docs, labels, sample))
