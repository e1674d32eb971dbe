"""Quality rules: base counts and a calibrated n-gram classifier against fixed thresholds.

The classifier is a logistic regression on the relative frequencies of hashed word unigrams and
bigrams and of hashed byte 3-, 4- and 5-grams, fitted to labelled quality rows and calibrated by a
logistic (Platt) fit on rows kept from the training. It learns from at most ``train_rows`` labelled
rows and ``TRAIN_BYTES`` bytes, documented bounds; everything else covers all rows. Documents are
scored in Arrow batches.

Defined results: null text has no words, counts 0 and fails the base rules; repeated rows are each
scored; without labelled rows of both kinds the model keeps whatever passes the base rules; an empty
table gives an empty result; ids may be of any type; other columns stay in ``row`` whatever their
names; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import scratch
from basalt.llm.labelled import labelled_sample

TRAIN_ROWS = 2000
WORD_BITS = 13
CHAR_BITS = 13
SIZE = (1 << WORD_BITS) + (1 << CHAR_BITS)
CHAR_GRAMS = (3, 4, 5)
SCALE = 20.0
THRESHOLD = 0.5
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
SLICE = 4_000_000
WORDS_KEPT = 300_000

_SPACES = re.compile(rb"[\x20\x09-\x0D]")
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_START = np.ones(256, dtype=bool)  # bytes that begin a code point
_START[128:192] = False
_START[[9, 10, 11, 12, 13, 32]] = False


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words in windows that occur at least twice, the first occurrence included."""
    n = len(ids) - window + 1
    if n < 2:
        return 0
    key = np.zeros(n, dtype=np.uint64)
    big = ids.astype(np.uint64)
    for i in range(window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + (big[i : i + n] + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = np.zeros(n, dtype=bool)
    for at in np.flatnonzero(key[order[1:]] == key[order[:-1]]):
        same[at] = same[at + 1] = True  # equal keys of mixed 64 bits; the words decide below
    if not same.any():
        return 0
    rows = order[same]
    seen: dict[bytes, int] = {}
    wide = ids.astype(np.int64)
    marks = np.zeros(len(ids) + 1, dtype=np.int64)
    names = [wide[r : r + window].tobytes() for r in rows]
    for x in names:
        seen[x] = seen.get(x, 0) + 1
    for r, x in zip(rows, names, strict=True):
        if seen[x] > 1:
            marks[r] += 1
            marks[r + window] -= 1
    return int((np.cumsum(marks)[:-1] > 0).sum())


def duplicate_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == len(set(lines)):
        return 0
    seen, n = set(), 0
    for x in lines:
        if x in seen:
            n += bool(x.strip(" \t\n\r\x0b\x0c"))
        else:
            seen.add(x)
    return n


class Hashes(dict):
    """Word bytes to 32-bit hash, bounded."""

    def __missing__(self, w: bytes) -> int:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[w] = h = crc32(w)
        return h


def word_buckets(words: np.ndarray) -> Iterator[np.ndarray]:
    """Buckets of the word unigrams and of the bigrams of a text's word hashes."""
    w = words.astype(np.uint64)
    up = np.uint64(64 - WORD_BITS)
    if len(w):
        yield (w * np.uint64(0x9E3779B97F4A7C15)) >> up
    if len(w) > 1:
        yield ((w[:-1] * np.uint64(0xD6E8FEB86659FD93) + w[1:]) * np.uint64(0x9E3779B97F4A7C15)) >> up


def char_buckets(raw: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(n, buckets) of the byte n-grams of a text, slice by slice."""
    wide = max(CHAR_GRAMS)
    for at in range(0, len(raw), SLICE):
        b = np.frombuffer(raw[at : at + SLICE + wide - 1], dtype=np.uint8).astype(np.uint64)
        v, here = np.zeros(len(b), dtype=np.uint64), min(SLICE, len(raw) - at)
        for n in range(1, wide + 1):
            v = (v[: len(b) - n + 1] << np.uint64(8)) | b[n - 1 :]
            if n in CHAR_GRAMS and len(v):
                yield n, ((v[:here] + np.uint64(n << 56)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - CHAR_BITS)


def measure(text: str | None, hashes: Hashes) -> tuple[int, int, int, int, int, np.ndarray, bytes]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, word hashes, bytes."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()  # bytes.split cuts at ASCII white space only
    arr = np.frombuffer(raw, dtype=np.uint8)
    chars = int(np.count_nonzero(_START[arr])) if len(arr) else 0
    symbols = int(np.count_nonzero(_SYMBOL[arr])) if len(arr) else 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    distinct = np.fromiter(map(hashes.__getitem__, number), dtype=np.int64, count=len(number))
    repeats = repeated_words(ids) if len(number) < len(words) else 0
    return len(words), chars, symbols, duplicate_lines(text) if text else 0, repeats, distinct[ids] if len(ids) else ids, raw


def features(words: np.ndarray, raw: bytes) -> np.ndarray:
    """Relative frequencies by bucket: words, then characters."""
    out = np.zeros(SIZE)
    for b in word_buckets(words):
        out[: 1 << WORD_BITS] += np.bincount(b.astype(np.int64), minlength=1 << WORD_BITS) / len(b)
    for n, c in char_buckets(raw):
        out[1 << WORD_BITS :] += np.bincount(c.astype(np.int64), minlength=1 << CHAR_BITS) / (len(raw) - n + 1)
    return out * SCALE


class Model:
    """Weights by bucket, intercept, and the calibration a * margin + b."""

    def __init__(self, weights: np.ndarray, bias: float, a: float, b: float):
        self.weights, self.bias, self.a, self.b = weights.astype(np.float32), bias, a, b
        self.words, self.chars = self.weights[: 1 << WORD_BITS], self.weights[1 << WORD_BITS :]

    def margin(self, words: np.ndarray, raw: bytes) -> float:
        z = sum(float(self.words[b].sum(dtype=np.float64)) / len(b) for b in word_buckets(words))
        z += sum(float(self.chars[c].sum(dtype=np.float64)) / (len(raw) - n + 1) for n, c in char_buckets(raw))
        return self.bias + SCALE * z

    def probability(self, words: np.ndarray, raw: bytes) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.a * self.margin(words, raw) + self.b, -40, 40))))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """Full-batch Adam on the mean loss with classes weighted alike."""
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    w, b = np.zeros(x.shape[1], dtype=np.float32), 0.0
    m, v = np.zeros(x.shape[1] + 1), np.zeros(x.shape[1] + 1)
    for t in range(1, steps + 1):
        z = x @ w + b
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        grad = np.append(g.astype(np.float32) @ x + l2 * w, g.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        move = 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, b = (w - move[:-1]).astype(np.float32), b - move[-1]
    return w, b


def _feature_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = Hashes()
    for b in batches:
        rows = []
        for x in b.column(1):
            m = measure(x.as_py(), hashes)
            rows.append(features(m[5], m[6]).astype(np.float16).tobytes())  # frequencies below 20
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, steps: int = 150, l2: float = 1e-5) -> Model:
    """Fit on at most ``train_rows`` labelled rows; every fifth of them is kept for calibration. A row
    is ``SIZE`` numbers whatever its text, so the driver holds ``train_rows`` times that."""
    scratch.ship(docs.sparkSession)
    s = labelled_sample(docs, labels, label, train_rows, id_col=id_col, text_col=text_col)
    got = s.mapInArrow(_feature_task, f"doc_id {s.schema['doc_id'].dataType.simpleString()}, y int, x binary").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy().astype(float) if got.num_rows else np.zeros(0)
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(SIZE), 0.0, 0.0, 40.0)
    rows = np.empty((len(y), SIZE), dtype=np.float32)
    for i, x in enumerate(got["x"]):
        rows[i] = np.frombuffer(x.as_buffer(), dtype=np.float16)
    kept = np.arange(len(rows)) % 5 == 0
    if len(set(y[~kept].tolist())) < 2 or len(set(y[kept].tolist())) < 2:
        kept[:] = False
    del got
    scratch.release()
    learn = rows[~kept]
    held = rows[kept]
    del rows
    w, b = _logistic(learn, y[~kept], l2, steps)
    a, c = 1.0, 0.0
    if kept.any():
        z = held @ w + b
        t = np.where(y[kept] == 1, (y[kept].sum() + 1) / (y[kept].sum() + 2), 1 / ((1 - y[kept]).sum() + 2))
        for _ in range(50):  # Newton's method on the two numbers
            p = 1 / (1 + np.exp(-np.clip(a * z + c, -40, 40)))
            g = np.array([((p - t) * z).sum() + 1e-3 * (a - 1), (p - t).sum()])
            q = p * (1 - p)
            h = np.array([[(q * z * z).sum() + 1e-3, (q * z).sum()], [(q * z).sum(), q.sum() + 1e-6]])
            d = np.linalg.solve(h, g)
            a, c = a - np.clip(d[0], -1, 1), c - np.clip(d[1], -1, 1)
    return Model(w, b, float(max(a, 1e-3)), float(c))


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the other columns), the base counts, base_failed, p_quality and kept."""
    scratch.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    weights, bias, a, b0 = model.weights, model.bias, model.a, model.b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, hashes = Model(weights, bias, a, b0), Hashes()
        for b in batches:
            out = []
            for x in b.column(1):
                *n, words, raw = measure(x.as_py(), hashes)
                failed = n[0] < MIN_WORDS or 100 * n[4] > MAX_REPEAT_PERCENT * n[0]
                p = m.probability(words, raw)
                out.append((*n, failed, p, not failed and p >= threshold))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], NAMES)

    row = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(run, f"row {row}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, p_quality double, kept boolean")


NAMES = ["row", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "p_quality", "kept"]


def op6_quality(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("row.doc_id", *NAMES[1:])
