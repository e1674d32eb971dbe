"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade >= j) = sigmoid(w . x - c_j) with one weight vector shared by all thresholds
c_1 < c_2 < ...; the outputs are the grade probabilities, the expected severity (their sum) and a
verdict at a fixed threshold on P(grade >= 1). Features are the distinct lower-case letter words of
a text and their prefixes, hashed; those that tell toxic rows of the training sample from others, in
either direction, are kept (at most ``n_features``, by likelihood ratio), so scoring looks words up in
a small table.

The sample has at most ``train_rows`` labelled rows and ``TRAIN_BYTES`` bytes, documented bounds. The
grades are the judges', not the text's (:func:`severity_grades`): 0 is not toxic, 1 toxic, and 2 toxic
in a text also judged to be of no quality. Where the labels have no such rows the model has one
threshold; labels with more grades of their own can be given to :func:`fit` instead.

Defined results: null, empty or letterless text has severity 0; text of words the model does not know
has its base severity; without labelled rows of two grades nothing is toxic; repeated rows are each scored; an empty table
gives an empty result; ids may be of any type; other columns stay in ``row`` whatever their names;
texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.llm import scratch
from basalt.llm.labelled import labelled_sample

TRAIN_ROWS = 4000
N_FEATURES = 2000
MIN_ROWS = 3
MIN_RATIO = 4.0  # log-likelihood a feature must explain
PREFIXES = (4, 5, 6, 8)
THRESHOLD = 0.2
WORDS_KEPT = 300_000

_WORD = re.compile(r"[^\W\d_]+")


def word_features(w: str) -> list[int]:
    """Hashes of a word and of its prefixes (a prefix is another feature than an equal word)."""
    return [crc32(b"w" + w.encode("utf-8", "replace"))] + [crc32(b"p" + w[:n].encode("utf-8", "replace")) for n in PREFIXES if len(w) > n]


class Lookup(dict):
    """Word to the positions of its selected features, bounded."""

    def __init__(self, position: dict[int, int]):
        super().__init__()
        self.position = position

    def __missing__(self, w: str) -> tuple[int, ...]:
        if len(self) > WORDS_KEPT:
            self.clear()
        self[w] = out = tuple(self.position[f] for f in word_features(w) if f in self.position)
        return out


class Model:
    """Feature positions, their weights, and the ordered thresholds of grades 1, 2, ..."""

    def __init__(self, features: list[int], weights: np.ndarray, cuts: list[float]):
        self.features, self.weights, self.cuts = features, weights, cuts
        self.lookup = Lookup({f: i for i, f in enumerate(features)})

    def at_least(self, text: str | None) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        if not self.cuts:
            return []
        words = set(_WORD.findall(text.lower())) if text else set()
        if not words:
            return [0.0] * len(self.cuts)
        found = set(chain.from_iterable(map(self.lookup.__getitem__, words)))
        z = float(self.weights[list(found)].sum()) if found else 0.0
        return [float(1 / (1 + np.exp(-np.clip(z - c, -40, 40)))) for c in self.cuts]


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        feats = []
        for x in b.column(1):
            words = set(_WORD.findall((x.as_py() or "").lower()))
            feats.append(sorted(set(chain.from_iterable(map(word_features, words)))))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(feats, pa.list_(pa.int64()))], ["doc_id", "y", "feats"])


def severity_grades(labels: DataFrame) -> DataFrame:
    """Labels with ``grade``: 0, 1 for toxic, 2 for toxic and of no quality; null where toxic is null."""
    worthless = F.coalesce(F.col("quality") == 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    return labels.withColumn("grade", F.when(F.col("toxic") == 0, 0).when(F.col("toxic") > 0, F.when(worthless, 2).otherwise(1)))


def _ordinal(x: np.ndarray, grade: np.ndarray, l2: float, steps: int) -> tuple[np.ndarray, list[float]]:
    """Adam on the mean negative log-likelihood; cuts as a first one and positive gaps."""
    k = int(grade.max())
    n, d = x.shape
    theta = np.concatenate([np.zeros(d), [1.0], np.zeros(k - 1)])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    sig = lambda t: 1 / (1 + np.exp(-np.clip(t, -40, 40)))
    for t in range(1, steps + 1):
        w, gaps = theta[:d], np.exp(theta[d + 1 :])
        cuts = theta[d] + np.concatenate([[0], np.cumsum(gaps)])
        s = np.column_stack([np.ones(n), *(sig(x @ w - c) for c in cuts), np.zeros(n)])
        p = np.maximum(s[np.arange(n), grade] - s[np.arange(n), grade + 1], 1e-9)
        ds = s * (1 - s)
        up, down = ds[np.arange(n), grade] / p, ds[np.arange(n), grade + 1] / p  # d log p / d (w.x - cut)
        gw = -(x.T @ (up - down)) / n + l2 * w
        gc = np.array([(up[grade == j].sum() - down[grade == j - 1].sum()) / n for j in range(1, k + 1)])
        ggap = np.array([gc[i:].sum() for i in range(1, k)]) * gaps
        g = np.concatenate([gw, [gc.sum()], ggap])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    cuts = theta[d] + np.concatenate([[0], np.cumsum(np.exp(theta[d + 1 :]))])
    return theta[:d], cuts.tolist()


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "grade", id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, n_features: int = N_FEATURES, l2: float = 3e-4, steps: int = 300) -> Model:
    """Fit on at most ``train_rows`` labelled rows; grades are whole numbers from 0."""
    scratch.ship(docs.sparkSession)
    if label == "grade" and "grade" not in labels.columns:
        labels = severity_grades(labels)
    s = labelled_sample(docs, labels, label, train_rows, id_col=id_col, text_col=text_col)
    got = s.mapInArrow(_sample_task, f"doc_id {s.schema['doc_id'].dataType.simpleString()}, y int, feats array<long>").toArrow().sort_by("doc_id")
    y = got["y"].to_numpy() if got.num_rows else np.zeros(0, dtype=int)
    y = np.unique(np.maximum(y, 0), return_inverse=True)[1]  # grades that occur, numbered from 0
    if len(set(y.tolist())) < 2:
        return Model([], np.zeros(0), [])
    lists = [f.values.to_numpy() for f in got["feats"]]
    owner = np.repeat(np.arange(len(lists)), [len(f) for f in lists])
    names, col = np.unique(np.concatenate(lists), return_inverse=True)
    hot = (y > 0).astype(float)
    both = np.bincount(col, minlength=len(names))
    toxic = np.bincount(col, hot[owner], minlength=len(names))
    # half the likelihood-ratio statistic of "has the feature" against "is toxic"
    base = hot.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        q = np.clip(toxic / np.maximum(both, 1), 1e-9, 1 - 1e-9)
        stat = toxic * np.log(q / base) + (both - toxic) * np.log((1 - q) / (1 - base))
    stat = np.where(both >= MIN_ROWS, stat, 0)
    pick = np.argsort(-stat, kind="stable")[:n_features]
    pick = np.sort(pick[stat[pick] > MIN_RATIO])
    if not len(pick):
        return Model([], np.zeros(0), [])
    place = np.full(len(names), -1)
    place[pick] = np.arange(len(pick))
    x = np.zeros((len(lists), len(pick)))
    ok = place[col] >= 0
    x[owner[ok], place[col[ok]]] = 1
    del got, lists
    scratch.release()
    w, cuts = _ordinal(x, y, l2, steps)
    return Model([int(f) for f in names[pick]], w, cuts)


def score(docs: DataFrame, model: Model, *, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (all columns but the text), severity, grade_probs, p_toxic, toxic and, last, the text."""
    scratch.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    features, weights, cuts = model.features, model.weights, model.cuts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(features, weights, cuts)
        for b in batches:
            probs = [m.at_least(x.as_py()) for x in b.column(1)]
            first = [p[0] if p else 0.0 for p in probs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sum(p) for p in probs], pa.float64()), pa.array(probs, pa.list_(pa.float64())), pa.array(first, pa.float64()), pa.array([p >= threshold for p in first], pa.bool_()), b.column(1)], ["row", "severity", "at_least", "p_toxic", "toxic", "text"])

    row = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(scratch.trimmed(run), f"row {row}, severity double, at_least array<double>, p_toxic double, toxic boolean, text string")


def op10_toxicity(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("row.doc_id", "severity", "p_toxic", "toxic")
