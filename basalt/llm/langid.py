"""Language identification of documents as mixtures, by expectation-maximisation.

Each learned language is a smoothed distribution over hashed byte trigrams of lower-cased letters,
counted over all training rows. A document's trigrams are modelled as a mixture of languages whose
proportions are estimated by expectation-maximisation; the language set grows from the best single
language, a language joining while the log-likelihood gains more than a penalty of half the
logarithm of the trigrams plus ``rho`` per trigram. The predicted language has the largest
proportion, which is the score.

The model has one row of ``2**BITS`` numbers for each language, so its size follows the number of
languages; ``max_languages`` bounds that and more raise ValueError.

Defined results: null text, or text without a letter, or a model without languages gives ``und``
with no languages and score 0; rows with a null language or null text teach nothing; repeated rows
count as often as they occur; texts are read whole, in slices of bounded memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basalt.llm import scratch

BITS = 14
SIZE = 1 << BITS
ROUNDS = 12
RHO = 0.03
MAX_LANGUAGES = 1000
SLICE = 4_000_000

#: ASCII bytes that are no letters become spaces; upper case was folded before.
_LETTERS = np.full(256, 32, dtype=np.uint8)
_LETTERS[97:123] = np.arange(97, 123)
_LETTERS[128:] = np.arange(128, 256)


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text)) if len(text) < 64 else any(map(str.isalpha, text[:64])) or any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Trigrams of a text by bucket; those of spaces only are left out."""
    raw = b" " + text.lower().encode("utf-8", "replace") + b" "  # so that any letter is in a trigram
    total = np.zeros(SIZE, dtype=np.int64)
    for at in range(0, max(1, len(raw) - 2), SLICE):
        b = _LETTERS[np.frombuffer(raw[at : at + SLICE + 2], dtype=np.uint8)].astype(np.uint32)
        if len(b) < 3:
            break
        v = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
        v = v[v != 0x202020]
        total += np.bincount((v * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=SIZE)
    return total


class Model:
    """Log-probabilities of buckets by language."""

    def __init__(self, langs: list[str], log_p: np.ndarray):
        self.langs, self.log_p = langs, log_p  # (SIZE, languages)

    def _em(self, p: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, float]:
        """p: (n, languages) scaled probabilities, c: (n,) counts."""
        theta = np.full(p.shape[1], 1.0 / p.shape[1])
        n = c.sum()
        for _ in range(ROUNDS):
            mix = p @ theta
            theta = theta * (p.T @ (c / mix)) / n
        return theta, float(c @ np.log(p @ theta))

    def mixture(self, total: np.ndarray, rho: float = RHO) -> dict[str, float]:
        """The selected languages and their proportions."""
        at = np.flatnonzero(total)
        if not len(at) or not self.langs:
            return {}
        c = total[at].astype(float)
        n = c.sum()
        logs = self.log_p[at].astype(float)
        logs -= logs.max(axis=1, keepdims=True)  # the same factor for every language of a bucket
        p = np.exp(logs)
        single = c @ logs
        chosen = [int(np.argmax(single))]
        best, theta = float(single[chosen[0]]), np.ones(1)
        if len(self.langs) > 1:
            shares, _ = self._em(p, c)
            penalty = 0.5 * np.log(n) + rho * n
            for j in np.argsort(-shares, kind="stable"):
                j = int(j)
                if j in chosen:
                    continue
                got, value = self._em(p[:, [*chosen, j]], c)
                if value - best <= penalty:
                    break
                chosen, best, theta = [*chosen, j], value, got
        return {self.langs[j]: float(t) for j, t in zip(chosen, theta, strict=True)}


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    by: dict[str, np.ndarray] = {}
    for b in batches:
        for text, lang in zip(b.column(0), b.column(1), strict=True):
            lang = lang.as_py()
            if lang not in by:
                by[lang] = np.zeros(SIZE, dtype=np.int64)
            by[lang] += counts(text.as_py())
    for lang, total in by.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])


def fit(train: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_languages: int = MAX_LANGUAGES) -> Model:
    """Learn from all rows with a text and a language."""
    scratch.ship(train.sparkSession)
    rows = train.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    sums = rows.mapInArrow(_train_task, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    table = sums.limit(max_languages * SIZE + 1).toArrow()  # the bound below, before anything is fetched
    langs = sorted(set(table["lang"].to_pylist()))
    if len(langs) > max_languages:
        raise ValueError(f"more than {max_languages} languages")
    total = np.zeros((SIZE, len(langs)))
    where = {x: i for i, x in enumerate(langs)}
    total[table["bucket"].to_numpy(), [where[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    p = total + 0.5 + 1e-6 * total.sum(axis=0, keepdims=True) / SIZE
    return Model(langs, np.log(p / p.sum(axis=0, keepdims=True)).astype(np.float32))


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", rho: float = RHO) -> DataFrame:
    """Add lang_pred, score and languages (map of the selected languages to proportions)."""
    scratch.ship(docs.sparkSession)
    rest = [c for c in docs.columns if c != text_col]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(text_col).alias("text"))
    langs, log_p = model.langs, model.log_p

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(langs, log_p)
        for b in batches:
            pred, score, maps = [], [], []
            for x in b.column(1):
                text = x.as_py()
                mix = m.mixture(counts(text), rho) if text and _has_letter(text) else {}
                top = max(mix, key=mix.get) if mix else "und"
                pred.append(top)
                score.append(min(1.0, mix.get(top, 0.0)))
                maps.append(list(mix.items()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(maps, pa.map_(pa.string(), pa.float64()))], ["row", "lang_pred", "score", "languages"])

    row = src.schema["row"].dataType.simpleString()
    return src.mapInArrow(run, f"row {row}, lang_pred string, score double, languages map<string,double>")


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id's text leaves 0 on division by 5 (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op5_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.filter(~held_out(F.col("doc_id"))).select("text", "lang"))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score", F.size("languages").alias("n_languages"))
