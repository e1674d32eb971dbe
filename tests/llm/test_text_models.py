"""Language, quality, toxicity, licences: exact counts, held-out accuracy, edge cases."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from basalt.llm import langid, licenses, quality, toxicity

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = langid.op5_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id")
    r = out.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r > 0.97 and out.count() == docs.count()
    assert out.filter("score < 0 or score > 1").count() == 0


def test_language_mixture_and_edges(spark, corpus):
    de, en = "der die das und ist nicht ein eine mit von zu auf ", "the of and to in is that was for with this on "
    train = spark.createDataFrame([(en * 20, "en"), (de * 20, "de"), (None, "en"), ("x", None)], "text string, lang string")
    m = langid.fit(train)
    assert m.langs == ["de", "en"]
    both = m.mixture(langid.counts(en * 10 + de * 10))
    assert set(both) == {"de", "en"} and all(0.3 < v < 0.7 for v in both.values())
    assert set(m.mixture(langid.counts(en * 10))) == {"en"}
    got = {r.row.doc_id: r for r in langid.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 %% 3"), (4, "a"), (5, "É")], "doc_id int, text string"), m).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(got[i].score == 0 for i in (1, 2, 3))
    assert got[4].lang_pred in m.langs and got[5].lang_pred in m.langs
    none = langid.fit(train.filter("false"))
    assert {r.lang_pred for r in langid.predict(corpus.select("doc_id", "text"), none).collect()} == {"und"}
    with pytest.raises(ValueError):
        langid.fit(train, max_languages=1)


def base_counts(text):
    words = WORD.findall(text or "")
    n, spans = len(words), Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(n - 7):
        if spans[tuple(words[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_quality_counts_equal_brute_force(spark, corpus, words):
    r = random.Random(4)
    extra = [" ".join(r.choices(words[:12], k=r.randint(1, 400))) for _ in range(30)] + ["a b\na b\n\n\na b \n a b", "x y z\x0bw\x1cv", "#" * 9, ("p q r s t u v w " * 3).strip()]
    docs = corpus.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    got = quality.score(docs, quality.Model(np.zeros(quality.SIZE), 0.0, 1.0, 9.0)).select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = []
    for d, t in docs.collect():
        n = base_counts(t)
        failed = n[0] < 20 or 100 * n[4] > 30 * n[0]
        want.append((d, *n, failed, not failed))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_quality_learns_on_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit(docs, labels.filter("doc_id % 3 <> 0"))
    out = quality.score(docs.select("doc_id", "text"), m).select("row.doc_id", "base_failed", "p_quality").join(labels.filter("doc_id % 3 = 0"), "doc_id").filter("not base_failed").toPandas()
    assert ((out.p_quality >= 0.5) == (out.quality == 1)).mean() > 0.95
    nothing = quality.fit(docs, labels.filter("false"))
    assert quality.score(docs.limit(5).select("doc_id", "text"), nothing).filter("p_quality < 0.5").count() == 0


def test_toxicity_learns_on_held_out_rows(spark):
    docs, labels = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    m = toxicity.fit(docs, labels.filter("doc_id % 3 <> 0"))
    assert len(m.cuts) == 2 and m.cuts[0] < m.cuts[1] and (m.weights < 0).any()
    out = toxicity.score(docs.select("doc_id", "text"), m).select("row.doc_id", "severity", F.col("toxic").alias("pred")).join(labels.filter("doc_id % 3 = 0"), "doc_id").toPandas()
    assert out[out.toxic == 1].pred.mean() > 0.85 and out[out.toxic == 0].pred.mean() < 0.02
    assert out.severity.between(0, 2).all() and out[out.toxic == 1].severity.mean() > out[out.toxic == 0].severity.mean() + 0.5


def test_toxicity_edges(spark, corpus):
    labels = spark.createDataFrame([(1, None), (2, 1), (2, 0)], "doc_id long, toxic int")
    m = toxicity.fit(corpus, labels)
    out = toxicity.score(corpus.select("doc_id", "text"), m)
    assert out.filter("toxic").count() == 0 and out.count() == corpus.count()
    x = np.array([[0.0], [0.0], [1.0], [1.0], [2.0], [2.0]])
    w, cuts = toxicity._ordinal(x, np.array([0, 0, 1, 1, 2, 2]), 1e-4, 400)
    assert w[0] > 0 and cuts[0] < w[0] < cuts[1] < 2 * w[0]


def test_licences(spark, corpus):
    text = "Copyright (c) 2020 Someone\n\n" + licenses.MIT.upper().replace(",", " ;").replace("COPYRIGHT HOLDERS", "Copyright Owners")
    rows = [(1, text), (2, licenses.MIT + " and more"), (3, None), (4, ""), (5, "…!"), (6, "Released  under the MIT Licence")]
    got = {r.row.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id int, text string")).collect()}
    assert [got[i].license for i in range(1, 7)] == ["MIT", None, None, None, None, "MIT"]
    assert got[3].digest is None and got[4].digest == got[5].digest
    clash = corpus.withColumnRenamed("lang", "digest").withColumnRenamed("source", "license")
    assert licenses.scan_licenses(clash).count() == corpus.count()
    assert licenses.scan_licenses(corpus.filter("false")).count() == 0


def plain_grams(raw, n):
    return [raw[i : i + n] for i in range(len(raw) - n + 1)]


def bucket(x, bits):
    return (x * 0x9E3779B97F4A7C15 % 2**64) >> (64 - bits)


def plain_margin(m, text):
    """The quality margin by the definition: mean weights of words, word pairs and byte n-grams."""
    from zlib import crc32

    raw = (text or "").encode()
    w = [crc32(x) for x in raw.split()]
    groups = [[float(m.weights[bucket(x, quality.WORD_BITS)]) for x in w], [float(m.weights[bucket((a * 0xD6E8FEB86659FD93 + b) % 2**64, quality.WORD_BITS)]) for a, b in zip(w, w[1:])]]
    for n in quality.CHAR_GRAMS:
        groups.append([float(m.weights[(1 << quality.WORD_BITS) + bucket((int.from_bytes(g, "big") + (n << 56)) % 2**64, quality.CHAR_BITS)]) for g in plain_grams(raw, n)])
    return m.bias + quality.SCALE * sum(sum(g) / len(g) for g in groups if g)


def test_quality_verdict_equals_brute_force(spark, pairs_of, monkeypatch):
    rng = np.random.default_rng(3)
    m = quality.Model(rng.normal(size=quality.SIZE), 0.1, 0.7, -0.2)
    df = spark.createDataFrame(pairs_of, "doc_id long, text string")
    got = sorted(((r.doc_id, r.p_quality, r.kept) for r in quality.score(df, m).select("row.doc_id", "p_quality", "kept").collect()), key=str)
    want = []
    for d, t in pairs_of:
        p = 1 / (1 + np.exp(-(0.7 * plain_margin(m, t) - 0.2)))
        n = base_counts(t)
        want.append((d, p, n[0] >= 20 and 100 * n[4] <= 30 * n[0] and p >= 0.5))
    for (a, p, k), (b, q, j) in zip(got, sorted(want, key=str)):
        assert a == b and abs(p - q) < 1e-4 and (k == j or abs(q - 0.5) < 1e-4)
    long = " ".join(t or "" for _, t in pairs_of)
    *_, words, raw = quality.measure(long, quality.Hashes())
    for size in (7, 1000):
        monkeypatch.setattr(quality, "SLICE", size)
        assert abs(m.margin(words, raw) - plain_margin(m, long)) < 1e-3
        assert np.allclose(quality.features(words, raw) @ m.weights + m.bias, plain_margin(m, long), atol=1e-3)


def test_toxicity_equals_brute_force(spark, pairs_of):
    words = sorted({w for _, t in pairs_of[:30] for w in re.findall(r"[^\W\d_]+", (t or "").lower())})[:200]
    rng = np.random.default_rng(5)
    features = sorted({f for w in words for f in toxicity.word_features(w)})
    m = toxicity.Model(features, rng.normal(size=len(features)), [0.5, 1.5])
    df = spark.createDataFrame(pairs_of, "doc_id long, text string")
    got = sorted(((r.row.doc_id, r.severity, r.p_toxic, r.toxic) for r in toxicity.score(df, m).collect()), key=str)
    want = []
    for d, t in pairs_of:
        has = {f for w in re.findall(r"[^\W\d_]+", (t or "").lower()) for f in toxicity.word_features(w)}
        z = sum(w for f, w in zip(features, m.weights) if f in has)
        p = [1 / (1 + np.exp(c - z)) if re.search(r"[^\W\d_]", t or "") else 0.0 for c in m.cuts]
        want.append((d, sum(p), p[0], p[0] >= toxicity.THRESHOLD))
    for a, b in zip(got, sorted(want, key=str)):
        assert a[0] == b[0] and np.allclose(a[1:3], b[1:3]) and a[3] == b[3]


def test_language_mixture_equals_brute_force():
    """The model's mixture against the same search written out for single trigrams."""
    texts = {"aa": "the of and to in is that was for with this on " * 8, "bb": "der die das und ist nicht ein eine mit von zu auf " * 8, "cc": "el la de que y en un ser se no haber por con su para " * 8}
    total = {k: langid.counts(v) for k, v in texts.items()}
    p = np.array([(n + 0.5 + 1e-6 * n.sum() / langid.SIZE) / (n + 0.5 + 1e-6 * n.sum() / langid.SIZE).sum() for n in total.values()]).T
    m = langid.Model(list(texts), np.log(p))

    def em(cols, c):
        theta = [1 / len(cols)] * len(cols)
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(cols)
            for b, n in c.items():
                mix = sum(t * p[b, j] for t, j in zip(theta, cols))
                for i, j in enumerate(cols):
                    new[i] += n * theta[i] * p[b, j] / mix
            theta = [x / sum(c.values()) for x in new]
        return theta, sum(n * np.log(sum(t * p[b, j] for t, j in zip(theta, cols))) for b, n in c.items())

    for text in (texts["aa"], texts["aa"][:150] + texts["bb"][:200], texts["cc"][:90] + texts["bb"][:90] + texts["aa"][:90], "x", "und der " * 3):
        counts = langid.counts(text)
        c = {int(b): int(counts[b]) for b in np.flatnonzero(counts)}
        n = sum(c.values())
        single = [em([j], c)[1] for j in range(3)]
        chosen = [int(np.argmax(single))]
        best, theta = single[chosen[0]], [1.0]
        shares, _ = em([0, 1, 2], c)
        for j in sorted(range(3), key=lambda j: -shares[j]):
            if j in chosen:
                continue
            got, value = em([*chosen, j], c)
            if value - best <= 0.5 * np.log(n) + langid.RHO * n:
                break
            chosen, best, theta = [*chosen, j], value, got
        got = m.mixture(counts)
        assert list(got) == [m.langs[j] for j in chosen] and np.allclose(list(got.values()), theta, atol=1e-6)


def test_classifiers_take_ids_of_any_type_clashing_columns_and_empty_tables(spark, corpus):
    r = random.Random(1)
    rows = [(f"id{i}", " ".join(r.choices(["bad", "awful", "mean"] if i % 2 else ["fine", "good", "calm"], k=30)), "x", "y", "z") for i in range(60)]
    docs = spark.createDataFrame(rows, "name string, body string, row string, text string, toxic string")
    labels = spark.createDataFrame([(f"id{i}", i % 2, 1 - i % 2) for i in range(60)], "name string, toxic int, quality int")
    t = toxicity.fit(docs, labels, id_col="name", text_col="body")
    out = toxicity.score(docs, t, text_col="body").select("row.name", "row.row", "row.toxic", F.col("toxic").alias("pred")).collect()
    assert len(out) == 60 and all(x.row == "x" and x.toxic == "z" and x.pred == int(x.name[2:]) % 2 for x in out)
    q = quality.fit(docs, labels, id_col="name", text_col="body")
    got = quality.score(docs, q, text_col="body").select("row.name", "p_quality").collect()
    assert all((x.p_quality > 0.5) == (int(x.name[2:]) % 2 == 0) for x in got)
    none = corpus.filter("false")
    some = spark.createDataFrame([(1, 1, 0)], "doc_id long, toxic int, quality int")
    assert toxicity.score(none, toxicity.fit(none, some)).count() == 0
    assert quality.score(none, quality.fit(none, some)).count() == 0
    assert langid.predict(none.select("doc_id", "text"), langid.fit(none)).count() == 0
    twice = corpus.select("doc_id", "text").unionByName(corpus.select("doc_id", "text"))
    m = langid.fit(corpus)
    assert langid.predict(twice, m).groupBy("row.doc_id", "lang_pred", "score").count().agg(F.sum("count")).first()[0] == 2 * corpus.count()


def test_sample_is_bounded_by_rows_and_bytes(spark, corpus):
    from basalt.llm.labelled import labelled_sample

    labels = corpus.select("doc_id", F.lit(1).alias("y")).filter("doc_id < 40")
    assert labelled_sample(corpus, labels, "y", 7).count() == 7
    some = labelled_sample(corpus, labels, "y", 100, most=3000)
    size = [len(r.text.encode()) for r in some.collect()]
    assert 0 < len(size) < 39 and sum(size) - max(size) < 3000


def test_licence_texts_of_a_folder(spark, tmp_path):
    (tmp_path / "Own").write_text("Copyright 2020 Me\n\nDo as you please.")
    assert licenses.folder_digests(str(tmp_path)) == {"Own": licenses.digest("do as YOU please")}
    known = licenses.known_digests()
    assert len(known) > 35 and len(set(licenses.FULL_TEXTS.values())) == len(licenses.FULL_TEXTS)
    notice = licenses.gnu_notice("program", "General Public License", "3", True)
    assert known[licenses.digest("Copyright (C) 2024 A. Person\n\n" + notice)] == "GPL-3.0"
    assert "the GNU General Public License as published by the Free Software Foundation, either version 3 of the License" in notice
