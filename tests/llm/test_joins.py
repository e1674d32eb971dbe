"""Jaccard join, substring dedup and top-k against brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from basalt.llm import jaccard, suffix_dedup, topk

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1)))


def brute_components(rows, percent=80):
    sets = [shingle_set(t) for _, t in rows]
    inv, group = defaultdict(list), list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, s in enumerate(sets):
        for j, n in Counter(j for f in s for j in inv[f]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                group[b] = a
        for f in s:
            inv[f].append(i)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    name = lambda i: min((d for d in least[find(i)] if d is not None), default=None)
    return sorted(((d, len(sets[i]), name(i) if sets[i] else d) for i, (d, _) in enumerate(rows)), key=str)


@pytest.mark.parametrize("options", [{}, {"sample": 100, "block": 2}])
def test_jaccard_equals_brute_force(corpus, pairs_of, options):
    got = sorted((tuple(r)[:3] for r in jaccard.jaccard_components(corpus, **options).collect()), key=str)
    assert got == brute_components(pairs_of)


def test_jaccard_on_a_family_of_near_copies(spark, words):
    r = random.Random(1)
    base, rows = r.choices(words, k=120), []
    for i in range(90):
        w = list(base)
        for k in r.sample(range(120), r.choice([0, 1, 1, 2, 2, 3, 5, 9])):
            w[k] = r.choice(words)
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(x)[:3] for x in jaccard.jaccard_components(df, block=8).collect()), key=str)
    assert got == brute_components(rows)


def test_signatures_meet_for_every_similar_pair(words):
    r, h, scheme = random.Random(3), jaccard.WordHashes(), jaccard.Scheme()
    met = 0
    for n in [*range(1, 40), 64, 65, 130, 513] * 12:
        w = r.choices(words, k=n + 4)
        v = list(w)
        for k in r.sample(range(len(v)), r.randint(0, 1 + n // 40)):
            v[k] = r.choice(words)
        v = v[: len(v) - r.randint(0, n // 6)]
        a, b = (jaccard.shingles(" ".join(x), h) for x in (w, v))
        if jaccard.similar(a, b, 80) and len(np.setxor1d(a, b)):
            met += 1
            assert set(scheme.of(a).tolist()) & set(scheme.of(b).tolist())
    assert met > 100
    few = [np.array(sorted(r.sample(range(1 << 60), n)), dtype=np.uint64) for n in (20, 60, 200) for _ in range(40)]
    sigs = [set(scheme.of(s).tolist()) for s in few]
    assert not any(x & y for i, x in enumerate(sigs) for y in sigs[:i])  # nothing met by emptiness


def test_sets_that_differ_as_far_as_allowed_meet():
    r, scheme = random.Random(8), jaccard.Scheme()
    for n in [*range(5, 60), 100, 333] * 6:
        base = r.sample(range(1 << 60), n)
        for more in range(0, n // 4 + 1):
            gone = jaccard.most_apart(n, n + more, 80) - more  # elements to leave out of the other set
            if gone < 0:
                break
            other = base[gone:] + r.sample(range(1 << 60), more)
            a, b = (np.array(sorted(x), dtype=np.uint64) for x in (base, other))
            if jaccard.similar(a, b, 80) and len(np.setxor1d(a, b)):
                assert set(scheme.of(a).tolist()) & set(scheme.of(b).tolist())


def test_one_per_group_keeps_clean_rows(corpus, pairs_of):
    kept = jaccard.one_per_group(corpus)
    assert kept.columns == corpus.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    comps = brute_components(pairs_of)
    empty = sum(n == 0 for _, n, _ in comps)
    assert len(rows) == empty + len({c for _, n, c in comps if n}) + 1  # id 3 is in two components
    assert {d for d, t in rows if shingle_set(t)} == {c for _, n, c in comps if n}


def brute_spans(rows, length, min_words=0):
    """(doc_id, text bytes, stretches) by counting every window."""
    raws = [(t or "").encode() for _, t in rows]
    seen = Counter(r[p : p + length] for r in raws for p in range(len(r) - length + 1))
    out = []
    for (d, _), r in zip(rows, raws):
        mark = bytearray(len(r))
        for p in range(len(r) - length + 1):
            if seen[r[p : p + length]] > 1:
                mark[p : p + length] = b"\1" * length
        spans = [m.span() for m in re.finditer(b"\1+", bytes(mark))]
        out.append((d, r, [(a, b) for a, b in spans if len(r[a:b].split()) >= min_words]))
    return out


def left_of(raw, spans):
    return b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(raw)]))


@pytest.mark.parametrize("options", [{}, {"hot": 1}, {"lengths": (100,), "gram": 30}, {"lengths": (400, 200), "min_words": (0, 51)}, {"lengths": (60, 333, 90), "gram": 20, "hot": 3}])
def test_suffix_dedup_equals_brute_force(corpus, pairs_of, options):
    got = suffix_dedup.repeated_spans(corpus, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "also")
    lengths = options.get("lengths", (400,))
    words = options.get("min_words", (0,) * len(lengths))
    each = [brute_spans(pairs_of, n, k) for n, k in zip(lengths, words)]
    want = []
    for (d, raw, spans), *more in zip(*each):
        want.append((d, len(raw), sum(b - a for a, b in spans), len(spans), hashlib.sha256(left_of(raw, spans)).hexdigest(), spans, [sum(b - a for a, b in s) for _, _, s in more]))
    rows = [(*r[:5], [tuple(x) for x in r.spans], r.also) for r in got.collect()]
    assert sorted(rows, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("options", [{}, {"hot": 1, "length": 90}, {"length": 400, "min_words": 0}])
def test_remove_repeated_equals_brute_force(corpus, pairs_of, options):
    out = suffix_dedup.remove_repeated(corpus, **options)
    assert out.columns == corpus.columns and dict(out.dtypes) == dict(corpus.dtypes)
    want = []
    for (d, t), (_, raw, spans) in zip(pairs_of, brute_spans(pairs_of, options.get("length", 200), options.get("min_words", 51))):
        want.append((d, left_of(raw, spans).decode("utf-8", "ignore") if spans else t))
    rows = out.collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(want, key=str)
    assert all(r.text is None or r.n_chars == len(r.text) for r in rows)
    assert {(r.doc_id, r.lang, r.source) for r in rows} == {(r.doc_id, r.lang, r.source) for r in corpus.collect()}


def test_texts_longer_than_a_chunk(spark, words, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 700)
    one, two = suffix_dedup._hashes()
    r = random.Random(9)
    raw = " ".join(r.choices(words, k=900)).encode()
    for least, cut in ((100, 100), (60, 150)):
        anchor, s, e, *_ = suffix_dedup.runs(raw, one, two, least, cut, 20)
        assert s[0] == 0 and e[-1] == len(raw) - least and (s[1:] == e[:-1] + 1).all()
        whole = suffix_dedup.runs(raw * 3, one, two, least, cut, 20)
        again = Counter(zip(whole[0].tolist(), whole[3].tolist(), whole[4].tolist()))
        assert max(again.values()) >= 2


def test_suffix_family_finds_longest_matches_and_merges_geometrically():
    f = suffix_dedup.SuffixFamily(20)
    r = random.Random(0)
    texts = [bytes(r.choices(b"ab", k=60)) for _ in range(40)] + [b"x" * 30, b"x" * 30]
    for t in texts:
        f.add([t], np.array([len(t) - 9]))
    assert all(len(a[0]) > 2 * len(b[0]) for a, b in zip(f.levels, f.levels[1:]))
    for keys, _ in f.levels:
        assert (keys[1:] > keys[:-1]).all()
    every = [t[p : p + 20] for t in texts for p in range(len(t) - 9)]
    for n in (10, 15, 20):
        seen = Counter(s[:n] for s in every if len(s) >= n)
        assert (f.longest >= n).tolist() == [len(s) >= n and seen[s[:n]] > 1 for s in every]


def brute_top_k(rows):
    usable = []
    for i, x in rows:
        if i is not None and x and all(c is not None and math.isfinite(c) for c in x):
            usable.append((i, tuple(math.floor(Fraction(float(np.float32(c))) * 1024) for c in x)))
    want = []
    for i, x in sorted({u for u in usable if u[0] % 100 == 0}):
        s = sorted((-sum(a * b for a, b in zip(x, y)), j) for j, y in usable if j != i and len(y) == len(x))[:10]
        want += [(i, k + 1, j, -n) for k, (n, j) in enumerate(s)]
    return sorted(want)


def test_top_k_equals_brute_force(spark):
    r = random.Random(2)
    v = [(i, [r.uniform(-1, 1) for _ in range(8)]) for i in range(300)]
    v += [(300 + i, v[10][1]) for i in range(150)]  # a very common vector
    v += [(900, None), (901, [float("nan")] * 8), (902, [1.0, None] + [0.0] * 6), (903, []), (None, [0.1] * 8), (100, [0.5, 0.5]), (7, v[7][1]), (905, [float("inf")] * 8)]
    v += [(1001 + i, [r.uniform(-1, 1) * 10.0 ** r.randint(0, 4) for _ in range(8)]) for i in range(40)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").withColumns({c: F.lit("x") for c in ("qno", "vec", "score", "rank", "query_id", "block")}).repartition(5)
    for options in ({}, {"block_rows": 1, "groups": 3}, {"groups": 20}):
        got = topk.top_k(df, F.col("vec_id") % 100 == 0, **options)
        assert sorted(map(tuple, got.collect())) == brute_top_k(v)
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_of_large_components(spark):
    r = random.Random(3)
    v = [(i, [r.uniform(-1, 1) * 10.0 ** r.choice([0, 0, 0, 4, 5, 6]) for _ in range(6)]) for i in range(260)]
    df = spark.createDataFrame(v, "vec_id long, embedding array<float>").repartition(4)
    assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 100 == 0).collect())) == brute_top_k(v)
    few = [(0, [1.0, 0.0]), (1, [70000.0, 0.0]), (2, [2.0, 0.0]), (3, [-3e38, 1.0])] + [(4 + i, [0.5, 1.0]) for i in range(20)]
    got = topk.top_k(spark.createDataFrame(few, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == brute_top_k(few) and got[0].vec_id == 1
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect()


def test_top_k_prunes():
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 32))
    c = np.floor(1024 * (centre[rng.integers(0, 20, 4000)] + 0.05 * rng.normal(size=(4000, 32))))
    q = np.floor(1024 * centre[:16])
    whole = q @ c.T
    cut = np.sort(whole, axis=1)[:, -10]
    chunk = topk.Chunk(q, c, 4)
    for i, rows, score in chunk.reaching(cut):
        assert sorted(rows.tolist()) == np.flatnonzero(whole[i] >= cut[i]).tolist() and (whole[i, rows] == score).all()
    assert chunk.products < 0.7 * q.size * len(c)
    first = topk.Chunk(q, c, 4)
    for i, rows, score in first.leading(3):
        assert (whole[i, rows] == score).all()
    assert first.products < 0.3 * q.size * len(c)


def test_empty_tables(corpus):
    none = corpus.filter("false")
    assert jaccard.jaccard_components(none).count() == 0
    assert suffix_dedup.repeated_spans(none).count() == 0
    assert jaccard.one_per_group(none).count() == 0
    assert suffix_dedup.remove_repeated(none).count() == 0


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    import time

    from basalt.llm import scratch

    def files():
        disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return {f for f in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}

    before, switch = files(), spark.conf.get(scratch.CLEANUP)
    saved = scratch.Scratch(spark, "test").save(spark.range(1000).repartition(5, "id"))
    for _ in range(20):
        if not files() - before:
            break
        time.sleep(0.5)
    assert not files() - before
    assert saved.count() == 1000 and spark.conf.get(scratch.CLEANUP) == switch


def test_a_task_of_many_anchors_holds_few_suffixes_at_a_time(monkeypatch):
    made = []

    class Noted(suffix_dedup.SuffixFamily):
        def __init__(self, cut):
            super().__init__(cut)
            made.append(self)

    monkeypatch.setattr(suffix_dedup, "SuffixFamily", Noted)
    monkeypatch.setattr(suffix_dedup, "FAMILY_BYTES", 500, raising=False)
    r = random.Random(3)
    texts = ["".join(r.choices("abcdefgh", k=60)).encode() for _ in range(40)]
    rows = [(2 * k + j, k, texts[k] + b"zy"[j : j + 1] * 10) for k in range(40) for j in (0, 1)]  # two contexts of each anchor
    cols = [[x[0] for x in rows], [0] * 80, [30] * 80, [1] * 80, [x[2] for x in rows], [x[1] for x in rows]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 4 else pa.int64()) for i, c in enumerate(cols)], ["rid", "s", "e", "n", "text", "anchor"])
    got = [x for b in suffix_dedup._settle((40,), 40)(iter([batch.slice(i, 7) for i in range(0, 80, 7)])) for x in b.to_pylist()]
    assert sorted((x["rid"], x["lo"], x["hi"]) for x in got) == [(i, 0, 20) for i in range(80)]
    assert max(len(f.longest) for f in made) <= 31 * 18  # 500 bytes, and the batch and anchor that pass them


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_reads_candidates_where_their_texts_lie(corpus, pairs_of, monkeypatch):
    from basalt.llm import scratch

    plans, save = [], scratch.Scratch.save
    monkeypatch.setattr(scratch.Scratch, "save", lambda self, df, name="t": plans.append((name, plan_of(df))) or save(self, df, name))
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)  # as on a large table
    got = sorted((tuple(r)[:3] for r in jaccard.jaccard_components(corpus).collect()), key=str)
    assert got == brute_components(pairs_of)
    assert "Exchange" not in next(plan for name, plan in plans if name == "sets")


def test_one_per_group_moves_no_text(corpus, pairs_of, monkeypatch):
    once = corpus.filter("doc_id is not null and doc_id <> 3")
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 0)
    kept = jaccard.one_per_group(once)
    assert "Exchange" not in plan_of(kept)
    want = sorted(d for d, n, c in brute_components([x for x in pairs_of if x[0] not in (None, 3)]) if d == c)
    assert sorted(r.doc_id for r in kept.collect()) == want
    assert kept.columns == corpus.columns and kept.filter(~F.col("text").eqNullSafe(F.col("text"))).isEmpty()


def test_one_per_group_by_either_set_of_ids(spark, corpus, words, monkeypatch):
    from basalt.llm import idset

    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    copies = spark.createDataFrame([(i, " ".join(words[:50] if i < 30 else words[80 * i : 80 * i + 50])) for i in range(36)], "doc_id long, text string")
    few = jaccard.one_per_group(copies)  # more rows go than stay
    assert sorted(r.doc_id for r in few.collect()) == [0, *range(30, 36)]
    there, mixed = rows(jaccard.one_per_group(corpus)), corpus.select(F.lit(1).cast("long").alias("doc_id"), "text", "lang")
    one_id = rows(jaccard.one_per_group(mixed).select("text"))  # every id repeats
    monkeypatch.setattr(idset, "MOST", 0)
    assert rows(jaccard.one_per_group(corpus)) == there
    assert rows(jaccard.one_per_group(mixed).select("text")) == one_id
    assert rows(jaccard.one_per_group(copies)) == rows(few)
