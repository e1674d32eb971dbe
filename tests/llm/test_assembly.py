"""Chat formatting, mixing, packing, and the pipeline."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from basalt.llm import chat, mixing, packing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_preferences(spark):
    T = "struct<role:string,text:string>"
    t = lambda *x: [{"role": r, "text": s} for r, s in x]
    same = t(("user", "q"), ("assistant", "a"))
    rows = [
        (1, same, t(("user", "q"), ("assistant", "b"), ("user", "x"))),
        (2, same, same),
        (3, t(("user", "p")), same),
        (4, [], same),
        (5, t(("user", "<|end|>")), t(("user", "<|end|>"), ("assistant", "é"))),
    ]
    got = {r.id: r for r in chat.format_preferences(spark.createDataFrame(rows, f"id int, chosen array<{T}>, rejected array<{T}>")).collect()}
    assert got[1].prompt == "<|user|>\nq<|end|>\n" and got[1].prompt_turns == 1
    for r in got.values():
        for c, m in ((r.chosen_completion, r.chosen_mask), (r.rejected_completion, r.rejected_mask)):
            assert all(c[s.end - 8 : s.end] == "<|end|>\n" and c[: s.start].endswith("<|assistant|>\n") for s in m)
            assert len(m) == c.count("<|assistant|>\n")
    assert got[2].chosen_completion == got[2].rejected_completion == "" and got[2].prompt_turns == 2
    assert got[3].prompt == "" and got[4].prompt_turns == 0
    assert "<\\|end|>" in got[5].prompt and [tuple(s) for s in got[5].rejected_mask] == [(14, 23)]


def test_clashing_columns_stay(spark, corpus):
    from basalt.llm import jaccard, langid, quality, suffix_dedup

    names = ["row", "g", "n", "k", "sha", "spans", "size", "taken", "key", "shard", "passes", "lo1", "toxic", "severity", "score", "kept", "comp", "least", "target"]
    docs = corpus.filter("doc_id < 60 and doc_id <> 3").withColumns({c: F.lit(c) for c in names})
    for out in (jaccard.one_per_group(docs), suffix_dedup.remove_repeated(docs), mixing.materialise(mixing.mix_sources(docs), docs)):
        assert out.columns == docs.columns
        assert out.count() > 0 and out.filter(" and ".join(f"`{c}` = '{c}'" for c in names)).count() == out.count()
    assert quality.score(docs, quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))).select("row.kept").distinct().count() == 1
    assert langid.predict(docs, langid.fit(docs)).select("row.score").first()[0] == "score"
    assert packing.packed(docs).count() >= docs.count()
    T = "array<struct<role:string,text:string>>"
    one = spark.createDataFrame([([], [], "a", "b", 1)], f"chosen {T}, rejected {T}, prompt string, both string, n int")
    got = chat.format_preferences(one).first()
    assert got.prompt == "" and got.both == "b" and got.n == 1


def test_conversations_with_nulls_and_no_python(spark):
    rows = [(4, 0, "user", "hi"), (4, 1, "assistant", "yes"), (5, 1, "assistant", None), (5, 0, None, "hey"), (6, 0, "user", "alone"), (8, 0, "assistant", "x"), (None, 0, "user", "lost"), (4, 1, "assistant", "yes")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_preferences(chat.swapped_reply_pairs(df))
    got = {r.conv_id: r for r in out.collect()}
    assert set(got) == {4, 5, 6, 8} and got[6].chosen_completion == got[6].rejected_completion == ""
    assert got[5].rejected_completion == "<|assistant|>\nyes<|end|>\n" and got[8].rejected_completion == ""
    plan = out._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert chat.format_preferences(chat.swapped_reply_pairs(df.filter("false"))).count() == 0


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    """Targets by repeated resharing."""
    keys = sorted(sizes, key=lambda k: (k is None, k or ""))
    w = {k: weights[i % len(weights)] for i, k in enumerate(keys)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[k] for k in full)
        share = sum(w[k] for k in keys if k not in full)
        t = {k: most * sizes[k] if k in full else w[k] * left / share for k in keys}
        over = {k for k in keys if k not in full and t[k] > most * sizes[k] * (1 + 1e-12)}
        if not over:
            return t
        full |= over


def test_mix_meets_targets(spark, corpus):
    docs = corpus.select("doc_id", "source", "text")
    rows = mixing.mix_sources(docs).select("row.doc_id", "row.source", "row.text", "size", "source_size", "target", "taken").collect()
    assert len(rows) == corpus.count()
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * max(1, r.target)
    for k, n in taken.items():
        assert abs(n - want[k]) <= max(4, 0.02 * want[k])
    again = mixing.mix_sources(docs.repartition(3)).select("row.doc_id", "size", "taken").collect()
    key = lambda x: sorted(((r.doc_id, r["size"], r.taken) for r in x), key=str)
    assert key(again) == key(rows)


def test_mix_caps_reshare(spark):
    rows = [(i, "a", "w " * 10) for i in range(2)] + [(10 + i, "b", "w " * 50) for i in range(20)] + [(40 + i, "c", "w " * 1) for i in range(3)] + [(99, "d", None)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string, text string")).select("row.source", "target", "source_size").distinct().collect()
    want = brute_targets({"a": 20, "b": 1000, "c": 3, "d": 0})
    assert {r.source: round(r.target, 6) for r in out} == {k: round(v, 6) for k, v in want.items()}


def test_sainte_lague_seats(spark):
    cells = spark.createDataFrame([("s", i, z) for i, z in enumerate([53, 24, 23, 7, 7, 7, 1])], "k string, shard long, z long")
    src = spark.createDataFrame([("s", 122, 1, 122.0, 10_000 * 5)], "k string, source_size long, weight long, target double, total long")
    got = {r.shard: r.quota_blocks for r in mixing.quotas(cells, src, block_words=5).collect()}
    seats = [0] * 7
    z = [53, 24, 23, 7, 7, 7, 1]
    for _ in range(24):  # 122 words in blocks of 5
        i = max(range(7), key=lambda j: (z[j] / (2 * seats[j] + 1), -j))
        seats[i] += 1
    assert [got[i] for i in range(7)] == seats


def test_materialised_mix(spark, corpus):
    m = mixing.mix_sources(corpus)
    want = {(r.doc_id, r["size"]): r.taken for r in m.select("row.doc_id", "size", "taken").collect()}
    out = mixing.materialise(m, corpus)
    assert out.columns == corpus.columns and dict(out.dtypes) == dict(corpus.dtypes)
    rows = out.collect()
    assert sum(len(WORD.findall(r.text)) for r in rows) == m.agg(F.sum("taken")).first()[0]
    assert all(r.n_chars == len(r.text) for r in rows) and any(v for v in want.values())
    assert mixing.materialise(mixing.mix_sources(corpus.filter("false")), corpus).count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().executedPlan().toString())
    more = mixing.mix_sources(corpus, shard_rows=1)  # a shard for each row
    assert more.agg(F.sum("taken")).first()[0] == sum(want.values()) or more.count() == corpus.count()


def test_pack_round_trip(spark, corpus, pairs_of):
    tok = fresh_tokenizer()
    pieces = packing.packed(corpus, window=64, step=4).collect()
    by_seq, by_doc = {}, {}
    for p in pieces:
        assert 0 < p.length <= 64 and len(p.ids) == 4 * p.length and zlib.crc32(p.ids) == p.ids_crc32
        by_seq.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append((p.start, bytes(p.ids)))
    for s in by_seq.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 64
    assert sorted(by_seq) == list(range(len(by_seq)))
    assert sum(p.length for p in pieces) > 0.93 * 64 * len(by_seq)
    want = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for _, t in pairs_of)
    got = sorted(b"".join(x for _, x in sorted(v)) for (d, _), v in by_doc.items() if d not in (3, None))
    rest = sorted(np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for d, t in pairs_of if d not in (3, None))
    assert got == rest and sum(map(len, want)) == sum(4 * p.length for p in pieces)
    assert packing.packed(corpus.filter("false")).count() == 0


def fresh_tokenizer(name="word_bpe_49k.json"):
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(name))


def test_encoder_equals_tokenizer_on_odd_texts():
    e, tok = packing.Encoder.of("word_bpe_49k.json"), fresh_tokenizer()
    assert e.by_word
    odd = ["<|endoftext|> it's don't We'll ÀÉÎ straße ŁÓDŹ İstanbul DENİZİ. İ! ΟΔΟΣ 12345 a1b2 \t x\x1cy z  \r\n foo.,!? bar's, é É. ª º µm ﬁ 漢字 😀!! |x| $5 'tis K", "", " ", "\n\n", "a." * 300, "É" * 50, "a<|endoftext|>b<|startoftext|>", "<|endoftext |> <|ENDOFTEXT|>", "e\u0301. e \u0301", "\ufb01! ǆ? Ǆ;"]
    r = random.Random(4)
    letters = [chr(c) for c in range(1, 0x300)] + list("\u0301\u0307Σςİıŉǰßﬀẞ') .,!?|<>") + ["<|endoftext|>"]
    odd += ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(3000)]
    odd += [w for c in range(1, 0x300) for t in e.TAIL for w in (chr(c) + t, "a" + chr(c) + t, chr(c) + "z" + t + t)]
    want = [np.array(x.ids, dtype="<u4").tobytes() for x in tok.encode_batch(odd, add_special_tokens=False)]
    assert [t for t, a, b in zip(odd, e.batch(odd), want) if a != b] == []


def test_other_tokenizers_get_whole_texts():
    e, tok = packing.Encoder.of("byte_bpe_50k.json"), fresh_tokenizer("byte_bpe_50k.json")
    assert not e.by_word
    for t in ("Two  words\n\nand. more", "", "<|endoftext|>"):
        assert e.batch([t]) == [np.array(tok.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes()]


def test_plan_uses_every_piece_and_fits():
    rng = np.random.default_rng(0)
    for lengths in (rng.integers(1, 17, 500), np.full(100, 9), np.array([16, 1]), np.array([], dtype=int)):
        hist = {int(b): int(n) for b, n in zip(*np.unique(lengths, return_counts=True))}
        got = {}
        for c, n in packing.plan(hist, window=64, step=4):
            assert sum(c) <= 16 and n > 0
            for b in c:
                got[b] = got.get(b, 0) + n
        assert got == hist
    x = packing.nnls(np.array([[1.0, 1.0], [0.0, 1.0]]), np.array([1.0, 2.0]))
    assert np.allclose(x, [0, 1.5], atol=1e-6)


def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "packing"]
    kept = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert kept.columns == docs.columns and kept.exceptAll(docs).count() == 0
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id", "offset", "ids"} <= set(out.columns)
