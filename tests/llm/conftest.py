import random

import pytest


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    syl = "an er in th on re ed or ti st ou ha".split()
    return ["".join(r.choices(syl, k=r.randint(1, 4))) for _ in range(3000)]


@pytest.fixture(scope="session")
def corpus(spark, words):
    """(doc_id, text, lang, source, n_chars): copies, near copies, shared passages, empty, null, long."""
    r = random.Random(7)
    passage = " ".join(r.choices(words, k=110))
    rows, n = [], 0

    def put(text, doc_id=-1, source="s0"):
        nonlocal n
        rows.append((n if doc_id == -1 else doc_id, text, r.choice(["en", "de", None]), source, None if text is None else len(text)))
        n += 1

    base = " ".join(r.choices(words, k=300))
    for k in range(40):
        put(" ".join(r.choices(words, k=r.randint(3, 250))), source=f"s{k % 4}" if k % 5 else None)
    for _ in range(6):
        put(base)
    for edits in (1, 2, 4, 8, 16, 30, 60):
        w = base.split(" ")
        for i in r.sample(range(len(w)), edits):
            w[i] = r.choice(words)
        put(" ".join(w))
    for k in range(8):
        put(" ".join(r.choices(words, k=40)) + "\n" + passage + "\n" + " ".join(r.choices(words, k=k)))
    put(None)
    put("")
    put(" \t\n ")
    put("one two three four")
    put("ONE two three four")
    put("Here. " * 400)
    put(" ".join(r.choices(words, k=9000)))
    put("é" * 700 + " ñ")
    put("repeated id", doc_id=3)
    put("repeated id", doc_id=3)
    put("no id at all " * 60, doc_id=None)
    put("no id at all " * 60, doc_id=None)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


@pytest.fixture(scope="session")
def pairs_of(corpus):
    return [(r.doc_id, r.text) for r in corpus.select("doc_id", "text").collect()]
