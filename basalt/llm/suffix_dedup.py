"""Exact substring deduplication with logarithmic families of suffix arrays.

A byte is removed if a string of ``length`` bytes around it starts at least twice in the corpus.

1. Scan. Suffixes are grouped by content so that equal strings meet: the anchor of a window (the
   shortest length asked for) is the ``GRAM``-byte string with the least fingerprint in it, and
   neighbouring windows with one anchor form a run. Equal windows have equal anchors, so only runs
   with an anchor met twice go on. The context of a run is its text to the end of the longest match
   asked for behind its last window. Contexts that are equal as wholes are counted, not gathered:
   all their windows are repeated, and one of them stands for them below.
2. Match. The other contexts go to tasks by anchor. There each batch gets a suffix array
   (:class:`SuffixFamily`: the suffixes of its windows, cut at the longest length, ordered by their
   bytes), is merge-scanned against every level of the family, the common prefixes of neighbours
   giving the longest match of every suffix, and becomes a level; levels of about equal size merge
   geometrically.
3. Anchors with more than ``HOT`` distinct contexts (a passage in many documents) would make one
   task hold them all; their windows are matched by a plain aggregation instead, on 128 bits.

One pass serves several lengths, since a match of the longest is one of the shortest. Joins on
anchors spread frequent ones over salts. The text is shuffled once, and rows that are cut in part a
second time.

Defined results: null text is empty; texts shorter than ``length`` keep everything; repeated rows
count as other places, so both lose what they share; one row per input row, null ids included.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.llm import scratch
from basalt.llm.skew import spread_join

LENGTH = 400
#: A passage: over fifty words, found by strings that fifty words of three letters fill.
PASSAGE_BYTES = 200
PASSAGE_WORDS = 51
GRAM = 40
HOT = 1024
CHUNK = 1 << 20
SLICE_BYTES = 400_000
#: Texts of a batch of the family: fewer batches mean fewer levels to match and merge.
BATCH_BYTES = 800_000
TASK_BYTES = 1_000_000
#: Contexts of a family: the next anchor starts another one.
FAMILY_BYTES = 400_000
LONG_RUN = 1000
#: Pairs of suffixes compared at a time: their bytes stay in a core's cache.
MATCH_ROWS = 512

_U = np.uint64


def _table(seed: int) -> np.ndarray:
    """256 odd 64-bit numbers by a mixing rule."""
    x = (np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15)) + _U(seed)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> _U(shift))) * _U(mul)
    return (x ^ (x >> _U(31))) | _U(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


class Rolling:
    """Polynomial fingerprints modulo 2**64 of any substring, from prefix sums."""

    def __init__(self, base: int, seed: int):
        self.base, self.inverse, self.table = base, pow(base, -1, 1 << 64), _table(seed)
        self.up = self.down = np.ones(1, dtype=_U)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(n + 1, min(2 * len(self.up), CHUNK + 2 * LENGTH))
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, dtype=_U)
                x[0] = 1
                setattr(self, name, np.cumprod(x, dtype=_U))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        out = np.zeros(len(data) + 1, dtype=_U)
        np.cumsum(self.table[data] * self.down[: len(data)], dtype=_U, out=out[1:])
        return out

    def of(self, prefix: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return _mix((prefix[hi] - prefix[lo]) * self.up[lo])


@functools.cache
def _hashes() -> tuple[Rolling, Rolling]:
    """The two fingerprints of this process: a worker keeps their powers, which a chunk bounds, for its next task."""
    return Rolling(0x9E3779B97F4A7C15, 1), Rolling(0xC2B2AE3D27D4EB4F, 2)


def runs(raw: bytes, one: Rolling, two: Rolling, least: int = LENGTH, cut: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """(anchor, first start, last start, fingerprint, fingerprint, times) of the runs of windows of
    ``least`` bytes; the 128-bit fingerprint is of the context, which reaches ``cut`` bytes behind
    the last start or to the end of the text; times is 2 where the anchor repeats inside the run, so
    that windows of it may be equal."""
    out: list[list[np.ndarray]] = [[], [], [], [], [], []]
    w = least - gram + 1
    for base in range(0, len(raw) - least + 1, CHUNK):
        b = np.frombuffer(raw[base : base + CHUNK + cut - 1], dtype=np.uint8)
        p, q = one.prefix(b), two.prefix(b)
        count = min(CHUNK, len(raw) - least + 1 - base)
        grams = count + least - gram
        g = _mix((p[gram : gram + grams] - p[:grams]) * one.up[:grams])
        span = 1
        m = g
        while 2 * span <= w:
            m = np.minimum(m[:-span], m[span:])
            span *= 2
        if span < w:
            m = np.minimum(m[: len(m) - (w - span)], m[w - span :])
        change = m[1:] != m[:-1]
        at = np.flatnonzero(change) + 1
        s = np.concatenate([[0], at])
        e = np.concatenate([at, [len(m)]]) - 1
        # the anchor leaves the window and an equal one follows: the run may repeat itself
        passed = np.concatenate([[0], np.cumsum(~change & (g[: len(m) - 1] == m[:-1]))])
        times = 1 + (passed[e] > passed[s])
        stop = np.minimum(e + cut, len(b))
        h1, h2 = one.of(p, s, stop), two.of(q, s, stop)
        for k in np.flatnonzero(stop - s > LONG_RUN):  # polynomials modulo 2**64 are only good for short strings
            wide = xxhash.xxh3_128_intdigest(b[s[k] : stop[k]].tobytes())
            h1[k], h2[k] = wide >> 64, wide & 0xFFFFFFFFFFFFFFFF
        for k, x in enumerate((m[s], s + base, e + base, h1, h2, times)):
            out[k].append(x.astype(_U).view(np.int64) if k in (0, 3, 4) else x.astype(np.int64))
    return [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in out]


RUN = "array<struct<anchor:bigint,s:bigint,e:bigint,h1:bigint,h2:bigint,times:bigint>>"
_RUN = pa.struct([(n, pa.int64()) for n in ("anchor", "s", "e", "h1", "h2", "times")])


def _scan(least: int, cut: int, gram: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sha, size, words, cols, ends = [], [], [], [[] for _ in range(6)], [0]
                for x in part.column(1):
                    raw = x.as_py() or b""
                    sha.append(hashlib.sha256(raw).hexdigest())
                    size.append(len(raw))
                    words.append(len(raw.split()))
                    got = runs(raw, one, two, least, cut, gram)
                    for c, g in zip(cols, got, strict=True):
                        c.append(g)
                    ends.append(ends[-1] + len(got[0]))
                flat = pa.StructArray.from_arrays([pa.array(np.concatenate(c)) for c in cols], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sha), pa.array(size, pa.int64()), pa.array(words, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)],
                    ["doc_id", "sha", "n_bytes", "n_words", "runs"],
                )

    return scratch.trimmed(work)


class SuffixFamily:
    """Levels of suffix arrays: suffixes cut at ``cut`` bytes, ordered by their bytes.

    ``longest[i]`` is the longest match (up to ``cut``) of the i-th suffix with any other one added
    before or after. Of suffixes that are equal to the cut, told by 128-bit fingerprints, one is
    indexed: near copies share most of theirs, and comparing equal bytes is what sorting costs. A
    suffix is held as its bytes plus one, padded with zeros, so that numpy's order of byte strings is
    the order of the texts (UTF-8 has no byte 255).
    """

    def __init__(self, cut: int = LENGTH):
        self.cut, self.width = cut, -(-cut // 8) * 8
        self.one, self.two = _hashes()
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # (suffixes in order, references)
        self.longest = self.size = np.zeros(0, dtype=np.int32)
        self.prints: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # of each level, ordered: (h1, h2, references)
        self.batches: list[slice] = []

    def _match(self, x: np.ndarray, y: np.ndarray, at: tuple[np.ndarray, np.ndarray]) -> None:
        """Note the common prefixes of pairs of suffixes (x and y, at these references)."""
        for lo in range(0, len(x), MATCH_ROWS):
            u, v = (z[lo : lo + MATCH_ROWS].view(np.uint64).reshape(-1, self.width // 8) for z in (x, y))
            word = (u != v).argmax(axis=1)
            row = np.arange(len(u))
            bits = u[row, word] ^ v[row, word]
            low = np.log2((bits & (~bits + _U(1))).astype(np.float64), where=bits != 0, out=np.full(len(u), 8.0 * self.width))
            r, t = (z[lo : lo + MATCH_ROWS] for z in at)
            common = np.minimum(8 * word + (low // 8).astype(np.int64), np.minimum(self.size[r], self.size[t])).astype(np.int32)
            np.maximum.at(self.longest, r, common)
            np.maximum.at(self.longest, t, common)

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        """Two ordered tables (the first column leads) as one."""
        at = np.searchsorted(a[0], b[0], side="right") + np.arange(len(b[0]))
        old = np.ones(len(a[0]) + len(b[0]), dtype=bool)
        old[at] = False
        out = []
        for x, y in zip(a, b, strict=True):
            z = np.empty(len(old), dtype=x.dtype)
            z[at], z[old] = y, x
            out.append(z)
        return tuple(out)

    def add(self, texts: list[bytes], counts: np.ndarray) -> None:
        """Index the first ``counts[i]`` suffixes of each text as a new batch."""
        size = np.array([len(t) for t in texts], dtype=np.int64)
        data = np.frombuffer((b"\xff" * self.width).join([*texts, b""]), dtype=np.uint8)
        first = np.cumsum(size + self.width) - (size + self.width)
        at = np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        length = np.minimum(np.repeat(first + size, counts) - at, self.cut)
        h1, h2 = (r.of(r.prefix(data), at, at + length) for r in (self.one, self.two))
        base = len(self.longest)
        self.batches.append(slice(base, base + len(at)))
        self.size = np.concatenate([self.size, length.astype(np.int32)])
        self.longest = np.concatenate([self.longest, np.zeros(len(at), dtype=np.int32)])
        # equal suffixes of the batch, then those that a level has
        order = np.argsort(h1)
        same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
        for x in (order[1:][same], order[:-1][same]):
            self.longest[base + x] = length[x]
        order = order[np.concatenate([[True], ~same])] if len(order) else order
        for p1, p2, refs in self.prints:
            to = np.minimum(np.searchsorted(p1, h1[order]), len(p1) - 1)
            hit = (p1[to] == h1[order]) & (p2[to] == h2[order])
            self.longest[base + order[hit]] = self.longest[refs[to[hit]]] = length[order[hit]]
            order = order[~hit]
        if not len(order):
            return
        prints = h1[order], h2[order], base + order
        every = np.ndarray(len(data) - self.width + 1, dtype=f"V{self.width}", buffer=data + np.uint8(1), strides=(1,))  # overlapping
        keys = every[at[order]].view(f"S{self.width}")
        by = np.argsort(keys, kind="stable")
        keys, refs = keys[by], base + order[by]
        self._match(keys[1:], keys[:-1], (refs[1:], refs[:-1]))
        for old, names in self.levels:  # a new suffix's neighbours; an old one's nearest is its neighbour or an old one
            to = np.searchsorted(old, keys)
            for side, ok in ((to - 1, to > 0), (to, to < len(old))):
                self._match(keys[ok], old[side[ok]], (refs[ok], names[side[ok]]))
        array = keys, refs
        while self.levels and len(self.levels[-1][0]) <= 2 * len(array[0]):
            array = self._merged(self.levels.pop(), array)
            prints = self._merged(self.prints.pop(), prints)
        self.levels.append(array)
        self.prints.append(prints)


def _intervals(mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last positions of the stretches of True."""
    d = np.diff(np.concatenate([[0], mark.astype(np.int8), [0]]))
    return np.flatnonzero(d == 1), np.flatnonzero(d == -1) - 1


def _parts(batch: pa.RecordBatch, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of contexts (rid, s, e, n, text) whose texts have about ``most`` bytes, one
    row at least: a window takes many times the memory of the byte it starts at."""
    size = [len(x.as_py()) for x in batch.column(4)]
    at = total = 0
    for i, n in enumerate(size):
        if i > at and total + int(n) > most:
            yield batch.slice(at, i - at)
            at, total = i, 0
        total += int(n)
    if at < batch.num_rows:
        yield batch.slice(at)


START = "rid long, len long, lo long, hi long"


def _settle(lengths: tuple[int, ...], cut: int):
    """Tasks over contexts in order of their anchors (the last column) to repeated starts (rid, len, lo,
    hi). Equal windows have equal anchors, so a family ends with an anchor once it is large enough."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, owners, held, last = SuffixFamily(cut), [], 0, None
        for batch in batches:
            for part in _parts(batch, BATCH_BYTES):
                anchor = part.column(5).to_numpy()
                same = np.argmax(np.append(anchor != last, True)) if held >= FAMILY_BYTES else len(anchor)
                for rows in (part.slice(0, same), part.slice(same)):
                    if not rows.num_rows:
                        continue
                    if held >= FAMILY_BYTES and rows.column(5)[0].as_py() != last:
                        yield from repeated(family, owners)
                        family, owners, held = SuffixFamily(cut), [], 0
                    own = np.column_stack([rows.column(i).to_numpy() for i in range(4)])
                    texts = [x.as_py() for x in rows.column(4)]
                    family.add(texts, own[:, 2] - own[:, 1] + 1)
                    owners.append(own)
                    held, last = held + sum(map(len, texts)), rows.column(5)[rows.num_rows - 1].as_py()
        yield from repeated(family, owners)

    def repeated(family: SuffixFamily, owners: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        for own, at in zip(owners, family.batches, strict=True):
            longest = family.longest[at]
            count = own[:, 2] - own[:, 1] + 1
            first = np.cumsum(count) - count
            row = np.repeat(np.arange(len(own)), count)
            single = own[row, 3] == 1  # others are repeated as wholes
            for length in lengths:
                a, b = _intervals((longest >= length) & single)
                cuts = [(x, y) for lo, hi in zip(a.tolist(), b.tolist(), strict=True) for x, y in _split(lo, hi, first + count)]
                if cuts:
                    lo, hi = np.array(cuts).T
                    r = row[lo]
                    move = own[r, 1] - first[r]
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (own[r, 0], np.full(len(r), length), lo + move, hi + move)], ["rid", "len", "lo", "hi"])

    return scratch.trimmed(work)


WINDOW = "h1 long, h2 long, rid long, len long, lo long, hi long, n long"


def _split(lo: int, hi: int, ends: np.ndarray) -> Iterator[tuple[int, int]]:
    """[lo, hi] cut where texts end (``ends`` exclusive)."""
    for e in ends[np.searchsorted(ends, lo, side="right") : np.searchsorted(ends, hi, side="right")]:
        if e > lo:  # a text may have no window
            yield lo, int(e) - 1
            lo = int(e)
    yield lo, hi


def _windows(lengths: tuple[int, ...]):
    """The distinct windows of a batch of contexts, with lo = hi; windows that a batch holds twice
    also come as stretches without fingerprints."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _hashes()
        for batch in batches:
            for part in _parts(batch):
                texts = [x.as_py() for x in part.column(4)]
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                size = np.array([len(t) for t in texts], dtype=np.int64)
                first = np.cumsum(size) - size
                p, q = one.prefix(data), two.prefix(data)
                cols = [part.column(i).to_numpy() for i in range(4)]
                for length in lengths:
                    k = np.clip(np.minimum(cols[2] - cols[1] + 1, size - length + 1), 0, None)
                    inside = np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                    at = np.repeat(first, k) + inside
                    h1, h2 = one.of(p, at, at + length), two.of(q, at, at + length)
                    rid, s, n = (np.repeat(cols[i], k) for i in (0, 1, 3))
                    pos = s + inside
                    order = np.lexsort((h2, h1))
                    same = (h1[order[1:]] == h1[order[:-1]]) & (h2[order[1:]] == h2[order[:-1]])
                    mark = np.zeros(len(pos), dtype=bool)
                    mark[order[1:][same]] = True
                    mark[order[:-1][same]] = True
                    keep = order[np.concatenate([[True], ~same])] if len(order) else order
                    at_p = pa.array(pos[keep])
                    times = np.where(mark[keep], np.maximum(n[keep], 2), n[keep])
                    yield _named([pa.array(h1.view(np.int64)[keep]), pa.array(h2.view(np.int64)[keep]), pa.array(rid[keep]), pa.array(np.full(len(keep), length)), at_p, at_p, pa.array(times)])
                    lo, hi = _intervals(mark)
                    cuts = [(a, b) for x, y in zip(lo.tolist(), hi.tolist(), strict=True) for a, b in _split(x, y, np.cumsum(k))]
                    if cuts:
                        a, b = np.array(cuts).T
                        none = pa.nulls(len(a), pa.int64())
                        yield _named([none, none, pa.array(rid[a]), pa.array(np.full(len(a), length)), pa.array(pos[a]), pa.array(pos[b]), pa.array(np.full(len(a), 2))])

    return scratch.trimmed(work)


def _named(cols: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(cols, ["h1", "h2", "rid", "len", "lo", "hi", "n"])


def covered(starts: list, length: int, size: int) -> list[list[int]]:
    """Maximal [start, stop) stretches of bytes under windows of ``length``; starts are (len, lo, hi),
    those of len 0 being repeated at any length."""
    spans: list[list[int]] = []
    for lo, hi in sorted((lo, min(hi, size - length) + length) for n, lo, hi in starts if n in (0, length)):
        if hi - lo < length:
            continue
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    return spans


def cut_out(raw: bytes, spans: list[list[int]]) -> bytes:
    left, at = [], 0
    for lo, hi in spans:
        left.append(raw[at:lo])
        at = hi
    return b"".join([*left, raw[at:]])


def long_enough(raw: bytes, spans: list[list[int]], min_words: int) -> list[list[int]]:
    """The stretches with at least so many words."""
    return [s for s in spans if len(raw[s[0] : s[1]].split()) >= min_words] if min_words else spans


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
SPANS = "array<struct<start:bigint,stop:bigint>>"


def _cut_spans(lengths: tuple[int, ...], min_words: tuple[int, ...]):
    """(rid, text bytes, repeated starts) to (rid, n_removed, n_spans, kept_sha256, spans, also): the
    stretches of the first length and how many bytes those of the others cover."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, count, sha, lists, also = [], [], [], [], []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                raw = x.as_py() or b""
                starts = [(v["len"], v["lo"], v["hi"]) for v in y.as_py() or []]
                each = [long_enough(raw, covered(starts, n, len(raw)), k) for n, k in zip(lengths, min_words, strict=True)]
                spans = each[0]
                removed.append(sum(h - lo for lo, h in spans))
                count.append(len(spans))
                sha.append(hashlib.sha256(cut_out(raw, spans)).hexdigest())
                lists.append([{"start": lo, "stop": h} for lo, h in spans])
                also.append([sum(h - lo for lo, h in s) for s in each[1:]])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(lists, _SPANS), pa.array(also, pa.list_(pa.int64()))],
                ["rid", "n_removed", "n_spans", "kept_sha256", "spans", "also"],
            )

    return scratch.trimmed(work)


def _cut_texts(length: int, min_words: int):
    """(row, text bytes, repeated starts) to (row, changed, text): what is left of each text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, changed = [], []
            for x, y in zip(batch.column(1), batch.column(2), strict=True):
                raw = x.as_py()
                spans = long_enough(raw, covered([(v["len"], v["lo"], v["hi"]) for v in y.as_py() or []], length, len(raw)), min_words)
                changed.append(bool(spans))
                out.append(cut_out(raw, spans).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(changed, pa.bool_()), pa.array(out, pa.string())], ["row", "changed", "text"])

    return scratch.trimmed(work)


class Repeats:
    """The repeated starts of one table, and the rows that need their text."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, lengths: tuple[int, ...], gram: int, hot: int):
        spark: SparkSession = docs.sparkSession
        scratch.ship(spark)
        self.spark, self.work = spark, scratch.Scratch(spark, "suffix")
        self.lengths, self.least, self.cut, self.hot = lengths, min(lengths), max(lengths), hot
        kind = docs.schema[id_col].dataType.simpleString()
        src = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
        d = src.mapInArrow(_scan(self.least, self.cut, gram), f"doc_id {kind}, sha string, n_bytes long, n_words long, runs {RUN}")
        self.docs = self.work.save(d.withColumn("rid", F.monotonically_increasing_id()), "docs")
        self._status()

    def _status(self) -> None:
        """Runs with a repeated anchor: n contexts are equal to a run's own, ``texts`` is set where
        some context of the anchor is met once."""
        work, d = self.work, self.docs
        entries = d.select("rid", F.explode("runs").alias("r")).select("rid", "r.*")
        again = work.save(entries.groupBy("anchor").agg(F.sum("times").alias("met")).filter("met > 1"), "again")
        flagged = work.save(spread_join(entries.drop("times"), again, ["anchor"], "met").drop("met"), "flagged")
        same = work.save(flagged.groupBy("anchor", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rep")), "same")
        ragged = same.groupBy("anchor").agg(F.count(F.lit(1)).alias("texts"), F.min("n").alias("least"), F.sum("n").alias("met")).filter("least = 1")
        ragged = work.save(ragged.select("anchor", "texts", "met"), "ragged")
        own = spread_join(flagged, same, ["anchor", "h1", "h2"], "n").drop("h1", "h2")
        self.status = work.save(spread_join(own, ragged, ["anchor"], "met", "left").drop("met"), "status")
        for t in (again, same, ragged, flagged):
            work.drop(t)
        self.whole = self.status.filter("n > 1")
        contexts = self.status.filter("texts is not null and (n = 1 or rid = rep)")
        # rows that need their text: not repeated as a whole, or holding a run that others are held against
        each = self.whole.groupBy("rid").agg(F.count(F.lit(1)).alias("done"))
        touched = self.status.select("rid").distinct().join(each, "rid", "left").join(d.select("rid", "doc_id", "sha", "n_words", F.size("runs").alias("n_runs")), "rid")
        open_ = touched.select("rid", "doc_id", "sha", "n_words", (F.coalesce("done", F.lit(0)) < F.col("n_runs")).alias("open"))
        held = contexts.groupBy("rid").agg(F.collect_list(F.struct("anchor", "s", "e", "n", "texts")).alias("held"))
        self.touched = work.save(open_.join(held, "rid", "left"), "touched")

    @staticmethod
    def named(touched: DataFrame) -> DataFrame:
        """One row for each id and text: of repeated rows the least, which stands for all their runs."""
        first = touched.groupBy(_key("doc_id").alias("k"), "sha").agg(F.min_by(F.struct("rid", "open", "held", "n_words"), "rid").alias("x"))
        return first.select("k", "sha", "x.*")

    def starts(self, texts: DataFrame) -> DataFrame:
        """(rid, starts) of the open rows; ``texts`` has rid, text, open and held."""
        run = texts.filter("held is not null").select("rid", "text", F.explode("held").alias("c"))
        context = F.expr(f"substring(text, cast(c.s as int) + 1, cast(c.e - c.s as int) + {self.cut})")
        run = run.select("rid", "c.s", "c.e", "c.n", context.alias("text"), "c.anchor", "c.texts")
        size = texts.filter("held is not null").select(F.explode("held").alias("c")).filter(F.col("c.texts") <= self.hot)
        held = size.agg(F.sum(F.col("c.e") - F.col("c.s") + self.cut)).first()[0] or 0
        tasks = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), held // TASK_BYTES)  # a task holds its suffixes
        names = ["rid", "s", "e", "n", "text"]
        few = run.filter(F.col("texts") <= self.hot).repartition(tasks, "anchor").sortWithinPartitions("anchor").select(*names, "anchor").mapInArrow(_settle(self.lengths, self.cut), START)
        win = self.work.save(run.filter(F.col("texts") > self.hot).select(names).repartition("rid", "s").mapInArrow(_windows(self.lengths), WINDOW), "windows")
        twice = win.filter("h1 is not null").groupBy("h1", "h2").agg(F.sum("n").alias("met")).filter("met > 1")
        many = spread_join(win, twice, ["h1", "h2"], "met").select("rid", "len", "lo", "hi").unionByName(win.filter("h1 is null").select("rid", "len", "lo", "hi"))
        # runs settled by their windows are in rows with an open run; of the others only those rows count
        open_ = self.touched.filter("open").select("rid")
        kept = self.whole.select("rid", F.lit(0).cast("long").alias("len"), F.col("s").alias("lo"), F.col("e").alias("hi")).join(open_, "rid", "left_semi")
        return kept.unionByName(few).unionByName(many).groupBy("rid").agg(F.collect_list(F.struct("len", "lo", "hi")).alias("starts"))


def _key(c: str):
    return F.coalesce(F.col(c).cast("string"), F.lit("-"))


def repeated_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lengths: tuple[int, ...] = (LENGTH,), min_words: tuple[int, ...] | None = None, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (byte ranges
    removed, half open), sha (the digest of its whole text) and also, all for the first length:
    ``also`` has the bytes covered at each further length. Stretches with fewer than ``min_words``
    words of their length (0: any) do not count."""
    min_words = min_words or (0,) * len(lengths)
    r = Repeats(docs, id_col, text_col, lengths, gram, hot)
    src = docs.select(_key(id_col).alias("k"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text")).withColumn("sha", F.sha2("text", 256))
    wanted = r.named(r.touched.filter("open or held is not null"))
    texts = r.work.save(src.join(wanted, ["k", "sha"]).drop("k", "sha", "n_words"), "texts")
    part = texts.filter("open").select("rid", "text").join(r.starts(texts), "rid").select("rid", "text", "starts")
    part = r.work.save(part.mapInArrow(_cut_spans(lengths, min_words), f"rid long, n_removed long, n_spans long, kept_sha256 string, spans {SPANS}, also array<bigint>"), "parts")
    r.work.keep_only(r.docs, r.touched, part)
    gone = r.touched.filter("not open").select("rid", F.lit(True).alias("gone"))
    out = r.docs.drop("runs").join(part, "rid", "left").join(gone, "rid", "left")
    all_of = lambda n, k: F.coalesce("gone", F.lit(False)) & (F.col("n_bytes") >= n) & (F.col("n_words") >= k)
    gone_ = all_of(lengths[0], min_words[0])
    zero = F.lit(0).cast("long")
    further = [F.when(all_of(n, k), F.col("n_bytes")).otherwise(F.coalesce(F.get("also", F.lit(i)), zero)) for i, (n, k) in enumerate(zip(lengths[1:], min_words[1:], strict=True))]
    return out.select(
        "doc_id", "n_bytes", "sha",
        F.when(gone_, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone_, zero + 1).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone_, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone_, F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("stop")))).otherwise(F.coalesce("spans", F.expr(f"cast(array() as {SPANS})"))).alias("spans"),
        F.array(*further).cast("array<bigint>").alias("also"),
    )


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", length: int = PASSAGE_BYTES, min_words: int = PASSAGE_WORDS, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """The same rows and columns with repeated passages cut out of the texts: every occurrence of a
    string of ``length`` bytes that starts twice in the corpus, where the stretch has at least
    ``min_words`` words.

    Cuts are made between bytes; a character that a cut divides goes too. Every row stays, even one
    of which nothing is left; ``chars_col`` follows a changed text.
    """
    r = Repeats(docs, id_col, text_col, (length,), gram, hot)
    info = r.named(r.touched)
    own = docs.select(F.struct("*").alias("row"), _key(id_col).alias("k"), F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256).alias("sha"))
    rows = r.work.save(own.join(info, ["k", "sha"], "left").drop("k", "sha"), "rows")
    text = F.col(f"row.`{text_col}`").cast("binary").alias("text")
    starts = r.work.save(r.starts(rows.filter("open or held is not null").select("rid", text, "open", "held")), "starts")
    r.work.keep_only(rows, starts)
    part = rows.filter("open").select("rid", "row", text).join(starts, "rid", "left")
    kind = rows.schema["row"].dataType.simpleString()
    part = part.select("row", "text", "starts").mapInArrow(_cut_texts(length, min_words), f"row {kind}, changed boolean, text string")
    gone = F.coalesce(~F.col("open") & (F.col("n_words") >= min_words), F.lit(False))
    rest = rows.filter("open is null or not open").select("row", gone.alias("changed"), F.when(gone, F.lit("")).otherwise(F.col(f"row.`{text_col}`")).alias("text"))
    types = dict(docs.dtypes)
    new = [
        F.col("text").alias(c) if c == text_col
        else F.when(F.col("changed"), F.char_length("text")).otherwise(F.col(f"row.`{c}`")).cast(types[c]).alias(c) if c == chars_col
        else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns
    ]
    return part.unionByName(rest).select(*new)


def op7_suffix_dedup(spark, sf_dir):
    """The contract's columns at 400 bytes; n_passage_bytes are those in repeated passages of over 50 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = repeated_spans(docs, lengths=(LENGTH, PASSAGE_BYTES), min_words=(0, PASSAGE_WORDS))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", F.col("also")[0].alias("n_passage_bytes"))
