"""Packing token sequences into fixed windows by non-negative least squares.

Documents are encoded to ids and cut into pieces of at most ``window`` ids; full windows stand
alone. What is left over is planned on a histogram of lengths (rounded up to ``step``), whose size
depends on the window only:

1. enumerate combinations of up to ``depth`` lengths that fill a window;
2. solve min ||A x - h||, x >= 0, for how often to use each (active set method, so at most one
   combination per histogram row is in use);
3. round the counts down to what the histogram still has;
4. pack the residual greedily, largest first, whole patterns at a time.

Each pattern claims a range of ranks of each of its lengths, so a piece finds its sequence from its
rank among the pieces of its length. Ranks are dealt in salted groups, so that one length holding a
third of all pieces is still ranked in parallel.

Defined results: null text counts as empty and gives the one end id; repeated rows are packed
separately; an empty table gives an empty result; texts of any length are encoded whole.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.llm import scratch

WINDOW = 2048
STEP = 8
DEPTH = 3
END_ID = 1
RANK_ROWS = 100_000
WORDS_KEPT = 200_000


# ---- encoding ----------------------------------------------------------------------------------


class Words(dict):
    """Word to the bytes of its ids, made when first asked for; an older generation is looked up."""

    def __init__(self, make, older: dict[str, bytes]):
        super().__init__({"": b""})
        self.make, self.older = make, older

    def __missing__(self, w: str) -> bytes:
        got = self.older.get(w)
        self[w] = got = self.make(w) if got is None else got
        return got


#: How the fast path needs a tokenizer to normalise and to split (fixed values of the file).
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, word by word through a bounded cache.

    Words are cut at plain spaces and line feeds, where the tokenizer's own splitting always cuts
    and drops the separator. Words of Latin-1 letters, with plain punctuation behind, skip the
    normaliser, which can only lower them, and go to the merge model at once; anything else is left
    to the whole tokenizer. A tokenizer with other rules gets whole texts.
    """

    _open: dict[str, Encoder] = {}
    TAIL = ".,!?;:%&*#$|"

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        self.tok = Tokenizer.from_file(path)
        self.by_word = self._known(path)
        self.merge = self.tok.model.tokenize
        # bytes that are no printable Latin-1 characters stand in a byte-level vocabulary as 256, 257, ...
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        rest = iter(range(256, 512))
        self.byte_level = {b: b if b in plain else next(rest) for b in range(256)}
        self.fresh = Words(self.word, {})

    @classmethod
    def _known(cls, path: str) -> bool:
        """Whether the file's rules are those that the word-wise path stands for."""
        import json

        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        added = [t for t in rules["added_tokens"] if t["lstrip"] or t["rstrip"] or t["normalized"] or t["content"].strip(cls.TAIL).isalpha() or any(c.isspace() for c in t["content"])]
        return rules["normalizer"] == NORMALIZER and rules["pre_tokenizer"] == SPLITTER and rules["model"]["type"] == "BPE" and not added

    @classmethod
    def of(cls, name: str) -> Encoder:
        if name not in cls._open:
            cls._open[name] = cls(name)
        return cls._open[name]

    def whole(self, text: str) -> bytes:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def word(self, w: str) -> bytes:
        core = w.rstrip(self.TAIL)
        if not core.isalpha() or max(core) >= "\u0100":  # further letters may fall apart when lowered
            return self.whole(w)
        if core == w:
            return self.letters(w)
        ids, tail = self.fresh.get(core), self.fresh.get(w[len(core) :])
        if ids is None:
            ids = self.fresh[core] = self.letters(core)
        if tail is None:
            tail = self.fresh[w[len(core) :]] = self.whole(w[len(core) :])
        return ids + tail

    def letters(self, core: str) -> bytes:
        low = core.lower()
        if not low.isascii():
            low = low.encode().decode("latin-1").translate(self.byte_level)
        return array("I", [t.id for t in self.merge(low)]).tobytes()

    def batch(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return [self.whole(t) for t in texts]
        if len(self.fresh) > WORDS_KEPT:
            self.fresh.older = {}  # two generations at most
            self.fresh = Words(self.word, self.fresh)
        get = self.fresh.__getitem__
        return [b"".join(map(get, t.replace("\n", " ").split(" "))) for t in texts]


def _encode(name: str, window: int, end_id: int, by_chars: int = 1_000_000):
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder.of(name)
        for batch in batches:
            at = 0
            texts = [t or "" for t in batch.column(1).to_pylist()]
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to]) <= by_chars):
                    chars += len(texts[to])
                    to += 1
                owner, start, size, total, ids = [], [], [], [], []
                for i, got in enumerate(enc.batch(texts[at:to])):
                    got += end
                    n = len(got) // 4
                    for lo in range(0, n, window):
                        part = got[4 * lo : 4 * (lo + window)]
                        owner.append(at + i)
                        start.append(lo)
                        size.append(len(part) // 4)
                        total.append(n)
                        ids.append(part)
                rows = batch.column(0).take(pa.array(owner, pa.int64()))
                yield pa.RecordBatch.from_arrays([rows, pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "ids"])
                at = to

    return run


def encode_pieces(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids): pieces of at most ``window`` ids of each document."""
    scratch.ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scratch.trimmed(_encode(tokenizer, window, end_id)), f"doc_id {kind}, start long, length long, doc_tokens long, ids binary")


# ---- planning ----------------------------------------------------------------------------------


def combinations(bins: int, depth: int) -> list[tuple[int, ...]]:
    """Descending tuples of 1 to ``depth`` bin numbers that sum to ``bins`` (a full window)."""
    out = []

    def grow(head: tuple[int, ...], left: int) -> None:
        if left == 0:
            out.append(head)
        elif len(head) < depth:
            for b in range(min(left, head[-1] if head else left), 0, -1):
                if b * (depth - len(head)) >= left:
                    grow((*head, b), left - b)

    grow((), bins)
    return out


def nnls(a: np.ndarray, h: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Non-negative least squares by the active set method of Lawson and Hanson."""
    rows, cols = a.shape
    x = np.zeros(cols)
    used: list[int] = []
    gram_tol = 1e-9 * max(1.0, np.abs(a.T @ h).max(initial=0))
    for _ in range(rounds or 3 * rows):
        w = a.T @ (h - a @ x)
        if used:
            w[used] = -np.inf
        j = int(np.argmax(w))
        if not w[j] > gram_tol:
            break
        used.append(j)
        while used:
            part = a[:, used]
            s = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(used)), part.T @ h)
            if (s > 1e-12).all():
                x[:] = 0
                x[used] = s
                break
            old = x[used]
            low = s <= 1e-12
            with np.errstate(divide="ignore", invalid="ignore"):
                move = np.where(low & (old - s > 0), old / (old - s), np.inf)
            step = min(1.0, move.min())
            x[used] = old + step * (s - old)
            keep = [c for c in used if x[c] > 1e-12 and not (c == j and step == 0)]
            for c in set(used) - set(keep):
                x[c] = 0
            used = keep
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(bin numbers, how many sequences) for pieces counted by bin = ceil(length / step)."""
    bins = window // step
    left = np.zeros(bins + 1, dtype=np.int64)
    for b, n in histogram.items():
        left[b] += n
    out: list[tuple[tuple[int, ...], int]] = []
    if left[bins]:
        out.append(((bins,), int(left[bins])))
        left[bins] = 0
    have = set(np.flatnonzero(left).tolist())
    if have:
        combos = [c for c in combinations(bins, depth) if have.issuperset(c)]
        if combos:
            rows = {b: i for i, b in enumerate(sorted(have))}
            a = np.zeros((len(rows), len(combos)))
            for j, c in enumerate(combos):
                for b in c:
                    a[rows[b], j] += 1
            x = nnls(a, left[sorted(have)].astype(float))
            for j in np.argsort(-x, kind="stable"):
                if x[j] < 1:
                    break
                c = combos[j]
                n = min(int(x[j]), *(int(left[b]) // c.count(b) for b in set(c)))
                if n > 0:
                    for b in c:
                        left[b] -= n
                    out.append((c, n))
    while left.any():  # greedy: the largest length first, then the largest that still fits
        spare, c = bins, []
        now = left.copy()
        while spare > 0:
            fit = np.flatnonzero(now[: spare + 1])
            if not len(fit):
                break
            b = int(fit[-1])
            take = min(int(now[b]), spare // b)
            c += [b] * take
            now[b] -= take
            spare -= b * take
        n = min(int(left[b]) // c.count(b) for b in set(c))
        for b in set(c):
            left[b] -= n * c.count(b)
        out.append((tuple(c), n))
    return out


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, ranks, first sequence, place in it) for every length of every pattern."""
    at: dict[int, int] = {}
    seq, out = 0, []
    for c, n in patterns:
        for place, b in enumerate(c):
            lo = at.get(b, 0)
            out.append((b, lo, n, seq, place))
            at[b] = lo + n
        seq += n
    return out


def assign(pieces: DataFrame, *, keys: tuple[str, ...] = ("doc_id", "start"), length: str = "length", window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (lengths 1 to ``window``)."""
    spark = pieces.sparkSession
    p = pieces.withColumn("_bin", F.expr(f"cast(({length} + {step - 1}) div {step} as int)"))
    counts = {r["_bin"]: r["n"] for r in p.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")).collect()}
    salts = max(16, -(-sum(counts.values()) // RANK_ROWS))
    p = p.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int"))
    cell = p.groupBy("_bin", "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy("_bin").orderBy("_salt").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")
    cell = cell.select("_bin", "_salt", before.alias("_base"))
    p = p.withColumn("_r", F.row_number().over(W.partitionBy("_bin", "_salt").orderBy(*keys, length)))
    p = p.join(cell, ["_bin", "_salt"]).withColumn("_rank", F.col("_base") + F.col("_r") - 1)
    rows = slots(plan(counts, window, step, depth))
    table = pa.table([pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 5, names=["_bin", "_lo", "_len", "_seq", "_place"])
    s = spark.createDataFrame(table).withColumn("_bin", F.col("_bin").cast("int"))
    s = s.groupBy("_bin").agg(F.array_sort(F.collect_list(F.struct("_lo", "_len", "_seq", "_place"))).alias("_slots"))
    p = p.join(F.broadcast(s), "_bin")  # its size depends on window / step only
    mine: Column = F.filter("_slots", lambda x: (x["_lo"] <= F.col("_rank")) & (F.col("_rank") < x["_lo"] + x["_len"]))[0]
    p = p.withColumn("_slot", mine).withColumn("sequence_id", F.col("_slot._seq") + F.col("_rank") - F.col("_slot._lo"))
    inside = W.partitionBy("sequence_id").orderBy("_slot._place").rowsBetween(W.unboundedPreceding, 0)
    p = p.withColumn("offset", (F.sum(length).over(inside) - F.col(length)).cast("long"))
    return p.drop("_bin", "_salt", "_base", "_r", "_rank", "_slots", "_slot")


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, step: int = STEP, depth: int = DEPTH) -> tuple[DataFrame, DataFrame]:
    """(pieces, placement), both by ``piece``: the pieces hold ``ids`` (little-endian uint32), the
    placement has sequence_id and offset, and the pieces' other columns but the ids."""
    work = scratch.Scratch(docs.sparkSession, "packing")
    pieces = encode_pieces(docs, id_col=id_col, text_col=text_col, window=window)
    pieces = work.save(pieces.withColumns({"ids_crc32": F.crc32("ids"), "piece": F.monotonically_increasing_id()}), "pieces")
    place = assign(pieces.drop("ids"), keys=("doc_id", "start", "ids_crc32", "piece"), window=window, step=step, depth=depth)
    return pieces, place


def packed(docs: DataFrame, **options) -> DataFrame:
    """The pieces with their ids and places: doc_id, start, length, doc_tokens, sequence_id, offset, ids."""
    pieces, place = pack(docs, **options)
    out = place.join(pieces.select("piece", "ids"), "piece")
    return out.select("doc_id", "start", "length", "doc_tokens", "ids_crc32", "sequence_id", "offset", "ids")


def op4_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    _, place = pack(docs)
    return place.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
