"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are dealt into ``groups``; a vector's score is the sum of its partial scores.
Queries are taken in blocks of bounded size (``block_rows``), each block against every vector:

1. each task takes the partial scores of the first group, and the few vectors leading its local list
   of a query are completed; the k-th best of all completed scores is a safe cutoff T;
2. T is broadcast with the block. A partial score, with the product of the norms of what is left (an
   upper bound by Cauchy and Schwarz), must reach T: only such entries are collected, and group by
   group fewer of them are left;
3. what survives has its remaining groups resolved exactly; at most k entries per query and task are
   sent, and the best k of those are the answer.

The products of the other groups are computed only for entries that are alive: as a matrix of the
vectors alive for some query of a chunk while that is dense, entry by entry where it is sparse.

Scores are exact integers: in doubles while every sum stays below 2**53, in 64-bit integers below
2**63, else in Python's. A score outside 64 bits cannot be returned and raises an error if it is among
a query's k best. Tasks send at most k rows per query, so a vector repeated in a third of all rows
sends no more than any other.

Defined results: a vector that is null, empty, or holds a null or non-finite component takes no
part, nor does a row with a null id; vectors of another length than the query's are no candidates;
repeated queries (same id and vector) are one query; repeated candidate rows each hold a rank, ties
going to the smaller id; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.llm import scratch

K = 10
SCALE = 1024
GROUPS = 4
BLOCK_ROWS = 8192
CHUNK = 256
SPARSE = 0.05
LONG = 2**63


def _vectors(ids: pa.Array, vecs: pa.Array, scale: float = SCALE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Usable vectors of a batch by their length: (ids, scaled components, whole numbers in doubles)."""
    sizes = np.asarray(vecs.value_lengths().fill_null(0))
    flat = vecs.flatten()
    bad = np.asarray(flat.is_null())
    x = np.asarray(flat.fill_null(0)).astype(np.float64)
    bad = bad | ~np.isfinite(x)
    x = np.floor(np.where(bad, 0, x) * scale)
    ends = np.cumsum(sizes)
    wrong = np.diff(np.concatenate([[0], np.cumsum(bad)])[np.concatenate([[0], ends])]) > 0
    ok = ~wrong & (sizes > 0) & ~np.asarray(ids.is_null())
    keys = np.asarray(ids.fill_null(0)).astype(np.int64)
    out = {}
    for n in np.unique(sizes[ok]):
        rows = np.flatnonzero(ok & (sizes == n))
        out[int(n)] = (keys[rows], x[(ends[rows] - n)[:, None] + np.arange(n)])
    return out


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x).max(initial=0))


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact products of rows whatever their size; Python integers where 64 bits may not do."""
    top = _largest(q) * _largest(c) * q.shape[1]
    if top < 2.0**53:
        return (q @ c.T).astype(np.int64)
    if top < 2.0**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(v) for v in row] for row in m], dtype=object).reshape(m.shape)
    return whole(q) @ whole(c).T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    if score.dtype == object:
        return np.array(sorted(range(len(score)), key=lambda i: (-score[i], ids[i]))[:k], dtype=np.int64)
    if len(score) > 4 * k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        over, tied = np.flatnonzero(score > kth), np.flatnonzero(score == kth)
        tied = tied[np.argsort(ids[tied], kind="stable")[: k - len(over)]]
        pos = np.concatenate([over, tied])
    else:
        pos = np.arange(len(score))
    return pos[np.lexsort((ids[pos], -score[pos]))][:k]


class Chunk:
    """Some queries of one length against some vectors whose scores fit doubles, group by group."""

    def __init__(self, q: np.ndarray, c: np.ndarray, groups: int):
        self.q, self.c = q, c
        m = min(groups, q.shape[1])
        self.parts = [np.arange(g, q.shape[1], m) for g in range(m)]
        self.products = 0  # multiplications of components done

    def rest(self, x: np.ndarray, g: int) -> np.ndarray:
        """Norms over the groups after ``g``, rounded up."""
        left = np.concatenate([[], *self.parts[g + 1 :]]).astype(int)
        return np.sqrt((x[:, left] ** 2).sum(axis=1)) * (1 + 1e-9)

    def partial(self, g: int, rows: slice | np.ndarray = slice(None)) -> np.ndarray:
        p = self.parts[g]
        cols = self.c[rows][:, p]
        self.products += len(self.q) * cols.size
        return self.q[:, p] @ cols.T

    def leading(self, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phase 1: (query, vectors leading its list of the first group, their whole scores)."""
        p = self.partial(0)
        k = min(k, p.shape[1])
        lead = np.argpartition(-p, k - 1, axis=1)[:, :k] if k < p.shape[1] else np.tile(np.arange(k), (len(p), 1))
        self.products += lead.size * self.q.shape[1]
        for i, rows in enumerate(lead):
            yield i, rows, (self.c[rows] @ self.q[i]).astype(np.int64)

    def reaching(self, cutoff: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Phases 2 and 3: (query, vectors that reach its cutoff, their whole scores)."""
        rows = np.arange(len(self.c))
        total = self.partial(0)
        for g in range(1, len(self.parts)):
            bound = self.rest(self.q, g - 1)[:, None] * self.rest(self.c[rows], g - 1)
            live = total + bound + 1 >= cutoff[:, None]
            some = live.any(axis=0)
            if live.sum() < SPARSE * max(1, len(self.q) * some.sum()):
                yield from self._resolve(g, rows, total, live, cutoff)
                return
            rows, total = rows[some], total[:, some]
            total = total + self.partial(g, rows)
        for i in range(len(self.q)):
            ok = np.flatnonzero(total[i] >= cutoff[i])
            yield i, rows[ok], total[i, ok].astype(np.int64)

    def _resolve(self, g: int, rows: np.ndarray, total: np.ndarray, live: np.ndarray, cutoff: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        left = np.concatenate(self.parts[g:])
        for i in range(len(self.q)):
            at = np.flatnonzero(live[i])
            score = total[i, at] + self.c[rows[at]][:, left] @ self.q[i, left]
            self.products += len(at) * len(left)
            ok = score >= cutoff[i]
            yield i, rows[at[ok]], score[ok].astype(np.int64)


def _scan(queries: dict, cutoff: dict[int, int] | None, k: int, groups: int, scale: float) -> Callable:
    """A task over candidate batches. queries: length -> (query numbers, ids, matrix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def offer(qno: int, ids: np.ndarray, score: np.ndarray) -> None:
            if qno in kept:
                ids, score = np.concatenate([kept[qno][0], ids]), np.concatenate([kept[qno][1], score])
            pos = _best(score, ids, k)
            kept[qno] = (ids[pos], score[pos])

        def take(qs: slice, n: int, ids: np.ndarray, found: Iterator) -> None:
            for i, rows, score in found:
                other = ids[rows] != queries[n][1][qs][i]
                if other.any():
                    offer(int(queries[n][0][qs][i]), ids[rows[other]], score[other])

        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                for n, (ids, c) in _vectors(part.column(0), part.column(1), scale).items():
                    if n not in queries:
                        continue
                    for lo in range(0, len(queries[n][0]), CHUNK):
                        qs = slice(lo, lo + CHUNK)
                        q = queries[n][2][qs]
                        small = np.abs(c).max(axis=1) * _largest(q) * n < 2.0**53
                        wide = np.flatnonzero(~small)
                        for w in range(0, len(wide), 64):
                            rows = wide[w : w + 64]
                            take(qs, n, ids, ((i, rows, s) for i, s in enumerate(_exact(q, c[rows]))))
                        if small.any():
                            names, chunk = ids[small], Chunk(q, c[small], groups)
                            if cutoff is None:
                                take(qs, n, names, chunk.leading(k + 1))  # one may be the query itself
                            else:
                                least = np.array([cutoff.get(int(x), -np.inf) for x in queries[n][0][qs]], dtype=np.float64)
                                take(qs, n, names, chunk.reaching(least))
        for qno, (ids, score) in kept.items():
            over = np.array([not -LONG <= int(x) < LONG for x in score])
            fits = [max(-LONG, min(LONG - 1, int(x))) for x in score]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), qno), pa.int64()), pa.array(ids, pa.int64()), pa.array(fits, pa.int64()), pa.array(over, pa.bool_())], ["qno", "vec_id", "score", "over"])

    return run


def top_k(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: float = SCALE, groups: int = GROUPS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of each query row."""
    spark: SparkSession = vectors.sparkSession
    scratch.ship(spark)
    work = scratch.Scratch(spark, "topk")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec"))
    chosen = vectors.filter(is_query).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("vec")).filter("vec_id is not null and vec is not null").distinct()
    chosen = work.save(chosen.withColumn("block", F.monotonically_increasing_id()), "queries")
    n = chosen.count()
    blocks = max(1, -(-n // block_rows))
    found = None
    for b in range(blocks):
        rows = chosen.filter(F.pmod(F.xxhash64("vec_id", "block"), F.lit(blocks)) == b).select("vec_id", "vec").toArrow()
        queries, owner, at = {}, {}, 0
        for part in rows.to_batches():
            for size, (ids, q) in _vectors(part.column(0), part.column(1).cast(pa.list_(pa.float64())), scale).items():
                qnos = np.arange(at, at + len(ids))
                at += len(ids)
                owner.update(zip(qnos.tolist(), ids.tolist(), strict=True))
                old = queries.get(size)
                queries[size] = (qnos, ids, q) if old is None else tuple(np.concatenate(x) for x in zip(old, (qnos, ids, q), strict=True))
        for size, (qnos, ids, q) in queries.items():
            order = np.argsort(np.abs(q).max(axis=1), kind="stable")  # wide ones together
            queries[size] = qnos[order], ids[order], q[order]
        schema = "qno long, vec_id long, score long, over boolean"
        first = v.mapInArrow(_scan(queries, None, max(2, k // 4), groups, scale), schema)
        best = W.partitionBy("qno").orderBy(F.desc("score"), "vec_id")
        cut = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k).select("qno", "score")
        cutoff = {r.qno: r.score for r in cut.collect()}
        sent = v.mapInArrow(_scan(queries, cutoff, k, groups, scale), schema)
        names = spark.createDataFrame(pa.table({"qno": pa.array(list(owner), pa.int64()), "query_id": pa.array(list(owner.values()), pa.int64())}))
        got = sent.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(F.broadcast(names), "qno")
        fits = F.when(F.col("over"), F.raise_error(F.lit("a score among the best does not fit 64 bits"))).otherwise(F.col("score"))
        got = work.save(got.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", fits.alias("score")), f"block{b}")
        found = got if found is None else found.unionByName(got)
    return found


def op2_top_k(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(e, F.col("vec_id") % 100 == 0)


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""
