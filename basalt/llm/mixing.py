"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

DataFrame functions only. A source's target is its weight's share of all words, capped at
``max_repeat`` times what it has, the excess going to the others by weight (water filling, in
closed form over one row per source). The target is divided into blocks of ``block_words`` words; the
blocks go to the source's shards by the highest quotients ``words / (2 seats + 1)``, so each shard
has an integer quota. A shard is a circular stream of its documents in a seeded order; its quota is
taken as whole passes plus one run of blocks starting at a seeded block.

Shards are dealt by a digest of the document id, ``SHARDS`` or one for each ``SHARD_ROWS`` rows of the
table, so a shard of a source that has them all holds about ``SHARD_ROWS`` rows at any size. Rows are
written once with their sizes; the plan is made on ids and sizes, and the rows are joined to it.

Defined results: null or empty text has size 0 and is never taken; a null source is a source of its
own, last in order; repeated rows count separately; an empty table gives an empty result; other
columns stay whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.llm import scratch

WORD = r"[^\x20\x09-\x0D]+"
SEED = "mix-1"
SHARDS = 128
SHARD_ROWS = 250_000
MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 16


def n_words(text: Column) -> Column:
    """Words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hex(text: Column, start: int) -> Column:
    return F.conv(F.substring(text, start, 8), 16, 10).cast("long")


def plan_sources(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(k, size) per source to (k, source_size, weight, target, total). One row per source."""
    every = W.partitionBy()
    six = 1
    for w in weights:
        six *= w
    ordered = sizes.withColumn("_n", F.row_number().over(W.orderBy("k")))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int")).cast("long")
    s = ordered.withColumns({"weight": weight, "_cap": F.col("size") * max_repeat, "total": F.sum("size").over(every)})
    s = s.withColumn("_ratio", F.col("_cap") * F.expr(f"{six} div weight"))
    up = W.orderBy("_ratio", "k")
    s = s.withColumns({
        "_before": F.coalesce(F.sum("_cap").over(up.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "_rest": F.sum("weight").over(up.rowsBetween(0, W.unboundedFollowing)),
    })
    s = s.withColumn("_full", F.col("_cap") * F.col("_rest") < F.col("weight") * (F.col("total") - F.col("_before")))
    open_words = F.col("total") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("_cap"))).over(every), F.lit(0))
    open_weight = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(every)
    target = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise((F.col("weight") * F.col("_open")).cast("double") / F.col("_oweight").cast("double"))
    s = s.withColumns({"_open": open_words, "_oweight": open_weight})
    return s.select("k", F.col("size").alias("source_size"), "weight", target.alias("target"), "total")


def quotas(cells: DataFrame, sources: DataFrame, max_repeat: int = MAX_REPEAT, seed: str = SEED, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Sainte-Laguë seats per (k, shard) with words z: each source's blocks over its shards.

    Rounding words * blocks / source_size gives seats of some divisor; the difference from the
    source's blocks, at most half its shards, is settled by the next (or last) quotients.
    """
    s = sources.withColumn("block", F.lit(block_words).cast("long")).withColumn("blocks", F.floor(F.col("target") / F.col("block") + 0.5).cast("long"))
    c = cells.filter("z > 0").join(s, "k")
    c = c.withColumn("seats0", F.expr("(cast(2 as decimal(1,0)) * cast(blocks as decimal(18,0)) * cast(z as decimal(18,0)) + cast(source_size as decimal(18,0))) div (cast(2 as decimal(1,0)) * cast(source_size as decimal(18,0)))").cast("long"))
    c = c.withColumn("lack", F.col("blocks") - F.sum("seats0").over(W.partitionBy("k")))
    tries = c.filter("lack <> 0").select("k", "shard", "z", "seats0", "lack", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("lack"))).alias("j"))
    tries = tries.filter("lack > 0 or j <= seats0")
    seat = F.when(F.col("lack") > 0, F.col("seats0") + F.col("j")).otherwise(F.col("seats0") - F.col("j") + 1)
    quotient = F.col("z").cast("double") / (2 * seat - 1).cast("double")
    tries = tries.withColumn("_q", F.when(F.col("lack") > 0, -quotient).otherwise(quotient))
    won = tries.withColumn("_r", F.row_number().over(W.partitionBy("k").orderBy("_q", "shard", "j"))).filter(F.col("_r") <= F.abs("lack"))
    won = won.groupBy("k", "shard").agg(F.count(F.lit(1)).alias("won"))
    c = c.join(won, ["k", "shard"], "left").withColumn("seats", F.col("seats0") + F.signum("lack").cast("long") * F.coalesce("won", F.lit(0)))
    c = c.withColumn("words", F.least(F.col("seats") * F.col("block"), F.col("z") * max_repeat))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col("k"), F.lit(":"), F.col("shard").cast("string")))
    first = _hex(key, 1) % F.expr("(z + block - 1) div block") * F.col("block")
    return c.select("k", "shard", "source_size", "target", F.col("seats").alias("quota_blocks"), F.expr("words div z").alias("passes"), (F.col("words") % F.col("z")).alias("run"), first.alias("first"), "z")


def mix_sources(docs: DataFrame, size: Column | None = None, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", seed: str = SEED, shards: int = SHARDS, shard_rows: int = SHARD_ROWS, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row: ``row`` (a struct of all its columns), size, source_size, target, taken, and where
    the taken words lie: ``passes`` whole copies, then words [lo1, hi1) and [lo2, hi2)."""
    work = scratch.Scratch(docs.sparkSession, "mixing")
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = docs.select(F.struct("*").alias("row"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("t")).alias("k"), key.alias("key"), (size if size is not None else n_words(F.col(text_col))).alias("size"))
    rows = work.save(rows.withColumn("rid", F.monotonically_increasing_id()), "rows")
    shards = max(shards, rows.count() // shard_rows)
    base = rows.select("rid", "k", "key", "size", (_hex(F.col("key"), 1) % shards).alias("shard"))
    cells = work.save(base.groupBy("k", "shard").agg(F.sum("size").alias("z")), "cells")
    sources = plan_sources(cells.groupBy("k").agg(F.sum("z").alias("size")), weights, max_repeat)
    plan = quotas(cells, sources, max_repeat, seed, block_words)
    order = W.partitionBy("k", "shard").orderBy("key", "size", "rid").rowsBetween(W.unboundedPreceding, 0)
    at = base.withColumn("to", F.sum("size").over(order)).withColumn("at", F.col("to") - F.col("size"))
    out = at.join(plan, ["k", "shard"], "left").join(sources.select("k", F.col("source_size").alias("s_size"), F.col("target").alias("s_target")), "k")
    end = F.col("first") + F.col("run")
    clip = lambda lo, hi: (F.greatest(F.col("at"), lo) - F.col("at"), F.least(F.col("to"), hi) - F.col("at"))
    lo1, hi1 = clip(F.col("first"), F.least(end, F.col("z")))
    lo2, hi2 = clip(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), end - F.col("z")))
    out = out.withColumns({"lo1": lo1, "hi1": F.greatest(lo1, hi1), "lo2": lo2, "hi2": F.greatest(lo2, hi2)})
    taken = F.coalesce(F.col("passes") * F.col("size") + (F.col("hi1") - F.col("lo1")) + (F.col("hi2") - F.col("lo2")), F.lit(0)).cast("long")
    out = out.select("rid", "size", F.col("s_size").cast("long").alias("source_size"), F.col("s_target").alias("target"), taken.alias("taken"), F.coalesce("passes", F.lit(0)).cast("long").alias("passes"), "lo1", "hi1", "lo2", "hi2", F.coalesce("quota_blocks", F.lit(0)).alias("quota_blocks"))
    out = work.save(out, "taken")
    work.keep_only(rows, out)
    return rows.select("rid", "row").join(out, "rid").drop("rid")


def materialise(mixed: DataFrame, docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The mix as rows with the columns of ``docs``: whole copies, then the partly taken words.

    A part keeps the white space between its words; ``chars_col`` follows the new text.
    """
    parts = F.array_distinct(F.filter(F.array(F.struct("lo1", "hi1"), F.struct(F.col("lo2").alias("lo1"), F.col("hi2").alias("hi1"))), lambda x: x["hi1"] > x["lo1"]))
    whole = F.array_repeat(F.struct(F.lit(0).cast("long").alias("lo1"), F.col("size").alias("hi1")), F.col("passes").cast("int"))
    every = mixed.filter("taken > 0").select("row", "size", F.explode(F.concat(whole, parts)).alias("p"))
    text = F.col(f"row.{text_col}")
    words = F.regexp_extract_all(text, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words, F.col("p.lo1").cast("int") + 1, (F.col("p.hi1") - F.col("p.lo1")).cast("int")), "")
    every = every.withColumn("_t", F.when((F.col("p.lo1") == 0) & (F.col("p.hi1") == F.col("size")), text).otherwise(cut))
    kind = dict(docs.dtypes)
    cols = [F.col("_t").alias(c) if c == text_col else F.char_length("_t").cast(kind[c]).alias(c) if c == chars_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return every.select(*cols)


def op8_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    narrow = docs.select("doc_id", "source", n_words(F.col("text")).alias("n"))
    m = mix_sources(narrow, F.col("n"))
    return m.select("row.doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""
WITH base AS (
  SELECT doc_id, coalesce('s' || source, 't') AS k, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
b AS (SELECT *, CAST('0x' || substr(key, 1, 8) AS BIGINT) % (SELECT greatest({SHARDS}, count(*) // {SHARD_ROWS}) FROM documents) AS shard FROM base),
cells AS (SELECT k, shard, CAST(sum(size) AS BIGINT) AS z FROM b GROUP BY k, shard),
s0 AS (SELECT k, CAST(sum(z) AS BIGINT) AS size FROM cells GROUP BY k),
s1 AS (SELECT *, 1 + (row_number() OVER (ORDER BY k) - 1) % 3 AS weight, size * {MAX_REPEAT} AS cap, CAST(sum(size) OVER () AS BIGINT) AS total FROM s0),
s2 AS (SELECT *, coalesce(CAST(sum(cap) OVER (ORDER BY cap * (6 // weight), k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before,
         CAST(sum(weight) OVER (ORDER BY cap * (6 // weight), k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest FROM s1),
s3 AS (SELECT *, cap * rest < weight * (total - before) AS capped FROM s2),
s4 AS (SELECT *, total - coalesce(CAST(sum(CASE WHEN capped THEN cap END) OVER () AS BIGINT), 0) AS open, CAST(sum(CASE WHEN NOT capped THEN weight END) OVER () AS BIGINT) AS oweight FROM s3),
s AS (SELECT k, size AS source_size, CASE WHEN capped THEN CAST(cap AS DOUBLE) ELSE CAST(weight * open AS DOUBLE) / CAST(oweight AS DOUBLE) END AS target,
        CAST({BLOCK_WORDS} AS BIGINT) AS block FROM s4),
c0 AS (SELECT cells.k, shard, z, source_size, target, block, CAST(floor(target / block + 0.5) AS BIGINT) AS blocks FROM cells JOIN s ON cells.k = s.k WHERE z > 0),
c1 AS (SELECT *, CAST((2 * CAST(blocks AS HUGEINT) * z + source_size) // (2 * source_size) AS BIGINT) AS seats0 FROM c0),
c2 AS (SELECT *, blocks - CAST(sum(seats0) OVER (PARTITION BY k) AS BIGINT) AS lack FROM c1),
t AS (SELECT *, unnest(range(1, abs(lack) + 1)) AS j FROM c2 WHERE lack <> 0),
t1 AS (SELECT *, CASE WHEN lack > 0 THEN -(CAST(z AS DOUBLE) / CAST(2 * (seats0 + j) - 1 AS DOUBLE)) ELSE CAST(z AS DOUBLE) / CAST(2 * (seats0 - j + 1) - 1 AS DOUBLE) END AS q FROM t WHERE lack > 0 OR j <= seats0),
won AS (SELECT k, shard, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY q, shard, j) AS r FROM t1) WHERE r <= abs(lack) GROUP BY k, shard),
p0 AS (SELECT c2.*, least((seats0 + sign(lack) * coalesce(won, 0)) * block, z * {MAX_REPEAT}) AS words FROM c2 LEFT JOIN won ON c2.k = won.k AND c2.shard = won.shard),
p AS (SELECT k, shard, z, CAST(words // z AS BIGINT) AS passes, CAST(words % z AS BIGINT) AS run,
        CAST('0x' || substr(md5('{SEED}:' || k || ':' || CAST(shard AS VARCHAR)), 1, 8) AS BIGINT) % ((z + block - 1) // block) * block AS begins FROM p0),
d AS (SELECT *, CAST(sum(size) OVER (PARTITION BY k, shard ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS upto FROM b),
e AS (SELECT d.*, p.z, p.passes, p.run, p.begins, d.upto - d.size AS starts FROM d LEFT JOIN p ON d.k = p.k AND d.shard = p.shard)
SELECT doc_id, e.size AS size, s.source_size AS source_size, s.target AS target,
  CAST(coalesce(passes * e.size + greatest(0, least(upto, least(begins + run, z)) - greatest(starts, begins)) + greatest(0, least(upto, greatest(0, begins + run - z)) - starts), 0) AS BIGINT) AS taken
FROM e JOIN s ON e.k = s.k
"""
