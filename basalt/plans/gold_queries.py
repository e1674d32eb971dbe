"""The layered pipeline's tables over the events table: daily facts, reload, audit."""

from __future__ import annotations

from pyspark.sql import functions as F

from basalt.functions import scalars as S
from basalt.operators.merge import insert_missing, upsert
from basalt.sources.tables import table

QUERIES: dict = {}
ORACLES: dict = {}


def daily(spark, d):
    """One row per (event type, day): the fact of the gold layer."""
    v = F.col("value").cast("decimal(18,6)")
    return table(spark, d, "events").groupBy("event_type", S.date_key(F.col("ts")).alias("date_key")).agg(F.count(F.lit(1)).alias("n"), F.sum(v).cast("double").alias("total"), F.max("value").alias("top"))


DAILY_SQL = "daily AS (SELECT event_type, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date_key, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,6))) AS DOUBLE) AS total, max(value) AS top FROM events GROUP BY 1, 2)"


def gold_daily_fact(spark, d):
    return daily(spark, d)


def gold_after_reload(spark, d):
    """A load of the first half, then of an overlapping second part, then of that again."""
    f = daily(spark, d)
    first, later = f.filter("date_key <= 20240118"), f.filter("date_key >= 20240110")
    once = upsert(first, later, ["event_type", "date_key"])
    return upsert(once, later, ["event_type", "date_key"])


def gold_first_write_wins(spark, d):
    f = daily(spark, d).select("event_type", "date_key", "n")
    return insert_missing(f.filter("date_key <= 20240115"), f.withColumn("n", F.col("n") + 1000), ["event_type", "date_key"])


def audit_slice(spark, d):
    f = daily(spark, d).filter("date_key between 20240105 and 20240111")
    return f.agg(F.count(F.lit(1)).alias("facts"), F.countDistinct("event_type").alias("kinds"), F.countDistinct("date_key").alias("days"), (F.count(F.lit(1)) == F.countDistinct("event_type") * F.countDistinct("date_key")).alias("complete"))


for fn, sql in (
    (gold_daily_fact, f"WITH {DAILY_SQL} SELECT * FROM daily"),
    (gold_after_reload, f"WITH {DAILY_SQL} SELECT * FROM daily"),
    (gold_first_write_wins, f"WITH {DAILY_SQL} SELECT event_type, date_key, CASE WHEN date_key <= 20240115 THEN n ELSE n + 1000 END AS n FROM daily"),
    (audit_slice, f"WITH {DAILY_SQL}, f AS (SELECT * FROM daily WHERE date_key BETWEEN 20240105 AND 20240111) SELECT count(*) AS facts, count(DISTINCT event_type) AS kinds, count(DISTINCT date_key) AS days, count(*) = count(DISTINCT event_type) * count(DISTINCT date_key) AS complete FROM f"),
):
    QUERIES[fn.__name__] = fn
    ORACLES[fn.__name__] = sql
