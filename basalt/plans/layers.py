"""Layered daily pipeline: landing documents, silver rows, gold tables, audit, run history.

``python -m basalt.plans.layers --start 2024-01-01 --end 2024-01-14 --root DIR [--force|--status|--reset]``
"""

from __future__ import annotations

import argparse
import datetime as dt
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.functions import scalars as S
from basalt.operators.merge import VersionedTable
from basalt.plans.dag import DAG, RunHistory
from basalt.sources import landing
from basalt.sources.workdir import Files


class AuditError(ValueError):
    """The gold layer does not hold what the run should have put there."""


class Gold:
    """dim_city, dim_date and fact_daily with keyed writes; loading twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.city, self.date, self.fact = (VersionedTable(spark, f"{path}/{n}") for n in ("dim_city", "dim_date", "fact_daily"))

    def load(self, silver: DataFrame) -> None:
        new = silver.select("city").distinct()
        if self.city.exists():
            have = self.city.read()
            new = new.join(have, new.city == have.city_name, "left_anti")
            top = have.agg(F.coalesce(F.max("city_key"), F.lit(0)).alias("top"))
        else:
            top = self.spark.range(1).select(F.lit(0).cast("long").alias("top"))
        keyed = new.crossJoin(F.broadcast(top)).select((F.col("top") + F.row_number().over(W.orderBy("city"))).cast("long").alias("city_key"), F.col("city").alias("city_name"))  # one row
        self.city.insert_missing(keyed, ["city_name"])
        c = F.col("date")
        days = silver.select("date").distinct().select(S.date_key(c).alias("date_key"), c.alias("full_date"), F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day"), F.date_format(c, "EEEE").alias("day_name"), S.is_weekend(c).alias("is_weekend"))
        self.date.insert_missing(days, ["date_key"])
        facts = silver.join(self.city.read(), F.col("city") == F.col("city_name")).select("city_key", S.date_key(c).alias("date_key"), *landing.METRICS.values())
        self.fact.upsert(facts, ["city_key", "date_key"])

    def slice(self, cities: list[str], start: str, end: str) -> DataFrame:
        lo, hi = (int(x.replace("-", "")) for x in (start, end))
        mine = self.city.read().filter(F.col("city_name").isin(cities))
        return self.fact.read().filter(F.col("date_key").between(lo, hi)).join(mine, "city_key")


def audit(facts: DataFrame, silver: DataFrame, cities: int, days: int) -> dict:
    """Counts of a run's slice against what it must be; AuditError names all that differs."""
    f = facts.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("city_key").alias("cities"), F.countDistinct("date_key").alias("days"), F.countDistinct("city_key", "date_key").alias("keys")).first()
    rows = silver.count()
    wrong = [f"{what}: {got}, not {want}" for what, got, want in (("rows", f.n, rows), ("cities", f.cities, cities), ("days", f.days, days), ("rows by cities and days", f.n, cities * days), ("distinct keys", f["keys"], f.n)) if got != want]
    if wrong:
        raise AuditError("; ".join(wrong))
    return {"rows": f.n, "cities": f.cities, "days": f.days}


def build_dag(spark: SparkSession, root: str, cities: list[str], start: str, end: str, get: Callable[[str, str, str], dict], **options) -> DAG:
    """extract -> {transform, manifest} -> load -> audit."""
    dag = DAG("daily", RunHistory(spark, f"{root}/runs"), **{k: v for k, v in options.items() if k == "sleep"})
    bronze, silver_path = f"{root}/bronze", f"{root}/silver/{start}__{end}"
    silver = lambda: spark.read.parquet(silver_path)
    gold = Gold(spark, f"{root}/gold")
    files = Files(spark)

    @dag.task("extract", retries=2)
    def extract(ctx):
        return len(landing.fetch_all(files, cities, start, end, bronze, get, **options))

    @dag.task("transform")
    def transform(ctx):
        landing.silver_rows(spark, bronze, start, end).write.mode("overwrite").parquet(silver_path)

    @dag.task("manifest", retries=1)
    def manifest(ctx):
        names = [n for n in files.names(bronze) if n.endswith(f"__{start}__{end}.json")]
        files.write(f"{root}/manifest__{start}__{end}.json", json.dumps({"run_id": f"{start}__{end}", "cities": cities, "start": start, "end": end, "files": names}))

    @dag.task("load", retries=1)
    def load(ctx):
        gold.load(silver())

    @dag.task("audit")
    def check(ctx):
        days = (dt.date.fromisoformat(end) - dt.date.fromisoformat(start)).days + 1
        return audit(gold.slice(cities, start, end), silver(), len(cities), days)

    extract >> transform >> load >> check
    extract >> manifest >> load
    return dag


def main(argv: list[str] | None = None, get: Callable[[str, str, str], dict] | None = None) -> int:
    from basalt.session import session

    p = argparse.ArgumentParser()
    yesterday = dt.date.today() - dt.timedelta(days=1)
    p.add_argument("--start", default=(yesterday - dt.timedelta(days=13)).isoformat())
    p.add_argument("--end", default=yesterday.isoformat())
    p.add_argument("--root", default="data")
    p.add_argument("--cities", nargs="*", default=["alpha", "beta"])
    p.add_argument("--url", default="", help="format string of city, start and end")
    for flag in ("--force", "--status", "--reset"):
        p.add_argument(flag, action="store_true")
    a = p.parse_args(argv)
    spark = session()
    dag = build_dag(spark, a.root, a.cities, a.start, a.end, get or landing.http_get(a.url))
    if a.reset:
        dag.reset()
    if a.status:
        print(dag.status())
        return 0
    return 0 if dag.run(f"{a.start}__{a.end}", {}, force=a.force) else 1


if __name__ == "__main__":
    raise SystemExit(main())
