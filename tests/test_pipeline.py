import json
import os

import pytest
from pyspark.sql import functions as F

from basalt.plans import dag as G
from basalt.plans import layers as L
from basalt.plans import warehouse
from basalt.sources import landing
from basalt.sources.workdir import Files
from basalt.streaming import incremental

SF = "/root/testdata/sf0.001"


def document(city, start, end):
    import datetime as dt

    lo, hi = dt.date.fromisoformat(start), dt.date.fromisoformat(end)
    days = [(lo + dt.timedelta(days=i)).isoformat() for i in range((hi - lo).days + 1)]
    return {"daily": {"time": days, "temperature_2m_mean": [float(len(city) + i) for i in range(len(days))], "precipitation_sum": [None] + [0.5] * (len(days) - 1), "wind_speed_10m_max": [10.0] * len(days)}}


def test_tasks_retry_cache_force_and_skip(spark, tmp_path):
    waits, calls = [], []
    d = G.DAG("t", G.RunHistory(spark, str(tmp_path / "runs")), sleep=waits.append)

    @d.task("a", retries=2, backoff=1.0)
    def a(ctx):
        calls.append("a")
        if len(calls) < 3:
            raise OSError("not yet")
        return "ok"

    @d.task("b")
    def b(ctx):
        raise ValueError("no")

    @d.task("c")
    def c(ctx):
        calls.append("c")

    a >> b >> c
    a >> b
    assert b.upstream == [a]
    with pytest.raises(TypeError, match="not before str"):
        a >> "b"
    assert d.run("r", {}) is False
    assert waits == [1.0, 2.0]
    assert {r.task: (r.status, r.attempts) for r in d.history.rows().collect()} == {"a": ("succeeded", 3), "b": ("failed", 1), "c": ("skipped", 0)}
    b.func = lambda ctx: None
    assert d.run("r", {}) is True and calls == ["a", "a", "a", "c"]
    assert d.run("r", {}, force=True) is True and calls == ["a", "a", "a", "c", "a", "c"]
    c >> a
    with pytest.raises(ValueError, match="cycle"):
        d.order()
    assert "succeeded" in d.status("r") and "succeeded" not in d.status("other")
    d.reset()
    assert d.history.rows().count() == 0


def test_layers_are_idempotent_and_audited(spark, tmp_path):
    root, asked = str(tmp_path), []

    def get(city, start, end):
        asked.append(city)
        return document(city, start, end)

    run = lambda s, e, **k: L.build_dag(spark, root, ["a", "bb"], s, e, get, sleep=lambda _: None).run(f"{s}__{e}", {}, **k)
    assert run("2024-01-01", "2024-01-07") and run("2024-01-05", "2024-01-10")
    gold = L.Gold(spark, f"{root}/gold")
    before = sorted(map(tuple, gold.fact.read().collect()), key=str)
    assert len(before) == 20 and gold.city.read().count() == 2 and gold.date.read().count() == 10
    assert run("2024-01-05", "2024-01-10") and len(asked) == 4  # cached
    assert run("2024-01-05", "2024-01-10", force=True) and len(asked) == 4  # files are kept
    assert sorted(map(tuple, gold.fact.read().collect()), key=str) == before
    assert json.load(open(f"{root}/manifest__2024-01-01__2024-01-07.json"))["files"] == ["a__2024-01-01__2024-01-07.json", "bb__2024-01-01__2024-01-07.json"]
    silver = spark.read.parquet(f"{root}/silver/2024-01-01__2024-01-07")
    facts = gold.slice(["a", "bb"], "2024-01-01", "2024-01-07")
    assert L.audit(facts, silver, 2, 7) == {"rows": 14, "cities": 2, "days": 7}
    for broken in (facts.filter("city_name <> 'a'"), facts.filter("date_key <> 20240103"), facts.unionByName(facts.limit(1)), facts.filter("not (city_name = 'a' and date_key = 20240103)")):
        with pytest.raises(L.AuditError):
            L.audit(broken, silver, 2, 7)


def test_landing_failures(spark, tmp_path):
    folder = str(tmp_path / "bronze")
    with pytest.raises(RuntimeError, match="x: no daily"):
        landing.fetch_all(Files(spark), ["x"], "2024-01-01", "2024-01-02", folder, lambda *a: {"reason": "bad"}, sleep=lambda _: None)
    tries = []

    def flaky(*a):
        tries.append(a)
        if len(tries) < 3:
            raise OSError("down")
        return document(*a)

    landing.fetch_city(Files(spark), "x", "2024-01-01", "2024-01-02", folder, flaky, sleep=lambda _: None)
    assert len(tries) == 3 and [n for n in os.listdir(folder) if not n.startswith(".")] == ["x__2024-01-01__2024-01-02.json"]
    got = landing.silver_rows(spark, folder, "2024-01-01", "2024-01-02").orderBy("date").collect()
    assert [(r.city, r.temp_mean_c, r.precip_mm) for r in got] == [("x", 1.0, None), ("x", 2.0, 0.5)]
    doc = document("y", "2024-01-01", "2024-01-02")
    doc["daily"]["precipitation_sum"].append(1.0)
    json.dump(doc, open(f"{folder}/y__2024-01-01__2024-01-02.json", "w"))
    with pytest.raises(Exception, match="bad daily values for y"):
        landing.silver_rows(spark, folder, "2024-01-01", "2024-01-02").collect()


def test_versions_of_one_mover(spark):
    import datetime as dt

    e = spark.createDataFrame([(26, dt.date(2023, 11, 21), "Mumbai", 1), (26, dt.date(2025, 2, 8), "Pune", 2), (26, dt.date(2025, 2, 8), "Delhi", 3), (26, dt.date(2025, 3, 8), "Delhi", 4)], "c int, at date, city string, n int")
    got = [tuple(r) for r in warehouse.versions(e, "c", "at", "city", "n").orderBy("valid_from").collect()]
    assert got == [(26, "Mumbai", dt.date(2023, 11, 21), dt.date(2025, 2, 7), False), (26, "Delhi", dt.date(2025, 2, 8), None, True)]


def test_warehouse_build(spark, tmp_path):
    out = warehouse.build(spark, SF, str(tmp_path))
    assert set(out) == {"dim_date", "dim_customer", "dim_product", "dim_customer_scd", "fact_sales", "fact_returns"}
    assert Files(spark).read(f"{tmp_path}/_current") == out["fact_sales"].rsplit("/", 1)[0]
    f = spark.read.parquet(out["fact_sales"])
    assert f.count() == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert f.select("order_id", "line_no").distinct().count() == f.count()


def test_stream_takes_each_file_once(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    src, args = str(tmp_path / "in"), (str(tmp_path / "t"), ["event_id"], str(tmp_path / "c"), "ts")
    e.filter("event_id < 500").write.parquet(src)
    assert incremental.load_available(spark, src, e.schema.simpleString()[7:-1].replace(":", " "), *args) == 1
    assert incremental.load_available(spark, src, e.schema.simpleString()[7:-1].replace(":", " "), *args) == 0
    e.filter("event_id >= 400").write.mode("append").parquet(src)
    assert incremental.load_available(spark, src, e.schema.simpleString()[7:-1].replace(":", " "), *args) == 1
    from basalt.operators.merge import VersionedTable

    assert VersionedTable(spark, args[0]).read().count() == e.count()
    assert incremental.daily_counts(e).agg(F.sum("n")).first()[0] == e.count()
