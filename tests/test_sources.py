import json

from pyspark.sql import functions as F

from basalt.sources import archive, seed, statistics


def test_archive_source(spark, tmp_path):
    for c in ("a", "b"):
        (tmp_path / f"{c}.json").write_text(json.dumps({"daily": {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_mean": [1.0, None], "precipitation_sum": [0.0, 0.5], "wind_speed_10m_max": [3.0, 4.0]}}))
    spark.dataSource.register(archive.ArchiveSource)
    df = spark.read.format("daily_archive").options(cities="a, b", start="2024-01-01", end="2024-01-02", url=f"file://{tmp_path}/{{city}}.json").load()
    assert sorted(tuple(r)[:3] for r in df.collect())[0] == ("a", "2024-01-01", 1.0) and df.count() == 4 and df.rdd.getNumPartitions() == 2


def test_seeded_shop(spark):
    t, again = seed.shop(spark), seed.shop(spark)
    for name, df in t.items():
        assert df.exceptAll(again[name]).count() == 0 and df.count() > 0
    assert t["orders"].join(t["customers"], "customer_id", "left_anti").count() == 0
    assert t["order_items"].groupBy("order_id", "line_no").count().filter("count > 1").count() == 0
    r = t["returns"].join(t["order_items"].withColumnRenamed("quantity", "bought"), ["order_id", "line_no"])
    assert r.count() == t["returns"].count() and r.filter(F.col("quantity") > F.col("bought")).count() == 0
    assert t["address_changes"].filter("old_city = new_city").count() == 0


def test_tables_with_statistics(spark, tmp_path):
    spark.sql("DROP TABLE IF EXISTS basalt_t")
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    statistics.save_table(df, "basalt_t", bucket=(4, "k"), sort=["k"])
    statistics.analyze(spark, "basalt_t", ["k"])
    plan = spark.table("basalt_t").groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    spark.sql("DROP TABLE basalt_t")
