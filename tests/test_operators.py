import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from basalt.functions import render
from basalt.functions import scalars as S
from basalt.operators import cleaning as C
from basalt.operators import distribution as D
from basalt.operators import merge as M
from basalt.operators import relational as R
from basalt.sources import text_files as T


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_coercion(spark):
    cells = ["", "nan", "NA", "N/A", "NULL", "null", "None", " 6 ", "17850.0", "2.55", "C536379", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    got = df.select("i", S.to_long(F.col("c")), S.to_double(F.col("c")), S.clean_text(F.col("c"))).orderBy("i").collect()
    assert [r[1] for r in got] == [None] * 7 + [6, 17850, None, None, None]
    assert [r[2] for r in got] == [None] * 7 + [6.0, 17850.0, 2.55, None, None]
    assert [r[3] for r in got] == [None] * 7 + ["6", "17850.0", "2.55", "C536379", None]


def test_join_null_safe_left_wins_and_fans_out(spark):
    a = spark.createDataFrame([(1, "a"), (None, "b"), (3, "c")], "k int, v string")
    b = spark.createDataFrame([(1, "x", 10), (1, "y", 11), (None, "z", 12)], "k int, v string, w int")
    assert rows(R.join(a, b, "k", "k")) == rows(spark.createDataFrame([(1, "a", 10), (1, "a", 11), (None, "b", 12)], "k int, v string, w int"))
    assert (3, "c", None) in rows(R.join(a, b, "k", "k", "left"))
    with pytest.raises(ValueError):
        R.join(a, b, "k", "k", "cross")
    with pytest.raises(KeyError, match="there are k, v"):
        R.project(a, ["nope"])


def test_null_order_both_ways(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    assert [r.v for r in R.order_by(df, [("v", False)]).collect()] == [1, 3, None]
    assert [r.v for r in R.order_by(df, [("v", True)]).collect()] == [None, 3, 1]
    with pytest.raises(ValueError):
        R.limit(df, -1)
    assert R.limit(df, 0).count() == 0


def test_ranks(spark):
    df = spark.createDataFrame([("a", 100), ("b", 90), ("c", 90), ("d", 80)], "k string, v int")
    o = [("v", True)]
    assert [r[0] for r in R.rank(df, [], o).orderBy("k").select("rank").collect()] == [1, 2, 2, 4]
    assert [r[0] for r in R.dense_rank(df, [], o).orderBy("k").select("dense_rank").collect()] == [1, 2, 2, 3]
    assert [r[0] for r in R.row_number(df, [], [*o, ("k", False)]).orderBy("k").select("row_num").collect()] == [1, 2, 3, 4]
    assert R.top_n(df, [], [*o, ("k", False)], 2).count() == 2


def test_running_sum_rows_frame_and_null(spark):
    df = spark.createDataFrame([(1, None, 0), (2, 10, 1), (3, 20, 1), (4, 30, 2)], "i int, v int, o int")
    assert [r.s for r in R.running_sum(df, "v", [], [("o", False), ("i", False)], "s").orderBy("i").collect()] == [0, 10, 30, 60]
    assert {r.t for r in R.partition_sum(df, "v", [], "t").collect()} == {60}
    assert rows(R.partition_sum(df, "v", ["o"], "t").select("o", "t").distinct()) == [(0, 0), (1, 30), (2, 30)]


def test_group_by_empty_and_null(spark):
    df = spark.createDataFrame([(None, 1), (None, None), ("a", 2)], "k string, v int")
    assert rows(R.group_by(df, ["k"], {"n": F.count(F.lit(1)), "s": S.sum0(F.col("v"))})) == rows(spark.createDataFrame([(None, 2, 1), ("a", 1, 2)], "k string, n int, s int"))
    none = df.filter("false")
    assert R.group_by(none, [], {"n": F.count(F.lit(1))}).count() == 0
    assert df.filter("v is null").agg(S.sum0(F.col("v"))).first()[0] == 0
    got = R.group_apply(df, ["k"], lambda g: g.assign(n=len(g))[["k", "n"]].head(1), "k string, n long")
    assert rows(got) == [("a", 1), (None, 2)]


def test_fold_rest(spark):
    df = spark.createDataFrame([(c, v) for c, v in zip("abcdefg", (7, 6, 5, 4, 3, 2, 1))], "k string, v int")
    assert dict(rows(R.fold_rest(df, "k", "v", 5)))["Rest"] == 3
    assert "Rest" not in dict(rows(R.fold_rest(df.filter("v > 2"), "k", "v", 5)))


def test_point_in_time(spark):
    d = dt.date
    v = spark.createDataFrame([(26, "Mumbai", d(2023, 11, 21), d(2025, 2, 7)), (26, "Delhi", d(2025, 2, 8), None)], "c int, city string, valid_from date, valid_to date")
    f = spark.createDataFrame([(26, d(2024, 6, 1)), (26, d(2025, 2, 7)), (26, d(2025, 2, 8)), (26, d(2025, 3, 1)), (27, d(2025, 3, 1))], "c int, at date")
    assert rows(R.point_in_time(f, v, "c", "at").select("at", "city")) == [(d(2024, 6, 1), "Mumbai"), (d(2025, 2, 7), "Mumbai"), (d(2025, 2, 8), "Delhi"), (d(2025, 3, 1), "Delhi")]


def test_waffle_and_histogram_edges(spark):
    df = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, v int")
    assert rows(D.waffle(df, "k", "v")) == [("a", 34), ("b", 33), ("c", 33)]
    same = spark.createDataFrame([(5.0,), (5.0,), (None,)], "v double")
    assert rows(D.histogram(same, "v", 4)) == [(0, 2)]
    two = spark.createDataFrame([(0.0,), (10.0,)], "v double")
    assert rows(D.histogram(two, "v", 5)) == [(0, 1), (4, 1)]


def test_flags(spark):
    df = spark.createDataFrame([("C1", -1.0, 2.0, None), ("2", -3.0, 0.0, 5), ("3", 4.0, 2.5, 5), ("4", None, 1.0, 5)], "invoice string, quantity double, price double, customer int")
    got = {r.invoice: r for r in C.flag(df).collect()}
    assert got["C1"].is_cancelled and not got["C1"].is_writeoff and not got["C1"].has_customer
    assert got["2"].is_writeoff and not got["2"].is_valid_price
    assert got["3"].is_revenue_safe and float(got["3"].revenue) == 10.0
    assert got["4"].is_revenue_safe is False and got["4"].is_writeoff is False
    assert dict(rows(C.null_profile(df)))["customer"] == 1


def test_versioned_upsert_is_idempotent_and_failed_write_changes_nothing(spark, tmp_path):
    t = M.VersionedTable(spark, str(tmp_path / "t"))
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    b = spark.createDataFrame([(2, "Y"), (3, "z")], "k int, v string")
    t.upsert(a, ["k"])
    t.upsert(b, ["k"])
    t.upsert(b, ["k"])
    assert rows(t.read()) == [(1, "x"), (2, "Y"), (3, "z")]
    t.insert_missing(spark.createDataFrame([(1, "no"), (9, "q")], "k int, v string"), ["k"])
    assert rows(t.read()) == [(1, "x"), (2, "Y"), (3, "z"), (9, "q")]
    with pytest.raises(Exception):
        t.replace(spark.range(3).select(F.raise_error(F.lit("broken")).alias("v")))
    assert t.read().count() == 4


def test_sql_runner_goes_on_after_errors(spark):
    out = T.run_sql(spark, "-- a comment; with a semicolon\nSELECT 'a;b' AS v; SELECT nope FROM nowhere;\nSELECT 2 AS n -- tail\n")
    assert len(out) == 3 and "a;b" in out[0][1] and out[1][1].startswith("error") and "2" in out[2][1]


@pytest.mark.parametrize("sql", ["SELECT id FROM range(3) WHERE sum(id) > 1", "SELECT id, count(*) FROM range(3)", "SELECT id FROM range(3) WHERE row_number() OVER (ORDER BY id) = 1"])
def test_wrong_statements_are_refused(spark, sql):
    with pytest.raises(AnalysisException):
        spark.sql(sql).collect()


def test_not_in_with_null_is_empty(spark):
    assert spark.sql("SELECT id FROM range(3) WHERE id NOT IN (SELECT * FROM VALUES (1L), (CAST(NULL AS BIGINT)))").count() == 0


def test_csv_round_trip(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("id,name,amount\n17850.0, a ,2.5\nNA,null,nan\nC1,b,1\n")
    df = T.read_csv(spark, str(p), longs=("id",), doubles=("amount",))
    assert rows(df) == rows(spark.createDataFrame([(17850, "a", 2.5), (None, None, None), (None, "b", 1.0)], "id long, name string, amount double"))
    T.write_csv(df, str(tmp_path / "out"))
    assert T.read_csv(spark, str(tmp_path / "out")).count() == 3
    with pytest.raises(FileNotFoundError):
        T.read_csv(spark, str(tmp_path / "missing.csv"))
    assert "id" in T.show(df, "title")


def test_rendering():
    assert render.nice_ticks(0, 10) == [0, 2, 4, 6, 8, 10]
    assert render.sparkline([1, 1, 1]) == "▁▁▁" and render.sparkline([]) == "" and render.sparkline([0, 1])[-1] == "█"
    assert render.blend("#000000", "#ffffff", 2) == "#ffffff"
    assert render.short_number(1234567) == "1.2M" and render.short_number(12345) == "12.3k"
    import xml.dom.minidom as m

    for c in (render.bar_chart([("a<b", 3), ("c", 1)], "t & t"), render.line_chart([(0, 1), (1, 2)]), render.grid_chart([(0, 0, 1.0)])):
        m.parseString(c.svg())
    assert "█" in render.text_bars([("a", 1)])


def test_quantiles_with_null_groups_ties_and_cells(spark):
    import random

    r = random.Random(1)
    data = [(k, r.choice([1.0, 2.0, r.random() * 9])) for k in ("a", None, "b") for _ in range(300)] + [("c", 4.0), ("d", None)]
    df = spark.createDataFrame(data, "k string, v double")
    want = df.groupBy("k").agg(F.median("v").alias("m"), F.percentile("v", F.lit(0.99)).alias("p")).filter("m is not null")
    for slack in (0.4, 0.05, 0.001):
        got = D.quantiles(df, "v", {"m": 0.5, "p": 0.99}, by=["k"], slack=slack)
        assert [(a, round(b, 9), round(c, 9)) for a, b, c in rows(got)] == [(a, round(b, 9), round(c, 9)) for a, b, c in rows(want)]
    assert D.quantiles(df.filter("false"), "v", {"m": 0.5}).count() == 0


def test_global_order_is_not_one_task(spark):
    df = spark.range(1000).withColumn("v", F.when(F.col("id") % 7 > 0, F.col("id") % 5))
    got = R.global_row_number(df, [("v", True), ("id", False)], "n")
    want = R.row_number(df, [], [("v", True), ("id", False)], "n")
    assert rows(got) == rows(want)
    assert R.global_row_number(df.filter("false"), [("id", False)], "n").count() == 0


def test_timestamps_and_short_numbers(spark):
    df = spark.createDataFrame([("2011-12-09 08:26:00",), (" 2011-12-09 08:26:00 ",), ("9/12/2011",), ("NA",), (None,)], "t string")
    assert [str(r[0]) for r in df.select(S.to_timestamp(F.col("t"))).collect()] == ["2011-12-09 08:26:00"] * 2 + ["None"] * 3
    n = spark.createDataFrame([(1234567.0,), (12345.0,), (7.0,), (-1500.0,), (None,)], "v double")
    assert [r[0] for r in n.select(S.short_number(F.col("v"))).collect()] == ["1.2M", "12.3k", "7.0", "-1.5k", None]
    c = spark.createDataFrame([(-1.0,), (0.5,), (2.0,)], "t double")
    assert [r[0] for r in c.select(S.blend("#000000", "#ffffff", F.col("t"))).collect()] == ["#000000", "#808080", "#ffffff"]


def test_custom_aggregate_in_two_phases(spark):
    import random

    r = random.Random(6)
    data = [("hot" if i % 3 else f"k{i % 50}", r.randint(0, 10**6)) for i in range(5000)]
    df = spark.createDataFrame(data, "k string, v long").repartition(6)

    def keep(f):
        return f.sort_values("v", ascending=False).groupby("k", sort=False).head(3)

    def third(f):
        f = keep(f)
        return f[["k"]].head(1).assign(third=f["v"].iloc[min(2, len(f) - 1)])

    want = {}
    for k, v in data:
        want[k] = sorted([*want.get(k, []), v], reverse=True)[:3]
    got = R.custom_aggregate(df, ["k"], keep, third, "k string, third long")
    assert dict(map(tuple, got.collect())) == {k: v[min(2, len(v) - 1)] for k, v in want.items()}


def test_more_charts():
    import xml.dom.minidom as m

    for c in (render.bar_rows_chart([("a<b", 3), ("c", 1)], "t & t"), render.bar_rows_chart([]), render.scatter_chart([(0, 1), (1, 2)]), render.scatter_chart([])):
        m.parseString(c.svg())
    assert render.scatter_chart([(0, 1), (1, 2)]).svg().count("<circle") == 2


def test_declared_tables_and_keys(spark):
    from basalt.plans import warehouse

    good = spark.createDataFrame([(1, "Porto")], "city_key long, city_name string")
    assert warehouse.conform(good, "dim_city").columns == ["city_key", "city_name"]
    bad = spark.createDataFrame([(None, "Porto")], "city_key long, city_name string")
    with pytest.raises(Exception, match="dim_city: no city_key"):
        warehouse.conform(bad, "dim_city").collect()


def test_migration_keeps_the_last_row_of_a_key(spark, tmp_path):
    t = M.VersionedTable(spark, str(tmp_path / "t"))
    t.replace(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (None, "c", 3), (2, "d", 1), (2, "d", 1)], "k int, v string, n int"))
    assert t.migrate(["k"], [F.desc("n")]) == 3
    assert rows(t.read()) == [(1, "b", 2), (2, "d", 1)]


def test_quantiles_to_the_last_digit(spark):
    import random

    import duckdb

    r = random.Random(1)
    data = [(k, round(r.uniform(1000, 500000), 2)) for k in range(60) for _ in range(r.randint(3, 90))]
    df = spark.createDataFrame(data, "k int, v double")
    got = {x.k: (x.m, x.p) for x in D.quantiles(df, "v", {"m": 0.3, "p": 0.99}, by=["k"]).collect()}
    con = duckdb.connect()
    for k in range(60):
        values = [v for g, v in data if g == k]
        assert got[k] == con.execute("select quantile_cont(x, 0.3), quantile_cont(x, 0.99) from (select unnest(?::double[]) x)", [values]).fetchone()
