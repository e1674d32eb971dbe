"""Sources, sinks, keyed loads, the task graph and rendering as queries over the standard tables.

What these write goes to a fresh folder on the shared file system (``sources.workdir``); small inputs
that an operator needs in a given form (documents, scripts, run outcomes) are made here.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from basalt.functions import render
from basalt.functions import scalars as S
from basalt.operators import cleaning as C
from basalt.operators import distribution as D
from basalt.operators import relational as R
from basalt.operators.merge import VersionedTable
from basalt.plans import layers
from basalt.plans.dag import DAG, RunHistory
from basalt.plans.warehouse import TABLES, create_tables
from basalt.sources import landing, seed, statistics, text_files
from basalt.sources.tables import table
from basalt.sources.workdir import Files, fresh
from basalt.streaming import incremental

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        ORACLES[fn.__name__] = sql
        return fn

    return keep


# ---- text files and coercion -------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def csv_scan(spark, d):
    """A table through a CSV and back, typed."""
    path = fresh(spark, "csv")
    text_files.write_csv(table(spark, d, "customer"), path)
    t = text_files.read_csv(spark, path, longs=("c_custkey", "c_nationkey"), doubles=("c_acctbal",))
    return t.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey FROM nation")
def csv_raw_scan(spark, d):
    path = fresh(spark, "csv")
    text_files.write_csv(table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey"), path)
    return text_files.read_csv(spark, path, clean=False)


CELL = "CASE o_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN ' nan ' WHEN 2 THEN 'NULL' WHEN 3 THEN concat(' ', CAST(o_orderkey AS VARCHAR), ' ') WHEN 4 THEN concat(CAST(o_orderkey AS VARCHAR), '.0') WHEN 5 THEN concat(CAST(o_orderkey AS VARCHAR), '.25') ELSE concat('C', CAST(o_orderkey AS VARCHAR)) END"


@query(f"""WITH t AS (SELECT o_orderkey, trim({CELL}) AS c FROM orders), n AS (SELECT o_orderkey, CASE WHEN c IN ('', 'nan', 'NA', 'N/A', 'NULL', 'null', 'None') THEN NULL ELSE c END AS c FROM t)
  SELECT o_orderkey, c AS as_text, CASE WHEN o_orderkey % 7 IN (3, 4) THEN o_orderkey END AS as_long, TRY_CAST(c AS DOUBLE) AS as_double FROM n""")
def cell_coercion(spark, d):
    """Texts as they stand in raw files to text, whole numbers and numbers."""
    cell = F.expr(CELL.replace("VARCHAR", "STRING"))
    t = table(spark, d, "orders").select("o_orderkey", cell.alias("c"))
    t = t.select("o_orderkey", S.clean_text(F.col("c")).alias("as_text"), F.col("c").alias("as_long"), F.col("c").alias("as_double"))
    return C.coerce(t, ("as_long",), ("as_double",))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate END AS at FROM orders")
def text_to_timestamp(spark, d):
    """Dates kept as text; every fifth has another form and becomes NULL."""
    t = F.when(F.col("o_orderkey") % 5 > 0, F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format("o_orderdate", "dd/MM/yy"))
    return table(spark, d, "orders").select("o_orderkey", S.to_timestamp(t).cast("timestamp_ntz").alias("at"))


@query("SELECT * FROM (VALUES ('SELECT 1', TRUE), ('SELECT ''a;b''', TRUE), ('SELECT nope FROM nowhere', FALSE), ('SELECT 2', TRUE)) AS v(statement, worked)")
def sql_script(spark, d):
    """A script whose third statement fails and whose fourth runs all the same."""
    out = text_files.run_sql(spark, "-- first; a comment\nSELECT 1;\nSELECT 'a;b';\nSELECT nope FROM nowhere;\nSELECT 2 -- last\n")
    return spark.createDataFrame([(s, not r.startswith("error")) for s, r in out], "statement string, worked boolean")


@query("""SELECT * FROM (VALUES (1, 'regions'), (2, 'r_regionkey  r_name'), (3, '-----------  -------'), (4, '0            AFRICA'), (5, '1            AMERICA'), (6, '(3 more)')) AS v(line, shown)""")
def table_preview(spark, d):
    t = text_files.show(table(spark, d, "region").select("r_regionkey", "r_name").orderBy("r_regionkey"), "regions", most=2).split("\n")
    lines = [s.rstrip() for s in t]
    return spark.createDataFrame(list(enumerate([*lines[:5], f"({table(spark, d, 'region').count() - 2} more)"], 1)), "line int, shown string")


@query("SELECT * FROM (VALUES ('aggregate in WHERE', TRUE), ('column outside GROUP BY', TRUE), ('window in WHERE', TRUE), ('plain', FALSE)) AS v(statement, refused)")
def refused_statements(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("basalt_orders")
    tried = {
        "aggregate in WHERE": "SELECT o_custkey FROM basalt_orders WHERE sum(o_totalprice) > 1",
        "column outside GROUP BY": "SELECT o_custkey, o_orderkey, count(*) FROM basalt_orders GROUP BY o_custkey",
        "window in WHERE": "SELECT o_custkey FROM basalt_orders WHERE row_number() OVER (ORDER BY o_orderkey) = 1",
        "plain": "SELECT o_custkey FROM basalt_orders",
    }

    def refused(sql: str) -> bool:
        try:
            spark.sql(sql)
        except AnalysisException:
            return True
        return False

    return spark.createDataFrame([(name, refused(sql)) for name, sql in tried.items()], "statement string, refused boolean")


@query("SELECT 'no column colour; there are r_regionkey, r_name' AS message")
def missing_column(spark, d):
    try:
        R.project(table(spark, d, "region").select("r_regionkey", "r_name"), ["colour"])
    except KeyError as e:
        return spark.createDataFrame([(e.args[0],)], "message string")
    raise AssertionError("a missing column was accepted")


# ---- landing, silver, gold ---------------------------------------------------------------------

START, END = "2024-01-05", "2024-01-11"
DAILY_SQL = f"""day AS (SELECT event_type AS city, CAST(ts AS DATE) AS date, max(value) AS temp_mean_c, CAST(count(*) AS DOUBLE) AS precip_mm, CASE WHEN min(value) < 0 THEN NULL ELSE min(value) END AS wind_max_kph
  FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}' + INTERVAL 1 DAY GROUP BY 1, 2)"""


def _documents(spark, d):
    """A get function: one document for each event type, its days summed up (a week of a few types)."""
    e = table(spark, d, "events").filter((F.col("ts") >= F.lit(START).cast("timestamp")) & (F.to_date("ts") <= F.lit(END).cast("date")))
    g = e.groupBy("event_type", F.to_date("ts").cast("string").alias("day")).agg(F.max("value").alias("top"), F.count(F.lit(1)).cast("double").alias("n"), F.when(F.min("value") >= 0, F.min("value")).alias("low"))
    by: dict[str, list] = {}
    for r in g.orderBy("event_type", "day").limit(10_000).collect():
        by.setdefault(r.event_type, []).append(r)

    def get(city: str, start: str, end: str) -> dict:
        rows = by[city]
        return {"daily": {"time": [r.day for r in rows], "temperature_2m_mean": [r.top for r in rows], "precipitation_sum": [r.n for r in rows], "wind_speed_10m_max": [r.low for r in rows]}}

    return sorted(by), get


@query(f"WITH {DAILY_SQL} SELECT city, date, temp_mean_c, precip_mm, wind_max_kph FROM day")
def landing_to_silver(spark, d):
    """Documents fetched into the landing folder, read back by file name, arrays zipped to rows, and
    the silver layer written and read."""
    cities, get = _documents(spark, d)
    root, files = fresh(spark, "landing"), Files(spark)
    landing.fetch_all(files, cities, START, END, f"{root}/bronze", get)
    files.write(f"{root}/bronze/{landing.landing_name('other', '2000-01-01', '2000-01-02')}", "{}")  # of another range
    landing.silver_rows(spark, f"{root}/bronze", START, END).write.mode("overwrite").parquet(f"{root}/silver")
    return spark.read.parquet(f"{root}/silver")


@query("SELECT event_type AS city, 1 AS fetched FROM events GROUP BY 1")
def landing_cache(spark, d):
    """How often each document was asked for when it is wanted three times, the first try failing."""
    cities, get = _documents(spark, d)
    root, files, asked = fresh(spark, "landing"), Files(spark), dict.fromkeys(cities, 0)
    tried: set[str] = set()

    def flaky(city: str, start: str, end: str) -> dict:
        if city not in tried:
            tried.add(city)
            raise OSError("not yet")
        asked[city] += 1
        return get(city, start, end)

    for _ in range(3):
        landing.fetch_all(files, cities, START, END, root, flaky, sleep=lambda _: None)
    return spark.createDataFrame(list(asked.items()), "city string, fetched int")


def _pipeline(spark, d, root: str):
    cities, get = _documents(spark, d)
    return layers.build_dag(spark, root, cities, START, END, get, sleep=lambda _: None)


RUN = f"{START}__{END}"


@query(f"WITH {DAILY_SQL} SELECT city AS city_name, CAST(strftime(date, '%Y%m%d') AS INTEGER) AS date_key, temp_mean_c, precip_mm, wind_max_kph FROM day")
def pipeline_gold(spark, d):
    """The whole layered run, twice, the second time forced: the fact table is the same."""
    root = fresh(spark, "pipeline")
    for force in (False, True):
        if not _pipeline(spark, d, root).run(RUN, {}, force=force):
            raise RuntimeError("the run failed")
    gold = layers.Gold(spark, f"{root}/gold")
    return gold.fact.read().join(gold.city.read(), "city_key").select("city_name", "date_key", "temp_mean_c", "precip_mm", "wind_max_kph")


@query(f"SELECT '{RUN}' AS run_id, event_type AS city, concat(event_type, '__{RUN}.json') AS file FROM events GROUP BY event_type")
def pipeline_manifest(spark, d):
    root = fresh(spark, "pipeline")
    _pipeline(spark, d, root).run(RUN, {})
    m = json.loads(Files(spark).read(f"{root}/manifest__{RUN}.json"))
    return spark.createDataFrame([(m["run_id"], c, f) for c, f in zip(m["cities"], m["files"], strict=True)], "run_id string, city string, file string")


@query(f"SELECT '{RUN}' AS run_id, * FROM (VALUES ('extract', 1), ('transform', 1), ('manifest', 1), ('load', 1), ('audit', 1)) AS v(task, attempts), (SELECT 'succeeded' AS status)")
def pipeline_history(spark, d):
    """What the run recorded; a second run finds all tasks done and records nothing new."""
    root = fresh(spark, "pipeline")
    _pipeline(spark, d, root).run(RUN, {})
    dag = _pipeline(spark, d, root)
    dag.run(RUN, {})
    if "audit" not in dag.status(RUN):
        raise AssertionError("the status does not name the tasks")
    return dag.history.rows().select("run_id", "task", "attempts", "status")


@query("SELECT * FROM (VALUES (1, 'a', 'succeeded', 3), (1, 'b', 'failed', 1), (1, 'c', 'skipped', 0), (2, 'a', 'succeeded', 3), (2, 'b', 'succeeded', 1), (2, 'c', 'succeeded', 1)) AS v(step, task, status, attempts)")
def task_outcomes(spark, d):
    """Retries, a failure and what it skips; then a rerun that does only what has not succeeded."""
    dag = DAG("t", RunHistory(spark, fresh(spark, "runs")), sleep=lambda _: None)
    tries, works = [], []

    @dag.task("a", retries=2)
    def a(ctx):
        tries.append(1)
        if len(tries) < 3:
            raise OSError("not yet")

    @dag.task("b")
    def b(ctx):
        if not works:
            raise ValueError("no")

    @dag.task("c")
    def c(ctx):
        return "done"

    a >> b >> c
    out = []
    for step in (1, 2):
        dag.run("r", {})
        out += [(step, r.task, r.status, r.attempts) for r in dag.history.rows().collect()]
        works.append(1)
    return spark.createDataFrame(out, "step int, task string, status string, attempts int")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, 'c'), (4, 'd')) AS v(place, task) UNION ALL SELECT 5, 'the graph has a cycle'")
def task_order(spark, d):
    dag = DAG("t", RunHistory(spark, fresh(spark, "runs")))
    a, b, c, e = (dag.task(n)(lambda ctx: None) for n in "abcd")
    a >> b >> c >> e
    a >> c
    rows = [(i, t.name) for i, t in enumerate(dag.order(), 1)]
    e >> a
    try:
        dag.order()
    except ValueError as x:
        rows.append((5, str(x).split(":")[0]))
    return spark.createDataFrame(rows, "place int, task string")


# ---- keyed tables ------------------------------------------------------------------------------


@query("SELECT 'r' AS run_id, CAST(o_orderkey % 50 AS VARCHAR) AS task, max(o_orderkey) AS last, count(*) AS times FROM orders GROUP BY 2")
def run_history_latest(spark, d):
    """Outcomes recorded again and again under one key: the latest stays."""
    o = table(spark, d, "orders").select(F.lit("r").alias("run_id"), (F.col("o_orderkey") % 50).cast("string").alias("task"), "o_orderkey")
    t = VersionedTable(spark, fresh(spark, "history"))
    cut = o.agg(F.expr("percentile_approx(o_orderkey, 0.5)")).first()[0]
    for part in (F.col("o_orderkey") <= cut, F.lit(True)):
        g = o.filter(part).groupBy("run_id", "task").agg(F.max("o_orderkey").alias("last"), F.count(F.lit(1)).alias("times"))
        t.upsert(g, ["run_id", "task"])
    return t.read()


@query("SELECT n_nationkey, n_name FROM nation")
def failed_write_changes_nothing(spark, d):
    t = VersionedTable(spark, fresh(spark, "table"))
    t.replace(table(spark, d, "nation").select("n_nationkey", "n_name"))
    bad = t.read().withColumn("n_name", F.when(F.col("n_nationkey") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("n_name")))
    try:
        t.replace(bad)
    except Exception:
        return t.read()
    raise AssertionError("a broken write was published")


@query("SELECT o_custkey, max(o_orderkey) AS last_order FROM orders GROUP BY 1")
def migrate_keyless_table(spark, d):
    """A table that was only ever appended to (twice, some rows without a key) becomes a keyed one, to
    which loads can be repeated."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("last_order"))
    t = VersionedTable(spark, fresh(spark, "table"))
    t.replace(o.unionByName(o).unionByName(o.select(F.lit(None).cast("long").alias("o_custkey"), "last_order")))
    t.migrate(["o_custkey"], [F.desc("last_order")])
    t.upsert(t.read(), ["o_custkey"])
    return t.read()


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1")
def bucketed_table(spark, d):
    """A bucketed, sorted table in place of an index: grouping by the bucket key needs no shuffle."""
    statistics.save_table(table(spark, d, "orders"), "basalt_bucketed", bucket=(8, "o_orderpriority"), sort=["o_orderkey"], path=fresh(spark, "bucketed"))
    return spark.table("basalt_bucketed").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'basalt_analyzed' AS name, count(*) AS n, min(o_orderkey) AS least, max(o_orderkey) AS greatest FROM orders")
def table_statistics(spark, d):
    """What the planner knows of a table after ANALYZE."""
    statistics.save_table(table(spark, d, "orders").select("o_orderkey"), "basalt_analyzed", path=fresh(spark, "analyzed"))
    statistics.analyze(spark, "basalt_analyzed", ["o_orderkey"])
    n, least, greatest = statistics.known(spark, "basalt_analyzed", "o_orderkey")
    return spark.createDataFrame([("basalt_analyzed", n, least, greatest)], "name string, n long, least long, greatest long")


@query("""SELECT * FROM (VALUES ('dim_date', 10, 1), ('dim_customer', 6, 1), ('dim_product', 6, 1), ('dim_customer_scd', 5, 2), ('fact_sales', 11, 2), ('fact_returns', 8, 2), ('dim_city', 2, 1), ('fact_daily', 5, 2)) AS v(name, columns, keys)""")
def declared_tables(spark, d):
    """The declared schemas made as empty tables: how many columns each has, and its keys that must
    not be NULL."""
    made = create_tables(spark, fresh(spark, "declared"))
    return spark.createDataFrame([(name, len(made[name].columns), len(TABLES[name].keys)) for name in made], "name string, columns int, keys int")


@query("""SELECT * FROM (VALUES ('orders without customer', 0), ('lines twice', 0), ('returns over what was bought', 0), ('refund over price', 0), ('moves to the same city', 0), ('customers', 1200), ('products', 300), ('orders', 25000)) AS v(what, n)""")
def seeded_shop(spark, d):
    """The generated shop at its full size keeps its own rules."""
    t = seed.shop(spark, customers=1200, products=300, orders=25_000)
    items = t["order_items"]
    net = F.round(F.col("quantity").cast("decimal(6,0)") * F.col("unit_price") * (1 - F.col("discount_pct")), 2)
    back = t["returns"].join(items.select("order_id", "line_no", F.col("quantity").alias("bought"), net.alias("net")), ["order_id", "line_no"])
    checks = {
        "orders without customer": t["orders"].join(t["customers"], "customer_id", "left_anti"),
        "lines twice": items.groupBy("order_id", "line_no").count().filter("count > 1"),
        "returns over what was bought": back.filter("quantity > bought"),
        "refund over price": back.filter("refund_amount > net"),
        "moves to the same city": t["address_changes"].filter("old_city = new_city"),
        "customers": t["customers"], "products": t["products"], "orders": t["orders"],
    }
    out = None
    for name, df in checks.items():
        one = df.agg(F.count(F.lit(1)).cast("int").alias("n")).select(F.lit(name).alias("what"), "n")
        out = one if out is None else out.unionByName(one)
    return out


# ---- streams -----------------------------------------------------------------------------------


@query("SELECT event_id, event_type, value FROM events")
def stream_keyed_load(spark, d):
    """Files taken once each by a stream into a keyed table; the second part overlaps the first."""
    e = table(spark, d, "events").select("event_id", "event_type", "value", "ts")
    root = fresh(spark, "stream")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in e.schema)
    cut = e.agg(F.expr("percentile_approx(event_id, 0.5)")).first()[0]
    for part in (F.col("event_id") <= cut, F.col("event_id") >= cut - 10):
        e.filter(part).write.mode("append").parquet(f"{root}/in")
        incremental.load_available(spark, f"{root}/in", schema, f"{root}/table", ["event_id"], f"{root}/checkpoint", "ts")
    return VersionedTable(spark, f"{root}/table").read().select("event_id", "event_type", "value")


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, max(value) AS top FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    """Tumbling days with a watermark, as a stream over the table's files, its last state."""
    e = table(spark, d, "events").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    root = fresh(spark, "stream")
    e.repartition(3).write.parquet(f"{root}/in")
    q = incremental.daily_counts(spark.readStream.schema(e.schema).parquet(f"{root}/in"))
    t = VersionedTable(spark, f"{root}/table")
    s = q.writeStream.outputMode("update").foreachBatch(lambda batch, n: t.upsert(batch, ["event_type", "day"])).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    s.awaitTermination()
    return t.read()


# ---- custom aggregates, rendering --------------------------------------------------------------


@query("SELECT o_orderpriority, list_sort(list(DISTINCT o_totalprice), 'DESC')[2] AS second FROM orders GROUP BY 1")
def agg_custom_function(spark, d):
    """The second highest price of each priority by a pandas function, in two phases."""

    def top_two(f):
        f = f.drop_duplicates(["o_orderpriority", "o_totalprice"])
        return f.sort_values("o_totalprice", ascending=False).groupby("o_orderpriority", sort=False).head(2)

    def second(f):
        f = top_two(f)
        return f[["o_orderpriority"]].head(1).assign(second=f["o_totalprice"].iloc[1] if len(f) > 1 else None)

    return R.custom_aggregate(table(spark, d, "orders").select("o_orderpriority", "o_totalprice"), ["o_orderpriority"], top_two, second, "o_orderpriority string, second double")


@query("""WITH g AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS v FROM orders GROUP BY 1)
  SELECT o_custkey, CASE WHEN v >= 1000000 THEN concat(CAST(CAST(round(v / 1000000, 1) AS DECIMAL(20,1)) AS VARCHAR), 'M') WHEN v >= 1000 THEN concat(CAST(CAST(round(v / 1000, 1) AS DECIMAL(20,1)) AS VARCHAR), 'k') ELSE CAST(CAST(round(v, 1) AS DECIMAL(20,1)) AS VARCHAR) END AS shown FROM g""")
def short_numbers(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(S.money(F.col("o_totalprice"))).alias("v"))
    return g.select("o_custkey", S.short_number(F.col("v")).alias("shown"))


@query("""SELECT c_custkey, replace(replace(replace(replace(replace(concat('<', c_name, '> & "', c_mktsegment, '''s"'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') AS escaped FROM customer""")
def xml_escape(spark, d):
    text = F.concat(F.lit("<"), F.col("c_name"), F.lit('> & "'), F.col("c_mktsegment"), F.lit("'s\""))
    return table(spark, d, "customer").select("c_custkey", S.escape_xml(text).alias("escaped"))


@query("""WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), t AS (SELECT *, CAST(n AS DOUBLE) / CAST(max(n) OVER () AS DOUBLE) AS t FROM g)
  SELECT event_type, day, concat('#', printf('%02x', CAST(floor(238 + t * -221 + 0.5) AS BIGINT)), printf('%02x', CAST(floor(238 + t * -170 + 0.5) AS BIGINT)), printf('%02x', CAST(floor(238 + t * -119 + 0.5) AS BIGINT))) AS colour FROM t""")
def colour_scale(spark, d):
    """Cells of a calendar coloured from light to dark by their counts."""
    g = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    top = g.agg(F.max("n").alias("top"))
    t = F.col("n").cast("double") / F.col("top").cast("double")
    return g.crossJoin(F.broadcast(top)).select("event_type", "day", S.blend("#eeeeee", "#114477", t).alias("colour"))  # one row


@query("""WITH g AS (SELECT o_orderpriority, floor(min(o_totalprice)) AS lo, ceil(max(o_totalprice)) AS hi FROM orders GROUP BY 1), s AS (SELECT *, pow(10, floor(log10((hi - lo) / 5))) AS p, (hi - lo) / 5 * (1 - 1e-12) AS least FROM g),
  k AS (SELECT *, CASE WHEN p >= least THEN p WHEN 2 * p >= least THEN 2 * p WHEN 5 * p >= least THEN 5 * p ELSE 10 * p END AS step FROM s)
  SELECT o_orderpriority, unnest(range(CAST(ceil(lo / step - 1e-9) AS BIGINT), CAST(floor(hi / step + 1e-9) AS BIGINT) + 1)) * step AS tick FROM k""")
def axis_ticks(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.floor(F.min("o_totalprice")).cast("double").alias("lo"), F.ceil(F.max("o_totalprice")).cast("double").alias("hi"))
    return D.nice_ticks(g, "lo", "hi").select("o_orderpriority", "tick")


@query("""WITH g AS (SELECT event_type, CAST(ts AS DATE) AS day, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2), l AS (SELECT *, min(v) OVER (PARTITION BY event_type) AS lo, max(v) OVER (PARTITION BY event_type) AS hi FROM g),
  b AS (SELECT event_type, day, substr('▁▂▃▄▅▆▇█', CAST(least(7, floor((v - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END * 7.999)) AS BIGINT) + 1, 1) AS c FROM l) SELECT event_type, string_agg(c, '' ORDER BY day) AS line FROM b GROUP BY 1""")
def sparklines(spark, d):
    g = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).cast("double").alias("v"))
    return D.sparkline(g, "event_type", "day", "v")


@query("""WITH g AS (SELECT c_mktsegment, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, n, n / max(n) OVER () * 260 AS extent FROM g""")
def bar_extents(spark, d):
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return D.bars(g, "c_mktsegment", "n")


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) SELECT kind, CASE WHEN kind = 'line' THEN 1 ELSE (SELECT count(*) FROM g) END AS marks FROM (VALUES ('bar'), ('barh'), ('line'), ('scatter'), ('calendar'), ('text')) AS v(kind)""")
def charts(spark, d):
    """How many marks each kind of chart draws for the customers by segment."""
    g = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).orderBy("c_mktsegment")
    rows = [(r.c_mktsegment, float(r.n)) for r in g.limit(100).collect()]
    points = [(float(i), v) for i, (_, v) in enumerate(rows)]
    marks = {
        "bar": render.bar_chart(rows, "customers").svg().count("<rect"),
        "barh": render.bar_rows_chart(rows, "customers").svg().count("<rect"),
        "line": render.line_chart(points, "customers").svg().count("<polyline"),
        "scatter": render.scatter_chart(points, "customers").svg().count("<circle"),
        "calendar": render.grid_chart([(0, i, v) for i, (_, v) in enumerate(rows)]).svg().count("<rect"),
        "text": len(render.text_bars(rows).split("\n")),
    }
    return spark.createDataFrame(list(marks.items()), "kind string, marks long")


@query("SELECT CAST(o_orderdate AS DATE) AS day, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key FROM orders GROUP BY 1, 2")
def date_key_round_trip(spark, d):
    """A day to its key and back."""
    k = table(spark, d, "orders").select(S.date_key(F.col("o_orderdate")).alias("date_key")).distinct()
    return k.select(F.to_date(F.col("date_key").cast("string"), "yyyyMMdd").alias("day"), "date_key")

