"""Dimensional warehouse over the standard tables: dimensions, facts, slowly changing history,
returns, reconciliation and the questions asked of them."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.functions import scalars as S
from basalt.operators import relational as R
from basalt.sources.tables import REVENUE_SQL, net_revenue, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def dbl(c):
    return c.cast("double")


# ---- dimensions --------------------------------------------------------------------------------

DATE_SQL = """dd AS (SELECT CAST(unnest(generate_series((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(o_orderdate AS DATE)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS full_date)"""


@query(f"""WITH {DATE_SQL} SELECT CAST(strftime(full_date, '%Y%m%d') AS INTEGER) AS date_key, full_date, CAST(year(full_date) AS INTEGER) AS year, CAST(quarter(full_date) AS INTEGER) AS quarter, CAST(month(full_date) AS INTEGER) AS month, strftime(full_date, '%B') AS month_name,
  CAST(day(full_date) AS INTEGER) AS day_of_month, CAST(dayofweek(full_date) AS INTEGER) AS day_of_week, strftime(full_date, '%A') AS day_name, dayofweek(full_date) IN (0, 6) AS is_weekend FROM dd""")
def dim_date(spark, d):
    """Every day from the first to the last order; one row of bounds is exploded, not recursed."""
    day = F.to_date("o_orderdate")
    b = table(spark, d, "orders").agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    t = b.filter("lo is not null").select(F.explode(F.expr("sequence(lo, hi, interval 1 day)")).alias("full_date"))
    c = F.col("full_date")
    return t.select(
        S.date_key(c).alias("date_key"), "full_date", F.year(c).alias("year"), F.quarter(c).alias("quarter"), F.month(c).alias("month"), F.date_format(c, "MMMM").alias("month_name"),
        F.dayofmonth(c).alias("day_of_month"), S.sunday_zero(c).alias("day_of_week"), F.date_format(c, "EEEE").alias("day_name"), S.is_weekend(c).alias("is_weekend"))


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey, c_name, c_mktsegment, n_name AS nation, r_name AS region FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def dim_customer(spark, d):
    t = lambda n: table(spark, d, n)
    j = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    j = R.global_row_number(j, [("c_custkey", False)], "customer_key")
    return j.select("customer_key", "c_custkey", "c_name", "c_mktsegment", F.col("n_name").alias("nation"), F.col("r_name").alias("region"))


@query("SELECT row_number() OVER (ORDER BY p_partkey) AS product_key, p_partkey, p_name, p_brand, p_type AS category, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS list_price FROM part")
def dim_product(spark, d):
    return R.global_row_number(table(spark, d, "part"), [("p_partkey", False)], "product_key").select("product_key", "p_partkey", "p_name", "p_brand", F.col("p_type").alias("category"), dbl(S.money(F.col("p_retailprice"))).alias("list_price"))


# ---- facts -------------------------------------------------------------------------------------

ALL = "l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
GROSS_SQL = "CAST(l_extendedprice AS DECIMAL(12,2))"
FACT_SQL = f"""fact AS (SELECT l_orderkey AS order_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, {ALL}) AS line_no, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS date_key, o_custkey, l_partkey, l_quantity AS quantity, {GROSS_SQL} AS gross,
    {GROSS_SQL} - CAST({REVENUE_SQL} AS DECIMAL(14,2)) AS discount, CAST({REVENUE_SQL} AS DECIMAL(14,2)) AS net, o_orderstatus AS status, l_returnflag, CAST(l_shipdate AS DATE) AS shipped, CAST(o_orderdate AS DATE) AS ordered FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def fact(spark, d) -> DataFrame:
    """Grain: order line, with a derived line number since the given one repeats; amounts in cents."""
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    no = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", *ALL.split(", "))).cast("long")
    lines = lines.withColumns({"line_no": no, "net": net_revenue(), "gross": S.cents(F.col("l_extendedprice"))})
    j = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(
        F.col("l_orderkey").alias("order_id"), "line_no", S.date_key(F.col("o_orderdate")).alias("date_key"), "o_custkey", "l_partkey", F.col("l_quantity").alias("quantity"), "gross",
        (F.col("gross") - F.col("net")).alias("discount"), "net", F.col("o_orderstatus").alias("status"), "l_returnflag", F.to_date("l_shipdate").alias("shipped"), F.to_date("o_orderdate").alias("ordered"))


@query(f"""WITH {FACT_SQL}, c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer), p AS (SELECT row_number() OVER (ORDER BY p_partkey) AS product_key, p_partkey FROM part)
  SELECT order_id, line_no, date_key, customer_key, product_key, quantity, CAST(gross AS DOUBLE) AS gross_amount, CAST(discount AS DOUBLE) AS discount_amount, CAST(net AS DOUBLE) AS net_revenue, status FROM fact JOIN c ON o_custkey = c_custkey JOIN p ON l_partkey = p_partkey""")
def fact_sales(spark, d):
    f = fact(spark, d)
    f = f.join(dim_customer(spark, d).select("customer_key", "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    f = f.join(dim_product(spark, d).select("product_key", "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return f.select("order_id", "line_no", "date_key", "customer_key", "product_key", "quantity", S.amount(F.col("gross")).alias("gross_amount"), S.amount(F.col("discount")).alias("discount_amount"), S.amount(F.col("net")).alias("net_revenue"), "status")


@query(f"WITH {FACT_SQL} SELECT order_id, line_no, CAST(strftime(shipped, '%Y%m%d') AS INTEGER) AS date_key, o_custkey, l_partkey, CAST(ceil(quantity / 2) AS BIGINT) AS quantity, CAST(round(net * CAST(0.5 AS DECIMAL(2,1)), 2) AS DOUBLE) AS refund_amount FROM fact WHERE l_returnflag = 'R'")
def fact_returns(spark, d):
    return returns(fact(spark, d)).select("order_id", "line_no", S.date_key(F.col("returned")).alias("date_key"), "o_custkey", "l_partkey", "quantity", S.amount(F.col("refund")).alias("refund_amount"))


def returns(f: DataFrame) -> DataFrame:
    """Return lines: flagged order lines come back at their shipping date, half of each, rounded up; amounts in cents."""
    return f.filter("l_returnflag = 'R'").select("order_id", "line_no", "o_custkey", "l_partkey", F.col("shipped").alias("returned"), F.ceil(F.col("quantity") / 2).cast("long").alias("quantity"), F.floor((F.col("net") + 1) / 2.0).cast("long").alias("refund"))


# ---- slowly changing history -------------------------------------------------------------------


def versions(events: DataFrame, key: str, at: str, attribute: str, tie: str) -> DataFrame:
    """(key, attribute, valid_from, valid_to, is_current): one version for each change.

    Of several events on one day the last counts; days without a change of the attribute make no
    version; valid_to is the day before the next version, NULL while current.
    """
    last = F.row_number().over(W.partitionBy(key, at).orderBy(F.desc(tie)))
    e = events.withColumn("__r", last).filter("__r = 1").drop("__r")
    w = W.partitionBy(key).orderBy(at)
    e = e.withColumn("__b", F.lag(attribute).over(w)).withColumn("__n", F.row_number().over(w))
    e = e.filter((F.col("__n") == 1) | ~F.col("__b").eqNullSafe(F.col(attribute)))
    nxt = F.lead(at).over(w)
    return e.select(key, attribute, F.col(at).alias("valid_from"), F.date_sub(nxt, 1).alias("valid_to"), nxt.isNull().alias("is_current"))


SCD_SQL = """e0 AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day_at, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) AS r FROM orders),
  e1 AS (SELECT *, lag(priority) OVER (PARTITION BY o_custkey ORDER BY day_at) AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY day_at) AS n FROM e0 WHERE r = 1), e2 AS (SELECT * FROM e1 WHERE n = 1 OR b IS DISTINCT FROM priority),
  scd AS (SELECT o_custkey, priority, day_at AS valid_from, lead(day_at) OVER (PARTITION BY o_custkey ORDER BY day_at) - 1 AS valid_to, lead(day_at) OVER (PARTITION BY o_custkey ORDER BY day_at) IS NULL AS is_current FROM e2)"""


def scd(spark, d) -> DataFrame:
    e = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("at"), F.col("o_orderpriority").alias("priority"), "o_orderkey")
    return versions(e, "o_custkey", "at", "priority", "o_orderkey")


@query(f"WITH {SCD_SQL} SELECT o_custkey, priority, valid_from, valid_to, is_current FROM scd")
def dim_customer_scd(spark, d):
    return scd(spark, d)


@query(f"WITH {SCD_SQL} SELECT count(*) AS versions, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE is_current) AS current_rows, count(*) FILTER (WHERE valid_to < valid_from) AS reversed FROM scd")
def reconcile_scd(spark, d):
    return scd(spark, d).agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("o_custkey").alias("customers"), F.count_if("is_current").alias("current_rows"), F.count_if(F.col("valid_to") < F.col("valid_from")).alias("reversed"))


@query(f"WITH {SCD_SQL} SELECT o_custkey, count(*) AS versions, count(DISTINCT priority) AS kinds FROM scd GROUP BY 1 HAVING count(*) > 1")
def mover_versions(spark, d):
    return scd(spark, d).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("priority").alias("kinds")).filter("versions > 1")


@query(f"WITH {SCD_SQL} SELECT o_custkey, priority, valid_from FROM scd WHERE valid_from <= DATE '1998-06-30' AND (valid_to IS NULL OR valid_to >= DATE '1998-06-30')")
def scd_lookup_at_date(spark, d):
    at = F.lit("1998-06-30").cast("date")
    return scd(spark, d).filter((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))).select("o_custkey", "priority", "valid_from")


def revenue_by_customer_day(spark, d) -> DataFrame:
    """(o_custkey, ordered, net, lines): summed before it meets versions, so that a customer with many
    lines brings one row for each of their days. Lines are summed by order first."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(net_revenue()).alias("net"), F.count(F.lit(1)).alias("lines"))
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("ordered"))
    j = lines.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return j.groupBy("o_custkey", "ordered").agg(F.sum("net").alias("net"), F.sum("lines").alias("lines"))


@query(f"WITH {FACT_SQL}, {SCD_SQL} SELECT priority, CAST(sum(net) AS DOUBLE) AS revenue, count(*) AS lines FROM fact JOIN scd ON fact.o_custkey = scd.o_custkey AND ordered >= valid_from AND (valid_to IS NULL OR ordered <= valid_to) GROUP BY 1")
def join_point_in_time(spark, d):
    j = R.point_in_time(revenue_by_customer_day(spark, d), scd(spark, d), "o_custkey", "ordered")
    return j.groupBy("priority").agg(S.amount(F.sum("net")).alias("revenue"), F.sum("lines").alias("lines"))


@query(f"""WITH {FACT_SQL}, {SCD_SQL}, a AS (SELECT priority, sum(net) AS v FROM fact JOIN scd ON fact.o_custkey = scd.o_custkey AND is_current GROUP BY 1), b AS (SELECT priority, sum(net) AS v FROM fact JOIN scd ON fact.o_custkey = scd.o_custkey AND ordered >= valid_from AND (valid_to IS NULL OR ordered <= valid_to) GROUP BY 1)
  SELECT coalesce(a.priority, b.priority) AS priority, CAST(coalesce(a.v, 0) AS DOUBLE) AS as_current, CAST(coalesce(b.v, 0) AS DOUBLE) AS as_was, CAST(coalesce(a.v, 0) - coalesce(b.v, 0) AS DOUBLE) AS delta FROM a FULL JOIN b ON a.priority = b.priority WHERE abs(coalesce(a.v, 0) - coalesce(b.v, 0)) > 0.005""")
def current_vs_history(spark, d):
    days = revenue_by_customer_day(spark, d)
    was = R.point_in_time(days, scd(spark, d), "o_custkey", "ordered").groupBy("priority").agg(F.sum("net").alias("b"))
    now = scd(spark, d).filter("is_current").select("o_custkey", "priority")
    totals = days.groupBy("o_custkey").agg(F.sum("net").alias("net"))
    a = totals.join(now, "o_custkey").groupBy("priority").agg(F.sum("net").alias("a"))
    zero = F.lit(0).cast("long")
    j = a.join(was, "priority", "full").select("priority", F.coalesce("a", zero).alias("a"), F.coalesce("b", zero).alias("b")).filter("a <> b")
    return j.select("priority", S.amount(F.col("a")).alias("as_current"), S.amount(F.col("b")).alias("as_was"), S.amount(F.col("a") - F.col("b")).alias("delta"))


# ---- returns -----------------------------------------------------------------------------------

RETURNS_SQL = "returned AS (SELECT order_id, line_no, l_partkey, shipped AS returned, CAST(ceil(quantity / 2) AS BIGINT) AS quantity, round(net * CAST(0.5 AS DECIMAL(2,1)), 2) AS refund FROM fact WHERE l_returnflag = 'R')"


@query(f"""WITH {FACT_SQL}, {RETURNS_SQL}, s AS (SELECT strftime(ordered, '%Y-%m') AS month, sum(net) AS v FROM fact WHERE status <> 'P' GROUP BY 1), b AS (SELECT strftime(returned, '%Y-%m') AS month, sum(refund) AS v FROM returned GROUP BY 1)
  SELECT month, CAST(s.v AS DOUBLE) AS sold, CAST(b.v AS DOUBLE) AS refunded, 100 * CAST(b.v AS DOUBLE) / CAST(s.v AS DOUBLE) AS percent FROM s JOIN b USING (month)""")
def refund_rate_month(spark, d):
    f = fact(spark, d)
    s = f.filter("status <> 'P'").groupBy(S.month_key(F.col("ordered")).alias("month")).agg(S.amount(F.sum("net")).alias("sold"))
    b = returns(f).groupBy(S.month_key(F.col("returned")).alias("month")).agg(S.amount(F.sum("refund")).alias("refunded"))
    return s.join(b, "month").withColumn("percent", 100 * F.col("refunded") / F.col("sold"))


@query(f"""WITH {FACT_SQL}, {RETURNS_SQL}, s AS (SELECT p_type, sum(net) AS v FROM fact JOIN part ON l_partkey = p_partkey WHERE status <> 'P' GROUP BY 1), b AS (SELECT p_type, sum(refund) AS v FROM returned JOIN part ON l_partkey = p_partkey GROUP BY 1)
  SELECT p_type, CAST(s.v AS DOUBLE) AS sold, CAST(b.v AS DOUBLE) AS refunded, 100 * CAST(b.v AS DOUBLE) / CAST(s.v AS DOUBLE) AS percent FROM s JOIN b USING (p_type)""")
def refund_rate_category(spark, d):
    f, p = fact(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    s = f.filter("status <> 'P'").join(p, "l_partkey").groupBy("p_type").agg(S.amount(F.sum("net")).alias("sold"))
    b = returns(f).join(p, "l_partkey").groupBy("p_type").agg(S.amount(F.sum("refund")).alias("refunded"))
    return s.join(b, "p_type").withColumn("percent", 100 * F.col("refunded") / F.col("sold"))


@query(f"WITH {FACT_SQL}, {RETURNS_SQL} SELECT count(*) AS lines, CAST(sum(CASE WHEN r.quantity < f.quantity THEN 1 ELSE 0 END) AS BIGINT) AS partly, CAST(sum(CASE WHEN r.quantity >= f.quantity THEN 1 ELSE 0 END) AS BIGINT) AS fully FROM returned r JOIN fact f ON r.order_id = f.order_id AND r.line_no = f.line_no")
def partial_returns(spark, d):
    f = fact(spark, d)
    j = returns(f).select("order_id", "line_no", F.col("quantity").alias("q")).join(f, ["order_id", "line_no"])
    return j.agg(F.count(F.lit(1)).alias("lines"), F.count_if(F.col("q") < F.col("quantity")).alias("partly"), F.count_if(F.col("q") >= F.col("quantity")).alias("fully"))


# ---- checks ------------------------------------------------------------------------------------


@query(f"""WITH {FACT_SQL}, {RETURNS_SQL} SELECT (SELECT count(*) FROM fact) AS fact_lines, (SELECT count(*) FROM lineitem) AS source_lines, (SELECT CAST(sum(net) AS DOUBLE) FROM fact) AS fact_revenue, (SELECT CAST(sum({REVENUE_SQL}) AS DOUBLE) FROM lineitem) AS source_revenue,
  (SELECT sum(net) FROM fact) = (SELECT sum({REVENUE_SQL}) FROM lineitem) AS revenue_agrees, (SELECT count(*) FROM returned) = (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') AS returns_agree""")
def reconcile_sales(spark, d):
    f = fact(spark, d)
    a = f.agg(F.count(F.lit(1)).alias("fact_lines"), F.sum("net").alias("fr"), F.count_if(F.col("l_returnflag") == "R").alias("rr"))
    b = table(spark, d, "lineitem").agg(F.count(F.lit(1)).alias("source_lines"), F.sum(net_revenue()).alias("sr"), F.count_if(F.col("l_returnflag") == "R").alias("sx"))
    return a.crossJoin(b).select("fact_lines", "source_lines", S.amount(F.col("fr")).alias("fact_revenue"), S.amount(F.col("sr")).alias("source_revenue"), (F.col("fr") == F.col("sr")).alias("revenue_agrees"), (F.col("rr") == F.col("sx")).alias("returns_agree"))  # one row each


@query("""SELECT 'lineitem.order' AS reference, (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)) AS orphans UNION ALL SELECT 'lineitem.part', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey))
  UNION ALL SELECT 'orders.customer', (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) UNION ALL SELECT 'customer.nation', (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = c_nationkey))""")
def orphan_keys(spark, d):
    out = None
    for child, key, parent, pk in (("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")):
        c, p = table(spark, d, child).select(key), table(spark, d, parent).select(pk)
        name = f"{child}.{parent.removesuffix('s')}"
        n = c.join(p, c[key] == p[pk], "left_anti").agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("reference"), "orphans")
        out = n if out is None else out.unionByName(n)
    return out


@query(f"""WITH {FACT_SQL}, flat AS (SELECT 'flat' AS model, sum(net) AS v, count(*) AS n FROM fact WHERE year(ordered) = 1997), nf AS (SELECT 'normalised' AS model, sum(net) AS v, count(*) AS n FROM fact JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3 AND year(ordered) = 1997 AND status NOT IN ('P')),
  star AS (SELECT 'star' AS model, sum(net) AS v, count(*) AS n FROM fact JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 3 AND date_key BETWEEN 19970101 AND 19971231 AND status <> 'P')
  SELECT model, CAST(v AS DOUBLE) AS revenue, n FROM flat UNION ALL SELECT model, CAST(v AS DOUBLE), n FROM nf UNION ALL SELECT model, CAST(v AS DOUBLE), n FROM star""")
def three_models(spark, d):
    """One question on a flat table (no status, no place: too high), normalised tables and the star."""
    f = fact(spark, d)
    people = table(spark, d, "customer").join(table(spark, d, "nation").filter("n_regionkey = 3"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey")
    own = f.join(people, F.col("o_custkey") == F.col("c_custkey"))
    year = (F.col("ordered") >= F.lit("1997-01-01").cast("date")) & (F.col("ordered") < F.lit("1998-01-01").cast("date"))
    total = lambda df, name: df.agg(S.amount(F.sum("net")).alias("revenue"), F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("model"), "revenue", "n")
    return total(f.filter(year), "flat").unionByName(total(own.filter(year & ~F.col("status").isin("P")), "normalised")).unionByName(total(own.filter("date_key between 19970101 and 19971231 and status <> 'P'"), "star"))


@query("""WITH flat AS (SELECT o_orderkey, c_custkey, CASE WHEN o_orderkey % 7 = 0 THEN c_mktsegment || '?' ELSE c_mktsegment END AS segment FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT c_custkey, count(DISTINCT segment) AS segments FROM flat GROUP BY 1 HAVING count(DISTINCT segment) > 1""")
def update_anomaly(spark, d):
    """A partial update of a denormalised table leaves customers with two values."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    seg = F.when(F.col("o_orderkey") % 7 == 0, F.concat("c_mktsegment", F.lit("?"))).otherwise(F.col("c_mktsegment"))
    flat = o.join(c, o.o_custkey == c.c_custkey).select("c_custkey", seg.alias("segment"))
    return flat.groupBy("c_custkey").agg(F.countDistinct("segment").alias("segments")).filter("segments > 1")


@dataclass(frozen=True)
class Declared:
    """Columns as DDL, the key, and the columns a table is laid out by."""

    columns: str
    keys: tuple[str, ...]
    partition: tuple[str, ...] = ()


MONEY = "DOUBLE"
TABLES = {
    "dim_date": Declared("date_key INT NOT NULL, full_date DATE, year INT, quarter INT, month INT, month_name STRING, day_of_month INT, day_of_week INT, day_name STRING, is_weekend BOOLEAN", ("date_key",)),
    "dim_customer": Declared("customer_key BIGINT NOT NULL, c_custkey BIGINT, c_name STRING, c_mktsegment STRING, nation STRING, region STRING", ("customer_key",)),
    "dim_product": Declared(f"product_key BIGINT NOT NULL, p_partkey BIGINT, p_name STRING, p_brand STRING, category STRING, list_price {MONEY}", ("product_key",)),
    "dim_customer_scd": Declared("o_custkey BIGINT NOT NULL, priority STRING, valid_from DATE NOT NULL, valid_to DATE, is_current BOOLEAN", ("o_custkey", "valid_from")),
    "fact_sales": Declared(f"order_id BIGINT NOT NULL, line_no BIGINT NOT NULL, date_key INT, customer_key BIGINT, product_key BIGINT, quantity DOUBLE, gross_amount {MONEY}, discount_amount {MONEY}, net_revenue {MONEY}, status STRING, year INT", ("order_id", "line_no"), ("year",)),
    "fact_returns": Declared(f"order_id BIGINT NOT NULL, line_no BIGINT NOT NULL, date_key INT, o_custkey BIGINT, l_partkey BIGINT, quantity BIGINT, refund_amount {MONEY}, year INT", ("order_id", "line_no"), ("year",)),
    "dim_city": Declared("city_key BIGINT NOT NULL, city_name STRING", ("city_key",)),
    "fact_daily": Declared("city_key BIGINT NOT NULL, date_key INT NOT NULL, temp_mean_c DOUBLE, precip_mm DOUBLE, wind_max_kph DOUBLE", ("city_key", "date_key")),
}


def create_tables(spark, path: str) -> dict[str, DataFrame]:
    """The declared tables, empty, as Parquet under ``path``."""
    out = {}
    for name, t in TABLES.items():
        empty = spark.createDataFrame([], t.columns)
        empty.write.mode("overwrite").partitionBy(*t.partition).parquet(f"{path}/{name}")
        out[name] = spark.read.schema(empty.schema).parquet(f"{path}/{name}")
    return out


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns in the declared order and types; a NULL in a key fails the job."""
    t = TABLES[name]
    cols = []
    for c in t.columns.split(", "):
        col, kind = c.split(" ")[:2]
        value = F.col(col).cast(kind)
        if col in t.keys:
            value = F.when(value.isNotNull(), value).otherwise(F.raise_error(F.lit(f"{name}: no {col}")).cast(kind))
        cols.append(value.alias(col))
    return df.select(*cols)


class WarehouseError(ValueError):
    """A reconciliation that does not hold."""


def build(spark, d, path: str) -> dict[str, str]:
    """Write all dimensions and facts to a new folder under ``path``, reconcile what was written, and
    only then let the tables be read there: the result names the folders of this build.

    Facts are partitioned by year, each year in as many files as its rows need. Raises WarehouseError
    instead of publishing numbers that do not agree; ``path/_current`` still names the last good build.
    """
    from basalt.sources.workdir import Files

    files, made = Files(spark), f"{path}/build-{uuid.uuid4().hex[:12]}"
    out = {}
    for name in ("dim_date", "dim_customer", "dim_product", "dim_customer_scd", "fact_sales", "fact_returns"):
        t = QUERIES[name](spark, d)
        if TABLES[name].partition:
            t = t.withColumn("year", F.expr("date_key div 10000").cast("int"))
            t = t.hint("rebalance", "year")  # splits large years, merges small ones
        out[name] = f"{made}/{name}"
        conform(t, name).write.partitionBy(*TABLES[name].partition).parquet(out[name])
    r = reconcile_sales(spark, d).first()
    wrote = spark.read.parquet(out["fact_sales"]).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(S.cents(F.col("net_revenue"))) / 100.0, 2).alias("v")).first()
    s = spark.read.parquet(out["dim_customer_scd"]).agg(F.countDistinct("o_custkey").alias("customers"), F.count_if("is_current").alias("current_rows"), F.count_if(F.col("valid_to") < F.col("valid_from")).alias("reversed")).first()
    if not (r.revenue_agrees and r.returns_agree) or wrote.n != r.source_lines or abs((wrote.v or 0) - (r.source_revenue or 0)) > 0.005:
        raise WarehouseError(f"sales do not reconcile: {r}, written {wrote}")
    if s.current_rows != s.customers or s.reversed:
        raise WarehouseError(f"history does not reconcile: {s}")
    files.write(f"{path}/_current", made)
    return out
