"""Business questions on sales: the retail, warehouse and exploratory query sets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.functions import scalars as S
from basalt.operators import cleaning as C
from basalt.operators import distribution as D
from basalt.operators import relational as R
from basalt.sources.tables import SALES_SQL, order_totals, sales, table

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


def rev():
    return F.sum("revenue")


# ---- retail ------------------------------------------------------------------------------------


@query(f"WITH {SALES_SQL} SELECT n_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def revenue_by_nation_top10(spark, d):
    g = order_totals(spark, d).groupBy("n_name").agg(rev().alias("r"))
    return g.orderBy(F.desc("r"), "n_name").limit(10).select("n_name", S.amount(F.col("r")).alias("revenue"))


@query(f"WITH {SALES_SQL} SELECT l_partkey, p_name, CAST(sum(revenue) AS DOUBLE) AS revenue, CAST(sum(l_quantity) AS BIGINT) AS units FROM sales JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 20")
def top_products(spark, d):
    g = sales(spark, d).groupBy("l_partkey").agg(rev().alias("r"), F.sum("l_quantity").cast("long").alias("units"))
    g = g.orderBy(F.desc("r"), "l_partkey").limit(20)
    p = table(spark, d, "part")
    return g.join(p, g.l_partkey == p.p_partkey).select("l_partkey", "p_name", S.amount(F.col("r")).alias("revenue"), "units")


@query(f"WITH {SALES_SQL} SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1")
def monthly_revenue(spark, d):
    return order_totals(spark, d).groupBy(S.month_key(F.col("o_orderdate")).alias("month")).agg(S.amount(rev()).alias("revenue"))


@query(f"WITH {SALES_SQL} SELECT r_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1")
def revenue_by_region(spark, d):
    return order_totals(spark, d).groupBy("r_name").agg(S.amount(rev()).alias("revenue"))


@query(f"""WITH {SALES_SQL}, g AS (SELECT n_name, strftime(o_orderdate, '%Y-%m') AS month, l_partkey, sum(revenue) AS r FROM sales GROUP BY 1, 2, 3)
  SELECT n_name, month, l_partkey, CAST(r AS DOUBLE) AS revenue, k FROM (SELECT *, row_number() OVER (PARTITION BY n_name, month ORDER BY r DESC, l_partkey) AS k FROM g) WHERE k <= 3""")
def top3_products_nation_month(spark, d):
    g = sales(spark, d).groupBy("n_name", S.month_key(F.col("o_orderdate")).alias("month"), "l_partkey").agg(rev().alias("r"))
    t = R.top_n(g, ["n_name", "month"], [("r", True), ("l_partkey", False)], 3, "k")
    return t.select("n_name", "month", "l_partkey", S.amount(F.col("r")).alias("revenue"), F.col("k").cast("long").alias("k"))


@query(f"""WITH {SALES_SQL}, g AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(revenue) AS r FROM sales GROUP BY 1)
  SELECT month, CAST(sum(r) OVER (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM g""")
def cumulative_revenue(spark, d):
    g = order_totals(spark, d).groupBy(S.month_key(F.col("o_orderdate")).alias("month")).agg(rev().alias("r"))
    return R.running_sum(g, "r", [], [("month", False)], "s").select("month", S.amount(F.col("s")).alias("running"))


@query(f"WITH {SALES_SQL}, g AS (SELECT n_name, sum(revenue) AS r FROM sales GROUP BY 1) SELECT n_name, CAST(r AS DOUBLE) AS revenue, 100 * CAST(r AS DOUBLE) / CAST(sum(r) OVER () AS DOUBLE) AS percent FROM g")
def revenue_share(spark, d):
    g = order_totals(spark, d).groupBy("n_name").agg(rev().alias("r"))
    return R.partition_sum(g, "r", [], "t").select("n_name", S.amount(F.col("r")).alias("revenue"), (100 * S.amount(F.col("r")) / S.amount(F.col("t"))).alias("percent"))


# ---- warehouse questions -----------------------------------------------------------------------

SOLD = "o_orderstatus <> 'P'"


@query(f"""WITH {SALES_SQL} SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders, CAST(sum(revenue) AS DOUBLE) / count(DISTINCT o_orderkey) AS aov FROM sales WHERE {SOLD} GROUP BY 1, 2""")
def monthly_orders_aov(spark, d):
    g = order_totals(spark, d).filter(SOLD).groupBy(F.year("o_orderdate").cast("long").alias("y"), F.month("o_orderdate").cast("long").alias("m"))
    return g.agg(S.amount(rev()).alias("revenue"), F.count(F.lit(1)).alias("orders"), S.ratio(S.amount(rev()), F.count(F.lit(1))).alias("aov"))


@query(f"""WITH {SALES_SQL}, g AS (SELECT p_type, year(o_orderdate) AS y, quarter(o_orderdate) AS q, CAST(sum(revenue) AS DOUBLE) AS r FROM sales JOIN part ON l_partkey = p_partkey WHERE {SOLD} GROUP BY 1, 2, 3)
  SELECT p_type, y, q, r AS revenue, 100 * (r - lag(r) OVER w) / lag(r) OVER w AS growth FROM g WINDOW w AS (PARTITION BY p_type ORDER BY y, q)""")
def category_quarter_growth(spark, d):
    j = sales(spark, d).filter(SOLD).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    g = j.groupBy("p_type", F.year("o_orderdate").cast("long").alias("y"), F.quarter("o_orderdate").cast("long").alias("q")).agg(S.amount(rev()).alias("revenue"))
    before = F.lag("revenue").over(W.partitionBy("p_type").orderBy("y", "q"))
    return g.withColumn("growth", 100 * (F.col("revenue") - before) / before)


@query(f"WITH {SALES_SQL} SELECT c_custkey, c_name, CAST(sum(revenue) AS DOUBLE) AS revenue, count(DISTINCT o_orderkey) AS orders FROM sales WHERE {SOLD} GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 10")
def top10_customers(spark, d):
    g = order_totals(spark, d).filter(SOLD).groupBy("c_custkey", "c_name").agg(rev().alias("r"), F.count(F.lit(1)).alias("orders"))
    return g.orderBy(F.desc("r"), "c_custkey").limit(10).select("c_custkey", "c_name", S.amount(F.col("r")).alias("revenue"), "orders")


@query(f"""WITH {SALES_SQL}, g AS (SELECT CASE WHEN dayofweek(o_orderdate) IN (0, 6) THEN 'weekend' ELSE 'weekday' END AS kind, sum(revenue) AS r FROM sales WHERE {SOLD} GROUP BY 1) SELECT kind, CAST(r AS DOUBLE) AS revenue, 100 * CAST(r AS DOUBLE) / (SELECT CAST(sum(r) AS DOUBLE) FROM g) AS percent FROM g""")
def weekend_share(spark, d):
    g = order_totals(spark, d).filter(SOLD).groupBy(F.when(S.is_weekend(F.col("o_orderdate")), "weekend").otherwise("weekday").alias("kind")).agg(rev().alias("r"))
    return R.partition_sum(g, "r", [], "t").select("kind", S.amount(F.col("r")).alias("revenue"), (100 * S.amount(F.col("r")) / S.amount(F.col("t"))).alias("percent"))


GROSS = "CAST(l_extendedprice AS DECIMAL(12,2))"


@query(f"""WITH {SALES_SQL} SELECT p_type, CAST(sum({GROSS}) AS DOUBLE) AS gross, CAST(sum({GROSS} - revenue) AS DOUBLE) AS leaked, 100 * CAST(sum({GROSS} - revenue) AS DOUBLE) / nullif(CAST(sum({GROSS}) AS DOUBLE), 0) AS percent FROM sales JOIN part ON l_partkey = p_partkey WHERE {SOLD} GROUP BY 1""")
def discount_leakage(spark, d):
    j = sales(spark, d).filter(SOLD).join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    gross = S.cents(F.col("l_extendedprice"))
    g = j.groupBy("p_type").agg(F.sum(gross).alias("g"), F.sum(gross - F.col("revenue")).alias("k"))
    return g.select("p_type", S.amount(F.col("g")).alias("gross"), S.amount(F.col("k")).alias("leaked"), F.try_divide(100 * S.amount(F.col("k")), S.amount(F.col("g"))).alias("percent"))


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderstatus, count(*) AS n, 100.0 * CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY strftime(o_orderdate, '%Y-%m')) AS DOUBLE) AS percent FROM orders GROUP BY 1, 2")
def status_mix_per_month(spark, d):
    g = table(spark, d, "orders").groupBy(S.month_key(F.col("o_orderdate")).alias("month"), "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("percent", 100.0 * dbl(F.col("n")) / dbl(F.sum("n").over(W.partitionBy("month"))))


# ---- exploration -------------------------------------------------------------------------------

RETAIL_SQL = """retail AS (SELECT CASE WHEN l_returnflag = 'R' AND l_linenumber % 2 = 0 THEN 'C' || CAST(l_orderkey AS VARCHAR) ELSE CAST(l_orderkey AS VARCHAR) END AS invoice,
    CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS quantity, CASE WHEN l_linenumber = 7 THEN 0 ELSE round(CAST(l_extendedprice / l_quantity AS DECIMAL(18,6)), 2) END AS price,
    CASE WHEN o_custkey % 10 = 0 THEN NULL ELSE o_custkey END AS customer, o_orderkey, o_orderdate, l_partkey, c_nationkey
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey),
  f0 AS (SELECT *, round(CAST(quantity AS DECIMAL(12,2)) * CAST(price AS DECIMAL(12,2)), 2) AS revenue, starts_with(invoice, 'C') AS is_cancelled FROM retail),
  flagged AS (SELECT *, quantity < 0 AND NOT is_cancelled AS is_writeoff, price > 0 AS is_valid_price, customer IS NOT NULL AS has_customer, NOT is_cancelled AND quantity > 0 AND price > 0 AS is_revenue_safe FROM f0),
  safe AS (SELECT * FROM flagged WHERE is_revenue_safe)"""


def retail(spark, d):
    """Order lines in the shape of raw retail data: signed quantities, C invoices, missing customers."""
    t = lambda n: table(spark, d, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    back = F.col("l_returnflag") == "R"
    code = F.col("l_orderkey").cast("string")
    j = j.select(
        F.when(back & (F.col("l_linenumber") % 2 == 0), F.concat(F.lit("C"), code)).otherwise(code).alias("invoice"),
        F.when(back, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(F.col("l_linenumber") == 7, F.lit(0).cast("decimal(18,2)")).otherwise(F.round((F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,6)"), 2).cast("decimal(18,2)")).alias("price"),
        F.when(F.col("o_custkey") % 10 != 0, F.col("o_custkey")).alias("customer"), "o_orderkey", "o_orderdate", "l_partkey", "c_nationkey")
    return C.flag(j)


def safe(spark, d):
    return C.revenue_safe(retail(spark, d))


@query(f"WITH {RETAIL_SQL} SELECT is_cancelled, is_writeoff, is_valid_price, has_customer, is_revenue_safe, count(*) AS n, CAST(sum(revenue) AS DOUBLE) AS revenue FROM flagged GROUP BY ALL")
def cleaning_flags(spark, d):
    return retail(spark, d).groupBy("is_cancelled", "is_writeoff", "is_valid_price", "has_customer", "is_revenue_safe").agg(F.count(F.lit(1)).alias("n"), dbl(rev()).alias("revenue"))


@query(f"""WITH {RETAIL_SQL}, g AS (SELECT customer, sum(revenue) AS v FROM safe WHERE customer IS NOT NULL GROUP BY 1), p AS (SELECT *, row_number() OVER w AS position, CAST(sum(v) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) AS share, count(*) OVER () AS n FROM g WINDOW w AS (ORDER BY v DESC, customer))
  SELECT max(n) AS customers, min(position) FILTER (WHERE share >= 0.5) AS to_half, max(share) FILTER (WHERE position = greatest(1, n // 10)) AS top_tenth FROM p""")
def customer_pareto(spark, d):
    g = safe(spark, d).filter("customer is not null").groupBy("customer").agg(rev().alias("v"))
    n = g.agg(F.count(F.lit(1)).alias("n"))
    p = D.pareto(g, "customer", "v").crossJoin(F.broadcast(n))  # one row
    return p.agg(F.max("n").alias("customers"), F.min(F.when(F.col("share") >= 0.5, F.col("position").cast("long"))).alias("to_half"), F.max(F.when(F.col("position") == F.greatest(F.lit(1), F.expr("n div 10")), F.col("share"))).alias("top_tenth"))


@query(f"WITH {RETAIL_SQL} SELECT 'month' AS kind, CAST(month(o_orderdate) AS INTEGER) AS k, CAST(sum(revenue) AS DOUBLE) AS revenue FROM safe GROUP BY 2 UNION ALL SELECT 'weekday', CAST((dayofweek(o_orderdate) + 6) % 7 AS INTEGER), CAST(sum(revenue) AS DOUBLE) FROM safe GROUP BY 2")
def seasonality(spark, d):
    s = safe(spark, d)
    one = lambda kind, k: s.groupBy(k.alias("k")).agg(dbl(rev()).alias("revenue")).select(F.lit(kind).alias("kind"), "k", "revenue")
    return one("month", F.month("o_orderdate")).unionByName(one("weekday", F.weekday("o_orderdate")))


@query("SELECT CAST(hour(ts) AS INTEGER) AS hr, count(*) AS n, arg_max(event_type, (c, event_type)) AS busiest FROM (SELECT *, count(*) OVER (PARTITION BY hour(ts), event_type) AS c FROM events) GROUP BY 1")
def hourly_profile(spark, d):
    g = table(spark, d, "events").groupBy(F.hour("ts").alias("hr"), "event_type").agg(F.count(F.lit(1)).alias("c"))
    return g.groupBy("hr").agg(F.sum("c").alias("n"), F.max_by("event_type", F.struct("c", "event_type")).alias("busiest"))


@query(f"""WITH {RETAIL_SQL} SELECT CAST(coalesce(sum(abs(revenue)) FILTER (WHERE is_cancelled), 0) AS DOUBLE) AS refunds, count(*) FILTER (WHERE is_writeoff) AS writeoffs, CAST(coalesce(sum(abs(quantity)) FILTER (WHERE is_writeoff), 0) AS BIGINT) AS units_off, CAST(sum(revenue) FILTER (WHERE is_revenue_safe) AS DOUBLE) AS gross,
  100 * CAST(coalesce(sum(abs(revenue)) FILTER (WHERE is_cancelled), 0) AS DOUBLE) / CAST(sum(revenue) FILTER (WHERE is_revenue_safe) AS DOUBLE) AS percent FROM flagged""")
def refunds_and_writeoffs(spark, d):
    r = retail(spark, d)
    refund = dbl(S.sum0(F.when(F.col("is_cancelled"), F.abs("revenue"))))
    gross = dbl(F.sum(F.when(F.col("is_revenue_safe"), F.col("revenue"))))
    return r.agg(refund.alias("refunds"), F.count_if("is_writeoff").alias("writeoffs"), S.sum0(F.when(F.col("is_writeoff"), F.abs("quantity"))).cast("long").alias("units_off"), gross.alias("gross"), (100 * refund / gross).alias("percent"))


@query(f"""WITH {RETAIL_SQL}, r AS (SELECT l_partkey, CAST(sum(abs(quantity)) AS BIGINT) AS units FROM flagged WHERE is_cancelled GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT l_partkey, units, p_name FROM r JOIN part ON l_partkey = p_partkey""")
def most_returned(spark, d):
    g = retail(spark, d).filter("is_cancelled").groupBy("l_partkey").agg(F.sum(F.abs("quantity")).cast("long").alias("units")).orderBy(F.desc("units"), "l_partkey").limit(10)
    return g.join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_partkey", "units", "p_name")


@query(f"""WITH {RETAIL_SQL}, b AS (SELECT invoice, CAST(sum(revenue) AS DOUBLE) AS v FROM safe GROUP BY 1) SELECT count(*) AS n, CAST(round(avg(v), 4) AS DOUBLE) AS mean, median(v) AS med, quantile_cont(v, 0.99) AS p99 FROM b""")
def basket_distribution(spark, d):
    b = safe(spark, d).groupBy("invoice").agg(dbl(rev()).alias("v"))
    one = b.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 4).alias("mean"))
    return one.join(F.broadcast(D.quantiles(b, "v", {"med": 0.5, "p99": 0.99})), F.lit(True), "left")  # one row each


@query(f"""WITH {RETAIL_SQL}, b AS (SELECT invoice, CAST(sum(revenue) AS DOUBLE) AS v FROM safe GROUP BY 1), q AS (SELECT quantile_cont(v, 0.99) AS p FROM b), c AS (SELECT CASE WHEN v > p THEN p ELSE v END AS v FROM b, q), m AS (SELECT min(v) AS lo, max(v) AS hi FROM c)
  SELECT CAST(least(29, floor((v - lo) / ((hi - lo) / 30))) AS INTEGER) AS bin, count(*) AS n FROM c, m GROUP BY 1""")
def basket_histogram(spark, d):
    b = safe(spark, d).groupBy("invoice").agg(dbl(rev()).alias("v"))
    top = D.quantiles(b, "v", {"p": 0.99})
    return D.histogram(b.crossJoin(F.broadcast(top)).select(S.clip_upper(F.col("v"), F.col("p")).alias("v")), "v", 30, flat=29)  # one row; SQL has equal values in the last bin


@query(f"""WITH {RETAIL_SQL}, t AS (SELECT n_name, CAST(coalesce(sum(revenue) FILTER (WHERE month(o_orderdate) <= 6), 0) AS DOUBLE) AS first, CAST(coalesce(sum(revenue) FILTER (WHERE month(o_orderdate) > 6), 0) AS DOUBLE) AS second FROM safe JOIN nation ON c_nationkey = n_nationkey GROUP BY 1) SELECT *, (second - first) / greatest(first, 1.0) AS change FROM t""")
def half_year_slope(spark, d):
    j = safe(spark, d).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return D.slope(j, "n_name", "revenue", F.month("o_orderdate") > 6)


@query(f"""WITH {RETAIL_SQL}, g AS (SELECT n_name, sum(revenue) AS v FROM safe JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), k AS (SELECT CASE WHEN row_number() OVER (ORDER BY v DESC, n_name) <= 5 THEN n_name ELSE 'Rest' END AS n_name, v FROM g), h AS (SELECT n_name, sum(v) AS v FROM k GROUP BY 1),
  s AS (SELECT n_name, CAST(v AS DOUBLE) / CAST(sum(CAST(v AS DOUBLE)) OVER (ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS DOUBLE) * 100 AS s FROM h), r AS (SELECT *, floor(s) AS f, row_number() OVER (ORDER BY s - floor(s) DESC, n_name) AS k, 100 - sum(floor(s)) OVER () AS remaining FROM s)
  SELECT n_name, CAST(f + CASE WHEN k <= remaining THEN 1 ELSE 0 END AS INTEGER) AS cells FROM r""")
def region_waffle(spark, d):
    g = safe(spark, d).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(rev().alias("v"))
    return D.waffle(R.fold_rest(g, "n_name", "v", 5), "n_name", "v")


@query(f"""WITH {RETAIL_SQL}, m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, sum(revenue) AS v, count(DISTINCT CAST(o_orderdate AS DATE)) AS days FROM safe GROUP BY 1), y AS (SELECT CAST(o_orderdate AS DATE) AS day, sum(revenue) AS v FROM safe GROUP BY 1)
  SELECT (SELECT arg_max(month, (v, month)) FROM m) AS best_month, (SELECT arg_max(days, (v, month)) FROM m) AS days_in_it, (SELECT arg_max(day, (v, day)) FROM y) AS best_day, (SELECT count(DISTINCT customer) FROM safe) AS customers, (SELECT count(DISTINCT invoice) FROM safe) AS invoices, (SELECT CAST(sum(revenue) AS DOUBLE) FROM safe) AS gross""")
def exploration_metrics(spark, d):
    s = safe(spark, d)
    m = s.groupBy(S.month_key(F.col("o_orderdate")).alias("month")).agg(rev().alias("v"), F.countDistinct(F.to_date("o_orderdate")).alias("days"))
    y = s.groupBy(F.to_date("o_orderdate").alias("day")).agg(rev().alias("v"))
    a = m.agg(F.max_by("month", F.struct("v", "month")).alias("best_month"), F.max_by("days", F.struct("v", "month")).alias("days_in_it"))
    b = y.agg(F.max_by("day", F.struct("v", "day")).alias("best_day"))
    c = s.agg(F.countDistinct("customer").alias("customers"), F.countDistinct("invoice").alias("invoices"), dbl(rev()).alias("gross"))
    return a.crossJoin(b).crossJoin(c)  # one row each


@query(f"""WITH {RETAIL_SQL} SELECT invoice IS NULL AS no_invoice, count(*) AS n, count(*) FILTER (WHERE customer IS NULL) AS no_customer, count(*) FILTER (WHERE quantity < 0) AS negative, count(*) FILTER (WHERE is_cancelled) AS cancelled FROM flagged GROUP BY 1""")
def retail_quality(spark, d):
    return retail(spark, d).groupBy(F.col("invoice").isNull().alias("no_invoice")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("customer").isNull()).alias("no_customer"), F.count_if(F.col("quantity") < 0).alias("negative"), F.count_if("is_cancelled").alias("cancelled"))
