"""One query per relational, scalar and distribution operator, with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.functions import scalars as S
from basalt.operators import distribution as D
from basalt.operators import relational as R
from basalt.sources.tables import REVENUE_SQL, SALES_SQL, net_revenue, order_totals, table

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function under its name with the SQL it is held against."""

    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return keep


def dbl(c):
    return c.cast("double")


# ---- scan, project, filter ---------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders")
def scan_orders_project(spark, d):
    return R.project(table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def where_half_open_range(spark, d):
    day = F.col("o_orderdate")
    return R.where(table(spark, d, "orders"), (day >= F.lit("1996-01-01").cast("timestamp")) & (day < F.lit("1997-01-01").cast("timestamp"))).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%E%' AND p_name LIKE '%a%'")
def where_like(spark, d):
    return table(spark, d, "part").filter(F.col("p_type").like("%E%") & F.col("p_name").like("%a%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')")
def where_in_not_in(spark, d):
    return table(spark, d, "orders").filter(F.col("o_orderstatus").isin("F", "O") & ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity BETWEEN 10 AND 12 AND l_shipdate IS NOT NULL")
def where_between_null(spark, d):
    return table(spark, d, "lineitem").filter(F.col("l_quantity").between(10, 12) & F.col("l_shipdate").isNotNull()).select("l_orderkey", "l_linenumber", "l_quantity")


@query(f"SELECT l_orderkey, l_linenumber, CAST({REVENUE_SQL} AS DOUBLE) AS revenue FROM lineitem")
def extend_revenue(spark, d):
    return R.extend(table(spark, d, "lineitem"), "revenue", S.amount(net_revenue())).select("l_orderkey", "l_linenumber", "revenue")


@query("""SELECT CASE WHEN l_quantity < 10 THEN 'small' WHEN l_quantity < 30 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n,
  CASE l_returnflag WHEN 'R' THEN 'returned' WHEN 'A' THEN 'accepted' ELSE 'none' END AS flag FROM lineitem GROUP BY ALL""")
def case_bucket(spark, d):
    q = F.col("l_quantity")
    size = F.when(q < 10, "small").when(q < 30, "medium").otherwise("large")
    flag = F.when(F.col("l_returnflag") == "R", "returned").when(F.col("l_returnflag") == "A", "accepted").otherwise("none")
    return table(spark, d, "lineitem").groupBy(size.alias("bucket"), flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer")
def distinct_nations(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct()


@query("""SELECT count(*) AS n, count(*) FILTER (WHERE l_shipdate IS NULL) AS null_dates, count(*) FILTER (WHERE CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END < 0) AS negative,
  count(*) FILTER (WHERE starts_with(CASE WHEN l_returnflag = 'R' THEN concat('C', CAST(l_orderkey AS VARCHAR)) ELSE CAST(l_orderkey AS VARCHAR) END, 'C')) AS cancelled, count(DISTINCT l_orderkey) AS invoices,
  min(l_shipdate) AS first_day, max(l_shipdate) AS last_day FROM lineitem""")
def dq_checks(spark, d):
    code = F.when(F.col("l_returnflag") == "R", F.concat(F.lit("C"), F.col("l_orderkey").cast("string"))).otherwise(F.col("l_orderkey").cast("string"))
    signed = F.when(F.col("l_returnflag") == "R", -F.col("l_quantity")).otherwise(F.col("l_quantity"))
    return table(spark, d, "lineitem").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_shipdate").isNull()).alias("null_dates"), F.count_if(signed < 0).alias("negative"),
        F.count_if(code.startswith("C")).alias("cancelled"), F.countDistinct("l_orderkey").alias("invoices"), F.min("l_shipdate").alias("first_day"), F.max("l_shipdate").alias("last_day"))


@query("""SELECT e.event_id, e.event_type, e.value FROM events e WHERE e.value > (SELECT avg(CAST(value AS DECIMAL(18,6))) FROM events)""")
def where_scalar_subquery(spark, d):
    e = table(spark, d, "events")
    mean = e.agg(F.avg(F.col("value").cast("decimal(18,6)")).cast("double").alias("mean"))
    return e.crossJoin(F.broadcast(mean)).filter("value > mean").select("event_id", "event_type", "value")  # one row


@query("""WITH a AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS spent FROM orders GROUP BY 1), b AS (SELECT * FROM a WHERE spent > 1000000)
  SELECT c_mktsegment, count(*) AS n FROM b JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def cte_chain(spark, d):
    table(spark, d, "orders").createOrReplaceTempView("basalt_orders")
    table(spark, d, "customer").createOrReplaceTempView("basalt_customer")
    return spark.sql("""WITH a AS (SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS spent FROM basalt_orders GROUP BY 1), b AS (SELECT * FROM a WHERE spent > 1000000)
      SELECT c_mktsegment, count(*) AS n FROM b JOIN basalt_customer ON o_custkey = c_custkey GROUP BY 1 ORDER BY 2""")


# ---- joins -------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return R.join(table(spark, d, "orders"), table(spark, d, "customer"), "o_custkey", "c_custkey").select("o_orderkey", "c_name")


@query("SELECT o_orderkey, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_orderkey) = 0 OR count(l_orderkey) > 8")
def join_left_unmatched(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    j = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return j.select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n_lines")).filter("n_lines = 0 or n_lines > 8")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
def join_left_extra_on(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    return c.join(o, (c.c_custkey == o.o_custkey) & (o.o_orderstatus == "P"), "left").select("c_custkey", "o_orderkey")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2)
  SELECT l.l_orderkey, l.l_linenumber, count(*) AS lines, max(r.n) AS returned FROM lineitem l JOIN r ON l.l_orderkey = r.l_orderkey AND l.l_linenumber = r.l_linenumber GROUP BY 1, 2""")
def join_composite_key(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    r = lines.filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))
    return lines.join(r, ["l_orderkey", "l_linenumber"]).groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("lines"), F.max("n").alias("returned"))


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 5000 GROUP BY 1), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 5000 GROUP BY 1)
  SELECT coalesce(a.k, b.k) AS nationkey, coalesce(a.n, 0) AS customers, coalesce(b.n, 0) AS suppliers FROM a FULL JOIN b ON a.k = b.k WHERE abs(coalesce(a.n, 0) - coalesce(b.n, 0)) > 1""")
def join_full_outer_diff(spark, d):
    a = table(spark, d, "customer").filter("c_acctbal > 5000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("a"))
    b = table(spark, d, "supplier").filter("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, "k", "full").select(F.col("k").alias("nationkey"), F.coalesce("a", F.lit(0)).alias("customers"), F.coalesce("b", F.lit(0)).alias("suppliers"))
    return j.filter(F.abs(F.col("customers") - F.col("suppliers")) > 1)


@query("""WITH l AS (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS k FROM orders), r AS (SELECT nullif(s, 'P') AS k, w FROM (VALUES ('F', 1), ('O', 2), ('P', 3)) AS v(s, w))
  SELECT o_orderkey, l.k AS k, w FROM l JOIN r ON l.k IS NOT DISTINCT FROM r.k""")
def join_null_safe(spark, d):
    left = table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("k"))
    right = spark.createDataFrame([("F", 1), ("O", 2), (None, 3)], "k string, w int")
    return R.join(left, right, "k", "k").select("o_orderkey", "k", "w")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def anti_not_in(spark, d):
    p = table(spark, d, "orders").filter("o_orderstatus = 'P'").select("o_custkey")
    c = table(spark, d, "customer")
    return c.join(p, c.c_custkey == p.o_custkey, "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def semi_exists(spark, d):
    o, r = table(spark, d, "orders"), table(spark, d, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return o.join(r, o.o_orderkey == r.l_orderkey, "left_semi").select("o_orderkey")


@query("""SELECT c_custkey, c_name, n, CAST(spent AS DOUBLE) AS spent FROM customer JOIN (SELECT o_custkey, count(*) AS n, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey WHERE n >= 5""")
def join_agg_subquery(spark, d):
    a = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), dbl(F.sum(S.money(F.col("o_totalprice")))).alias("spent"))
    c = table(spark, d, "customer")
    return c.join(a.filter("n >= 5"), c.c_custkey == a.o_custkey).select("c_custkey", "c_name", "n", "spent")


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders JOIN (SELECT o_custkey AS k, min(o_orderdate) AS first FROM orders GROUP BY 1) ON o_custkey = k AND o_orderdate = first""")
def first_event_self_join(spark, d):
    o = table(spark, d, "orders")
    return o.withColumn("r", F.rank().over(W.partitionBy("o_custkey").orderBy("o_orderdate"))).filter("r = 1").select("o_custkey", "o_orderkey", "o_orderdate")


@query("""WITH m AS (SELECT * FROM (VALUES ('F', 'finished'), ('O', 'open')) AS v(k, label)) SELECT label, count(*) AS n FROM orders JOIN m ON o_orderstatus = k GROUP BY label""")
def map_lookup_region(spark, d):
    m = spark.createDataFrame([("F", "finished"), ("O", "open")], "o_orderstatus string, label string")
    return table(spark, d, "orders").join(F.broadcast(m), "o_orderstatus").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SALES_SQL}, t AS (SELECT r_name, CAST(coalesce(sum(CASE WHEN month(o_orderdate) <= 6 THEN revenue END), 0) AS DOUBLE) AS h1, CAST(coalesce(sum(CASE WHEN month(o_orderdate) > 6 THEN revenue END), 0) AS DOUBLE) AS h2 FROM sales GROUP BY 1)
  SELECT *, h1 + h2 AS total FROM t""")
def outer_align_halves(spark, d):
    s = order_totals(spark, d)
    late = F.month("o_orderdate") > 6
    return s.groupBy("r_name").agg(S.amount(S.sum0(F.when(~late, F.col("revenue")))).alias("h1"), S.amount(S.sum0(F.when(late, F.col("revenue")))).alias("h2")).withColumn("total", F.col("h1") + F.col("h2"))


# ---- aggregation -------------------------------------------------------------------------------


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) / count(l_quantity) AS mean_qty, min(l_quantity) AS min_qty, max(l_quantity) AS max_qty FROM lineitem GROUP BY 1, 2""")
def agg_all_basic(spark, d):
    total = dbl(F.sum(S.money(F.col("l_quantity"))))
    return R.group_by(table(spark, d, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": F.count(F.lit(1)), "sum_qty": total, "mean_qty": total / F.count("l_quantity"), "min_qty": F.min("l_quantity"), "max_qty": F.max("l_quantity")})


@query("SELECT o_orderstatus, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END), 0) AS DOUBLE) AS total FROM orders GROUP BY 1")
def agg_sum_zero_on_null(spark, d):
    v = F.when(F.col("o_orderstatus") != "P", S.money(F.col("o_totalprice")))
    return table(spark, d, "orders").groupBy("o_orderstatus").agg(dbl(S.sum0(v)).alias("total"))


@query("SELECT l_returnflag, count(DISTINCT l_orderkey) AS orders, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def agg_count_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("l_partkey").alias("parts"))


@query("SELECT year(o_orderdate) AS y, count(*) FILTER (WHERE o_orderstatus = 'F') AS finished, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN CAST(o_totalprice AS DECIMAL(12,2)) ELSE 0 END) AS DOUBLE) AS open_total FROM orders GROUP BY 1")
def agg_conditional(spark, d):
    zero = F.lit(0).cast("decimal(12,2)")
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").cast("long").alias("y")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("finished"), dbl(F.sum(F.when(F.col("o_orderstatus") == "O", S.money(F.col("o_totalprice"))).otherwise(zero))).alias("open_total"))


@query("SELECT o_orderpriority, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.99) AS p99 FROM orders GROUP BY 1")
def agg_median_p99(spark, d):
    return D.quantiles(table(spark, d, "orders"), "o_totalprice", {"med": 0.5, "p99": 0.99}, by=["o_orderpriority"])


@query("SELECT count(l_quantity) AS n, avg(l_quantity) AS mean, round(stddev_samp(l_quantity), 6) AS std, min(l_quantity) AS least, quantile_cont(l_quantity, 0.25) AS p25, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, max(l_quantity) AS greatest FROM lineitem")
def agg_describe(spark, d):
    return D.describe(table(spark, d, "lineitem"), "l_quantity").withColumn("std", F.round("std", 6))


@query("SELECT p_type, arg_min(nullif(p_brand, 'Brand#11'), p_partkey) FILTER (WHERE nullif(p_brand, 'Brand#11') IS NOT NULL) AS first_brand FROM part GROUP BY 1")
def agg_first_non_null(spark, d):
    b = F.nullif(F.col("p_brand"), F.lit("Brand#11"))
    return table(spark, d, "part").groupBy("p_type").agg(F.min_by(b, F.when(b.isNotNull(), F.col("p_partkey"))).alias("first_brand"))


@query("SELECT event_type, arg_max(event_id, (value, -event_id)) AS best, max(value) AS top FROM events GROUP BY 1")
def agg_max_by(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max_by("event_id", F.struct("value", -F.col("event_id"))).alias("best"), F.max("value").alias("top"))


@query("""WITH a AS (SELECT c_nationkey AS k, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS t FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)
  SELECT r_name, CAST(sum(t) AS DOUBLE) AS total, count(*) AS nations FROM a JOIN nation ON k = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1""")
def agg_two_stage_region(spark, d):
    t = lambda n: table(spark, d, n)
    per = t("orders").groupBy("o_custkey").agg(F.sum(S.money(F.col("o_totalprice"))).alias("t"))
    per = per.join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.sum("t").alias("t"))
    j = per.join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name").agg(dbl(F.sum("t")).alias("total"), F.count(F.lit(1)).alias("nations"))


@query(f"WITH {SALES_SQL} SELECT n_name, CAST(sum(revenue) AS DOUBLE) AS revenue FROM sales GROUP BY 1 HAVING sum(revenue) > 100000")
def having_threshold(spark, d):
    return order_totals(spark, d).groupBy("n_name").agg(S.amount(F.sum("revenue")).alias("revenue")).filter("revenue > 100000")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY o_orderstatus) AS BIGINT) AS of_status FROM orders GROUP BY 1, 2")
def agg_over_agg(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("of_status", F.sum("n").over(W.partitionBy("o_orderstatus")))


@query("SELECT l_returnflag, CAST(sum(abs(CASE WHEN l_returnflag = 'R' THEN -CAST(l_quantity AS DECIMAL(12,2)) ELSE CAST(l_quantity AS DECIMAL(12,2)) END)) AS DOUBLE) AS units FROM lineitem GROUP BY 1")
def agg_abs_sum(spark, d):
    q = S.money(F.col("l_quantity"))
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(dbl(F.sum(F.abs(F.when(F.col("l_returnflag") == "R", -q).otherwise(q)))).alias("units"))


@query("SELECT o_custkey, max(c_name) AS name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def agg_any_value_guard(spark, d):
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    return o.join(c, o.o_custkey == c.c_custkey).groupBy("o_custkey").agg(F.max("c_name").alias("name"), F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, CASE WHEN count(*) FILTER (WHERE value < 0) = 0 THEN NULL ELSE CAST(count(*) AS DOUBLE) / count(*) FILTER (WHERE value < 0) END AS safe FROM events GROUP BY 1")
def agg_safe_ratio(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(S.ratio(F.count(F.lit(1)), F.count_if(F.col("value") < 0)).alias("safe"))


@query("SELECT nullif(o_orderstatus, 'P') AS k, count(*) AS n FROM orders WHERE nullif(o_orderstatus, 'P') IS NOT NULL GROUP BY 1")
def agg_drop_null_keys(spark, d):
    k = F.nullif(F.col("o_orderstatus"), F.lit("P"))
    return table(spark, d, "orders").select(k.alias("k")).filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(12,2))) AS DOUBLE) - CAST(min(l_quantity) AS DOUBLE) AS spread FROM lineitem GROUP BY 1")
def agg_custom(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg((dbl(F.sum(S.money(F.col("l_quantity")))) - F.min("l_quantity")).alias("spread"))


# ---- windows -----------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey) AS row_num FROM orders")
def win_row_number(spark, d):
    t = R.row_number(table(spark, d, "orders"), ["o_custkey"], [("o_totalprice", True), ("o_orderkey", False)])
    return t.select("o_custkey", "o_orderkey", F.col("row_num").cast("long").alias("row_num"))


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders")
def win_rank(spark, d):
    return R.rank(table(spark, d, "orders"), ["o_custkey"], [("o_orderpriority", False)], "r").select("o_orderkey", F.col("r").cast("long").alias("r"))


@query("SELECT o_orderkey, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS r FROM orders")
def win_dense_rank(spark, d):
    return R.dense_rank(table(spark, d, "orders"), ["o_custkey"], [("o_orderpriority", False)], "r").select("o_orderkey", F.col("r").cast("long").alias("r"))


@query("""SELECT o_orderkey, CAST(sum(coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_totalprice AS DECIMAL(12,2)) END, 0)) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS running FROM orders""")
def win_running_rows(spark, d):
    o = table(spark, d, "orders").withColumn("v", F.when(F.col("o_orderstatus") != "P", S.money(F.col("o_totalprice"))))
    return R.running_sum(o, "v", ["o_custkey"], [("o_orderdate", False), ("o_orderkey", False)], "s").select("o_orderkey", dbl(F.col("s")).alias("running"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS DOUBLE) AS running FROM orders")
def win_running_range(spark, d):
    w = W.partitionBy("o_custkey").orderBy("o_orderpriority")
    return table(spark, d, "orders").select("o_orderkey", dbl(F.sum(S.money(F.col("o_totalprice"))).over(w)).alias("running"))


@query("SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey) AS DOUBLE) AS total FROM orders")
def win_partition_sum(spark, d):
    o = table(spark, d, "orders").withColumn("v", S.money(F.col("o_totalprice")))
    return R.partition_sum(o, "v", ["o_custkey"], "t").select("o_orderkey", dbl(F.col("t")).alias("total"))


@query("SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) / CAST(sum(sum(CAST(o_totalprice AS DECIMAL(12,2)))) OVER () AS DOUBLE) AS share FROM orders GROUP BY 1")
def win_grand_total_share(spark, d):
    g = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.sum(S.money(F.col("o_totalprice"))).alias("v"))
    return R.partition_sum(g, "v", [], "t").select("o_orderpriority", (dbl(F.col("v")) / dbl(F.col("t"))).alias("share"))


@query("""WITH q AS (SELECT year(o_orderdate) * 10 + quarter(o_orderdate) AS q, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS v FROM orders GROUP BY 1)
  SELECT q, CAST(v AS DOUBLE) AS v, CAST(v AS DOUBLE) / CAST(lag(v) OVER (ORDER BY q) AS DOUBLE) - 1 AS growth FROM q""")
def win_lag_growth(spark, d):
    q = (F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("long")
    g = table(spark, d, "orders").groupBy(q.alias("q")).agg(dbl(F.sum(S.money(F.col("o_totalprice")))).alias("v"))
    return g.select("q", "v", (F.col("v") / F.lag("v").over(W.orderBy("q")) - 1).alias("growth"))


@query("SELECT o_orderkey, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next_date FROM orders")
def win_lead_versions(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.lead("o_orderdate").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next_date"))


@query("SELECT * FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3")
def topn_per_group(spark, d):
    t = R.top_n(table(spark, d, "orders"), ["o_custkey"], [("o_totalprice", True), ("o_orderkey", False)], 3, "n")
    return t.select("o_custkey", "o_orderkey", F.col("n").cast("long").alias("n"))


@query("""WITH g AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS v FROM orders GROUP BY 1)
  SELECT o_custkey, CAST(v AS DOUBLE) AS v, row_number() OVER (ORDER BY v DESC, o_custkey) AS position, CAST(sum(v) OVER (ORDER BY v DESC, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(sum(v) OVER () AS DOUBLE) AS share FROM g""")
def pareto_cumulative(spark, d):
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.sum(S.money(F.col("o_totalprice"))).alias("v"))
    return D.pareto(g, "o_custkey", "v").select("o_custkey", dbl(F.col("v")).alias("v"), F.col("position").cast("long").alias("position"), "share")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS customer_key, c_custkey FROM customer")
def win_surrogate_key(spark, d):
    return R.global_row_number(table(spark, d, "customer").select("c_custkey"), [("c_custkey", False)], "customer_key")


@query("""WITH g AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2) SELECT p_type, p_size, n, row_number() OVER w AS rn, rank() OVER (PARTITION BY p_type ORDER BY n DESC) AS rk, dense_rank() OVER (PARTITION BY p_type ORDER BY n DESC) AS dr
  FROM g WINDOW w AS (PARTITION BY p_type ORDER BY n DESC, p_size)""")
def rank_tie_demo(spark, d):
    g = table(spark, d, "part").groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy("p_type").orderBy(F.desc("n"))
    return g.select("p_type", "p_size", "n", F.row_number().over(W.partitionBy("p_type").orderBy(F.desc("n"), "p_size")).cast("long").alias("rn"), F.rank().over(w).cast("long").alias("rk"), F.dense_rank().over(w).cast("long").alias("dr"))


# ---- sort, limit, sets -------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def topk_orders(spark, d):
    return R.limit(R.order_by(table(spark, d, "orders"), [("o_totalprice", True), ("o_orderkey", False)]), 25).select("o_orderkey", "o_totalprice")


def _nullable(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderpriority"), F.lit("3-MEDIUM")).alias("v"))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderpriority, '3-MEDIUM') NULLS LAST, o_orderkey) AS pos FROM orders")
def order_nulls_asc(spark, d):
    return R.global_row_number(_nullable(spark, d), [("v", False), ("o_orderkey", False)], "pos").select("o_orderkey", "pos")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_orderpriority, '3-MEDIUM') DESC NULLS FIRST, o_orderkey) AS pos FROM orders")
def order_nulls_desc(spark, d):
    return R.global_row_number(_nullable(spark, d), [("v", True), ("o_orderkey", False)], "pos").select("o_orderkey", "pos")


@query("SELECT n_name, n_regionkey, row_number() OVER (ORDER BY abs(n_regionkey - 2) DESC, n_name) AS pos FROM nation")
def multi_key_sort(spark, d):
    return table(spark, d, "nation").select("n_name", "n_regionkey", F.row_number().over(W.orderBy(F.desc(F.abs(F.col("n_regionkey") - 2)), "n_name")).cast("long").alias("pos"))


@query("SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS at FROM orders UNION ALL SELECT 'event', event_id, ts FROM events")
def union_all_events(spark, d):
    o = table(spark, d, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("at"))
    return o.unionByName(table(spark, d, "events").select(F.lit("event").alias("kind"), F.col("event_id").alias("id"), F.col("ts").alias("at")))


@query("""WITH g AS (SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, n_name) AS k FROM g)
  SELECT CASE WHEN k <= 5 THEN n_name ELSE 'Rest' END AS n_name, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def fold_rest_top5(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))
    return R.fold_rest(c, "n_name", "n", 5)


# ---- scalars -----------------------------------------------------------------------------------


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS day_key, count(*) AS n FROM orders GROUP BY 1, 2")
def month_key(spark, d):
    return table(spark, d, "orders").groupBy(S.month_key(F.col("o_orderdate")).alias("month"), S.date_key(F.col("o_orderdate")).alias("day_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(dayofweek(ts) AS INTEGER) AS dow, CAST(hour(ts) AS INTEGER) AS hr, count(*) AS n, dayofweek(ts) IN (0, 6) AS weekend FROM events GROUP BY ALL")
def dow_hour_profile(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").groupBy(S.sunday_zero(ts).alias("dow"), F.hour(ts).alias("hr"), S.is_weekend(ts).alias("weekend")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(year(o_orderdate) AS VARCHAR) || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR) AS q, strftime(o_orderdate, '%B') AS month_name, strftime(o_orderdate, '%A') AS day_name, count(*) AS n FROM orders GROUP BY 1, 2, 3")
def quarter_label(spark, d):
    day = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy(S.quarter_label(day).alias("q"), F.date_format(day, "MMMM").alias("month_name"), F.date_format(day, "EEEE").alias("day_name")).agg(F.count(F.lit(1)).alias("n"))


@query("WITH q AS (SELECT quantile_cont(o_totalprice, 0.99) AS p FROM orders) SELECT o_orderkey, CASE WHEN o_totalprice > p THEN p ELSE o_totalprice END AS clipped FROM orders, q")
def clip_p99(spark, d):
    o = table(spark, d, "orders")
    top = D.quantiles(o, "o_totalprice", {"p": 0.99})
    return o.crossJoin(F.broadcast(top)).select("o_orderkey", S.clip_upper(F.col("o_totalprice"), F.col("p")).alias("clipped"))  # one row


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) + 1 AS next_day, CAST(o_orderdate AS DATE) - 1 AS day_before, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days, last_day(CAST(o_orderdate AS DATE)) AS month_end FROM orders")
def date_add_sub(spark, d):
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", F.date_add(day, 1).alias("next_day"), F.date_sub(day, 1).alias("day_before"), F.datediff(day, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), F.last_day(day).alias("month_end"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("""SELECT c_custkey, trim(concat('  ', c_name, ' ')) AS trimmed, replace(c_name, '#', '-') AS swapped, split_part(c_name, '#', 2) AS tail, substr(c_name, 1, 8) AS head, starts_with(c_name, 'Cust') AS starts, lower(c_mktsegment) = lower('BUILDING') AS same FROM customer""")
def string_ops(spark, d):
    n = F.col("c_name")
    return table(spark, d, "customer").select("c_custkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("trimmed"), F.replace(n, F.lit("#"), F.lit("-")).alias("swapped"), F.split_part(n, F.lit("#"), F.lit(2)).alias("tail"), F.substring(n, 1, 8).alias("head"), n.startswith("Cust").alias("starts"), S.same_text(F.col("c_mktsegment"), F.lit("building")).alias("same"))


@query("SELECT o_orderkey, CAST(round(CAST(o_totalprice AS DECIMAL(12,2)), 1) AS DOUBLE) AS r1, abs(o_totalprice - 1000) AS a, CAST(o_orderkey AS VARCHAR) AS t, TRY_CAST(o_orderpriority AS BIGINT) AS bad, coalesce(nullif(o_orderstatus, 'P'), 'none') AS s FROM orders")
def cast_round_coalesce(spark, d):
    return table(spark, d, "orders").select("o_orderkey", dbl(F.round(S.money(F.col("o_totalprice")), 1)).alias("r1"), F.abs(F.col("o_totalprice") - 1000).alias("a"), F.col("o_orderkey").cast("string").alias("t"), F.col("o_orderpriority").try_cast("bigint").alias("bad"), F.coalesce(F.nullif(F.col("o_orderstatus"), F.lit("P")), F.lit("none")).alias("s"))


# ---- distributions -----------------------------------------------------------------------------


@query("""WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(19, floor((o_totalprice - lo) / ((hi - lo) / 20))) AS INTEGER) AS bin, count(*) AS n FROM orders, b GROUP BY 1""")
def histogram_bins(spark, d):
    return D.histogram(table(spark, d, "orders"), "o_totalprice", 20)


@query("""WITH b AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_type, CAST(least(11, floor((value - lo) / ((hi - lo) / 12))) AS INTEGER) AS bin, count(*) AS n FROM events, b GROUP BY 1, 2""")
def ridgeline_bins(spark, d):
    return D.ridgeline(table(spark, d, "events"), "event_type", "value", 12)


@query("""WITH g AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1), s AS (SELECT *, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) * 100 AS s FROM g),
  r AS (SELECT *, floor(s) AS f, row_number() OVER (ORDER BY s - floor(s) DESC, c_mktsegment) AS k, 100 - sum(floor(s)) OVER () AS remaining FROM s) SELECT c_mktsegment, CAST(f + CASE WHEN k <= remaining THEN 1 ELSE 0 END AS INTEGER) AS cells FROM r""")
def waffle_counts(spark, d):
    return D.waffle(table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")), "c_mktsegment", "n")


@query("""WITH t AS (SELECT event_type, CAST(coalesce(sum(CASE WHEN day(ts) <= 15 THEN 1 END), 0) AS DOUBLE) AS first, CAST(coalesce(sum(CASE WHEN day(ts) > 15 THEN 1 END), 0) AS DOUBLE) AS second FROM events GROUP BY 1) SELECT *, (second - first) / greatest(first, 1.0) AS change FROM t""")
def slope_delta(spark, d):
    return D.slope(table(spark, d, "events").withColumn("one", F.lit(1)), "event_type", "one", F.dayofmonth("ts") > 15)


@query("""WITH t AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1), f AS (SELECT min(day) AS first FROM t) SELECT day, CAST((dayofweek(day) + 6) % 7 AS INTEGER) AS row, CAST(date_diff('day', first, day) // 7 AS INTEGER) AS col, n FROM t, f""")
def calendar_grid(spark, d):
    e = table(spark, d, "events").select(F.to_date("ts").alias("day"), F.lit(1).alias("n"))
    return D.calendar_grid(e, "day", "n")
