"""Distribution operators: histograms, ridgelines, waffles, calendars, slopes, Pareto curves.

Bounds are one-row aggregates joined back; no table is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from basalt.operators import relational as R


def _bin(value: Column, bins: int) -> Column:
    """Equal-width bin of a value; the greatest value falls in the last bin."""
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    return F.least(F.lit(bins - 1), F.floor((value - F.col("__lo")) / width)).cast("int")


def _bounded(df: DataFrame, value: str) -> DataFrame:
    b = df.agg(F.min(value).cast("double").alias("__lo"), F.max(value).cast("double").alias("__hi"))
    b = b.withColumn("__flat", F.col("__hi") == F.col("__lo")).withColumn("__hi", F.when(F.col("__flat"), F.col("__lo") + 1).otherwise(F.col("__hi")))
    return df.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(b))  # one row


def histogram(df: DataFrame, value: str, bins: int, flat: int = 0) -> DataFrame:
    """(bin, n) of the bins that hold values; equal values, which have no width, are in bin ``flat``."""
    at = F.when(F.col("__flat"), F.lit(flat)).otherwise(_bin(F.col(value), bins))
    return _bounded(df, value).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def ridgeline(df: DataFrame, group: str, value: str, bins: int) -> DataFrame:
    """(group, bin, n) with the same edges for every group."""
    return _bounded(df, value).groupBy(group, _bin(F.col(value), bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def waffle(df: DataFrame, label: str, value: str, cells: int = 100) -> DataFrame:
    """Whole cells for each label, summing to ``cells`` by largest remainders (ties by label)."""
    share = F.col(value).cast("double") / F.sum(F.col(value).cast("double")).over(W.partitionBy()) * cells
    t = df.withColumn("__s", share).withColumn("__f", F.floor("__s"))
    t = t.withColumn("__left", F.lit(cells) - F.sum("__f").over(W.partitionBy()))
    t = t.withColumn("__r", F.row_number().over(W.orderBy(F.desc(F.col("__s") - F.col("__f")), label)))
    return t.select(label, (F.col("__f") + (F.col("__r") <= F.col("__left")).cast("int")).cast("int").alias("cells"))


def calendar_grid(df: DataFrame, day: str, value: str) -> DataFrame:
    """(day, row, col, value): weekday with Monday 0, and weeks counted from the first day."""
    first = df.agg(F.min(day).alias("__first"))
    d = df.groupBy(day).agg(F.sum(value).alias(value)).crossJoin(F.broadcast(first))  # one row
    return d.select(day, F.weekday(day).alias("row"), F.floor(F.datediff(day, "__first") / 7).cast("int").alias("col"), value)


def slope(df: DataFrame, label: str, value: str, late: Column) -> DataFrame:
    """(label, first, second, change): sums before and after, change relative to at least 1."""
    t = df.groupBy(label).agg(F.coalesce(F.sum(F.when(~late, F.col(value))), F.lit(0)).cast("double").alias("first"), F.coalesce(F.sum(F.when(late, F.col(value))), F.lit(0)).cast("double").alias("second"))
    return t.withColumn("change", (F.col("second") - F.col("first")) / F.greatest("first", F.lit(1.0)))


def pareto(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value, position, running, share): cumulative share from the largest down.

    Input is one row per key, already aggregated; ranges of it are ordered and summed in parallel.
    """
    t = R.in_global_order(df.select(key, value), [(value, True), (key, False)], total=value)
    inside = W.partitionBy("__part").orderBy("__i").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.select(key, value, (F.col("__before") + F.col("__i") + 1).alias("position"), (F.col("__sum") + F.sum(value).over(inside)).alias("running"))
    total = df.agg(F.sum(value).alias("__total"))
    return t.crossJoin(F.broadcast(total)).withColumn("share", F.col("running").cast("double") / F.col("__total").cast("double")).drop("__total")  # one row


def _fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c rounded once, as DuckDB's build interpolates: a value on the edge of a bin changes its
    bin with the last digit of a bound. The product's error is exact (Dekker), and so is the sum's."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    p = a * b
    ah, bh = high(a), high(b)
    low = ((ah * bh - p) + ah * (b - bh) + (a - ah) * bh) + (a - ah) * (b - bh)
    s = p + c
    t = s - p
    fused = s + (((p - (s - t)) + (c - t)) + low)
    return F.when((F.abs(a) < 1e290) & (F.abs(s) < float("inf")), fused).otherwise(s)  # splitting overflows above


def quantiles(df: DataFrame, value: str, names: dict[str, float], by: Sequence[str] = (), slack: float = 0.001) -> DataFrame:
    """Exact quantiles, interpolated between neighbours: a column for each name, one row for each
    group (one in all without ``by``; an empty table has none then).

    Values are counted and dealt to cells; a rank is looked for in the cell that holds it. The bounds of
    cells are approximate percentiles a little (``slack``) below and above each quantile, so the cell to
    be sorted is a small part of the values; were they far off, cells would be larger and results the same.
    """
    group = F.struct(F.lit(0).alias("__all"), *by)  # one key, whose NULLs are equal
    rows = df.filter(F.col(value).isNotNull()).select(group.alias("__g"), F.col(value).cast("double").alias("__v"))
    counted = rows.groupBy("__g", "__v").agg(F.count(F.lit(1)).alias("__n"))
    steps = sorted({min(1.0, max(0.0, p + e)) for p in names.values() for e in (-slack, slack)})
    bounds = rows.groupBy("__g").agg(F.percentile_approx("__v", steps, 10_000).alias("__b"), F.count(F.lit(1)).alias("__rows"))
    celled = counted.join(bounds, "__g").select("__g", "__v", "__n", "__rows", F.size(F.filter("__b", lambda x: x < F.col("__v"))).alias("__cell"))
    sums = celled.groupBy("__g", "__cell", "__rows").agg(F.sum("__n").alias("__m"))
    upto = F.sum("__m").over(W.partitionBy("__g").orderBy("__cell"))  # two rows for each name, one more
    sums = sums.withColumn("__first", upto - F.col("__m")).withColumn("__last", upto - 1)
    wanted = F.array(*[F.struct(F.lit(n).alias("name"), (F.lit(p) * (F.col("__rows") - 1)).alias("at")) for n, p in names.items()])
    asked = sums.withColumn("__q", F.explode(wanted)).withColumn("__k", F.explode(F.array_distinct(F.array(F.floor("__q.at"), F.ceil("__q.at")))))
    asked = asked.filter((F.col("__k") >= F.col("__first")) & (F.col("__k") <= F.col("__last")))
    asked = asked.select("__g", "__cell", "__first", F.col("__q.name").alias("__name"), F.col("__q.at").alias("__at"), "__k")
    inside = celled.join(asked.select("__g", "__cell", "__first").distinct(), ["__g", "__cell"])
    top = F.sum("__n").over(W.partitionBy("__g", "__cell").orderBy("__v"))
    inside = inside.select("__g", "__cell", "__v", "__n", (F.col("__first") + top - 1).alias("__to"))
    hit = asked.join(inside, ["__g", "__cell"]).filter("__k <= __to and __k > __to - __n")
    two = hit.groupBy("__g", "__name", "__at").agg(F.min_by("__v", "__k").alias("__lo"), F.max_by("__v", "__k").alias("__hi"))
    part = F.col("__at") - F.floor("__at")
    one = two.withColumn("__r", _fused(F.col("__lo"), 1 - part, F.col("__hi") * part))
    one = one.groupBy("__g").agg(*[F.max(F.when(F.col("__name") == n, F.col("__r"))).alias(n) for n in names])
    return one.select(*[F.col(f"__g.{k}").alias(k) for k in by], *names)


def describe(df: DataFrame, value: str) -> DataFrame:
    """count, mean, sample deviation, least, quartiles (interpolated), greatest: one row."""
    c = F.col(value).cast("double")
    one = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("least"), F.max(c).alias("greatest"))
    q = quantiles(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    t = one.join(F.broadcast(q), F.lit(True), "left")  # one row each
    return t.select("n", "mean", "std", "least", "p25", "p50", "p75", "greatest")


def nice_ticks(df: DataFrame, lo: str, hi: str, count: int = 5) -> DataFrame:
    """Rows with ``tick`` exploded: round values from lo to hi at steps of 1, 2 or 5 times a power of ten."""
    top = F.when(F.col(hi) > F.col(lo), F.col(hi)).otherwise(F.col(lo) + 1)
    rough = (top - F.col(lo)) / F.lit(float(count))
    power = F.pow(F.lit(10.0), F.floor(F.log10(rough)))
    least = rough * (1 - 1e-12)
    step = F.when(power >= least, power).when(2 * power >= least, 2 * power).when(5 * power >= least, 5 * power).otherwise(10 * power)
    t = df.withColumn("__step", step)
    first, last = F.ceil(F.col(lo) / F.col("__step") - 1e-9), F.floor(top / F.col("__step") + 1e-9)
    return t.withColumn("__k", F.explode(F.sequence(first, last))).withColumn("tick", F.col("__k") * F.col("__step")).drop("__k", "__step")


def sparkline(df: DataFrame, label: str, order: str, value: str) -> DataFrame:
    """(label, line): a label's values in order as blocks of eight heights between its least and most."""
    w = W.partitionBy(label)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    level = F.least(F.lit(7), F.floor((F.col(value) - lo) / span * 7.999)).cast("int")
    t = df.select(label, F.struct(F.col(order), F.substring(F.lit("▁▂▃▄▅▆▇█"), level + 1, F.lit(1)).alias("b")).alias("x"))
    return t.groupBy(label).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("line"))


def bars(df: DataFrame, label: str, value: str, length: float = 260.0) -> DataFrame:
    """(label, value, extent): how long a bar is when the largest has ``length``."""
    top = df.agg(F.max(F.abs(value)).alias("__top"))
    t = df.crossJoin(F.broadcast(top))  # one row
    return t.select(label, value, (F.abs(value) / F.when(F.col("__top") > 0, F.col("__top")).otherwise(F.lit(1.0)) * length).alias("extent"))
