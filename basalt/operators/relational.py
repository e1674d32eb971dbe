"""Relational operators whose rules for NULL, ties and order differ from Spark's own.

Everything else is plain DataFrame API. ``order`` arguments are lists of (column, descending);
windows and sorts need a total order to be repeatable, so callers add a unique last key.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.storagelevel import StorageLevel


def require(df: DataFrame, columns: Sequence[str]) -> None:
    """Fail early, naming what is missing and what there is."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise KeyError(f"no column {', '.join(missing)}; there are {', '.join(df.columns)}")


def project(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep and reorder columns."""
    require(df, columns)
    return df.select(*columns)


def where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows for which the predicate is true (NULL counts as false)."""
    return df.filter(predicate)


def extend(df: DataFrame, name: str, expr: Column) -> DataFrame:
    """Add or replace a column."""
    return df.withColumn(name, expr)


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str = "inner") -> DataFrame:
    """Equi-join in which NULL matches NULL and, of columns named alike, the left one stays."""
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how}")
    require(left, [left_key])
    require(right, [right_key])
    kept = [c for c in right.columns if c not in left.columns]
    r = right.select(F.col(right_key).alias("__key"), *kept)
    return left.join(r, left[left_key].eqNullSafe(r["__key"]), how).drop("__key")


def sort_key(name: str, descending: bool = False) -> Column:
    """Ascending puts NULL last; descending is the exact reverse, NULL first."""
    return F.col(name).desc_nulls_first() if descending else F.col(name).asc_nulls_last()


def order_by(df: DataFrame, order: Sequence[tuple[str, bool]]) -> DataFrame:
    require(df, [c for c, _ in order])
    return df.orderBy(*[sort_key(c, d) for c, d in order])


def limit(df: DataFrame, n: int) -> DataFrame:
    if n < 0:
        raise ValueError("limit must not be negative")
    return df.limit(n)


def group_by(df: DataFrame, keys: Sequence[str], aggs: dict[str, Column]) -> DataFrame:
    """Grouped aggregation; NULL is a key like any other; without keys an empty input has no rows."""
    require(df, keys)
    out = [c.alias(n) for n, c in aggs.items()]
    if keys:
        return df.groupBy(*keys).agg(*out)
    return df.groupBy(F.lit(1).alias("__all")).agg(*out).drop("__all")


def group_apply(df: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """Escape hatch for aggregates that no expression can state: a pandas function per group.

    A group is held in one task, so keep this for groups of bounded size.
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)


def custom_aggregate(df: DataFrame, keys: Sequence[str], partial: Callable, final: Callable, schema: str) -> DataFrame:
    """An aggregate that no expression can state, for groups of any size.

    ``partial`` turns a pandas frame of rows (a batch) into a frame of the same columns with a few
    rows for each key, and may be applied to its own results; ``final`` does that for all that is left of
    one group and gives the columns of ``schema``. Batches are reduced where they are before anything
    is moved, and what a task made of a group is reduced again, so a group that holds a third of all
    rows comes together as a few rows for each task.
    """
    names = df.columns

    def reduce(frames):
        import pandas as pd

        held = None
        for f in frames:
            f = partial(f)
            held = f if held is None else partial(pd.concat([held, f], ignore_index=True))
        if held is not None:
            yield held[names]

    return df.mapInPandas(reduce, df.schema).groupBy(*keys).applyInPandas(final, schema)


def _window(partition: Sequence[str], order: Sequence[tuple[str, bool]]):
    return W.partitionBy(*partition).orderBy(*[sort_key(c, d) for c, d in order])


def row_number(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "row_num") -> DataFrame:
    return df.withColumn(name, F.row_number().over(_window(partition, order)))


def in_global_order(df: DataFrame, order: Sequence[tuple[str, bool]], total: str | None = None) -> DataFrame:
    """Rows with ``__part``, ``__i`` (the row's place in its part, from 0) and ``__before`` (the rows in
    earlier parts; with ``total``, also ``__sum``, that column's sum over earlier parts).

    Parts are ranges of the order, sorted each in its own task, so nothing gathers the whole table;
    only one row for each part is brought together. Parts are kept on disk, since a second range
    partitioning may choose other bounds; a lost part is made again with the same ones.
    """
    require(df, [c for c, _ in order])
    keys = [sort_key(c, d) for c, d in order]
    parts = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id()
    parts = parts.withColumn("__part", F.shiftright(at, 33).cast("int")).withColumn("__i", at.bitwiseAND(F.lit((1 << 33) - 1)))
    parts = parts.persist(StorageLevel.DISK_ONLY)
    value = F.sum(F.coalesce(F.col(total), F.lit(0))) if total else F.lit(0)
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), value.alias("__v"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # one row for each part
    zero = F.lit(0)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), zero).alias("__before"), *([F.coalesce(F.sum("__v").over(before), zero).alias("__sum")] if total else []))
    return parts.join(F.broadcast(sizes), "__part")  # as many rows as partitions


def global_row_number(df: DataFrame, order: Sequence[tuple[str, bool]], name: str = "row_num") -> DataFrame:
    """Row numbers over the whole table; the order needs a unique last key to be repeatable."""
    t = in_global_order(df, order)
    return t.select(*df.columns, (F.col("__before") + F.col("__i") + 1).alias(name))


def rank(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "rank") -> DataFrame:
    """Ranks with gaps; NULLs tie with each other."""
    return df.withColumn(name, F.rank().over(_window(partition, order)))


def dense_rank(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "dense_rank") -> DataFrame:
    return df.withColumn(name, F.dense_rank().over(_window(partition, order)))


def running_sum(df: DataFrame, column: str, partition: Sequence[str], order: Sequence[tuple[str, bool]], name: str = "running_sum") -> DataFrame:
    """Row by row (ROWS frame), NULL adding 0."""
    w = _window(partition, order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(F.col(column), F.lit(0))).over(w))


def partition_sum(df: DataFrame, column: str, partition: Sequence[str], name: str = "partition_sum") -> DataFrame:
    """The partition's total on each row; without keys the grand total, added by a join of one row
    so that no task holds the whole table."""
    value = F.sum(F.coalesce(F.col(column), F.lit(0)))
    if partition:
        return df.withColumn(name, value.over(W.partitionBy(*partition)))
    return df.crossJoin(F.broadcast(df.agg(value.alias(name))))  # one row


def top_n(df: DataFrame, partition: Sequence[str], order: Sequence[tuple[str, bool]], n: int, name: str = "row_num") -> DataFrame:
    """At most n rows of each partition; the limit is pushed below the sort by the planner."""
    return row_number(df, partition, order, name).filter(F.col(name) <= n)


def fold_rest(df: DataFrame, label: str, value: str, n: int, rest: str = "Rest") -> DataFrame:
    """The n largest labels and one row for the others, if they amount to more than 0.

    The largest are found by a top-k, so the labels are never sorted in one task.
    """
    top = df.orderBy(F.desc(value), label).limit(n).select(F.col(label).alias("__top"))
    named = df.join(F.broadcast(top), F.col(label) == F.col("__top"), "left")  # n rows
    named = named.withColumn(label, F.coalesce("__top", F.lit(rest)))
    return named.groupBy(label).agg(F.sum(value).alias(value)).filter((F.col(label) != rest) | (F.col(value) > 0))


def point_in_time(facts: DataFrame, versions: DataFrame, key: str, at: str, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    """Each fact with the version that was valid at its date, both ends inclusive, open end NULL.

    The equality on ``key`` keeps this a hash or merge join; the dates are a residual condition.
    """
    v = versions.select(F.col(key).alias("__k"), *[c for c in versions.columns if c != key])
    on = (facts[key] == v["__k"]) & (facts[at] >= v[valid_from]) & (v[valid_to].isNull() | (facts[at] <= v[valid_to]))
    return facts.join(v, on).drop("__k")
