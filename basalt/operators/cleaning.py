"""Cleaning: typed columns and flags; nothing is deleted, analyses choose by flag."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basalt.functions.scalars import money, to_double, to_long


def coerce(df: DataFrame, longs: tuple[str, ...] = (), doubles: tuple[str, ...] = ()) -> DataFrame:
    """Text columns to numbers, NULL where the text is none."""
    new = {c: to_long(F.col(c)) for c in longs} | {c: to_double(F.col(c)) for c in doubles}
    return df.withColumns(new)


def flag(df: DataFrame, invoice: str = "invoice", quantity: str = "quantity", price: str = "price", customer: str = "customer") -> DataFrame:
    """Add revenue and the flags is_cancelled, is_writeoff, is_valid_price, has_customer, is_revenue_safe.

    A NULL in a comparison counts as false. A quantity in DOUBLE is rounded as the number it is, as SQL
    does, not as its shortest decimal: 1.005 is below the half.
    """
    units = F.col(quantity)
    if df.schema[quantity].dataType.typeName() == "double":
        units = F.round(units * 100) / 100
    no = F.lit(False)
    cancelled = F.coalesce(F.col(invoice).cast("string").startswith("C"), no)
    negative = F.coalesce(F.col(quantity) < 0, no)
    positive = F.coalesce(F.col(quantity) > 0, no)
    priced = F.coalesce(F.col(price) > 0, no)
    out = df.withColumn("revenue", F.round(money(units) * money(F.col(price)), 2))
    return out.withColumns({
        "is_cancelled": cancelled,
        "is_writeoff": negative & ~cancelled,
        "is_valid_price": priced,
        "has_customer": F.col(customer).isNotNull(),
        "is_revenue_safe": ~cancelled & positive & priced,
    })


def revenue_safe(df: DataFrame) -> DataFrame:
    """Rows that count as sales."""
    return df.filter("is_revenue_safe")


def null_profile(df: DataFrame) -> DataFrame:
    """(column, nulls) in one pass over the table."""
    one = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").alias("nulls")) for c in df.columns])
    return one.select(F.explode(pairs).alias("p")).select("p.*")
