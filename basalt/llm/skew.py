"""Joins on keys of which a few may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FEW = 200
HOT_KEYS = 2000


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], met: str, how: str = "inner") -> DataFrame:
    """``big`` joined with ``small``, which has one row for each key and in ``met`` how many rows of
    ``big`` the key has at most.

    Keys with more than a ``HOT_KEYS``-th of all rows, of which there are fewer than ``HOT_KEYS``, are
    broadcast with their number of salts; their rows in ``big`` are dealt to the salts by a digest
    of the row, and their rows in ``small``, ``HOT_KEYS`` more at most, are repeated for each.
    """
    total, most = small.agg(F.sum(met), F.max(met)).first()
    cut = max(FEW, (total or 0) // HOT_KEYS)
    if (most or 0) <= cut:
        return big.join(small, keys, how)
    salts = F.expr(f"cast(({met} + {cut - 1}) div {cut} as int)")
    hot = small.filter(F.col(met) > cut).select(*keys, salts.alias("_salts"))
    left = big.join(F.broadcast(hot), keys, "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("_salts")).cast("int"), F.lit(0))).drop("_salts")
    right = small.withColumn("_salt", F.explode(F.when(F.col(met) > cut, F.sequence(F.lit(0), salts - 1)).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
