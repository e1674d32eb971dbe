"""Layout and statistics in place of indexes: partitioned, sorted tables and planner statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def save_table(df: DataFrame, name: str, *, partition: list[str] | None = None, bucket: tuple[int, str] | None = None, sort: list[str] | None = None, path: str | None = None) -> None:
    """Save as a Parquet table laid out for its reads: partitions for pruning, buckets for joins
    without a shuffle, sorting for row-group minima and maxima."""
    w = df.write.mode("overwrite").format("parquet")
    if path:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")
        w = w.option("path", path)
    if partition:
        w = w.partitionBy(*partition)
    if bucket:
        w = w.bucketBy(*bucket)
        if sort:
            w = w.sortBy(*sort)
    w.saveAsTable(name)


def analyze(spark: SparkSession, name: str, columns: list[str] | None = None) -> None:
    """Row count and, for named columns, distinct counts and ranges for the optimizer."""
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS" + (f" FOR COLUMNS {', '.join(columns)}" if columns else ""))


def known(spark: SparkSession, name: str, column: str) -> tuple[int, int, int]:
    """(rows, least, greatest) that the planner has on record for a whole-number column."""
    text = lambda rows, key: next(r[1] for r in rows if r[0] == key)
    table = text(spark.sql(f"DESCRIBE EXTENDED {name}").select("col_name", "data_type").collect(), "Statistics")
    one = spark.sql(f"DESCRIBE EXTENDED {name} {column}").collect()
    return int(table.split(", ")[-1].split(" ")[0]), int(text(one, "min")), int(text(one, "max"))
