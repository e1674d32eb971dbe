"""Session factory."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "basalt", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with UTC, ANSI and adaptive execution; a running session is reused.

    ``shuffle_partitions`` is for the size at hand: about one for each 100 MB that a shuffle moves.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    if shuffle_partitions:
        fixed["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for k, v in (fixed | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()
