"""Landing layer: one JSON document per (city, range), fetched once, and its rows.

The file name ``city__start__end.json`` is the cache key; files are written through Hadoop's file
system, so the folder may be in any store that the executors read. The fetch function is given, so
tests and offline runs need no network.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basalt.sources.workdir import Files

METRICS = {"temperature_2m_mean": "temp_mean_c", "precipitation_sum": "precip_mm", "wind_speed_10m_max": "wind_max_kph"}
DAILY = "daily struct<time: array<string>, temperature_2m_mean: array<double>, precipitation_sum: array<double>, wind_speed_10m_max: array<double>>"


def landing_name(city: str, start: str, end: str) -> str:
    return f"{city}__{start}__{end}.json"


def fetch_city(files: Files, city: str, start: str, end: str, folder: str, get: Callable[[str, str, str], dict], retries: int = 3, backoff: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Fetch one document, with doubling waits between tries, and put it in place in one rename."""
    path = f"{folder}/{landing_name(city, start, end)}"
    for attempt in range(retries):
        try:
            doc = get(city, start, end)
            if "daily" not in doc:
                raise ValueError(f"no daily values for {city}: {doc.get('reason', 'unknown reason')}")
            break
        except (OSError, ValueError):
            if attempt == retries - 1:
                raise
            sleep(backoff * 2**attempt)
    files.write(path, json.dumps(doc))
    return path


def fetch_all(files: Files, cities: list[str], start: str, end: str, folder: str, get: Callable[[str, str, str], dict], **options) -> list[str]:
    """All cities; those that are there are not fetched again. Fails at the end, naming what failed."""
    paths, failed = [], []
    for c in cities:
        path = f"{folder}/{landing_name(c, start, end)}"
        try:
            paths.append(path if files.exists(path) else fetch_city(files, c, start, end, folder, get, **options))
        except (OSError, ValueError) as e:
            failed.append(f"{c}: {e}")
    if failed:
        raise RuntimeError("; ".join(failed))
    return paths


def http_get(url: str, timeout: float = 30.0) -> Callable[[str, str, str], dict]:
    """A get function for an archive service; ``url`` is a format string of city, start and end."""
    from urllib.request import urlopen

    def get(city: str, start: str, end: str) -> dict:
        with urlopen(url.format(city=city, start=start, end=end), timeout=timeout) as r:
            return json.load(r)

    return get


def silver_rows(spark: SparkSession, folder: str, start: str, end: str) -> DataFrame:
    """(city, date, metrics) of the documents of a range: parallel arrays zipped to rows.

    A document without values, or with arrays of unequal length, fails the job.
    """
    raw = spark.read.schema(DAILY).option("multiLine", True).json(f"{folder}/*__{start}__{end}.json")
    city = F.split_part(F.regexp_replace(F.col("_metadata.file_name"), "%20", " "), F.lit("__"), F.lit(1))
    n = F.size("daily.time")
    equal = F.lit(True)
    for m in METRICS:
        equal = equal & (F.size(f"daily.{m}") == n)
    ok = F.coalesce(equal & (n > 0), F.lit(False))
    checked = raw.select(city.alias("city"), F.when(ok, F.col("daily")).otherwise(F.raise_error(F.concat(F.lit("bad daily values for "), city))).alias("daily"))
    rows = checked.select("city", F.explode(F.arrays_zip("daily.time", *[f"daily.{m}" for m in METRICS])).alias("z"))
    return rows.select("city", F.to_date("z.time").alias("date"), *[F.col(f"z.{m}").alias(name) for m, name in METRICS.items()])
