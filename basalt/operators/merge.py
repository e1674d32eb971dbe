"""Keyed merges on Parquet tables, published by a pointer so that readers never see half a table.

A table is a folder of versions ``v=000001``, ... and a file ``_current`` that names the one to
read. A write goes to a new version; only when it is complete is the pointer replaced, in one rename.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def upsert(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows win; of the old ones those without a new counterpart stay (NULL keys match)."""
    on = [target[k].eqNullSafe(new[k]) for k in keys]
    return target.join(new.select(*keys), on, "left_anti").unionByName(new.select(*target.columns))


def insert_missing(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """First write wins: only keys not there yet are added."""
    on = [new[k].eqNullSafe(target[k]) for k in keys]
    return target.unionByName(new.join(target.select(*keys), on, "left_anti").select(*target.columns))


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("__r = 1").drop("__r")


def give_keys(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """A table that grew without a key, made fit for one: of several rows for a key the last one stays,
    and rows without a key, which no keyed load could replace, go."""
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return latest(rows.filter(known), keys, order)


class VersionedTable:
    """A Parquet table with atomic replacement."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read_pointer(self) -> str | None:
        p = self._path(f"{self.path}/_current")
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
        finally:
            stream.close()

    def exists(self) -> bool:
        return self._read_pointer() is not None

    def read(self) -> DataFrame:
        version = self._read_pointer()
        if version is None:
            raise FileNotFoundError(f"no table at {self.path}")
        return self.spark.read.parquet(f"{self.path}/{version}")

    def replace(self, df: DataFrame) -> None:
        """Write a new version, then point to it; a failed write leaves the old version current."""
        now = self._read_pointer()
        name = f"v={int(now.split('=')[1]) + 1 if now else 1:06d}"
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        temp, current = self._path(f"{self.path}/_next"), self._path(f"{self.path}/_current")
        out = self._fs.create(temp, True)
        out.write(bytearray(name.encode()))
        out.close()
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(self._fs.makeQualified(temp), self._fs.makeQualified(current), options)

    def migrate(self, keys: list[str], order: list[Column]) -> int:
        """Replace a keyless table by a keyed one in one step; returns how many rows went."""
        before = self.read()
        self.replace(give_keys(before, keys, order))
        return before.count() - self.read().count()

    def upsert(self, new: DataFrame, keys: list[str]) -> None:
        self.replace(upsert(self.read(), new, keys) if self.exists() else new)

    def insert_missing(self, new: DataFrame, keys: list[str]) -> None:
        self.replace(insert_missing(self.read(), new, keys) if self.exists() else new)
