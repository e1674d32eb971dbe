"""Where jobs keep intermediate tables, and how workers get this package.

Intermediate tables are Parquet in the shared folder named by ``spark.checkpoint.dir``, so any
executor can be lost. Where that setting is absent (tests, a laptop) they go to the warehouse.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder of this session for intermediate tables, removed when the driver ends."""
    sc = spark.sparkContext
    app = sc.applicationId
    if app not in _folders:
        root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_intermediate"
        _folders[app] = f"{root.rstrip('/')}/basalt-{uuid.uuid4().hex[:12]}"
        atexit.register(_remove_quietly, spark, _folders[app])
    return _folders[app]


def _remove_quietly(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the session may be gone at interpreter exit
        pass


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path through Hadoop's file system, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Shuffle files go when the write that made them ends; else they stay until the driver collects its
#: garbage, and on a large input the steps of a job pile up on disk.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Named intermediate tables of one job."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:8]}"
        self._n = 0
        self._paths: list[str] = []

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write ``df`` and return the table read back: cut lineage, computed once."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._basalt_path = path
        self._paths.append(path)
        return out

    def keep_only(self, *tables: DataFrame) -> None:
        """Delete all tables of this job but those that its result still reads."""
        kept = {t._basalt_path for t in tables}
        for path in self._paths:
            if path not in kept:
                remove(self.spark, path)
        self._paths = [p for p in self._paths if p in kept]

    def drop(self, df: DataFrame) -> None:
        """Delete a table that no later step reads."""
        if path := getattr(df, "_basalt_path", None):
            remove(self.spark, path)


#: Rows and bytes of an Arrow batch: texts can be long, and a batch is held twice on its way.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, which need not have it installed, and bound the size of
    the Arrow batches of this session."""
    for k, v in BATCH.items():
        spark.conf.set(k, v)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="basalt-"), "basalt.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("basalt", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def trimmed(work):
    """The same Arrow function, giving spare memory back to the system when its task ends: workers are
    kept for the next task, and an executor's memory is bounded for all of them together."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def release() -> None:
    """Give back what Arrow and the C library keep of memory that is done with."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)
