"""A small task graph runner: dependencies, retries with doubling waits, cached successes, history."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from basalt.functions.render import text_table
from basalt.operators.merge import VersionedTable

HISTORY = "run_id string, task string, status string, attempts int, started timestamp, finished timestamp, error string, detail string"


@dataclass(eq=False)
class Task:
    name: str
    func: Callable[[dict], object]
    retries: int = 0
    backoff: float = 1.0
    upstream: list[Task] = field(default_factory=list)

    def __rshift__(self, other: Task) -> Task:
        """``a >> b``: b needs a, once however often it is said. Gives b, so chains read left to right."""
        if not isinstance(other, Task):
            raise TypeError(f"a task can only come before a task, not before {type(other).__name__}")
        if self not in other.upstream:
            other.upstream.append(self)
        return other

    def run(self, ctx: dict, sleep: Callable[[float], None] = time.sleep) -> tuple[int, object]:
        """(attempts, result); raises what the last attempt raised."""
        for attempt in range(1, self.retries + 2):
            if attempt > 1:
                sleep(self.backoff * 2 ** (attempt - 2))
            try:
                return attempt, self.func(ctx)
            except Exception:
                if attempt > self.retries:
                    raise
        raise AssertionError("unreachable")


class RunHistory:
    """Outcomes keyed by (run_id, task), the latest one winning."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, VersionedTable(spark, path)

    def record(self, **row) -> None:
        new = self.spark.createDataFrame([tuple(row[c.split()[0]] for c in HISTORY.split(", "))], HISTORY)
        self.table.upsert(new, ["run_id", "task"])

    def succeeded(self, run_id: str, task: str) -> bool:
        if not self.table.exists():
            return False
        return not self.table.read().filter((F.col("run_id") == run_id) & (F.col("task") == task) & (F.col("status") == "succeeded")).isEmpty()

    def rows(self):
        return self.table.read().orderBy("run_id", "started") if self.table.exists() else self.spark.createDataFrame([], HISTORY)


class DAG:
    def __init__(self, name: str, history: RunHistory, sleep: Callable[[float], None] = time.sleep):
        self.name, self.history, self.tasks, self.sleep = name, history, {}, sleep

    def task(self, name: str, retries: int = 0, backoff: float = 1.0) -> Callable[[Callable], Task]:
        """Decorator: register a function as a task."""

        def keep(func: Callable) -> Task:
            self.tasks[name] = t = Task(name, func, retries, backoff)
            return t

        return keep

    def order(self) -> list[Task]:
        """Tasks so that each follows what it needs; ValueError on a cycle."""
        graph = TopologicalSorter({t.name: [u.name for u in t.upstream] for t in self.tasks.values()})
        try:
            return [self.tasks[n] for n in graph.static_order()]
        except CycleError as e:
            raise ValueError(f"the graph has a cycle: {' -> '.join(e.args[1])}") from e

    def run(self, run_id: str, ctx: dict, force: bool = False) -> bool:
        """Run what has not succeeded yet under this run id (all, if forced); stop at a failure,
        recording every task that could not run as skipped. True if all succeeded."""
        done: set[str] = set()
        failed = False
        for t in self.order():
            started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            row = {"run_id": run_id, "task": t.name, "attempts": 0, "started": started, "error": None, "detail": None}
            if failed or any(u.name not in done for u in t.upstream):
                self.history.record(**row, status="skipped", finished=started)
                continue
            if not force and self.history.succeeded(run_id, t.name):
                done.add(t.name)
                continue
            try:
                row["attempts"], result = t.run(ctx, self.sleep)
                row["detail"], status = None if result is None else str(result), "succeeded"
                done.add(t.name)
            except Exception as e:
                row["attempts"], row["error"], status, failed = t.retries + 1, f"{type(e).__name__}: {e}"[:500], "failed", True
            self.history.record(**row, status=status, finished=dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
        return not failed

    def status(self, run_id: str | None = None) -> str:
        """The recorded outcomes of a run (or of all) as text: task, status, attempts, seconds, note."""
        rows = self.history.rows()
        rows = rows.filter(F.col("run_id") == run_id) if run_id else rows
        seconds = F.col("finished").cast("double") - F.col("started").cast("double")
        t = rows.select("run_id", "task", "status", "attempts", F.format_number(seconds, 1).alias("seconds"), F.coalesce("error", "detail").alias("note"))
        return text_table(t.columns, [tuple(r) for r in t.limit(1000).collect()], title=self.name, most=1000)

    def reset(self) -> None:
        """Forget all runs."""
        if self.history.table.exists():
            self.history.table.replace(self.history.spark.createDataFrame([], HISTORY))
