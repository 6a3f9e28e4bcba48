"""Running jobs: a ledger as an append-only table, a chain that stops at its first fatal step, and polite fetching."""

from __future__ import annotations

import random
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.tables import latest_per_key

LEDGER = "run_id string, job string, item string, status string, rows bigint, message string, started timestamp, finished timestamp"


@dataclass
class Run:
    job: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    items: list[tuple] = field(default_factory=list)

    def item(self, name: str, status: str, rows: int = 0, message: str = "", started: datetime | None = None) -> None:
        now = datetime.now(timezone.utc)
        self.items.append((self.run_id, self.job, name, status, rows, message[:500], started or now, now))


@contextmanager
def ledger(spark: SparkSession, path: str, job: str) -> Iterator[Run]:
    """A run whose items, and itself as item '', are appended to the ledger however it ends: done, partial or failed."""
    run, started = Run(job), datetime.now(timezone.utc)
    try:
        yield run
        bad = sum(x[3] == "failed" for x in run.items)
        run.item("", "done" if not bad else "partial" if bad < len(run.items) else "failed", sum(x[4] for x in run.items), "", started)
    except Exception as e:
        run.item("", "failed", 0, f"{type(e).__name__}: {e}", started)
        raise
    finally:
        spark.createDataFrame(run.items, LEDGER).coalesce(1).write.mode("append").parquet(path)


def latest_runs(entries: DataFrame) -> DataFrame:
    """The last run of each job."""
    return latest_per_key(entries.where("item = ''"), ["job"], [F.desc("started")])


def settled_today(entries: DataFrame, job: str, today) -> DataFrame:
    """Items of a job that ended well on the day: they needn't be fetched again."""
    d = entries.where((F.col("job") == job) & (F.col("item") != "") & (F.to_date("finished") == F.lit(today)))
    return latest_per_key(d, ["item"], [F.desc("finished")]).where("status = 'done'").select("item")


def chain(steps: list[tuple[str, Callable[[], object], bool]]) -> list[tuple[str, str]]:
    """Run (name, function, fatal) in order; a fatal failure stops what follows, another one is only noted."""
    out, stopped = [], False
    for name, f, fatal in steps:
        if stopped:
            out.append((name, "skipped"))
            continue
        try:
            f()
            out.append((name, "done"))
        except Exception as e:  # noqa: BLE001
            out.append((name, f"failed: {e}"))
            stopped = fatal
    return out


class Limiter:
    """At most `rate` calls a second over all threads, evenly spaced."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.next, self.lock, self.clock, self.sleep = 1 / rate, 0.0, threading.Lock(), clock, sleep

    def wait(self) -> None:
        with self.lock:
            now = self.clock()
            at = max(now, self.next)
            self.next = at + self.gap
        if at > now:
            self.sleep(at - now)


def with_backoff(f: Callable[[], object], attempts: int = 4, base: float = 1.5, give_up: tuple[type[Exception], ...] = (), sleep: Callable[[float], None] = time.sleep) -> object:
    """f's result, tried again after base, 2 base, 4 base ... seconds with up to half as much added; errors in give_up aren't tried again."""
    for k in range(attempts):
        try:
            return f()
        except Exception as e:
            if isinstance(e, give_up) or k == attempts - 1:
                raise
            sleep(base * 2**k * (1 + random.random() / 2))
    raise ValueError("attempts has to be positive")
