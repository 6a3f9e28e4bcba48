"""Event-time aggregates and keyed state on streams; the same functions serve a batch, and replaying a table equals it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.stored import materialised


def stream_of(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """The Parquet files of a folder as a stream, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)


def tumbling(events: DataFrame, length: str, late: str = "1 hour") -> DataFrame:
    """Count and sum of values by type and window; rows later than `late` behind the newest are left out of closed windows."""
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, length: str, step: str, late: str = "1 hour") -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return d.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    d = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return d.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def ewma_by_user(events: DataFrame, half_life: float, idle: str | None = None, late: str = "1 hour") -> DataFrame:
    """(user_id, event_id, ewma): an exponential mean of each user's values, carried from batch to batch as state.

    With `idle` (an interval such as "7 days") a user's state goes once the watermark, `late` behind the newest event, is that
    far past the user's last event; a user that comes back begins anew. Without it users are kept for ever.
    """
    lam = 0.5 ** (1 / half_life)
    span = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else 0

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        value, last = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        out = []
        for x in pdf["value"]:
            value = x if value is None else lam * value + (1 - lam) * x
            out.append(value)
        last = max(last, int(pd.Timestamp(pdf["ts"].iloc[-1]).value // 1_000_000))
        state.update((value, last))
        if span:
            state.setTimeoutTimestamp(max(last + span, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": key[0], "event_id": pdf["event_id"], "ewma": out})

    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if idle else events
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, event_id long, ewma double", "value double, last long", "append", timeout)


class Upserts:
    """The newest row of each key, in a folder: rows lie in buckets by key, and a batch writes only the buckets that it touches.

    A small file for each batch says which version of each bucket is current; it is written last, so a batch that fails
    leaves the one before in force, and one that comes again writes the same. Versions that the last two batches don't name
    are removed. `buckets` must stay what it was when the folder was begun.
    """

    def __init__(self, path: str, keys: list[str], order: str, buckets: int = 256):
        self.path, self.keys, self.order, self.buckets = path.rstrip("/"), keys, order, buckets

    def _fs(self, spark: SparkSession):
        p = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _versions(self, spark: SparkSession) -> list[int]:
        fs, path = self._fs(spark)
        at = path(f"{self.path}/_current")
        return sorted(int(f.getPath().getName().removeprefix("n=")) for f in fs.listStatus(at) if f.getPath().getName().startswith("n=")) if fs.exists(at) else []

    def current(self, spark: SparkSession, before: int | None = None) -> dict[int, int]:
        """The version of each bucket that there is, of the newest batch or the newest one before a given one: `buckets` entries at most."""
        known = [n for n in self._versions(spark) if before is None or n < before]
        return {r["bucket"]: r["version"] for r in spark.read.parquet(f"{self.path}/_current/n={known[-1]}").collect()} if known else {}

    def read(self, spark: SparkSession, versions: dict[int, int] | None = None) -> DataFrame | None:
        """All rows of the current versions; None if there are none."""
        versions = self.current(spark) if versions is None else versions
        return spark.read.parquet(*(f"{self.path}/v={v}/bucket={b}" for b, v in sorted(versions.items()))) if versions else None

    def put(self, batch: DataFrame, number: int) -> None:
        """Takes in batch `number`; a foreachBatch function. Of a key's rows the one with the largest `order` stays; null keys are one key."""
        from tidemark.sources.tables import latest_per_key

        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        delta = materialised(latest_per_key(batch, self.keys, [F.desc(self.order)]).withColumn("bucket", bucket))
        touched = {r["bucket"] for r in delta.select("bucket").distinct().collect()}
        held = self.current(spark, number)
        base = self.read(spark, {b: v for b, v in held.items() if b in touched})
        rows = delta if base is None else delta.unionByName(base.withColumn("bucket", bucket))
        rows = latest_per_key(rows, self.keys, [F.desc(self.order)])
        # A bucket is one file: its rows are about a `buckets`-th of the table.
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={number}")
        now = held | dict.fromkeys(touched, number)
        spark.createDataFrame(sorted(now.items()), "bucket int, version int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/_current/n={number}")
        self._clean(spark, number)

    def _clean(self, spark: SparkSession, number: int) -> None:
        fs, path = self._fs(spark)
        kept = [n for n in self._versions(spark) if n <= number][-2:]
        named = {(b, v) for n in kept for b, v in ((r["bucket"], r["version"]) for r in spark.read.parquet(f"{self.path}/_current/n={n}").collect())}
        for n in self._versions(spark):
            if n < min(kept):
                fs.delete(path(f"{self.path}/_current/n={n}"), True)
        for v in fs.listStatus(path(self.path)):
            name = v.getPath().getName()
            if not name.startswith("v="):
                continue
            parts = [b.getPath() for b in fs.listStatus(v.getPath()) if b.getPath().getName().startswith("bucket=")]
            stale = [b for b in parts if (int(b.getName().removeprefix("bucket=")), int(name.removeprefix("v="))) not in named]
            for b in stale:
                fs.delete(b, True)
            if len(stale) == len(parts) and int(name.removeprefix("v=")) not in {v for _, v in named}:
                fs.delete(v.getPath(), True)


def upsert_sink(path: str, keys: list[str], order: str, buckets: int = 256):
    """A foreachBatch function that keeps the newest row of each key in a folder, exactly once; see Upserts, which reads it."""
    return Upserts(path, keys, order, buckets).put
