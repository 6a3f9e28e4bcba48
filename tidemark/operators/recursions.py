"""Exponential means of a key's rows in buckets of time, so that one key's recursion runs in as many tasks as it has buckets.

A step of the recursion, v -> lam v + (1 - lam) x, is an affine map, and steps one after the other are one again. So each
bucket runs its rows on an unknown start, v = a s + b; the buckets' own maps, a row each, give every bucket its start in a
second, short pass; and each row's value is its a and b at that start.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.joins import bucket_of


def exponential_means(df: DataFrame, key: str, t: str, x: str, half_life: float, bucket: str | int | None = None) -> DataFrame:
    """(key, t, value, before) of each row of df: the exponential mean of the key's values up to the row, and up to the row before.

    The mean begins with the key's first value; a missing value leaves it as it is; before the first value both are null.
    df has one row for each key and time; null keys are one key.
    """
    lam = 0.5 ** (1 / half_life)
    d = df.select(F.col(key).alias("key"), F.col(t).alias("t"), F.col(x).cast("double").alias("x"), bucket_of(df, t, bucket).alias("bucket"))
    kinds = {c: d.schema[c].dataType.simpleString() for c in ("key", "t", "bucket")}

    def inside(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        there = np.isfinite(pdf["x"].to_numpy(float))
        a, b, out = 1.0, 0.0, []
        for v, ok in zip(pdf["x"].to_numpy(float), there, strict=True):
            before = (a, b)
            if ok:
                a, b = lam * a, lam * b + (1 - lam) * v
            out.append((a, b, *before))
        made = pd.DataFrame(out, columns=["a", "b", "a0", "b0"])
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "t": pdf["t"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "seen": np.cumsum(there), "seen0": np.cumsum(there) - there, "x": pdf["x"].to_numpy(), **{c: made[c].to_numpy() for c in made}})

    rows = d.groupBy("key", "bucket").applyInPandas(inside, f"key {kinds['key']}, t {kinds['t']}, bucket {kinds['bucket']}, seen long, seen0 long, x double, a double, b double, a0 double, b0 double")
    last = F.max(F.struct("t", "a", "b", "seen"))
    maps = rows.groupBy("key", "bucket").agg(last.alias("m"), F.min_by("x", F.when(F.col("x").isNotNull() & ~F.isnan("x"), F.col("t"))).alias("first")).select("key", "bucket", "m.a", "m.b", "m.seen", "first")

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bucket")
        v, n, out = None, 0, []
        for a, b, seen, first in zip(pdf["a"], pdf["b"], pdf["seen"], pdf["first"], strict=True):
            # The first value of all stands in for what was before it: the step that takes it in leaves it as it is.
            v = float(first) if v is None and seen else v
            out.append((v, n))
            v, n = (None if v is None else a * v + b), n + int(seen)
        return pd.DataFrame({"key": pdf["key"].to_numpy(), "bucket": pdf["bucket"].to_numpy(), "start": np.array([x for x, _ in out], dtype=float), "held": np.array([x for _, x in out], dtype=np.int64)})

    begun = maps.groupBy("key").applyInPandas(starts, f"key {kinds['key']}, bucket {kinds['bucket']}, start double, held long").withColumnsRenamed({"key": "k", "bucket": "at"})
    both = rows.join(begun, F.col("key").eqNullSafe(F.col("k")) & F.col("bucket").eqNullSafe(F.col("at")))
    value = lambda a, b, n: F.when(F.col("held") + F.col(n) > 0, F.col(a) * F.col("start") + F.col(b))
    return both.select(F.col("key").alias(key), F.col("t").alias(t), value("a", "b", "seen").alias("value"), value("a0", "b0", "seen0").alias("before"))
