"""Spark-native analytics over panels of daily series and over text corpora."""

from __future__ import annotations

from pathlib import Path


def for_workers(spark) -> None:
    """Let Python workers started from now on import this package from where the driver has it, unless it is installed there anyway."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in known:
        env["PYTHONPATH"] = ":".join([root, *known])
