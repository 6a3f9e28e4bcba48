"""A grid of configurations over one universe: what they share is computed once and fanned out; fits are stored by their content.

A configuration mixes covariances of several memories. The products of a pair of series on a day don't depend on it, nor
does the exponential mean of one half-life on how it is mixed, so one pass over the pairs serves every configuration.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.covariance import pairs
from tidemark.operators.series import DAYS


@dataclass(frozen=True)
class Configuration:
    """A name and the (weight, half-life) of each part of the covariance; weights sum to one."""

    name: str
    mix: tuple[tuple[float, float], ...]

    def __post_init__(self):
        if not self.mix or abs(sum(w for w, _ in self.mix) - 1) > 1e-9 or any(h <= 0 for _, h in self.mix):
            raise ValueError(f"the weights of {self.name} have to sum to one, over positive half-lives")

    def key(self) -> str:
        """A hash of what the configuration does, whatever it is called and however its parts are ordered."""
        return hashlib.sha256(json.dumps(sorted(self.mix)).encode()).hexdigest()[:12]


def normalised(name: str, mix: list[tuple[float, float]]) -> Configuration:
    """A configuration whose positive weights are scaled to one, parts of one half-life taken together, from the shortest on."""
    parts: dict[float, float] = {}
    for w, h in mix:
        if w <= 0:
            raise ValueError(f"a weight of {name} isn't positive")
        parts[h] = parts.get(h, 0.0) + w
    total = sum(parts.values())
    return Configuration(name, tuple((w / total, h) for h, w in sorted(parts.items())))


def label(c: Configuration) -> str:
    """What a configuration is, in short: 50 % of 8 and 50 % of 52 is `8:50+52:50`."""
    return "+".join(f"{h:g}:{100 * w:g}" for w, h in sorted(c.mix, key=lambda x: x[1]))


def pair_memories(panel: DataFrame, half_lives: list[float], least: int = 60) -> DataFrame:
    """(i, j, t, means) of panel (id, t, x), i <= j: at each day both have, the exponential means of their products for every
    half-life, up to and with the day; from the least-th common day on. A series may begin late: a pair counts its own days."""
    d = pairs(panel.where("x IS NOT NULL")).select("i", "j", "t", (F.col("a") * F.col("b")).alias("ab"))
    lam = np.array([0.5 ** (1 / h) for h in half_lives])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        s, w, out = np.zeros(len(lam)), np.zeros(len(lam)), []
        for x in pdf["ab"].to_numpy(float):
            s, w = lam * s + (1 - lam) * x, lam * w + (1 - lam)
            out.append((s / w).tolist())
        return pd.DataFrame({"i": pdf["i"], "j": pdf["j"], "t": pdf["t"], "means": out}).iloc[least - 1 :]

    return d.groupBy("i", "j").applyInPandas(one, "i string, j string, t date, means array<double>")


def configured(memories: DataFrame, half_lives: list[float], weights: DataFrame, configurations: list[Configuration]) -> DataFrame:
    """(portfolio, configuration, t, sigma) a year: the volatility of holdings weights (portfolio, id, weight) under each
    configuration's covariance of day t; null on days on which a pair of the holdings has none. Variances of each half-life
    are summed once; a configuration is a weighted sum of those."""
    a = weights.select("portfolio", F.col("id").alias("i"), F.col("weight").alias("wi"))
    b = weights.select("portfolio", F.col("id").alias("j"), F.col("weight").alias("wj"))
    k = weights.groupBy("portfolio").agg((F.count(F.lit(1)) * (F.count(F.lit(1)) + 1) / 2).alias("needed"))
    w = F.col("wi") * F.col("wj") * F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    d = memories.join(a, "i").join(b, ["portfolio", "j"]).groupBy("portfolio", "t").agg(F.count(F.lit(1)).alias("n"), *(F.sum(w * F.get("means", m)).alias(f"v{m}") for m in range(len(half_lives))))
    d = d.join(k, "portfolio")
    at = {h: F.col(f"v{m}") for m, h in enumerate(half_lives)}
    variance = lambda c: sum((p * at[h] for p, h in c.mix[1:]), c.mix[0][0] * at[c.mix[0][1]])
    each = F.explode(F.array(*(F.struct(F.lit(c.name).alias("configuration"), variance(c).alias("v")) for c in configurations))).alias("c")
    return d.select("portfolio", "t", "n", "needed", each).select("portfolio", "c.configuration", "t", F.when(F.col("n") == F.col("needed"), F.sqrt(F.greatest(F.col("c.v"), F.lit(0.0)) * DAYS)).alias("sigma"))


def grid(panel: DataFrame, weights: DataFrame, configurations: list[Configuration], least: int = 60) -> DataFrame:
    """`configured` of a panel (id, t, x), for the half-lives that the configurations name."""
    half_lives = sorted({h for c in configurations for _, h in c.mix})
    return configured(pair_memories(panel, half_lives, least), half_lives, weights, configurations)


def spec_key(spec) -> str:
    """A hash of a specification (a dataclass), by its fields in order of name."""
    return hashlib.sha256(json.dumps(asdict(spec), sort_keys=True).encode()).hexdigest()[:16]


def fit_once(wanted: DataFrame, spec, store: str, fit: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The fits of wanted (id, ...) under a specification from the table at `store`, where only those that it lacks are fitted now.

    The table has a folder for each specification's hash, and a row at least for each id that was ever asked for, also where
    a fit gave nothing. fit(rows) returns rows with an `id`. Two runs that fit one id at the same time store it twice; ids
    are read by the newest run. Ids that are null aren't fitted.
    """
    spark, path = wanted.sparkSession, f"{store}/spec={spec_key(spec)}"
    try:
        known = spark.read.parquet(path)
        todo = wanted.join(known.select("id").distinct(), "id", "left_anti")
    except AnalysisException:
        known, todo = None, wanted
    todo = todo.where("id IS NOT NULL")
    if todo.limit(1).count():
        made = todo.select("id").distinct().join(fit(todo), "id", "left").withColumn("fitted_at", F.current_timestamp())
        made.write.mode("append").parquet(path)
        known = spark.read.parquet(path)
    if known is None:
        return fit(wanted.limit(0))
    newest = known.groupBy("id").agg(F.max("fitted_at").alias("fitted_at"))
    values = [c for c in known.columns if c not in ("id", "fitted_at")]
    return known.join(newest, ["id", "fitted_at"]).join(wanted.select("id").distinct(), "id", "left_semi").where(F.greatest(*(F.col(c).isNotNull().cast("int") for c in values), F.lit(0)) == 1).select("id", *values)
