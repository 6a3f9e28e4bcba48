"""Choice among models: calibration screen, parsimony, gates, splits, and a deterministic search over specifications."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def in_band(bias: Column, n: Column) -> Column:
    """A ratio of realised to predicted volatility within two standard errors of one."""
    return F.abs(bias - 1) <= F.sqrt(2 / n)


def chosen(models: DataFrame, slack: float = 0.5) -> DataFrame:
    """One row for each id of models (id, model, complexity, mean_loss, kept, eligible): among the kept ones (eligible ones first,
    if there are any), within `slack` of the least complexity the one of lowest loss."""
    w = W.partitionBy("id")
    d = models.where("kept").withColumn("any_ok", F.bool_or("eligible").over(w)).where("eligible OR NOT any_ok")
    d = d.withColumn("least", F.min("complexity").over(w)).where(F.col("complexity") <= F.col("least") + slack)
    return d.withColumn("rn", F.row_number().over(w.orderBy("mean_loss", "model"))).where("rn = 1").drop("rn", "any_ok", "least")


def verdicts(scores: DataFrame, gates: dict[str, Column], fatal: list[str], least: int = 24) -> DataFrame:
    """scores with flags (names of the gates that don't hold) and verdict: INSUFFICIENT under `least` rows, FAIL on a fatal gate
    or more than two flags, PASS without a flag, else CAVEATS. A gate that can't be computed doesn't hold."""
    flags = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in gates.items())))
    d = scores.withColumn("flags", flags)
    dead = F.arrays_overlap("flags", F.array(*(F.lit(k) for k in fatal)))
    return d.withColumn("verdict", F.when(F.col("n") < least, "INSUFFICIENT").when(dead | (F.size("flags") > 2), "FAIL").when(F.size("flags") == 0, "PASS").otherwise("CAVEATS"))


def split(n: int, h: int, step: int = 21, least: int = 756) -> tuple[list[int], list[int]]:
    """Forecast rows for training and for the final test: every `step` rows back from the last full horizon; the test takes 30 %,
    24 to 36 of them, and training rows whose horizon reaches into it are left out."""
    rows = list(range(n - 1 - h, least - 1, -step))[::-1]
    k = min(36, max(24, int(0.3 * len(rows))))
    test = rows[-k:]
    return [r for r in rows[:-k] if not test or r + h < test[0]], test


def effective(weights: DataFrame, key: str, w: str) -> DataFrame:
    """(key, n_eff): squared sum of weights over the sum of their squares."""
    return weights.groupBy(key).agg(F.try_divide(F.pow(F.sum(w), F.lit(2.0)), F.sum(F.col(w) * F.col(w))).alias("n_eff"))


@dataclass(frozen=True)
class Candidate:
    factors: tuple[str, ...]
    window: int = 252
    estimator: str = "ols"
    half_life: float | None = None

    def key(self) -> str:
        """A hash of what differs from the defaults, so that a new field with a default moves no key."""
        base = asdict(Candidate(()))
        own = {k: v for k, v in asdict(self).items() if k == "factors" or v != base[k]}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:12]

    def complexity(self) -> float:
        return len(self.factors) + (0.5 if self.estimator != "ols" else 0.0) + (0.25 if self.half_life else 0.0)


def neighbours(c: Candidate, pool: list[str]) -> list[Candidate]:
    """What a critic would try next: one factor fewer, one more, another window, a robust fit, exponential weights."""
    fewer = [Candidate(tuple(x for x in c.factors if x != f), c.window, c.estimator, c.half_life) for f in c.factors if len(c.factors) > 1]
    more = [Candidate((*c.factors, f), c.window, c.estimator, c.half_life) for f in pool if f not in c.factors]
    other = [Candidate(c.factors, w, c.estimator, c.half_life) for w in (126, 252, 504) if w != c.window]
    return [*fewer, *more, *other, Candidate(c.factors, c.window, "huber" if c.estimator == "ols" else "ols", c.half_life), Candidate(c.factors, c.window, c.estimator, None if c.half_life else 63.0)]


def search(seeds: list[Candidate], pool: list[str], score: Callable[[list[Candidate]], dict[str, float]], rounds: int = 3, most: int = 40) -> list[tuple[Candidate, float]]:
    """Candidates with their losses, best first. score runs one Spark job for a round's candidates. A round tries the neighbours of
    the best so far; the search ends without an improvement or at `most` candidates."""
    known: dict[str, tuple[Candidate, float]] = {}
    todo = list(dict.fromkeys(seeds))
    for _ in range(rounds):
        todo = [c for c in dict.fromkeys(todo) if c.key() not in known][: most - len(known)]
        if not todo:
            break
        before = min((x for _, x in known.values()), default=float("inf"))
        got = score(todo)
        known |= {c.key(): (c, got[c.key()]) for c in todo if c.key() in got}
        best = min(known.values(), key=lambda x: (x[1], x[0].key()), default=None)
        if best is None or best[1] >= before:
            break
        todo = neighbours(best[0], pool)
    return sorted(known.values(), key=lambda x: (x[1], x[0].key()))
