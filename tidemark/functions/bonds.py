"""Column expressions of bond arithmetic and of level and return transforms. Rates are decimals; cash is in per cent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.operators.series import DAYS, by, last_rows, safe_ln

#: Below this a yield counts as zero and the limits hold.
TINY = 1e-8


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def par_duration(tenor, y, m: int = 2) -> Column:
    """Modified duration of a par bond, (1 - (1 + y/m)^(-m T)) / y; T at a yield of nothing."""
    t, y = _c(tenor), _c(y)
    return F.when(F.abs(y) < TINY, t.cast("double")).otherwise((1 - F.pow(1 + y / m, -m * t)) / F.when(F.abs(y) >= TINY, y))


def par_convexity(tenor, y, m: int = 2) -> Column:
    """Convexity of a par bond, from the second derivative of its price, at least zero; T (T + 1/m) at a yield of nothing."""
    t, y = _c(tenor), _c(y)
    safe = F.when(F.abs(y) >= TINY, y)
    v = F.pow(1 + y / m, -m * t)
    return F.when(F.abs(y) < TINY, t * (t + 1.0 / m)).otherwise(F.greatest(F.lit(0.0), 2 * (1 - v) / (safe * safe) - 2 * t * v / (safe * (1 + y / m))))


def annual_duration(maturity, y) -> Column:
    m, y = _c(maturity), _c(y)
    return F.when(F.abs(y) < TINY, m.cast("double")).otherwise((1 - F.pow(1 + y, -m)) / F.when(F.abs(y) >= TINY, y))


def yield_change_return(y: str, tenor, cash: str | None = None, w=None) -> Column:
    """Return of a constant-maturity par bond: duration and convexity at the yield before, plus the carry over cash of one day."""
    w = w or by()
    before, change = F.lag(y).over(w), F.col(y) - F.lag(y).over(w)
    carry = (before - (F.lag(cash).over(w) / 100 if cash else F.lit(0.0))) / DAYS
    return -par_duration(tenor, before) * change + 0.5 * par_convexity(tenor, before) * change * change + carry


def spread_change_return(spread: str, duration: float, w=None) -> Column:
    """Excess return of a spread in decimals: minus duration times its change, plus a day of the spread before."""
    w = w or by()
    return -duration * (F.col(spread) - F.lag(spread).over(w)) + F.lag(spread).over(w) / DAYS


def diff(x: str, w=None) -> Column:
    return F.col(x) - F.lag(x).over(w or by())


def log_diff(x: str, w=None) -> Column:
    return safe_ln(F.col(x)) - safe_ln(F.lag(x).over(w or by()))


def diff_standardised(d: str, window: int = DAYS, least: int = 60) -> Column:
    """A change over the standard deviation of the last `window` of them, itself included; `d` is the column of changes."""
    w = last_rows(window)
    sd = F.stddev_samp(d).over(w)
    return F.when((F.count(d).over(w) >= least) & (sd > 0), F.col(d) / F.when(sd > 0, sd))


def excess_return(r: str, cash: str, w=None) -> Column:
    """Return over the cash rate known the row before, in per cent a year."""
    return F.col(r) - F.lag(cash).over(w or by()) / 100 / DAYS


def to_base(r_local: str, r_fx: str) -> Column:
    return F.col(r_local) + F.col(r_fx)


def annualised(vol: str, per_year: int = DAYS) -> Column:
    return F.col(vol) * F.sqrt(F.lit(float(per_year)))


def winsorised(x: str, low: str, high: str) -> Column:
    return F.least(F.greatest(F.col(x), F.col(low)), F.col(high))


def held_share(x: str, key: str = "id") -> Column:
    """Share of a series' rows that have a value."""
    w = W.partitionBy(key)
    return F.count(x).over(w) / F.count(F.lit(1)).over(w)


def value_at_risk(sigma, q: float, per_year: int = DAYS) -> Column:
    """|q| sigma for one period, q a quantile of a variable of unit variance."""
    return F.lit(abs(q)) * _c(sigma) / F.sqrt(F.lit(float(per_year)))


def qlike(actual, predicted) -> Column:
    """x - ln x - 1 with x the squared ratio of actual to predicted volatility."""
    a, p = _c(actual), _c(predicted)
    ok = (a > 0) & (p > 0)
    x = F.pow(F.when(ok, a) / F.when(ok, p), F.lit(2.0))
    return F.when(ok, x - F.ln(x) - 1)


def daily_loss(r, sigma, per_year: int = DAYS) -> Column:
    """r^2 / s^2 + ln s^2 with s^2 the variance of one period."""
    s2 = F.pow(_c(sigma), F.lit(2.0)) / per_year
    return F.when(s2 > 0, F.pow(_c(r), F.lit(2.0)) / F.when(s2 > 0, s2) + F.ln(F.when(s2 > 0, s2)))


def reversion_weight(half_life: float | None, h: int) -> float:
    """Weight of today's variance in the mean of h days when it reverts with that half-life."""
    if not half_life or h <= 1:
        return 1.0
    phi = 0.5 ** (1 / half_life)
    return (1 - phi**h) / (h * (1 - phi))
