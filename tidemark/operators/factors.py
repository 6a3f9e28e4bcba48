"""Factor returns from instrument returns and levels: constructions by name, in the order of their hierarchy.

A construction takes long rows and gives (t, value). BUILDERS is the extension point: register a function of
(context, inputs) under a name and recipes can use it.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.functions.bonds import diff, excess_return, log_diff, yield_change_return
from tidemark.operators.series import DAYS, by, ffill_inside, last_rows, rank_share


@dataclass
class Panels:
    """returns (id, t, ret), levels (id, t, value) and cash (t, cash), aligned to one calendar."""

    returns: DataFrame
    levels: DataFrame | None = None
    cash: DataFrame | None = None


@dataclass
class Recipe:
    factor_id: str
    method: str
    inputs: dict = field(default_factory=dict)
    level: int = 0
    residual_on: list[str] = field(default_factory=list)


def leg_mean(name: Column, ids: list[str], x: str) -> Column:
    return F.avg(F.when(name.isin(ids), F.col(x)))


def single(p: Panels, i: dict) -> DataFrame:
    """One return with its sign; with `fx`, that currency's return is added, with `excess`, the cash of the row before taken off."""
    d = p.returns.where(F.col("id") == i["id"]).select("id", "t", "ret")
    if i.get("fx"):
        d = d.join(p.returns.where(F.col("id") == i["fx"]).select("t", F.col("ret").alias("fx")), "t").withColumn("ret", F.col("ret") + F.col("fx"))
    if i.get("excess"):
        d = d.join(p.cash, "t", "left").withColumn("ret", excess_return("ret", "cash"))
    return d.select("t", (F.col("ret") * i.get("sign", 1)).alias("value"))


def spread(p: Panels, i: dict) -> DataFrame:
    """Long minus short; a day needs both."""
    d = p.returns.where(F.col("id").isin(i["long"], i["short"])).groupBy("t")
    return d.agg((F.max(F.when(F.col("id") == i["long"], F.col("ret"))) - F.max(F.when(F.col("id") == i["short"], F.col("ret")))).alias("value"))


def basket(p: Panels, i: dict) -> DataFrame:
    """Mean of the long legs that exist minus mean of the short ones that do."""
    d = p.returns.where(F.col("id").isin(i["long"] + i.get("short", []))).groupBy("t")
    long = leg_mean(F.col("id"), i["long"], "ret")
    return d.agg((long - leg_mean(F.col("id"), i["short"], "ret") if i.get("short") else long).alias("value"))


def bond_returns(p: Panels, tenors: dict[str, float], scale: float = 0.01, limit: int = 5) -> DataFrame:
    """(id, t, ret, tenor) of par bonds from yields in per cent; gaps of up to `limit` rows inside a series are filled."""
    kind = F.create_map(*(x for k, v in tenors.items() for x in (F.lit(k), F.lit(v))))
    d = p.levels.where(F.col("id").isin(list(tenors))).withColumn("y", ffill_inside("value", limit) * scale).withColumn("tenor", kind[F.col("id")])
    return d.withColumn("ret", yield_change_return("y", F.col("tenor"))).select("id", "t", "ret", "tenor")


def curve(p: Panels, i: dict) -> DataFrame:
    """Level, slope or curvature of returns per unit of duration, times `scale`: short, middle and long tenors weighted accordingly."""
    short, mid, long = i["tenors"]
    b = p.levels.where(F.col("id").isin(short, mid, long)).withColumn("d", -diff("value") / 100)
    at = lambda k: F.max(F.when(F.col("id") == k, F.col("d")))
    shape = {"level": (at(short) + at(mid) + at(long)) / 3, "slope": at(long) - at(short), "curvature": 2 * at(mid) - at(short) - at(long)}[i["shape"]]
    return b.groupBy("t").agg((shape * i.get("scale", 5.0)).alias("value"))


def level_transform(p: Panels, i: dict) -> DataFrame:
    d = p.levels.where(F.col("id") == i["id"])
    return d.select("t", {"diff": diff, "log_diff": log_diff, "level": F.col}[i["transform"]]("value").alias("value"))


def spread_level(p: Panels, i: dict) -> DataFrame:
    """One level minus another where both are known, then transformed as a level."""
    d = p.levels.where(F.col("id").isin(i["a"], i["b"])).groupBy("t").agg((F.max(F.when(F.col("id") == i["a"], F.col("value"))) - F.max(F.when(F.col("id") == i["b"], F.col("value")))).alias("value"))
    d = d.where("value IS NOT NULL").withColumn("id", F.lit("spread"))
    return d.select("t", {"diff": diff, "log_diff": log_diff, "level": F.col}[i["transform"]]("value").alias("value"))


def synthetic_bond(p: Panels, i: dict) -> DataFrame:
    """Return of a par bond of one tenor from its yield in per cent, over cash if `carry` says so; short gaps inside the series are filled."""
    d = p.levels.where(F.col("id") == i["id"]).withColumn("y", ffill_inside("value", i.get("limit", 5)) * 0.01)
    d = d.join(p.cash, "t", "left") if i.get("carry") else d
    return d.select("t", yield_change_return("y", F.lit(float(i["tenor"])), "cash" if i.get("carry") else None).alias("value"))


def variance_premium(p: Panels, i: dict) -> DataFrame:
    """Yesterday's implied variance of a day minus today's squared return; implied volatility in per cent a year."""
    v = p.levels.where(F.col("id") == i["implied"]).select("t", F.lag("value").over(by()).alias("v"))
    return p.returns.where(F.col("id") == i["id"]).join(v, "t").select("t", (F.pow(F.col("v") / 100, F.lit(2.0)) / DAYS - F.pow("ret", F.lit(2.0))).alias("value"))


def tsmom(p: Panels, i: dict) -> DataFrame:
    """Sign of the sum of `span` returns that end `skip` rows ago, held at inverse volatility; the weights' absolute sum is one."""
    look = by().rowsBetween(-(i["skip"] + i["span"] - 1), -i["skip"])
    vol = by().rowsBetween(-i["vol"], -1)
    d = p.returns.withColumns({"s": F.when(F.count("ret").over(look) == i["span"], F.signum(F.sum("ret").over(look))), "v": F.when(F.count("ret").over(vol) >= i["vol"] // 2, F.stddev_samp("ret").over(vol))})
    d = d.withColumn("w", F.when((F.col("v") > 0) & F.col("ret").isNotNull(), F.col("s") / F.when(F.col("v") > 0, F.col("v"))))
    return d.groupBy("t").agg(F.try_divide(F.sum(F.col("w") * F.col("ret")), F.sum(F.abs("w"))).alias("value"))


def xs_momentum(p: Panels, i: dict) -> DataFrame:
    """Mean return of the upper third by past return minus that of the lower third, ranked on what was known the row before."""
    look = by().rowsBetween(-(i["skip"] + i["span"] - 1), -i["skip"])
    d = p.returns.withColumn("s", F.when(F.count("ret").over(look) == i["span"], F.sum("ret").over(look)))
    d = d.withColumn("share", rank_share("s"))
    return d.groupBy("t").agg((F.avg(F.when(F.col("share") > 2 / 3, F.col("ret"))) - F.avg(F.when(F.col("share") < 1 / 3, F.col("ret")))).alias("value"))


def fx_carry(p: Panels, i: dict) -> DataFrame:
    """Mean over the legs of sign(rate difference known the row before) times spot return plus a day of it; rates in per cent."""
    d = p.levels.where(F.col("id").isin(i["legs"])).select("id", "t", (F.lag("value").over(by()) - i["home"]).alias("gap"))
    return p.returns.join(d, ["id", "t"]).groupBy("t").agg(F.avg(F.signum("gap") * (F.col("ret") + F.col("gap") / 100 / DAYS)).alias("value"))


BUILDERS: dict[str, Callable[[Panels, dict], DataFrame]] = {
    "single": single, "spread": spread, "basket": basket, "curve": curve, "level_transform": level_transform, "spread_level": spread_level, "synthetic_bond": synthetic_bond,
    "variance_premium": variance_premium, "tsmom": tsmom, "xs_momentum": xs_momentum, "fx_carry": fx_carry,
}


def in_order(recipes: list[Recipe]) -> list[Recipe]:
    """Recipes by level, then as declared; each may be residualised only on ones built before it."""
    seen: set[str] = set()
    out = sorted(recipes, key=lambda r: r.level)
    for r in out:
        if r.method not in BUILDERS:
            raise ValueError(f"{r.factor_id}: no construction named {r.method}")
        if late := [x for x in r.residual_on if x not in seen]:
            raise ValueError(f"{r.factor_id}: residual on {late}, which come later")
        if r.factor_id in seen:
            raise ValueError(f"{r.factor_id} is declared twice")
        seen.add(r.factor_id)
    return out


def build(p: Panels, recipes: list[Recipe]) -> DataFrame:
    """(factor_id, t, value) of all recipes."""
    parts = [BUILDERS[r.method](p, r.inputs).select(F.lit(r.factor_id).alias("factor_id"), "t", "value") for r in in_order(recipes)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def rescaled(df: DataFrame, target: float, x: str = "value") -> DataFrame:
    """A factor in units of a volatility of `target` a year, from its whole sample."""
    sd = df.groupBy("factor_id").agg((F.stddev_samp(x) * F.sqrt(F.lit(float(DAYS)))).alias("__sd"))
    return df.join(sd, "factor_id").withColumn(x, F.when(F.col("__sd") > 0, F.col(x) * target / F.when(F.col("__sd") > 0, F.col("__sd")))).drop("__sd")


def common_as_of(df: DataFrame, calendar: DataFrame, max_lag: int = 2) -> DataFrame:
    """One row: the last day that all factors reach which aren't more than max_lag calendar rows behind the newest."""
    # The calendar is one series.
    pos = calendar.select("t").distinct().withColumn("pos", F.row_number().over(W.orderBy("t")))
    last = df.where("value IS NOT NULL").groupBy("factor_id").agg(F.max("t").alias("t")).join(pos, "t")
    newest = last.agg(F.max("pos").alias("top"))
    return last.crossJoin(F.broadcast(newest)).where(F.col("pos") >= F.col("top") - max_lag).agg(F.min("t").alias("as_of"))


def sparse_change(levels: DataFrame, releases: int = 52, least: int = 12) -> DataFrame:
    """(id, t, value) of a level that is released now and then: on a release its change over the standard deviation of the last
    `releases` changes (itself included), zero between releases, null before the first that can be standardised."""
    w = last_rows(releases)
    r = levels.where("value IS NOT NULL").withColumn("d", diff("value"))
    r = r.withColumn("z", F.when((F.count("d").over(w) >= least) & (F.stddev_samp("d").over(w) > 0), F.col("d") / F.stddev_samp("d").over(w))).select("id", "t", "z")
    d = levels.join(r, ["id", "t"], "left")
    begun = F.min(F.when(F.col("z").isNotNull(), F.col("t"))).over(W.partitionBy("id"))
    return d.select("id", "t", F.when(F.col("t") >= begun, F.coalesce("z", F.lit(0.0))).alias("value"))


def spot_levels(pairs: DataFrame, home: str = "USD") -> DataFrame:
    """(id, t, value): home units for one unit of a currency, from closes of pairs named USDxxx (inverted) or xxxUSD."""
    first = F.substring("id", 1, 3) == home
    value = F.when(F.col("value") > 0, F.when(first, 1 / F.when(F.col("value") > 0, F.col("value"))).otherwise(F.col("value")))
    return pairs.where(first | (F.substring("id", 4, 3) == home)).select(F.when(first, F.substring("id", 4, 3)).otherwise(F.substring("id", 1, 3)).alias("id"), "t", value.alias("value"))


def in_home_currency(returns: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, t, ret): local log returns (id, ccy, t, ret) plus the sum of the currency's moves (ccy, t, ret) since the series' row before."""
    from tidemark.operators.joins import interval_sums

    d = returns.withColumn("low", F.lag("t").over(by())).where("low IS NOT NULL")
    s = interval_sums(d.withColumnRenamed("t", "high"), moves.select("ccy", "t", F.col("ret").alias("move")), "ccy", "low", "high", "t", "move")
    return s.select("id", F.col("high").alias("t"), (F.col("ret") + F.col("total")).alias("ret"))


def orthogonalised(built: DataFrame, recipes: list[Recipe], **fit) -> DataFrame:
    """(factor_id, t, value, residual): each factor less its causal fit on the residuals of those it names, in the recipes' order."""
    from tidemark.operators.regression import residuals

    done: dict[str, DataFrame] = {}
    for r in in_order(recipes):
        own = built.where(F.col("factor_id") == r.factor_id).select("factor_id", "t", "value")
        if r.residual_on:
            d = own.select(F.col("factor_id").alias("id"), "t", F.col("value").alias("y"))
            for k, x in enumerate(r.residual_on):
                d = d.join(done[x].select("t", F.col("residual").alias(f"x{k}")), "t", "left")
            e = residuals(d, [f"x{k}" for k in range(len(r.residual_on))], **fit).select("t", F.col("resid").alias("residual"))
            done[r.factor_id] = own.join(e, "t", "left")
        else:
            done[r.factor_id] = own.withColumn("residual", F.col("value"))
    out = None
    for d in done.values():
        d = d.select("factor_id", "t", "value", "residual")
        out = d if out is None else out.unionByName(d)
    return out


def formula(r: Recipe) -> str:
    """A recipe in words of algebra."""
    i = r.inputs
    text = {
        "single": lambda: f"{'-' if i.get('sign', 1) < 0 else ''}r({i['id']})", "spread": lambda: f"r({i['long']}) - r({i['short']})",
        "basket": lambda: "mean(" + ", ".join(f"r({x})" for x in i["long"]) + ")" + (" - mean(" + ", ".join(f"r({x})" for x in i["short"]) + ")" if i.get("short") else ""),
        "curve": lambda: f"{i['shape']} of -dy({', '.join(i['tenors'])})", "level_transform": lambda: f"{i['transform']}({i['id']})", "variance_premium": lambda: f"({i['implied']}[t-1] / 100)^2 / 252 - r({i['id']})^2",
        "tsmom": lambda: f"sum(w r) / sum|w|, w = sign(sum of {i['span']} r to t-{i['skip']}) / sd({i['vol']})", "xs_momentum": lambda: f"mean r of the upper third - lower third by sum of {i['span']} r to t-{i['skip']}",
        "fx_carry": lambda: "mean(sign(gap) (r + gap / 252))",
        "spread_level": lambda: f"{i['transform']}({i['a']} - {i['b']})", "synthetic_bond": lambda: f"bond({i['id']}, {i['tenor']})",
    }[r.method]()
    return f"{r.factor_id} = {text}" + (f", less its fit on {', '.join(r.residual_on)}" if r.residual_on else "")
