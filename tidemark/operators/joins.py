"""Joins in time: as-of in both directions, interval sums, fills, and gaps against a calendar.

A key's rows are dealt out by buckets of time, so a key with most of the rows takes as many tasks as it has buckets. What a
bucket needs from the ones before it, the last value or a sum, comes from a table with a row for each bucket of each key;
that row goes in front of the bucket's own rows, so no join and no pair of rows is ever formed that isn't part of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType
from pyspark.sql.window import Window as W

#: Buckets of a date, of a time and of a number.
DATES, TIMES, NUMBERS = "quarter", "day", 4096


def bucket_of(df: DataFrame, t: str, bucket: str | int | None = None) -> Column:
    """The bucket of a row's time: a unit of date_trunc, or for a number the width of a bucket."""
    kind = df.schema[t].dataType
    if isinstance(kind, NumericType):
        return F.floor(F.col(t) / (bucket or NUMBERS))
    return F.date_trunc(bucket or (DATES if isinstance(kind, DateType) else TIMES), F.col(t))


def with_last(df: DataFrame, key: str, t: str, value: str, order: list[str], out: str, bucket: str | int | None = None) -> DataFrame:
    """df with `out`: of the key's rows up to this one, by `order` (t first), the last `value` that isn't null.

    Null keys are one key; rows without a time come before all others. Ties in `order` may stand in any order.
    """
    d = df.withColumns({"__bucket": bucket_of(df, t, bucket), "__own": F.lit(1)})
    at = F.struct(*order)
    per = d.groupBy(key, "__bucket").agg(F.max_by(value, F.when(F.col(value).isNotNull(), at)).alias(value))
    w = W.partitionBy(key).orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ahead = per.withColumn(value, F.last(value, ignorenulls=True).over(w)).where(F.col(value).isNotNull()).withColumn("__own", F.lit(0))
    inside = W.partitionBy(key, "__bucket").orderBy("__own", *(F.col(c).asc_nulls_first() for c in order)).rowsBetween(W.unboundedPreceding, 0)
    both = d.unionByName(ahead, allowMissingColumns=True).withColumn(out, F.last(value, ignorenulls=True).over(inside))
    return both.where("__own = 1").drop("__bucket", "__own")


def with_running(df: DataFrame, key: str, t: str, value: str, out: str, bucket: str | int | None = None) -> DataFrame:
    """df, one row for each key and time, with `out`: the sum of `value` over the key's rows up to this one; nulls count as nothing."""
    d = df.withColumns({"__bucket": bucket_of(df, t, bucket), "__own": F.lit(1), "__x": F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType))})
    w = W.partitionBy(key).orderBy(F.col("__bucket").asc_nulls_first()).rowsBetween(W.unboundedPreceding, -1)
    ahead = d.groupBy(key, "__bucket").agg(F.sum("__x").alias("__x")).withColumn("__x", F.sum("__x").over(w)).where("__x IS NOT NULL").withColumn("__own", F.lit(0))
    inside = W.partitionBy(key, "__bucket").orderBy("__own", F.col(t).asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    both = d.unionByName(ahead, allowMissingColumns=True).withColumn(out, F.sum("__x").over(inside))
    return both.where("__own = 1").drop("__bucket", "__own", "__x")


def forward_filled(df: DataFrame, key: str, t: str, value: str, out: str, limit: int | None = None, bucket: str | int | None = None) -> DataFrame:
    """df, one row for each key and time, with `out`: `value`, or the key's last one before it, at most `limit` rows before."""
    if limit is None:
        return with_last(df, key, t, value, [t], out, bucket)
    d = with_running(df.withColumn("__one", F.lit(1).cast("long")), key, t, "__one", "__pos", bucket)
    d = d.withColumn("__held", F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("x"), F.col("__pos").alias("pos"))))
    d = with_last(d, key, t, "__held", [t], "__last", bucket)
    return d.withColumn(out, F.when(F.col("__pos") - F.col("__last.pos") <= limit, F.col("__last.x"))).drop("__one", "__pos", "__held", "__last")


def asof_backward(left: DataFrame, right: DataFrame, key: str, t: str, value: str, strict: bool = False, bucket: str | int | None = None) -> DataFrame:
    """left with `value`, right's value at its latest time at or before left's (before it, if strict), and `value_t`, that time.

    right has one row for each key and time. Keys without an earlier row get nulls.
    """
    side = F.lit(1 if strict else 0)
    names = [c for c in left.columns if c not in (key, t)]
    row = F.struct(*names) if names else F.struct(F.lit(1).alias("__one"))
    a = left.select(key, t, row.alias("__row"), (F.lit(1) - side).alias("__side"))
    b = right.select(key, t, side.alias("__side"), F.struct(F.col(value).alias("v"), F.col(t).alias("t")).alias("__v"))
    d = with_last(a.unionByName(b, allowMissingColumns=True), key, t, "__v", [t, "__side"], "__last", bucket).where("__row IS NOT NULL")
    return d.select(key, t, *(F.col(f"__row.{c}").alias(c) for c in names), F.col("__last.v").alias(value), F.col("__last.t").alias(f"{value}_t"))


def roll_forward(rows: DataFrame, calendar: DataFrame, key: str, t: str, value: str) -> DataFrame:
    """(key, t, value): each row moved to the next calendar day at or after its own; of several on one day the latest wins. Rows after the last day go."""
    # Where a date goes depends on the date alone: the distinct dates and the calendar, both as short as the years they span,
    # are put in one order and the next open day is looked up there.
    both = rows.select(F.col(t).alias("__d")).distinct().withColumn("__open", F.lit(None).cast("date")).unionByName(calendar.select(F.col(t).alias("__d"), F.col(t).cast("date").alias("__open")).distinct())
    ahead = W.orderBy("__d").rangeBetween(W.currentRow, W.unboundedFollowing)
    goes = both.withColumn("__day", F.min("__open").over(ahead)).where("__open IS NULL AND __day IS NOT NULL").select("__d", "__day")
    d = rows.join(goes, rows[t] == goes["__d"])
    return d.groupBy(key, F.col("__day").alias(t)).agg(F.max_by(value, rows[t]).alias(value))


def interval_sums(bounds: DataFrame, moves: DataFrame, key: str, low: str, high: str, t: str, value: str) -> DataFrame:
    """bounds with `total`, the sum of the moves in (low, high]: the difference of running sums as of either end."""
    running = with_running(moves.groupBy(key, t).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("__m")), key, t, "__m", "__run").select(key, t, "__run")
    at_high = asof_backward(bounds.withColumnRenamed(high, t), running, key, t, "__run").withColumnRenamed(t, high).withColumnRenamed("__run", "__at_high").drop("__run_t")
    at_low = asof_backward(at_high.withColumnRenamed(low, t), running, key, t, "__run").withColumnRenamed(t, low).drop("__run_t")
    return at_low.withColumn("total", F.coalesce("__at_high", F.lit(0.0)) - F.coalesce("__run", F.lit(0.0))).drop("__at_high", "__run")


def missing_days(present: DataFrame, sessions: DataFrame, key: str, t: str) -> DataFrame:
    """(key, t): sessions between a key's first and last date on which it has no row. A null key is one key, which has rows on no date.

    A month of a key is one row with a bit for each of its days, and so is a month of the calendar; days become rows again
    only where they are missing, so that what moves are months and not the full series.
    """
    month, bit = F.trunc(t, "month").alias("__month"), F.call_function("shiftleft", F.lit(1), F.dayofmonth(t) - 1)
    open_days = sessions.select(t).groupBy(month).agg(F.bit_or(bit).alias("__open"))
    had = present.where(F.col(t).isNotNull()).groupBy(key, month).agg(F.bit_or(bit).alias("__had"), F.min(t).alias("__low"), F.max(t).alias("__high"))
    whole = W.partitionBy(key)
    d = had.withColumns({"__low": F.min("__low").over(whole), "__high": F.max("__high").over(whole), "__next": F.lead("__month").over(whole.orderBy("__month"))})
    # A month without rows has no bit; months up to the key's next one are told from its row.
    until = F.coalesce(F.add_months("__next", -1), F.col("__month"))
    d = d.select(key, "__low", "__high", "__had", F.col("__month").alias("__of"), F.explode(F.sequence("__month", until, F.expr("interval 1 month"))).alias("__month"))
    has = F.when(F.col(key).isNotNull() & (F.col("__of") == F.col("__month")), F.col("__had")).otherwise(0)
    # The calendar has a row for each month.
    d = d.join(F.broadcast(open_days), "__month").withColumn("__lacks", F.col("__open").bitwiseAND(F.bitwise_not(has)))
    lacking = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda i: F.call_function("shiftright", "__lacks", i).bitwiseAND(1) == 1)
    days = d.where("__lacks <> 0").select(key, "__low", "__high", F.explode(F.transform(lacking, lambda i: F.date_add("__month", i))).alias(t))
    return days.where(F.col(t).between(F.col("__low"), F.col("__high"))).select(key, t)


def either_key(left: DataFrame, right: DataFrame, keys: list, right_key: str, how: str = "left") -> DataFrame:
    """left with right's other columns where right_key equals one of `keys` (columns of left), the first of them that is found.

    right has one row for each key. Each key is a join of its own, so no row has to be known again by a number.
    """
    names = [c for c in right.columns if c != right_key]
    d = left
    for k, key in enumerate(keys):
        r = right.select(F.col(right_key).alias(f"__key_{k}"), F.struct(*names).alias(f"__row_{k}"))
        d = d.withColumn(f"__try_{k}", key if isinstance(key, Column) else F.col(key))
        d = d.join(r, F.col(f"__try_{k}") == F.col(f"__key_{k}"), "left").drop(f"__key_{k}", f"__try_{k}")
    d = d.withColumn("__row", F.coalesce(*(f"__row_{k}" for k in range(len(keys)))))
    d = d if how == "left" else d.where("__row IS NOT NULL")
    return d.select(*left.columns, *(F.col(f"__row.{c}").alias(c) for c in names))
