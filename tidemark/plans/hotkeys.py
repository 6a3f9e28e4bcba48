"""As-of joins, interval sums and fills on a single key that holds every row: the tasks are the buckets of time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import joins as j
from tidemark.operators import recursions as rc
from tidemark.plans.panel import query
from tidemark.plans.relational import read


def one_stream(spark, sf_dir):
    """All events as one series, in the order of their time; events of one time are one, the newest by number."""
    e = read(spark, sf_dir, "events").groupBy("ts").agg(F.max_by(F.struct("event_id", "event_type", "value"), "event_id").alias("x"))
    return e.select(F.lit("all").alias("k"), "ts", "x.*")


STREAM = "e AS (SELECT ts, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY ts)"


@query(f"""WITH {STREAM} SELECT l.event_id, r.value, r.ts AS value_t FROM (SELECT * FROM e WHERE event_type = 'purchase') l ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'error') r ON l.ts > r.ts""")
def hot_key_asof(spark, sf_dir):
    """The last error before each purchase, of all users together."""
    e = one_stream(spark, sf_dir)
    return j.asof_backward(e.where("event_type = 'purchase'").select("k", "ts", "event_id"), e.where("event_type = 'error'").select("k", "ts", "value"), "k", "ts", "value", strict=True).select("event_id", "value", "value_t")


@query(f"""WITH {STREAM}, v AS (SELECT ts, event_id, CASE WHEN event_type = 'error' THEN value END AS x FROM e)
SELECT event_id, last_value(x IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, last_value(x IGNORE NULLS) OVER (ORDER BY ts ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS filled_3 FROM v""")
def hot_key_fill(spark, sf_dir):
    e = one_stream(spark, sf_dir).select("k", "ts", "event_id", F.when(F.col("event_type") == "error", F.col("value")).alias("x"))
    return j.forward_filled(j.forward_filled(e, "k", "ts", "x", "filled"), "k", "ts", "x", "filled_3", 3).select("event_id", "filled", "filled_3")


@query(f"""WITH {STREAM}, r AS (SELECT ts, sum(value) OVER (ORDER BY ts) AS run FROM e) SELECT e.event_id, round(b.run - coalesce(a.run, 0), 4) AS total FROM e ASOF JOIN r b ON e.ts >= b.ts ASOF LEFT JOIN r a ON e.ts - INTERVAL 6 HOUR >= a.ts""")
def hot_key_interval(spark, sf_dir):
    """The value of all events in the six hours up to each one."""
    e = one_stream(spark, sf_dir)
    b = e.select("k", "event_id", (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("low"), F.col("ts").alias("high"))
    return j.interval_sums(b, e.select("k", "ts", "value"), "k", "low", "high", "ts", "value").select("event_id", F.round("total", 4).alias("total"))


@query(f"""WITH RECURSIVE {STREAM}, v AS (SELECT event_id, ts, value, row_number() OVER (ORDER BY ts) AS i FROM e),
m AS (SELECT event_id, i, value AS v, NULL::DOUBLE AS before FROM v WHERE i = 1 UNION ALL SELECT v.event_id, v.i, power(0.5, 1 / 50.0) * m.v + (1 - power(0.5, 1 / 50.0)) * v.value, m.v FROM m JOIN v ON v.i = m.i + 1)
SELECT event_id, round(v, 6) AS value, round(before, 6) AS before FROM m""")
def hot_key_mean(spark, sf_dir):
    """The exponential mean of all events' values, a recursion over a single key, in buckets of a day."""
    e = one_stream(spark, sf_dir)
    d = rc.exponential_means(e, "k", "ts", "value", 50.0)
    return d.join(e.select("ts", "event_id"), "ts").select("event_id", F.round("value", 6).alias("value"), F.round("before", 6).alias("before"))
