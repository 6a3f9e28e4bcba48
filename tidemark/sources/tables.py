"""Sources and sinks of long tables: schemas, upserts, watermarks, restatements and vintages, as plain DataFrame operations.

Parquet has no update in place, so each of these gives the new table; `replace_partitions` writes it without touching what
it reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W


def _schema(**kinds: str) -> T.StructType:
    return T.StructType([T.StructField(k, T._parse_datatype_string(v)) for k, v in kinds.items()])


#: Stored tables, by name: their columns in order.
COLUMNS = {
    "input_return": "instrument_id string, date date, close double, adj_close double, ret_simple double, ret_log double, volume bigint, currency string, source string",
    "input_level": "series_id string, date date, value double, source string",
    "input_fx": "ccy string, date date, usd_per_unit double",
    "factor_return": "factor_id string, date date, ret_log double, ret_excess double, ret_orth double, n_inputs smallint, is_complete boolean",
    "loading": "spec_id string, instrument_id string, window_end date, factor_id string, beta double, se double, t_stat double, p_value double, vif double",
    "loading_cov": "spec_id string, instrument_id string, window_end date, factor_ids array<string>, cov array<double>",
}


def read(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table under its declared schema."""
    return spark.read.schema(COLUMNS[name]).parquet(f"{path}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, table: str, column: str, low: int, high: int, parts: int, **options) -> DataFrame:
    """A foreign table in `parts` ranges of a numeric column; filters and columns are pushed to the server."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=parts, fetchsize=50_000, **options).load()


def finite(df: DataFrame) -> DataFrame:
    """NaN and infinities of every floating column become null, as stored tables have them."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == F.lit(float("inf")))
    return df.withColumns({f.name: F.when(~bad(f.name), F.col(f.name)) for f in df.schema if isinstance(f.dataType, T.DoubleType | T.FloatType)})


def upsert(base: DataFrame, delta: DataFrame, keys: list[str], changed: Column | None = None, version: str | None = None, only_if: Column | None = None) -> DataFrame:
    """base with delta's rows in place of those with the same keys, and delta's new ones.

    `changed` (over aliases b and d) says when a replaced row's `version` rises by one; `only_if` when a row may be
    replaced at all. delta has one row for each key.
    """
    b, d = base.alias("b"), delta.alias("d")
    on = [F.col(f"b.{k}").eqNullSafe(F.col(f"d.{k}")) for k in keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    j = b.withColumn("__b", F.lit(1)).alias("b").join(d.withColumn("__d", F.lit(1)).alias("d"), cond, "full")
    both = F.col("b.__b").isNotNull() & F.col("d.__d").isNotNull()
    take = F.when(both, only_if if only_if is not None else F.lit(True)).otherwise(F.col("d.__d").isNotNull())
    out = []
    for c in base.columns:
        if c == version:
            rises = F.when(changed if changed is not None else F.lit(False), 1).otherwise(0)
            out.append(F.when(both & take, F.col(f"b.{c}") + rises).when(F.col("b.__b").isNull(), F.lit(1)).otherwise(F.col(f"b.{c}")).alias(c))
        else:
            out.append(F.when(take, F.col(f"d.{c}")).otherwise(F.col(f"b.{c}")).alias(c))
    return j.select(*out)


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    return base.unionByName(delta.join(base.select(*keys).distinct(), keys, "left_anti"))


def replace_keys(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """Delete-then-insert: all of base's rows of delta's keys give way to delta's."""
    return base.join(delta.select(*keys).distinct(), keys, "left_anti").unionByName(delta)


def resume(source: DataFrame, base: DataFrame, key: str, t: str, overlap_days: int = 0) -> DataFrame:
    """source's rows after each key's own newest date in base, or from `overlap_days` before it; unknown keys in full."""
    marks = base.groupBy(key).agg(F.max(t).alias("__mark"))
    d = source.join(marks, key, "left")
    return d.where(F.col("__mark").isNull() | (F.col(t) > F.date_sub("__mark", overlap_days))).drop("__mark")


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__rn = 1").drop("__rn")


def restated(base: DataFrame, actions: DataFrame, key: str, t: str, columns: list[str]) -> DataFrame:
    """base with `columns` before an action's date multiplied by its factor; actions has (key, t, factor), several for a key multiply."""
    steps = actions.select(F.col(key), F.col(t).alias("__at"), F.ln("factor").alias("__f"))
    rows = base.select(F.col(key).alias("__k"), F.col(t).alias("__at")).distinct()
    marks = rows.withColumn("__f", F.lit(0.0)).unionByName(steps.withColumnRenamed(key, "__k"))
    later = marks.withColumn("__later", F.coalesce(F.sum("__f").over(W.partitionBy("__k").orderBy("__at").rangeBetween(W.currentRow, W.unboundedFollowing)), F.lit(0.0)) - F.sum("__f").over(W.partitionBy("__k", "__at")))
    scale = later.groupBy("__k", "__at").agg(F.exp(F.max("__later")).alias("__scale"))
    d = base.join(scale, (base[key] == scale["__k"]) & (base[t] == scale["__at"]))
    return d.select(*((F.col(c) * F.col("__scale")).alias(c) if c in columns else F.col(c) for c in base.columns))


def first_releases(vintages: DataFrame, keys: list[str], value: str, released: str) -> DataFrame:
    """One row for each observation, as it was first released."""
    return vintages.groupBy(*keys).agg(F.min_by(value, released).alias(value), F.min(released).alias(released))


def release_points(first: DataFrame, reference: str, released: str, value: str, lag: int, trusted: int = 14) -> DataFrame:
    """(t, value): observations on the day they became known: the release if at most `trusted` days after the reference, else reference plus lag; the later reference wins a day."""
    on = F.when(F.datediff(released, reference).between(0, trusted), F.col(released)).otherwise(F.date_add(reference, lag))
    return first.withColumn("t", on).groupBy("t").agg(F.max_by(value, reference).alias(value))


def replace_partitions(df: DataFrame, path: str, partition: str) -> None:
    """Overwrite only the partitions that df has rows of. df may read from `path`: it is staged first."""
    spark = df.sparkSession
    staged = f"{path}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def read_valuation_csv(spark: SparkSession, path: str, date_col: str = "Date") -> DataFrame:
    """(country, date, value) of a wide CSV with day-first dates; zero and what isn't a number are missing."""
    wide = spark.read.option("header", True).csv(path)
    wide = wide.toDF(*(c.lstrip("﻿").strip() for c in wide.columns))
    names = [c for c in wide.columns if c != date_col]
    long = wide.select(F.expr(f"try_to_timestamp(`{date_col}`, 'd/M/yyyy')").cast("date").alias("date"), *names).unpivot("date", names, "country", "raw")
    return long.select("country", "date", F.expr("nullif(try_cast(raw AS double), 0)").alias("value")).where("date IS NOT NULL AND value IS NOT NULL")


def decimal_month(x: Column) -> Column:
    """1871.1 is October 1871: the last day of the month that the two digits after the point name."""
    n = F.round(x * 100).cast("int")
    return F.last_day(F.make_date(F.floor(n / 100).cast("int"), F.pmod(n, F.lit(100)), F.lit(1)))


def flattened(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, names, cov): a matrix in pairs (i, j, value) as its sorted names and row-major array."""
    g = entries.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("i", "j", "value"))).alias("m"))
    return g.select(*keys, F.array_sort(F.array_distinct("m.i")).alias("names"), F.col("m.value").alias("cov"))


def unflattened(stored: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of a matrix that is stored as names and a row-major array."""
    e = stored.select(*keys, "names", F.posexplode("cov").alias("p", "value"))
    k = F.size("names")
    return e.select(*keys, F.get("names", F.floor(F.col("p") / k).cast("int")).alias("i"), F.get("names", F.col("p") % k).alias("j"), "value")


def register(spark: SparkSession, folder: str, names: list[str]) -> None:
    """The Parquet tables of a folder as temporary views, for SQL."""
    for n in names:
        spark.read.parquet(f"{folder}/{n}.parquet").createOrReplaceTempView(n)


def validated(df: DataFrame, name: str) -> DataFrame:
    """df in the declared columns and types of a stored table; a missing or a further column is an error."""
    want = T._parse_datatype_string(COLUMNS[name])
    if sorted(df.columns) != sorted(f.name for f in want):
        raise ValueError(f"{name} has the columns {[f.name for f in want]}, not {df.columns}")
    return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in want))


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """(series_id, date, value) of landed JSON lines {series_id, observations: [{date, value}]}; '.' and '' are missing."""
    raw = spark.read.schema("series_id string, observations array<struct<date: string, value: string>>").json(path)
    return raw.select("series_id", F.explode("observations").alias("o")).select("series_id", F.to_date("o.date").alias("date"), F.expr("try_cast(o.value AS double)").alias("value"))


def with_release(df: DataFrame, pattern: str = r"R(\d+)") -> DataFrame:
    """df with `release`, what the pattern's group finds in the name of the row's file."""
    return df.withColumn("release", F.regexp_extract(F.element_at(F.split(F.input_file_name(), "/"), -1), pattern, 1))


def stacked_header(rows: DataFrame, header_rows: int, wanted: dict[str, str]) -> DataFrame:
    """Columns of a landed sheet (line, c0, c1 ...) by labels that are stacked over them in the first lines: `wanted` gives a name for
    each joined label; one that isn't there is an error."""
    cells = [c for c in rows.columns if c != "line"]
    top = rows.where(F.col("line") < header_rows).orderBy("line").collect()
    labels = {" ".join(str(r[c]).strip() for r in top if r[c]): c for c in cells}
    if lost := [k for k in wanted if k not in labels]:
        raise ValueError(f"no columns under {lost}")
    return rows.where(F.col("line") >= header_rows).select(*(F.col(labels[k]).alias(v) for k, v in wanted.items()))


def recipe_inputs(recipes: DataFrame, keys: list[str]) -> DataFrame:
    """(factor_id, place, input) of recipes (factor_id, construction: JSON): the names under the keys, lists or single, in order, once."""
    lists = [F.coalesce(F.from_json(F.get_json_object("construction", f"$.inputs.{k}"), "array<string>"), F.array(F.get_json_object("construction", f"$.inputs.{k}"))) for k in keys]
    names = F.array_distinct(F.array_compact(F.concat(*lists)))
    return recipes.select("factor_id", F.posexplode(names).alias("place", "input"))
