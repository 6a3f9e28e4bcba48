"""Files that are landed as they came, and tables of other databases: hashes, idempotent replacement, partition bounds."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path
from urllib.parse import urlsplit

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stored import materialised, shared_folder
from tidemark.sources.tables import replace_partitions


def land_csv(df: DataFrame, folder: str, notes: list[str] | None = None) -> None:
    """df as CSV files in `folder`, as others deliver them: `notes` as lines of their own and a header before the rows of each file."""
    rows = df.select(F.to_csv(F.struct(*(F.col(c).cast("string").alias(c) for c in df.columns)), {"quoteAll": "true"}).alias("value"), F.spark_partition_id().alias("__part"))
    parts = rows.select("__part").distinct()
    head = [*(notes or []), ",".join(f'"{c}"' for c in df.columns)]
    top = parts.select("__part", F.posexplode(F.array(*(F.lit(h) for h in head))).alias("__at", "value"))
    lines = materialised(rows.withColumn("__at", F.lit(len(head))).unionByName(top))
    lines.repartition("__part").sortWithinPartitions("__part", "__at").select("__part", "value").write.mode("overwrite").partitionBy("__part").text(folder)


def read_landed(spark: SparkSession, folder: str, schema: str, notes: int = 0) -> DataFrame:
    """The rows of land_csv's files in the types of `schema`, without their notes and headers; a cell that isn't of its type is null.

    A line counts as a header if it has the names of the schema, and as a note if it is none of the CSV's rows.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]
    lines = spark.read.text(folder)
    strings = ", ".join(f"{n} string" for n in names)
    header = ",".join(f'"{n}"' for n in names)
    d = lines.where((F.col("value") != header) & F.startswith("value", F.lit('"'))).select(F.from_csv("value", strings).alias("x")).select("x.*")
    kinds = [c.strip().split(" ", 1) for c in schema.split(",")]
    return d.select(*(F.expr(f"try_cast(nullif({n}, '') AS {kind})").alias(n) for n, kind in kinds))


def content_hash(spark: SparkSession, folder: str) -> str:
    """A hash of the files of a folder, whatever they are called: each is hashed where it is read, only the hashes reach the driver
    as one string, in their own order."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select(F.sha2("content", 256).alias("h"))
    return d.agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")).first()["h"]


def replace_source(rows: DataFrame, path: str, source: str, sha: str) -> bool:
    """Put rows in place of all that the table at `path` has of `source`, unless it is there with that hash already. Whether it wrote.

    The table is partitioned by source and carries the hash, so one source's files are replaced and the others' stay.
    """
    spark = rows.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path)):
        known = spark.read.parquet(path).where(F.col("source") == source).select("sha").limit(1).collect()
        if known and known[0]["sha"] == sha:
            return False
    replace_partitions(rows.withColumns({"sha": F.lit(sha), "source": F.lit(source)}), path, "source")
    return True


def bounds(spark: SparkSession, url: str, table: str, column: str, parts: int, options: dict | None = None) -> list[str]:
    """Conditions that cut a remote table into `parts` of equal width in a whole-numbered column; nulls go to the first. One row is read."""
    q = f"(SELECT min({column}) AS low, max({column}) AS high FROM {table}) b"
    r = spark.read.format("jdbc").options(url=url, dbtable=q, **(options or {})).load().first()
    if r[0] is None:
        return ["1 = 1"]
    low, width = int(r[0]), max(1, -(-(int(r[1]) - int(r[0]) + 1) // parts))
    cuts = [low + k * width for k in range(1, parts)]
    return [f"{column} < {cuts[0]} OR {column} IS NULL", *(f"{column} >= {a} AND {column} < {b}" for a, b in zip(cuts[:-1], cuts[1:], strict=True)), f"{column} >= {cuts[-1]}"] if cuts else ["1 = 1"]


def foreign(spark: SparkSession, url: str, table: str, column: str | None = None, parts: int = 8, fetch: int = 50_000, options: dict | None = None) -> DataFrame:
    """A table of another database: filters and columns are pushed to it; with a column it is read in `parts` at once."""
    given = {"fetchsize": str(fetch), **(options or {})}
    if column is None:
        return spark.read.format("jdbc").options(url=url, dbtable=table, **given).load()
    return spark.read.jdbc(url, table, predicates=bounds(spark, url, table, column, parts, options), properties=given)


#: The database that Spark brings along.
DERBY = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def delivered(df: DataFrame, table: str) -> str:
    """The URL of a read-only database with df as its `table`, which the driver and all executors open at once; its options are DERBY.

    An embedded database that can be written to belongs to one process. So it is filled where the driver runs, as one server
    would be: executors write the rows as CSV, the database loads these file by file onto its own disk and never holds more than its
    page cache. What is shared is the archive of the finished database. The shared folder has to be a mounted one.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    root = urlsplit(shared_folder(spark))
    if root.scheme not in ("", "file"):
        raise ValueError("an embedded database is opened from files: set spark.checkpoint.dir to a mounted folder")
    csv, archive = Path(root.path) / f"tidemark-{name}", Path(root.path) / f"tidemark-{name}.jar"
    # Quotes are doubled; a null is nothing, an empty string a pair of quotes.
    df.write.csv(f"file://{csv}", escape='"', nullValue="", emptyValue='""', timestampFormat="yyyy-MM-dd HH:mm:ss.SSSSSS")
    connect = spark._jvm.java.sql.DriverManager.getConnection
    with tempfile.TemporaryDirectory() as folder:
        url = f"jdbc:derby:{folder}/data"
        # No partitions, so that only the driver opens it.
        spark.createDataFrame(spark.sparkContext.emptyRDD(), df.schema).write.jdbc(f"{url};create=true", table, properties=DERBY)
        db = connect(url)
        load = db.prepareCall("CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, ?, ?, ',', '\"', 'UTF-8', 0)")
        for file in sorted(csv.glob("part-*.csv")):
            load.setString(1, table.upper())
            load.setString(2, str(file))
            load.execute()
        db.close()
        try:
            connect(f"{url};shutdown=true")
        except Py4JJavaError as done:
            # A database says that it is shut down by an exception.
            if done.java_exception.getSQLState() != "08006":
                raise
        # Stored as it is, so that pages are found by their place.
        with zipfile.ZipFile(archive, "w", zipfile.ZIP_STORED) as out:
            for x in sorted(Path(folder).glob("data/**/*")):
                if x.suffix != ".lck" and "tmp" not in x.relative_to(folder).parts:
                    out.write(x, x.relative_to(folder))
    path = spark._jvm.org.apache.hadoop.fs.Path(f"file://{csv}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return f"jdbc:derby:jar:({archive})data"


def foreign_schema(spark: SparkSession, url: str, names: list[str], options: dict | None = None) -> dict[str, DataFrame]:
    """Registers the named tables of another database as temporary views and returns them; nothing is read before they are used."""
    out = {n: foreign(spark, url, n, options=options) for n in names}
    for n, d in out.items():
        d.createOrReplaceTempView(n.split(".")[-1].strip('"').lower())
    return out
