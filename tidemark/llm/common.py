"""Helpers shared by the corpus operators: words, hashes, spans, written intermediate tables and row components."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import for_workers
from tidemark.sources.stored import one_process

#: White space as the contracts define it: space and the code points 9 to 13.
SPACE = "[\\x20\\x09-\\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a new folder under /tmp if all of Spark runs in one process, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not one_process(spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(folder)
        folder = f"file://{folder}"
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and a lost executor loses nothing of it."""
    path = f"{shared_folder(df.sparkSession)}/tidemark-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables from `written` that nothing reads any more."""
    for d in tables:
        path = d.sparkSession._jvm.org.apache.hadoop.fs.Path(d.written_to)
        path.getFileSystem(d.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def with_columns_from(df: DataFrame, column: str, make, new: dict[str, str], portion: int) -> DataFrame:
    """df without `column` but with the `new` columns (name: type) that make(list of its values) returns as lists or arrays.

    Arrow batches go through untouched, so other columns keep their types and nulls whatever they hold. Work is done on
    about `portion` bytes at a time.
    """
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    for_workers(df.sparkSession)
    names = [f"c{i}" for i in range(len(df.columns))]
    rest = [(n, f) for n, f in zip(names, df.schema, strict=True) if f.name != column]
    d = df.toDF(*names)
    at = names[df.columns.index(column)]
    added = [f"n{i}" for i in range(len(new))]

    kinds = {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False))
            begin = 0
            while begin < batch.num_rows:
                done = int(ends[begin - 1]) if begin else 0
                stop = max(begin + 1, int(np.searchsorted(ends, done + portion)))
                part = batch.slice(begin, stop - begin)
                made = make(part.column(at).to_pylist())
                extra = [pa.array(x, type=kinds[t]) for x, t in zip(made, new.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(n) for n, _ in rest] + extra, names=[n for n, _ in rest] + added)
                begin = stop
        pa.default_memory_pool().release_unused()

    schema = ", ".join([f"{n} {f.dataType.simpleString()}" for n, f in rest] + [f"{n} {t}" for n, t in zip(added, new.values(), strict=True)])
    done = d.mapInArrow(run, schema)
    return done.select(*(F.col(n).alias(f.name) for n, f in rest), *(F.col(n).alias(k) for n, k in zip(added, new, strict=True)))


def text_of(column: str | Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs outside SPACES, in order, unchanged."""
    return F.array_remove(F.split(text, SPACE), "")


def bits_between(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hex16(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Running values are made in pieces of CHUNK, pieces of those and so on, so that no array is copied once for each entry.
CHUNK = 128


def bound(value: Column, use) -> Column:
    """use(value) with the value computed once, though `use` refers to it several times."""
    return F.get(F.transform(F.array(value), use), 0)


def running(a: Column, zero: int, op: str) -> Column:
    """Of an array of ints as many ints: zero for the first entry, then op over all entries before.

    op is SQL of {a} and {b}, associative, with zero as its neutral value.
    """
    plain = lambda x: f"aggregate({x}, named_struct('at', {zero}, 'out', cast(array() AS array<int>)), (acc, v) -> named_struct('at', {op.format(a='acc.at', b='v')}, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"

    def chunked(x: str, level: int) -> str:
        if level == 1:
            return plain(x)
        cut = f"transform(sequence(0, cast(floor((size({x}) - 1) / {CHUNK}) AS int)), k -> slice({x}, k * {CHUNK} + 1, {CHUNK}))"
        totals = f"transform(c{level}, y -> aggregate(y, {zero}, (acc, v) -> {op.format(a='acc', b='v')}))"
        ahead = f"get(transform(array({totals}), t{level} -> {chunked(f't{level}', level - 1)}), 0)"
        pieces = f"flatten(zip_with(c{level}, {ahead}, (y, base) -> transform({plain('y')}, v -> {op.format(a='v', b='base')})))"
        return f"CASE WHEN size({x}) > {CHUNK} THEN get(transform(array({cut}), c{level} -> {pieces}), 0) ELSE {plain(x)} END"

    return F.get(F.call_function("transform", F.array(a), F.expr(f"x -> {chunked('x', 2)}")), 0)


#: Operations for `running`.
SUM, LARGEST, SMALLEST = "{a} + {b}", "greatest({a}, {b})", "least({a}, {b})"


def places(kind: str, matches: Column, pieces: Column, check=None) -> Column:
    """The matches that pass the check as array<struct<kind, start, end, value>>, in code points, the end exclusive.

    pieces: the lengths of what a split at the same pattern leaves between the matches.
    """
    before = F.concat(F.array(F.lit(0)), F.transform(matches, F.length))
    steps = F.zip_with(F.slice(pieces, 1, F.size(matches)), F.slice(before, 1, F.size(matches)), lambda p, q: p + q)
    starts = bound(steps, lambda x: F.zip_with(running(x, 0, SUM), x, lambda p, q: p + q))
    spans = F.zip_with(starts, matches, lambda at, m: F.struct(F.lit(kind).alias("kind"), at.alias("start"), (at + F.length(m)).cast("int").alias("end"), m.alias("value")))
    return F.when(F.size(matches) > 0, F.filter(spans, lambda s: check(s["value"])) if check else spans).otherwise(F.array().cast(SPAN))


def matches_with_places(df: DataFrame, text: str, patterns: dict[str, str], checks: dict, guards: dict[str, list[str]]) -> DataFrame:
    """Adds for each kind a column <kind> of its leftmost non-overlapping matches that pass their check.

    guards: a text with none of these strings can't have a match of that kind.
    """
    maybe = {k: reduce(lambda a, b: a | b, [F.contains(F.col(text), F.lit(g)) for g in guards[k]]) if k in guards else F.lit(True) for k in patterns}
    found = df.withColumns({f"__m_{k}": F.when(maybe[k], F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))) for k, p in patterns.items()})
    found = found.withColumns({f"__p_{k}": F.when(F.size(f"__m_{k}") > 0, F.transform(F.split(F.col(text), p, -1), F.length)) for k, p in patterns.items()})
    return found.withColumns({k: places(k, F.col(f"__m_{k}"), F.col(f"__p_{k}"), checks.get(k)) for k in patterns}).drop(*(f"__{x}_{k}" for x in "mp" for k in patterns))


def indexed(text: Column) -> Column:
    """The text with four bytes a code point, so that a piece of it is reached without walking there."""
    return F.encode(text, "UTF-32")


def piece(points: Column, begin: Column, end: Column) -> Column:
    """Code points begin to end (exclusive) of an indexed text. A letter in front keeps a first U+FEFF from being read as a byte order mark."""
    return F.substring(F.decode(F.concat(F.lit(b"\0\0\0A"), F.substring(points, begin * 4 + 1, (end - begin) * 4)), "UTF-32"), F.lit(2), end - begin)


def masked_text(text: Column, spans: Column, mask) -> Column:
    """The text with each span replaced by mask(span); spans are sorted by start, and what overlaps an earlier one only shortens the text between."""
    ends = F.transform(spans, lambda s: s["end"])
    parts = lambda p: F.zip_with(spans, running(ends, 0, LARGEST), lambda s, at: F.when(s["start"] >= at, F.concat(piece(p, at, s["start"]), mask(s))).otherwise(F.lit("")))
    rest = lambda p: piece(p, F.array_max(ends), F.greatest(F.array_max(ends), F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(bound(indexed(text), lambda p: F.concat(F.array_join(parts(p), ""), rest(p))))


def clear_of(spans: Column, others: Column) -> Column:
    """The spans, sorted by start, that overlap none of the others: one pass over both in order, forwards and backwards."""
    far = 2_147_483_647
    row = lambda s, tag, i: F.struct(s["start"].alias("start"), F.lit(tag).alias("tag"), s["end"].alias("end"), i.cast("int").alias("i"))
    both = F.sort_array(F.concat(F.transform(others, lambda s, i: row(s, 0, i)), F.transform(spans, lambda s, i: row(s, 1, i))))

    def swept(x: Column) -> Column:
        ended = running(F.transform(x, lambda y: F.when(y["tag"] == 0, y["end"]).otherwise(0)), 0, LARGEST)
        begins = F.reverse(running(F.reverse(F.transform(x, lambda y: F.when(y["tag"] == 0, y["start"]).otherwise(far))), far, SMALLEST))
        clear = F.zip_with(F.zip_with(x, ended, lambda y, e: F.when((y["tag"] == 1) & (e <= y["start"]), y)), begins, lambda y, b: F.when(b >= y["end"], y["i"]))
        return F.transform(F.array_compact(clear), lambda i: F.get(spans, i))

    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(bound(both, swept))


def joined_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def seeded(seed: str, id_col: str, text_hash: str) -> Column:
    """A hex key that puts rows in a seeded order; rows without an id are told apart by their text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("null:"), F.col(text_hash).cast("string")))))


def running_before(df: DataFrame, group: str, key: str, value: str, ties: list[str]) -> DataFrame:
    """df with `before`: the sum of `value` over the rows of the same group (not null) that come earlier by the hex key, then ties.

    A group is cut into 4096 cells by the key's first three digits, so no task sees a whole group: a window runs inside
    each cell, and the cells' own totals, a table of 4096 rows a group at most, say what lies before a cell.
    """
    d = df.withColumn("__cell", F.substring(key, 1, 3))
    cells = d.groupBy(group, "__cell").agg(F.sum(value).alias("__sum"))
    ahead = W.partitionBy(group).orderBy("__cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("__ahead", F.coalesce(F.sum("__sum").over(ahead), F.lit(0))).drop("__sum")
    inside = W.partitionBy(group, "__cell").orderBy(key, *ties).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    # The window has dealt the rows out by the very keys of this join, so they don't move again.
    d = d.join(cells, [group, "__cell"])
    return d.withColumn("before", F.col("__ahead") + F.col("__inside")).drop("__cell", "__ahead", "__inside")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges(a, b): label is the smallest node that node reaches.

    Labels fall to the smallest one among neighbours and then jump to their label's label, until none changes, so the
    rounds grow with the logarithm of the longest chain. Every round is written to the shared folder.
    """
    both = written(edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = held = written(labels)
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("heard")), "b").groupBy(F.col("a").alias("node")).agg(F.min("heard").alias("heard"))
        near = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = written(near.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")))
        changed = after.where("old <> label").limit(1).count()
        discard(held)
        labels, held = after.select("node", "label"), after
        if not changed:
            discard(both)
            return labels
