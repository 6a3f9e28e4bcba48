"""SimHash near-duplicates by the generalised pigeonhole, and document fingerprints with permuted block tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import for_workers
from tidemark.llm.common import bits_between, components, discard, hex16, table, text_of, words_of, written
from tidemark.llm.hamming import block_tables, links, pigeonhole_cells, pigeonhole_plan
from tidemark.llm.simhash import fingerprints, lower_words, shingle_hashes, weighted_terms
from tidemark.llm.wordbytes import C1, mixed, portions, runs


def shingle_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, fp) of each row; no words: fp is zero.

    Equal rows of one partition are added up together and dealt out again: their votes are in the same proportion.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("t")).select("doc_id", F.xxhash64("t").alias("text_hash"), F.spark_partition_id().alias("part"), lower_words(F.col("t")).alias("w"))
    d = d.select("doc_id", "text_hash", "part", F.posexplode_outer(shingle_hashes(F.col("w"), shingle)).alias("i", "h"))
    rows = F.sum(F.when(F.coalesce("i", F.lit(0)) == 0, 1).otherwise(0)).cast("int").alias("rows")
    return fingerprints(d, ["doc_id", "text_hash", "part"], more=[rows]).select("doc_id", "text_hash", "fp", F.explode(F.sequence(F.lit(1), "rows")).alias("copy")).drop("copy")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, text_hash, fp, group_fp, component_id) of each row: rows whose fingerprints link at `radius` or fewer differing bits, transitively.

    component_id is the smallest doc_id that the row reaches, group_fp the smallest fingerprint of the group. Defined results: a null text is empty; texts without
    words have fingerprint zero and are linked like any other; identical rows stay rows of their own; null ids are
    ignored in the minimum; ties don't matter; other columns aren't read; an empty table gives an empty result.
    Equal fingerprints are one node, so a group of copies of any size costs one row here.
    """
    fps = written(shingle_fingerprints(docs, id_col, text_col, shingle))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    labels = components(links(pigeonhole_cells(nodes, pigeonhole_plan(nodes, radius)), radius))
    lowest = nodes.join(labels.withColumnRenamed("node", "fp"), "fp")
    roots = lowest.groupBy("label").agg(F.min("rep").alias("component_id"))
    grouped = nodes.join(lowest.select("fp", "label").join(roots, "label"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("group_fp"), F.coalesce("component_id", "rep").alias("component_id"))
    return fps.join(written(grouped), "fp").select("doc_id", "text_hash", "fp", "group_fp", "component_id")


#: Similar texts: words in a shingle, the least share of common shingles, bits in which the fingerprints of their words may
#: differ, members of a cell that may meet as pairs of rows, and members that may all meet inside a task: to deal a row out
#: again costs about as much as some thousand comparisons of two longs.
SHINGLE, SIMILARITY, WORD_RADIUS, FEW, SMALL = 5, 0.8, 8, 16, 4096
#: Bins of a sketch of the shingles, and how often cells are split by them again.
BINS, SPLITS = 128, 3
#: Hashes whose bits are laid out at a time.
VOTERS = 10_000


def least_common(bins: np.ndarray, similarity: float) -> np.ndarray:
    """Of so many bins that hold a shingle as many agree at that share of common shingles, give or take their standard deviation; if any hold one, one."""
    return np.minimum(bins, np.maximum(1, bins * similarity - np.sqrt(bins * similarity * (1 - similarity))))


def most_apart(similarity: float) -> np.ndarray:
    """The bins in which two similar sketches differ at most, by the number (0 to BINS) that one of the two or both hold."""
    held = np.arange(BINS + 1)
    return held - np.ceil(least_common(held, similarity)).astype(int)


def bin_blocks(similarity: float, held: int = BINS) -> int:
    """Blocks that the bins are cut into for sketches of which two hold so many bins or fewer: more than they may differ in if
    they are similar, and the more to choose from the fewer bins are in use."""
    return min(BINS, int(most_apart(similarity)[: held + 1].max()) + 2 + (BINS - held) // 16)


def block_plan(similarity: float) -> list[tuple[int, np.ndarray]]:
    """(blocks, dealt) for ranges of the number of bins that two sketches hold: the blocks to cut into, and by how many of its
    fullest blocks a sketch is dealt out, by the bins that it holds itself; 0 if it is in no similar pair of that range.

    Of n blocks similar sketches that differ in d bins share n - d at least. In one order of all blocks d others at most come
    before the first that they share, so it is among the first d + 1 of either sketch: the fullest, which fewest have by chance.
    """
    differ, plan, most = most_apart(similarity), [], BINS
    while most:
        least, dealt = most * 3 // 4 + 1, np.zeros(BINS + 1, dtype=int)
        for held in range(least, most + 1):
            own = slice(held - differ[held], held + 1)
            dealt[own] = np.maximum(dealt[own], differ[held] + 1)
        plan.append((bin_blocks(similarity, most), dealt))
        most = least - 1
    return plan


def votes(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """The 64-bit SimHash of each row's hashes (row ascends): a bit is one if it is set in over half of them."""
    ones, out = np.zeros((rows, 64), dtype=np.int64), np.zeros(rows, dtype=np.uint64)
    for low in range(0, len(h), VOTERS):
        some = row[low : low + VOTERS]
        first = np.flatnonzero(np.concatenate([[True], some[1:] != some[:-1]]))
        bits = np.unpackbits(h[low : low + VOTERS].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[some[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
    set_bits = 2 * ones > np.bincount(row, minlength=rows)[:, None]
    out[:] = np.packbits(set_bits, axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def sketches(h: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """BINS bytes of each row: a bin's byte comes from the smallest of the row's hashes that fall in it, 0 if none does."""
    out = np.zeros((rows, BINS), dtype=np.uint8)
    at = row * BINS + (h % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    first = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
    out.reshape(-1)[at[first]] = 1 + mixed(h[first]) % np.uint64(255)
    return out


def text_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, text_hash, words, sketch) of each row: the SimHash of its different words and a sketch of its shingles, A-Z in lower case.

    A null text has no words; without any, words is zero and the sketch all zeros. Rows stay rows, whatever repeats.
    """
    for_workers(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, w in portions(batches):
            n = some.num_rows
            w.data = np.where((w.data >= 65) & (w.data <= 90), w.data | 32, w.data)
            h = w.hashes(0, len(w.starts))
            order = np.lexsort((h, w.doc))
            sorted_h, sorted_doc = h[order], w.doc[order]
            new = np.concatenate([[True], (sorted_h[1:] != sorted_h[:-1]) | (sorted_doc[1:] != sorted_doc[:-1])])[: len(h)]
            count = np.diff(w.first)
            runs_h = runs(h, shingle)
            whole = np.flatnonzero(w.doc[: len(runs_h)] == w.doc[shingle - 1 : shingle - 1 + len(runs_h)])
            # Texts of fewer words have one shingle of all of them.
            short = np.flatnonzero((count > 0) & (count < shingle))
            few = np.array([runs(h[w.first[i] : w.first[i + 1]], int(count[i]))[0] for i in short], dtype=np.uint64)
            row, s = np.concatenate([w.doc[whole], short]), np.concatenate([runs_h[whole], few])
            made = sketches(mixed(s ^ C1), row, n)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), some.column("text_hash"), pa.array(votes(sorted_h[new], sorted_doc[new], n).view(np.int64)), pa.array([x.tobytes() for x in made], type=pa.binary())], names=["doc_id", "text_hash", "words", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), text_of(text_col).alias("text"))
    return d.mapInArrow(run, f"doc_id {kind}, text_hash long, words long, sketch binary")


def agree(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sketches agree as those of similar texts do."""
    held = (a > 0) | (b > 0)
    return ((a == b) & held).sum(axis=-1) >= least_common(held.sum(axis=-1), similarity)


def sketches_of(rows: pa.RecordBatch | pa.Table, column: str) -> np.ndarray:
    return np.frombuffer(b"".join(rows.column(column).to_pylist()), dtype=np.uint8).reshape(-1, BINS)


def alike(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): the labels of the pairs (a, b, la, lb) of nodes whose sketches agree."""
    d = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = agree(sketches_of(batch, "sa"), sketches_of(batch, "sb"), similarity)
            yield batch.select(["la", "lb"]).filter(pa.array(same)).rename_columns(["a", "b"])

    return d.select("la", "lb", "sa", "sb").mapInArrow(run, "a long, b long")


def alike_inside(members: DataFrame, nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(a, b): labels that alike pairs among the members (cell, node, words, label, n) of a cell link, so many that all such are connected.

    All members of a cell meet inside a task, and no row comes about for a pair. A cell of more than SMALL is cut into
    portions by a hash of its nodes, of which every two are a group, so a task holds two portions whatever a cell's size.
    """
    parts = F.ceil(F.col("n") / SMALL)
    d = members.withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    d = d.select("cell", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "node", "words", "label")

    def run(rows: pa.Table) -> pa.Table:
        words, label = rows.column("words").to_numpy().view(np.uint64), rows.column("label").to_numpy().copy()
        sketch, found = sketches_of(rows, "sketch"), []
        for i in range(len(words) - 1):
            near = i + 1 + np.flatnonzero((np.bitwise_count(words[i + 1 :] ^ words[i]) <= radius) & (label[i + 1 :] != label[i]))
            linked = np.unique(label[near[agree(sketch[i], sketch[near], similarity)]])
            found += [(int(label[i]), int(x)) for x in linked]
            if len(linked):
                label[np.isin(label, linked)] = label[i]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return d.join(nodes.select("node", "sketch"), "node").groupBy("cell", "low", "high").applyInArrow(run, "a long, b long")


def sketch_blocks(nodes: DataFrame, level: int, similarity: float) -> DataFrame:
    """(node, block): hashes of blocks of bins, in another order at each level, of which any two alike sketches share one."""
    for_workers(nodes.sparkSession)
    plan, order = block_plan(similarity), np.random.default_rng(level).permutation(BINS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A block's hash is the sum of those of its bins; an empty bin adds nothing.
        value = mixed(np.arange(1, BINS * 256 + 1, dtype=np.uint64) * C1).reshape(BINS, 256)
        value[:, 0] = 0
        for batch in batches:
            node = batch.column("node").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)[:, order]
            h, used = value[np.arange(BINS), sketch], (sketch > 0).sum(axis=1)
            for k, (blocks, dealt) in enumerate(plan):
                some = np.flatnonzero(dealt[used])
                if not len(some):
                    continue
                first, number = np.arange(blocks) * BINS // blocks, np.arange(blocks, dtype=np.uint64) + np.uint64(k * BINS)
                held = np.add.reduceat(sketch[some] > 0, first, axis=1, dtype=np.int16)
                sums = np.add.reduceat(h[some], first, axis=1) + mixed(number * C1)
                taken = np.arange(blocks) < dealt[used[some]][:, None]
                block = mixed(np.take_along_axis(sums, np.argsort(-held, axis=1, kind="stable"), axis=1)[taken])
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node[some], dealt[used[some]])), pa.array(block.view(np.int64))], names=["node", "block"])

    return nodes.select("node", "sketch").mapInArrow(run, "node long, block long")


def by_sketch(members: DataFrame, nodes: DataFrame, level: int, similarity: float) -> DataFrame:
    """Smaller cells by blocks of bins that lose no alike pair; cells of one member are left out."""
    blocks = sketch_blocks(nodes.join(members.select("node").distinct(), "node", "left_semi"), level, similarity)
    return not_alone(members.join(blocks, "node").select(F.xxhash64("cell", "block").alias("cell"), *(c for c in members.columns if c != "cell")))


def not_alone(cells: DataFrame) -> DataFrame:
    """The rows of cells that have more than one; a node is in a cell once."""
    return cells.join(cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cell"), "cell")


def apart(members: DataFrame) -> DataFrame:
    """The members of cells whose members aren't all of one group yet, with the number `n` of a cell's members; written."""
    open_cells = members.groupBy("cell").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high").select("cell", "n")
    return written(members.join(open_cells, "cell"))


def joined_cells(cells: DataFrame, nodes: DataFrame, radius: int, similarity: float) -> DataFrame:
    """(node, label) of all nodes (node, words, sketch): the connected groups of the alike pairs among the members (cell, node) of common cells.

    First a node meets one node only, of those that its cells have in common wherever they can, so that a large group of near
    copies needs a pair a node. What is of one group by then needs no more. In cells of SMALL members or fewer all those meet
    that are still apart, in cells of FEW as pairs of rows, in larger ones inside a task. Cells above SMALL are
    split by their sketches into cells that lose no alike pair, and so on, SPLITS times; members that stay together then
    share bins in every split, and all of those that are still apart meet. Ties between members are settled by a hash.
    """
    members = written(cells.join(nodes.select("node", "words"), "node").select("cell", "node", "words", F.col("node").alias("label")))
    base, known = members, written(nodes.select("node", F.col("node").alias("label")))
    close = bits_between(F.col("a.words"), F.col("b.words")) <= radius
    columns = [F.col("a.node").alias("a"), F.col("b.node").alias("b"), F.col("a.label").alias("la"), F.col("b.label").alias("lb")]

    def merge(links: DataFrame) -> None:
        """New labels for members and known, given pairs (a, b) of labels that are of one group."""
        nonlocal members, base, known
        found = written(links.distinct())
        if found.limit(1).count():
            names = components(found).select(F.col("node").alias("label"), F.col("label").alias("new"))
            new = F.coalesce("new", "label").alias("label")
            old, members = base, written(members.join(names, "label", "left").select("cell", "node", "words", new))
            before, known = known, written(known.join(names, "label", "left").select("node", new))
            base = members
            discard(old, before)
        discard(found)

    def settled() -> DataFrame:
        """Of the members those that are still apart in their cell, with the cell's size."""
        nonlocal members, base
        old, base = base, apart(members)
        members = base.drop("n")
        discard(old)
        return base

    for level in range(SPLITS + 1):
        left = settled()
        hubs = left.groupBy("cell").agg(F.min_by(F.struct("node", "words", "label"), F.xxhash64("node")).alias("hub")).select(F.col("cell").alias("at"), "hub.*")
        met = left.alias("a").join(hubs.alias("b"), F.expr("a.cell = b.at AND a.label <> b.label")).where(close).select(columns)
        merge(alike(met.groupBy("a").agg(F.min_by(F.struct("b", "la", "lb"), F.xxhash64("b")).alias("x")).select("a", "x.*"), nodes, similarity))
        left = settled()
        last = level == SPLITS or not left.where(F.col("n") > SMALL).limit(1).count()
        few, more = left.where(F.col("n") <= FEW), left.where(F.col("n") > FEW)
        # What is in large cells goes on, with the labels that it gets here.
        members = left.drop("n") if last else left.where(F.col("n") > SMALL).drop("n")
        pairs = few.alias("a").join(few.alias("b"), F.expr("a.cell = b.cell AND a.label < b.label")).where(close).select(columns).distinct()
        merge(alike(pairs, nodes, similarity).unionByName(alike_inside(more if level == SPLITS else more.where(F.col("n") <= SMALL), nodes, radius, similarity)))
        if last:
            break
        old, base = base, written(by_sketch(members, nodes, level + 1, similarity))
        members = base
        discard(old)
    discard(base)
    return known


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = WORD_RADIUS) -> DataFrame:
    """(doc_id, text_hash, group) of each row: texts that share `similarity` or more of their shingles by their sketches, transitively.

    Candidates are texts that share a block of bins of their sketches, which every two with alike sketches do, and whose
    words' fingerprints, which a few changed words move less than shingles, are within `radius` bits. They are verified by
    their whole sketches, whose bins agree in a share that is that of common shingles, less a standard deviation. Defined
    results: as in near_groups; group is a number without further meaning.
    """
    fps = written(text_fingerprints(docs, id_col, text_col, shingle).withColumn("node", F.xxhash64("words", "sketch")))
    nodes = written(fps.select("node", "words", "sketch").distinct())
    labels = joined_cells(not_alone(sketch_blocks(nodes, 0, similarity).withColumnRenamed("block", "cell")), nodes, radius, similarity)
    discard(nodes)
    return fps.join(labels, "node").select("doc_id", "text_hash", F.col("label").alias("group"))


def first_of_each(docs: DataFrame, groups: DataFrame, group: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows of which no other in the group has a smaller id (null last) or, with one id, a smaller text hash; of identical rows one.

    groups has a row for each row of docs. Only what goes is joined to the texts. They move once, on any size: what goes
    grows with them, so it is too much to send to all tasks, and a small table shows what a large one takes.
    """
    groups = groups.select("doc_id", "text_hash", F.col(group).alias("group"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("x")).select("group", F.col("x.doc_id").alias("first_id"), F.col("x.text_hash").alias("first_hash"))
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    rows = groups.groupBy("group", "doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).join(first, "group")
    rows = rows.where(~own | (F.col("n") > 1)).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), own.alias("__stays"))
    rows = written(rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    d = docs.toDF(*names)
    key = F.col(names[docs.columns.index(id_col)])
    d = d.withColumn("__own", F.xxhash64(text_of(names[docs.columns.index(text_col)])))
    same = key.eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash"))
    once = d.join(rows.hint("merge"), same, "left_anti")
    # Of rows that are there more than once and stay, one does.
    w = W.partitionBy("__own", key).orderBy(F.lit(0))
    often = d.join(rows.where("__stays"), same, "left_semi").withColumn("__copy", F.row_number().over(w)).where("__copy = 1")
    return once.select(*names).unionByName(often.select(*names)).toDF(*docs.columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs' rows without near-duplicates, the first of each group of near_groups. Options are those of near_groups; results are defined as there."""
    return first_of_each(docs, near_groups(docs, id_col, text_col, **options), "group_fp", id_col, text_col)


def one_of_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs' rows without similar ones, the first of each group of similar_groups. Options are those of similar_groups; results are defined as there."""
    return first_of_each(docs, similar_groups(docs, id_col, text_col, **options), "group", id_col, text_col)


def op8_simhash_neardup(spark, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def term_fingerprints(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, fp) of weighted word pairs."""
    d = texts.select(*keys, words_of(F.col(text)).alias("w"))
    d = d.select(*keys, F.explode_outer(weighted_terms(F.col("w"))).alias("x")).select(*keys, F.col("x.h").alias("h"), F.col("x.v").alias("v"))
    return fingerprints(d, keys, weight=F.col("v"))


#: Ranges of ids that documents are dealt into at most, and documents in a range; the ranges' bounds and first rows are broadcast.
RANGES, IN_RANGE = 1 << 16, 2_000


def id_ranges(docs: DataFrame, key: str) -> DataFrame:
    """docs (with a text_hash) with `range`, a number that ascends with the key, then with the text hash; the ranges hold
    about equally many rows. Null keys come first, in ranges below zero.

    Their bounds are approximate quantiles of the key, RANGES of them at most: one row for all tasks, searched by halving.
    A key that is several bounds at once, as many rows share it, has as many ranges, by the text hash.
    """
    sizes = docs.agg(F.count(key).alias("n"), F.count(F.lit(1)).alias("all")).first()
    n, nulls = sizes["n"], max(1, min(RANGES, (sizes["all"] - sizes["n"]) // IN_RANGE))
    parts = max(1, min(RANGES, n // IN_RANGE))
    cuts = docs.select(key).approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts)) if parts > 1 else []
    bounds = docs.sparkSession.createDataFrame([(sorted(int(x) for x in cuts),)], "__bounds array<bigint>")
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(RANGES.bit_length()))))
    # How many bounds are at or below the key (or below it): each step takes another power of two of them if they all are.
    found = lambda test: F.aggregate(steps, F.lit(0), lambda at, s: F.when(F.coalesce(test(F.get("__bounds", at + s - 1)), F.lit(False)), at + s).otherwise(at))
    d = docs.crossJoin(F.broadcast(bounds)).withColumn("__to", found(lambda b: b <= F.col(key)))
    own = F.coalesce(F.get("__bounds", F.col("__to") - 1) == F.col(key), F.lit(False))
    d = d.withColumn("__from", F.when(own, found(lambda b: b < F.col(key)) + 1).otherwise(F.col("__to")))
    share = lambda parts: F.least(F.floor((F.col("text_hash").cast("double") / 2.0**64 + 0.5) * parts), parts - 1).cast("int")
    by_hash = share(F.lit(nulls)) - nulls
    return d.withColumn("range", F.when(F.col(key).isNull(), by_hash).otherwise(F.col("__from") + share(F.col("__to") - F.col("__from") + 1))).drop("__bounds", "__from", "__to")


def with_next(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text_hash, t) with `range`, `row` and the next row's doc_id, text_hash and t, as next_id, next_hash and next_t.

    Rows are ordered by id (null first), then text hash; after the last comes the first. The text is dealt out once: the
    first row of each range is also dealt to the range before, where it comes last and follows that range's own last row.
    """
    d = id_ranges(docs, "doc_id")
    edges = d.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", "text_hash")).alias("x"))
    # RANGES rows at most: one task may order them.
    edges = edges.selectExpr("range AS r", "x.doc_id AS first_id", "x.text_hash AS first_hash", "coalesce(lag(range) OVER (ORDER BY range), max(range) OVER ()) AS before")
    e = F.broadcast(written(edges))
    d = d.join(e, (F.col("range") == F.col("r")) & F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash")), "left")
    borrowed = F.struct(F.col("before").alias("range"), F.lit(1).alias("lent"))
    own = F.struct("range", F.lit(0).alias("lent"))
    d = d.select("doc_id", "text_hash", "t", F.explode(F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, borrowed))).alias("x"))
    d = d.select("doc_id", "text_hash", "t", "x.range", "x.lent")
    w = W.partitionBy("range").orderBy("lent", F.col("doc_id").asc_nulls_first(), "text_hash")
    d = d.withColumns({"row": F.row_number().over(w), "next_id": F.lead("doc_id").over(w), "next_hash": F.lead("text_hash").over(w), "next_t": F.lead("t").over(w)})
    return d.where("lent = 0").drop("lent")


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """Fingerprints of each text and of its edited text, their likeness, near_id (the smallest id within the radius) and
    near_count (the other fingerprints within it, all of which the block tables find).

    The edited text replaces the last floor(n/2) code points by the first as many of the next row's text; rows are in the
    order of with_next. Likeness is the share of equal bits. near_id comes from permuted block tables. Defined results: a
    null text is empty, its fingerprint zero; a single row is its own next; identical rows come one after the other and
    each has a result; ids are integers; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    fps = written(term_fingerprints(d, ["doc_id", "text_hash"], "t"))
    n = F.length("t").cast("long")
    edited = with_next(d).withColumn("n_chars", n).withColumn("e", F.expr("concat(left(t, cast(n_chars - floor(n_chars / 2) as int)), left(coalesce(next_t, t), cast(floor(n_chars / 2) as int)))"))
    keys = ["range", "row", "doc_id", "text_hash", "n_chars", "next_id", "next_hash", "edited_sha256"]
    edited = edited.withColumn("edited_sha256", F.sha2("e", 256)).select(*keys, words_of(F.col("e")).alias("w"))
    terms = edited.select(*keys, F.explode_outer(weighted_terms(F.col("w"))).alias("x")).select(*keys, F.col("x.h").alias("h"), F.col("x.v").alias("v"))
    edited_fps = fingerprints(terms, keys, weight=F.col("v")).withColumnRenamed("fp", "edited_fp")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    pairs = links(block_tables(nodes, radius), radius)
    near = pairs.join(nodes.withColumnRenamed("fp", "b").withColumnRenamed("rep", "other"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("other").alias("other"), F.count(F.lit(1)).alias("near_count"))
    near = nodes.join(near, "fp", "left").select("fp", F.least("rep", "other").alias("near_id"), F.coalesce("near_count", F.lit(0)).cast("long").alias("near_count"))
    known = written(fps.join(near, "fp"))
    a, b, c = edited_fps.alias("a"), known.alias("b"), fps.alias("c")
    out = a.join(b, F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.text_hash") == F.col("b.text_hash")))
    out = out.join(c, F.col("a.next_id").eqNullSafe(F.col("c.doc_id")) & (F.coalesce("a.next_hash", "a.text_hash") == F.col("c.text_hash")), "left")
    return out.select("a.doc_id", "a.n_chars", "a.edited_sha256", "a.edited_fp", "b.fp", "b.near_id", "b.near_count", F.col("c.fp").alias("next_fp"))


def likeness(a, b):
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def op3_fingerprints(spark, sf_dir: str) -> DataFrame:
    d = document_fingerprints(table(spark, sf_dir, "documents"))
    fp, edited, after = F.col("fp"), F.col("edited_fp"), F.col("next_fp")
    return d.select("doc_id", "n_chars", "edited_sha256", hex16(fp).alias("fingerprint"), hex16(edited).alias("edited_fingerprint"), likeness(fp, edited).alias("near_edited"), likeness(fp, after).alias("near_next"), "near_id", "near_count")
