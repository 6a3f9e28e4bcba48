"""Removal of word sequences that occur earlier in the corpus, by level-wise doubling.

A window of WINDOW words is a candidate only while the shorter runs inside it are repeated. Level 1 looks at runs of a
quarter of that length, and only at each window's anchor: of the runs that begin in its first half the one with the
smallest hash (the leftmost of equals), which equal windows share at the same offset, so about one run in six is counted
and none that matters is missed. Anchors that are repeated are extended to twice the length; those that still are, to
the whole window. There, neighbouring windows of one anchor form a unit: units with equal words are settled as one, and
only the first of each kind is opened into single windows, which meet those of other first units. What is not the first
occurrence is removed. No level compares rows with each other: each counts hashes and joins the counts back.

Hashing runs on numpy arrays inside tasks, over the bytes of the Arrow batches and a bounded number of words at a time,
however long a text is. All lengths are hashed in one pass; only rows that survive a level meet the next.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import for_workers
from tidemark.llm.common import discard, table, text_of, written
from tidemark.llm.wordbytes import C1, C2, mixed, portions, powers, runs

WINDOW = 20
#: A place and the number of windows from there on share one long.
SHARED = 4096
#: Stands for a null id.
LAST = (1 << 63) - 1


def sums(h: np.ndarray, base: np.uint64) -> Callable:
    """A hash of the words [low, high) for arrays of both."""
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * powers(base, len(h)), dtype=np.uint64)])
    back = powers(np.uint64(pow(int(base), -1, 1 << 64)), len(h) + 1)
    return lambda low, high: mixed((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64))


def leftmost_smallest(value: np.ndarray, width: int) -> np.ndarray:
    """The place of the smallest of the `width` values from each place on."""
    best, place, reach = value, np.arange(len(value)), 1
    while reach < width:
        step = min(reach, width - reach)
        m = max(0, len(best) - step)
        left = best[:m] <= best[step : step + m]
        best, place = np.where(left, best[:m], best[step : step + m]), np.where(left, place[:m], place[step : step + m])
        reach += step
    return place


def listed(some: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row's array of place * SHARED + m the row, the place and m."""
    lists = some.column(column)
    size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return np.repeat(np.arange(len(lists)), size), flat // SHARED, flat % SHARED


def as_batch(columns: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({k: v.view(np.int64) if isinstance(v, np.ndarray) and v.dtype == np.uint64 else v for k, v in columns.items()})


def of_rows(some: pa.RecordBatch, column: str, rows: np.ndarray) -> np.ndarray:
    return some.column(column).to_numpy(zero_copy_only=False)[rows]


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """The rows, a written table that goes, whose key occurs more than once. The counts are written, so that both sides are dealt out for the join alone and a frequent key can be split."""
    often = written(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key))
    out = written(rows.join(often, key))
    discard(rows, often)
    return out


def per_document(rows: DataFrame) -> DataFrame:
    """One row a document (k, t) with the array s of its places; as long as the document at most, as identical rows share their places."""
    return written(rows.select("k", "t", "low", "m").distinct().groupBy("k", "t").agg(F.collect_list(F.col("low") * SHARED + F.col("m")).alias("s")))


def with_lists(texts: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    return texts.join(lists, ["k", "t"], how)


def elsewhere(a: str) -> Column:
    """Whether a row isn't the head of its kind."""
    return (F.col("k") != F.col(f"{a}.k")) | (F.col("t") != F.col(f"{a}.t")) | (F.col("low") != F.col(f"{a}.low"))


def removed_runs(texts: DataFrame, window: int) -> DataFrame:
    """(k, t, s): for each place * SHARED + m in s, the windows that begin at the words place .. place + m - 1 of document (k, t) occur earlier."""
    quarter, half = window // 4, window // 2

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, w in portions(batches):
            for low, stop in w.stretches():
                h = w.hashes(low, min(len(w.starts), stop + window - 1))
                n = min(stop - low, len(h) - window + 1)
                if n <= 0:
                    continue
                short, longer, whole = runs(h, quarter), runs(h, half), sums(h, C1)
                anchor = leftmost_smallest(short, window - half + 1)[:n]
                start = np.flatnonzero(w.doc[low : low + n] == w.doc[low + window - 1 : low + window - 1 + n])
                anchor = anchor[start]
                new = np.flatnonzero(np.concatenate([[True], (np.diff(start) != 1) | (np.diff(anchor) != 0)])) if len(start) else start
                m = np.diff(np.append(new, len(start)))
                at, a = start[new], anchor[new]
                row = w.doc[low + at]
                yield as_batch({"short": short[a], "half": longer[a], "unit": whole(at, at + m + window - 1), "k": of_rows(some, "k", row), "t": of_rows(some, "t", row), "low": low + at - w.first[row], "m": m})

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, w in portions(batches):
            row, place, m = listed(some, "s")
            place = np.repeat(w.first[row] + place, m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            row = np.repeat(row, m)
            for low, stop in w.stretches():
                here = np.flatnonzero((place >= low) & (place < stop))
                if len(here):
                    h = w.hashes(low, min(len(w.starts), stop + window - 1))
                    a, b = sums(h, C1), sums(mixed(h ^ C1), C2)
                    at, r = place[here] - low, row[here]
                    yield as_batch({"h": a(at, at + window), "h2": b(at, at + window), "k": of_rows(some, "k", r), "t": of_rows(some, "t", r), "low": place[here] - w.first[r]})

    rows = written(texts.mapInArrow(anchored, "short long, half long, unit long, k long, t long, low long, m long"))
    rows = repeated(repeated(rows, "short"), "half")
    # The words outside the half are told apart by `unit`, so a unit's key has 128 bits.
    heads = written(rows.groupBy("half", "unit").agg(F.min(F.struct("k", "t", "low", "m")).alias("head"), F.count(F.lit(1)).alias("n")))
    later = rows.join(heads.where("n > 1").select("half", "unit", "head"), ["half", "unit"]).where(elsewhere("head")).select("k", "t", "low", "m")
    leading = per_document(heads.select("head.k", "head.t", "head.low", "head.m"))
    singles = written(with_lists(texts, leading, "inner").select("k", "t", "text", "s").mapInArrow(opened, "h long, h2 long, k long, t long, low long"))
    tops = written(singles.groupBy("h", "h2").agg(F.min(F.struct("k", "t", "low")).alias("head"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    alone = singles.join(tops, ["h", "h2"]).where(elsewhere("head")).select("k", "t", "low", F.lit(1).cast("long").alias("m"))
    out = per_document(later.unionByName(alone))
    discard(rows, heads, leading, singles, tops)
    return out


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) and kept_sha256 of each row.

    A word goes if a window of `window` words over it has the words of a window that starts earlier: in a document with a
    smaller id, or earlier in the same one. Windows are judged on the input. Defined results: a null text has no words;
    a null id comes after all others; rows with one id are parts of one document, in the order of their text's hash, and
    identical rows are the same part, so neither removes the other; an empty table gives an empty result. Ids are integers;
    other columns aren't read.
    """
    if window < 8 or window % 4 or window >= SHARED:
        raise ValueError(f"the window has to be a multiple of 4 from 8 to {SHARED - 4}")
    for_workers(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_of(text_col).alias("text"))
    texts = d.select("id", F.coalesce("id", F.lit(LAST)).alias("k"), F.xxhash64("text").alias("t"), "text")
    gone_runs = removed_runs(texts.select("k", "t", "text"), window)

    def left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, w in portions(batches):
            row, place, m = listed(some, "s")
            depth = np.zeros(len(w.starts) + 1, dtype=np.int64)
            np.add.at(depth, w.first[row] + place, 1)
            np.add.at(depth, w.first[row] + place + m + window - 1, -1)
            kept = np.cumsum(depth[:-1]) == 0
            count = np.diff(w.first)
            total = np.concatenate([[0], np.cumsum(kept)])
            held = total[w.first[1:]] - total[w.first[:-1]]
            word = np.flatnonzero(kept)
            # A kept word that another one follows takes along the white space behind it, as a space.
            follows = np.concatenate([w.doc[word[1:]] == w.doc[word[:-1]], [False]]) if len(word) else np.zeros(0, dtype=bool)
            data, edge = w.data.copy(), np.zeros(len(w.data) + 1, dtype=np.int8)
            data[w.ends[word[follows]]] = 32
            edge[w.starts[word]] += 1
            edge[w.ends[word] + follows] -= 1
            size = np.bincount(w.doc[word], weights=w.ends[word] - w.starts[word] + follows, minlength=len(count)).astype(np.int64)
            left = data[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()
            ends = np.concatenate([[0], np.cumsum(size)])
            texts = [left[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield as_batch({"id": some.column("id"), "n_words": count, "n_removed": count - held, "kept": pa.array(texts, type=pa.binary()).cast(pa.string()), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in texts], type=pa.string())})

    done = with_lists(texts, gone_runs, "left").select("id", "text", "s").mapInArrow(left_over, "id long, n_words long, n_removed long, kept string, kept_sha256 string")
    return done.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_words", "n_removed", "kept", "kept_sha256")


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")
