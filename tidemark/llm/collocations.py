"""Phrase collocations by hierarchical pair naming.

A word that is frequent in its language gets a number. Two neighbours that both have one make a pair; pairs that are frequent
over all documents get numbers of their own, and these take the place of the pair's first word, so that the next round's
pairs are phrases of one word more: a phrase of k words is the pair of the two of k - 1 words that overlap in it. The pair is
also the phrase's pointer to those two, from which its cuts and what it lies in are looked up by joins.

Texts are read once, into sequences of codes (numbers of a portion's own table of different words or pairs). Each round sends
a portion's different pairs with their counts through one shuffle, where all portions' entries of a pair meet: their sum is the
pair's count, the smallest of their places its number, and the frequent ones' numbers go back to their portions. Entries move
sorted and compressed, a row for each portion and range of pairs, and so do the numbers. Sequences lose every stretch that
can't be part of a longer phrase. No table of all phrases is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import for_workers
from tidemark.llm.common import discard, table, text_of, written

#: Words in a phrase at most, occurrences at least, phrases reported for each language, share of a phrase that a longer one holds.
LONGEST, FREQUENT, TOP, WITHIN = 4, 30, 2000, (80, 100)
#: Bytes of texts in a portion, and portions of a task at most: a portion's number takes 31 bits with that of its task.
PORTION, IN_TASK = 8_000_000, 1 << 12
#: Portions for each range of pairs: a task holds a range's entries of all portions, about as many as so many portions have. Names packed at a time.
IN_RANGE, NAMES = 4, 1_000_000

#: What a byte is (0 part of a word, 1 between words, 2 between pieces), and its lower case in A-Z.
KIND, LOWER = np.zeros(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)
KIND[[32, 9]] = 1
KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
LOWER[65:91] += 32


def words(data: np.ndarray, begin: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The words of texts (begin: where each starts in data, and the end), in lower case; of each word the text and the piece."""
    kind = KIND[data]
    inside = kind == 0
    first = np.zeros(len(data) + 1, dtype=bool)
    first[begin] = True
    start = np.flatnonzero(inside & (first[:-1] | ~np.concatenate([[False], inside[:-1]])))
    doc = np.searchsorted(begin, start, side="right") - 1
    piece = np.cumsum((kind == 2) | first[:-1])[start]
    # Words lie one after the other once all else is gone.
    ends = np.append(np.cumsum(inside)[start] - 1, inside.sum()).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(LOWER[data[inside]])]), doc, piece


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys, each key's place among them, and how often each occurs."""
    return np.unique(keys, return_inverse=True, return_counts=True)


def stretches(code: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """The codes with -1 between places that aren't linked (linked[i]: i and i + 1), without those that have no neighbour."""
    left = np.concatenate([[False], linked])
    keep = left | np.concatenate([linked, [False]])
    # One gap behind each stretch is enough.
    gap = np.flatnonzero(keep & ~np.concatenate([linked, [False]]))
    return np.insert(code, gap + 1, -1)[np.insert(keep, gap + 1, True)].astype(np.int32)


def squeezed(codes: np.ndarray) -> bytes:
    """The codes (int32) by planes of bytes, compressed: most are small."""
    raw = codes.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(codes).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=4 * n, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(4, n).T).view("<i4")[:, 0]


def packed(*columns: np.ndarray) -> bytes:
    """Columns of longs, equally long, as the differences of their entries by planes of bytes, compressed: best if they ascend."""
    d = np.stack([np.diff(c, prepend=0) for c in columns]).astype("<i8")
    raw = ((d << 1) ^ (d >> 63)).view(np.uint8).reshape(len(columns), -1, 8).transpose(0, 2, 1).tobytes()
    return len(columns[0]).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, columns: int) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], decompressed_size=8 * n * columns, codec="zstd", asbytes=True)
    z = np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(columns, 8, n).transpose(0, 2, 1)).view("<i8")[:, :, 0]
    return np.cumsum(((z >> 1) & 0x7FFFFFFFFFFFFFFF) ^ -(z & 1), axis=1)


SEQUENCES = "p int, codes binary, word array<string>, lang array<string>, n array<long>"
#: parts: by range the entries (code, a, b, n) of the portion's pairs, packed.
PAIRED = pa.schema([("p", pa.int32()), ("codes", pa.binary()), ("parts", pa.list_(pa.binary()))])


def as_rows(p: int, codes: np.ndarray, n: np.ndarray, word: pa.Array, lang: pa.Array) -> pa.RecordBatch:
    """A portion's row: its sequence of codes, and by code the word, the language and the occurrences n."""
    one = lambda x, kind: pa.array([x], type=pa.list_(kind))
    return pa.RecordBatch.from_arrays([pa.array([p], type=pa.int32()), pa.array([squeezed(codes)], type=pa.binary()), one(word, pa.string()), one(lang, pa.string()), one(n, pa.int64())], names=["p", "codes", "word", "lang", "n"])


def read_portions(docs: DataFrame, portion: int = PORTION) -> DataFrame:
    """SEQUENCES of docs (lang, text): a row for each `portion` of text, whose codes are the portion's different words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        done = TaskContext.get().partitionId() * IN_TASK
        for batch in batches:
            text = batch.column("text").cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], dtype=np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(text.buffers()[2] or b"", dtype=np.uint8)
            low = 0
            while low < len(text):
                high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + portion, side="right")) - 1)
                column, doc, piece = words(raw[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
                langs = batch.column("lang").slice(low, high - low).dictionary_encode()
                different = column.dictionary_encode()
                m = max(1, len(langs.dictionary))
                keys, code, n = counted(different.indices.to_numpy().astype(np.int64) * m + langs.indices.to_numpy()[doc])
                if len(code):
                    word = different.dictionary.take(pa.array(keys // m)).cast(pa.string())
                    yield as_rows(done, stretches(code, piece[1:] == piece[:-1]), n, word, langs.dictionary.take(pa.array(keys % m)))
                    done += 1
                low = high
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(run, SEQUENCES)


def in_ranges(a: np.ndarray, b: np.ndarray, n: np.ndarray, ranges: int) -> list[bytes | None]:
    """The entries of pairs, sorted by (a, b), by the range that their hash falls in."""
    h = (a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (b.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    r = ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)) % np.uint64(ranges)
    order = np.argsort(r, kind="stable")
    ends = np.searchsorted(r[order], np.arange(ranges + 1))
    each = (order[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True))
    return [packed(i, a[i], b[i], n[i]) if len(i) else None for i in each]


def paired(portions: DataFrame, names: DataFrame, ranges: int) -> DataFrame:
    """PAIRED of the pairs of neighbours that both have a number: names (p, names) has the packed (code, id) of a portion's codes, in several rows."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        p = key[0].as_py()
        out = []
        if right.num_rows and left.num_rows:
            # A portion is one row; its sequence is bounded by PORTION or one text.
            codes = unsqueezed(left.column("codes")[0].as_py())
            code, ids = np.concatenate([unpacked(x.as_py(), 2) for x in right.column("names")], axis=1)
            order = np.argsort(ids)
            code, ids = code[order], ids[order]
            number = np.full(max(int(code.max()), int(codes.max(initial=0))) + 2, -1, dtype=np.int64)
            number[code] = np.arange(len(ids))
            at = number[codes]
            both = (at[:-1] >= 0) & (at[1:] >= 0)
            keys, pair, n = counted(at[:-1][both] * len(ids) + at[1:][both])
            if len(keys):
                full = np.full(len(at) - 1, -1, dtype=np.int64)
                full[both] = pair
                parts = in_ranges(ids[keys // len(ids)], ids[keys % len(ids)], n, ranges)
                out.append(pa.RecordBatch.from_arrays([pa.array([p], type=pa.int32()), pa.array([squeezed(stretches(full, both[:-1] & both[1:]))], type=pa.binary()), pa.array([parts], type=pa.list_(pa.binary()))], schema=PAIRED))
        return pa.Table.from_batches(out, schema=PAIRED)

    return portions.select("p", "codes").groupBy("p").cogroup(names.select(F.col("p").alias("of"), "names").groupBy("of")).applyInArrow(run, "p int, codes binary, parts array<binary>")


NUMBERED = pa.schema([("p", pa.int32()), ("names", pa.binary()), ("id", pa.list_(pa.int64())), ("a", pa.list_(pa.int64())), ("b", pa.list_(pa.int64())), ("f", pa.list_(pa.int64()))])


def frequent_pairs(portions: DataFrame, least: int, back: bool) -> DataFrame:
    """The pairs that occur `least` times or more over all portions (PAIRED): a row of lists (id, a, b, f) for each range, f
    occurrences, id the smallest place; and, if their numbers go `back`, rows (p, names) as in `paired`; written."""

    def run(entries: pa.Table) -> pa.Table:
        p = entries.column("p").to_numpy().astype(np.int64)
        some = [unpacked(x.as_py(), 4) for x in entries.column("data")]
        of = np.repeat(np.arange(len(p)), [x.shape[1] for x in some])
        code, a, b, n = np.concatenate(some, axis=1)
        del some
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        f = np.add.reduceat(n[order], first)
        ids = np.minimum.reduceat(((p[of] << 32) | code)[order], first)
        keep = f >= least
        columns = [[None], [None], [ids[keep]], [a[first][keep]], [b[first][keep]], [f[keep]]]
        if back and keep.any():
            size = np.diff(np.append(first, len(order)))
            stays = np.repeat(keep, size)
            mine, numbers = order[stays], np.repeat(ids, size)[stays]
            # Back into the order in which the portions' entries came.
            again = np.argsort(mine)
            mine, numbers = mine[again], numbers[again]
            ends = np.searchsorted(of[mine], np.arange(len(p) + 1))
            for i in np.flatnonzero(np.diff(ends)):
                x = slice(ends[i], ends[i + 1])
                columns[0].append(int(p[i]))
                columns[1].append(packed(code[mine[x]], numbers[x]))
            for c in columns[2:]:
                c += [None] * (len(columns[0]) - 1)
        return pa.Table.from_arrays([pa.array(c, type=t.type) for c, t in zip(columns, NUMBERED, strict=True)], schema=NUMBERED)

    d = portions.select("p", F.posexplode("parts").alias("r", "data")).where("data IS NOT NULL")
    return written(d.groupBy("r").applyInArrow(run, "p int, names binary, id array<long>, a array<long>, b array<long>, f array<long>"))


def entries(portions: DataFrame, *columns: str) -> DataFrame:
    """(place, columns) of the portions' tables, a row for each code; place holds the portion and the code in one long."""
    d = portions.select("p", F.posexplode(F.arrays_zip(*columns)).alias("code", "x"))
    return d.select(F.shiftleft(F.col("p").cast("long"), 32).bitwiseOR(F.col("code")).alias("place"), *(F.col(f"x.{c}").alias(c) for c in columns))


def frequent(places: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(place, id, a, keys) of the places (place, keys, n) whose keys occur `least` times or more over all: a occurrences, and as
    their number the smallest of their places; written. A portion has one place at most for a key."""
    w = W.partitionBy(*keys)
    d = places.withColumns({"f": F.sum("n").over(w), "id": F.min("place").over(w)}).where(F.col("f") >= least)
    return written(d.select("place", "id", "f", *keys))


def names_of(held: DataFrame) -> DataFrame:
    """(p, names) of each place, the names packed; those that a task has of a portion are one row or a few."""

    def pack(place: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(place)
        place, ids = place[order], ids[order]
        p, code = place >> 32, place & 0xFFFFFFFF
        different, begin = np.unique(p, return_index=True)
        ends = np.append(begin, len(p))
        names = [packed(code[x:y], ids[x:y]) for x, y in zip(ends[:-1], ends[1:], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(different, type=pa.int32()), pa.array(names, type=pa.binary())], names=["p", "names"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for batch in batches:
            # Copies: a batch's memory isn't its receiver's.
            some.append(np.stack([batch.column(c).to_numpy() for c in ("place", "id")]))
            n += batch.num_rows
            if n >= NAMES:
                yield pack(*np.concatenate(some, axis=1))
                some, n = [], 0
        if n:
            yield pack(*np.concatenate(some, axis=1))

    return held.select("place", "id").mapInArrow(run, "p int, names binary")


def exact(x: str | Column) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("decimal(20,0)")


def phrases(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = FREQUENT, portion: int = PORTION) -> tuple[DataFrame, DataFrame]:
    """The frequent phrases and the languages' sizes.

    Phrases: (id, lang, k, phrase, a, first, rest, part_a, part_b): a occurrences of k words, first[i] those of its first i + 1
    words, rest[i] those of what follows them, part_a and part_b the ids of the phrases without the last and without the
    first word (ids are told apart within one k). Sizes: (lang, n), all words. Phrases lie inside a piece and a language; null is the language `und`.
    """
    for_workers(docs.sparkSession)
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).alias("text"))
    portions = written(read_portions(d, portion))
    # Languages are summed up in each task before they move.
    sizes = written(entries(portions, "lang", "n").groupBy("lang").agg(F.sum("n").alias("n")))
    held = frequent(entries(portions, "lang", "word", "n"), ["lang", "word"], least)
    none = F.array().cast("array<long>")
    level = held.where("place = id").select("id", "lang", F.lit(1).alias("k"), F.col("word").alias("phrase"), F.col("word").alias("last"), F.col("f").alias("a"), none.alias("first"), none.alias("rest"), F.lit(None).cast("long").alias("part_a"), F.lit(None).cast("long").alias("part_b"))
    levels, level, names = [], written(level), names_of(held)
    ranges = max(1, portions.count() // IN_RANGE)
    for k in range(2, longest + 1):
        before, portions = portions, written(paired(portions, names, ranges))
        discard(before, held)
        held = frequent_pairs(portions, least, k < longest)
        names = held.where("p IS NOT NULL").select("p", "names")
        pairs = held.where("p IS NULL").select(F.explode(F.arrays_zip("id", "a", "b", "f")).alias("x")).select("x.*")
        x, y = level.alias("x"), level.alias("y")
        joined = pairs.join(x, F.col("x.id") == pairs["a"]).join(y, F.col("y.id") == pairs["b"])
        level = written(joined.select(
            pairs["id"], "x.lang", F.lit(k).alias("k"), F.concat_ws(" ", "x.phrase", "y.last").alias("phrase"), "y.last", F.col("f").alias("a"),
            F.array_append(F.col("x.first"), F.col("x.a")).alias("first"), F.array_prepend(F.col("y.rest"), F.col("y.a")).alias("rest"), pairs["a"].alias("part_a"), pairs["b"].alias("part_b"),
        ))
        levels.append(level)
    discard(portions, held)
    found = levels[0]
    for more in levels[1:]:
        found = found.unionByName(more)
    return found.drop("last"), sizes


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = LONGEST, least: int = FREQUENT, top: int = TOP, within: tuple[int, int] = WITHIN, portion: int = PORTION) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases by score.

    The score of a phrase with a occurrences is the smallest floor(2000000 a / (l + r)) over its cuts into two, with l and r
    occurrences of the two parts; of cuts with one score the first. A phrase goes if a longer one that holds it has
    within[0] / within[1] of its occurrences or more; it is enough to look at those of one word more, as any longer one is
    in one of them, which occurs at least as often. Ties: more occurrences, then the phrase by its UTF-8 bytes.

    Defined results: a null text is empty, a null language is `und` (as is that name itself); texts without words and empty
    tables give nothing; repeated rows count each; other columns aren't read. Counts are over all documents.
    """
    found, sizes = phrases(docs, text_col, lang_col, longest, least, portion)
    part, over = exact("a") * 2_000_000, exact
    cut = F.transform(F.arrays_zip("first", "rest"), lambda x, i: F.struct(F.call_function("div", part, over(x["first"]) + over(x["rest"])).alias("score"), i.alias("i"), x["first"].alias("l"), x["rest"].alias("r")))
    scored = found.withColumn("cut", F.array_min(cut))
    longer = found.select((F.col("k") - 1).alias("k"), F.explode(F.array("part_a", "part_b")).alias("id"), F.col("a").alias("longer")).groupBy("k", "id").agg(F.max("longer").alias("longer"))
    kept = scored.join(longer, ["k", "id"], "left").where(F.col("longer").isNull() | (exact("longer") * within[1] < exact("a") * within[0]))
    # Spark ranks inside each task first and sends `top` rows of a language on.
    w = W.partitionBy("lang").orderBy(F.col("cut.score").desc(), F.col("a").desc(), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def op13_collocations(spark, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


ORACLE = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
q AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM q CROSS JOIN (SELECT unnest(range(1, {LONGEST + 1})) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
size AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND a >= {FREQUENT}),
cuts AS (
  SELECT c.lang, c.phrase, c.a, c.w, j, x.a AS l, y.a AS r, (2000000::HUGEINT * c.a // (x.a + y.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS j FROM c) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(list_slice(c.w, 1, j), ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(list_slice(c.w, j + 1, len(c.w)), ' ')),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
inner_of AS (SELECT c.lang, array_to_string(list_slice(c.w, s, s + m - 1), ' ') AS phrase, max(c.a) AS longer FROM (SELECT *, unnest(range(2, k)) AS m FROM c) c, unnest(range(1, len(c.w) - m + 2)) AS t(s) GROUP BY ALL),
kept AS (SELECT b.* FROM best b LEFT JOIN inner_of i USING (lang, phrase) WHERE i.longer IS NULL OR {WITHIN[1]} * i.longer < {WITHIN[0]} * b.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept k JOIN size USING (lang) QUALIFY rank <= {TOP}
"""
