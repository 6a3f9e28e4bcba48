"""Token ids of texts in files of fixed-width bits.

A file holds the ids of a range of documents, in order. Each id takes the fewest bits that the vocabulary needs, lowest
bit first; BLOCK ids form a block that begins on a byte, and the footer has the offset of each block, so a slice of ids is
read and unpacked by numpy without what lies before it. Layout, little-endian:

    blocks | u64 offset of each block and their end | u64 first id of each document and their end | i64 document id
    | u8 whether it has one | trailer: u64 documents, u64 ids, u32 bits, u32 ids in a block, 8 bytes MAGIC

Tasks write files under names of their own attempt and report them as rows; the manifest is the table of those rows that
Spark has committed, so a lost or repeated attempt leaves a file that no manifest names and nothing else.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import for_workers
from tidemark.llm.common import shared_folder, table, text_of, written
from tidemark.llm.neardup import id_ranges

MAGIC, TRAILER = b"TIDEIDS1", struct.Struct("<QQII8s")
BLOCK = 1 << 16
#: Bytes of texts encoded together in a task, and pieces that a worker remembers the ids of.
PORTION, REMEMBERED = 4_000_000, 600_000
TOKENIZER, END = "byte_bpe_50k.json", 2


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- bits


def packed(ids: np.ndarray, bits: int) -> bytes:
    """The ids (below 2 ** bits) in `bits` bits each, lowest first, filled up to a whole byte."""
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    return np.packbits(each, bitorder="little").tobytes()


def unpacked(data: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of packed data."""
    each = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), dtype=np.uint8)
    wide[:, :bits] = each
    return np.packbits(wide, axis=1, bitorder="little").view("<u4")[:, 0]


def file_at(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI (file, hdfs, s3, gs, abfs) or of an absolute path."""
    return pafs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", uri))


class Writer:
    """Writes one file; ids come in any portions, documents one after the other."""

    def __init__(self, uri: str, bits: int):
        fs, path = file_at(uri)
        self.uri, self.bits, self.out = uri, bits, fs.open_output_stream(path)
        self.offsets, self.starts, self.docs = [0], [np.zeros(1, dtype="<u8")], []
        self.open, self.n_open, self.n_ids = [], 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        """Documents with `counts` ids each, which lie in `ids` one after the other."""
        self.starts.append((self.n_ids + np.cumsum(counts)).astype("<u8"))
        self.docs.append(doc_ids)
        self.n_ids += len(ids)
        self.open.append(ids)
        self.n_open += len(ids)
        if self.n_open >= BLOCK:
            self.flush(self.n_open - self.n_open % BLOCK)

    def flush(self, n: int) -> None:
        ids = np.concatenate(self.open) if self.open else np.zeros(0, dtype=np.uint32)
        for low in range(0, n, BLOCK):
            data = packed(ids[low : min(n, low + BLOCK)], self.bits)
            self.out.write(data)
            self.offsets.append(self.offsets[-1] + len(data))
        self.open, self.n_open = [ids[n:].copy()], len(ids) - n

    def close(self) -> dict:
        self.flush(self.n_open)
        docs = pa.chunked_array(self.docs, type=pa.int64()).combine_chunks() if self.docs else pa.array([], type=pa.int64())
        has = docs.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8)
        self.out.write(np.array(self.offsets, dtype="<u8").tobytes())
        self.out.write(np.concatenate(self.starts).tobytes())
        self.out.write(docs.fill_null(0).to_numpy().astype("<i8").tobytes() + has.tobytes())
        self.out.write(TRAILER.pack(len(docs), self.n_ids, self.bits, BLOCK, MAGIC))
        self.out.close()
        return {"file": self.uri, "n_docs": len(docs), "n_ids": self.n_ids}


class IdFile:
    """Reads one file: documents and any slice of its ids, by the blocks that hold it."""

    def __init__(self, uri: str):
        fs, path = file_at(uri)
        self.f = fs.open_input_file(path)
        self.size = self.f.size()
        self.n_docs, self.n_ids, self.bits, self.block, magic = TRAILER.unpack(self.f.read_at(TRAILER.size, self.size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} isn't a file of token ids")
        blocks = -(-self.n_ids // self.block)
        at = self.size - TRAILER.size - 9 * self.n_docs - 8 * (self.n_docs + 1) - 8 * (blocks + 1)
        self.offsets, at = self.array(at, blocks + 1, "<u8"), at + 8 * (blocks + 1)
        self.starts, at = self.array(at, self.n_docs + 1, "<u8").astype(np.int64), at + 8 * (self.n_docs + 1)
        self.doc_ids, at = self.array(at, self.n_docs, "<i8"), at + 8 * self.n_docs
        self.has_id = self.array(at, self.n_docs, "u1").astype(bool)

    def array(self, at: int, n: int, kind: str) -> np.ndarray:
        return np.frombuffer(self.f.read_at(n * np.dtype(kind).itemsize, at), dtype=kind)

    def ids(self, low: int, high: int) -> np.ndarray:
        """The ids [low, high) of the file."""
        out = []
        for b in range(low // self.block, -(-high // self.block) if high > low else 0):
            first, last = b * self.block, min(self.n_ids, (b + 1) * self.block)
            data = self.f.read_at(int(self.offsets[b + 1] - self.offsets[b]), int(self.offsets[b]))
            out.append(unpacked(data, last - first, self.bits)[max(low - first, 0) : high - first])
        return np.concatenate(out) if out else np.zeros(0, dtype="<u4")

    def document(self, i: int) -> np.ndarray:
        """The ids of the i-th document of the file."""
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def close(self) -> None:
        self.f.close()


# --- encoding

#: UTF-8 forms of white space outside ASCII, and of separators that not all define as white space.
OTHER_SPACES = [b"\x1c", b"\x1d", b"\x1e", b"\x1f", *(chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))]
#: A piece of letters that is one word for the tokenizer's pattern: Latin letters to U+024F, which are letters in every version of Unicode.
LATIN_WORD = re.compile(rb"[ ]?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+")
#: What a byte-level pattern is, by the tokenizer file: nothing is changed before it, and it is the library's own.
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: printable ones as themselves, the others by the letters from U+0100 on, in order."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(0x100 + hidden.index(b)) if b in hidden else chr(b) for b in range(256)}


def piece_starts(data: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Places in UTF-8 texts (`begin`: where each starts) at which a byte-level tokenizer surely starts a new piece.

    Its pattern looks ahead only at the end of white space and never back, and a space belongs to the word behind it. So a
    piece starts at white space behind a word, at the last white space before a word and, unless that is a space, at the
    word; and between a letter and a mark, in either order, unless the mark is an apostrophe before the letter. Places next
    to any other character are left out: the two pieces stay together, which is right as well.
    """
    n = len(data)
    plain = (data == 32) | ((data >= 9) & (data <= 13))
    other = np.zeros(n, dtype=bool)
    maybe = np.isin(data, np.unique(np.array([x[0] for x in OTHER_SPACES], dtype=np.uint8)))
    if maybe.any():
        raw = data.tobytes()
        for at in np.flatnonzero(maybe).tolist():
            for x in OTHER_SPACES:
                if raw.startswith(x, at):
                    other[at : at + len(x)] = True
    word = ~plain & ~other
    low = data | 0x20
    letter = (low >= 97) & (low <= 122) & (data < 128)
    if n:
        lead = (data[:-1] >= 0xC3) & (data[:-1] <= 0xC9) & ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)))
        letter[:-1] |= lead
        letter[1:] |= lead
    mark = (data > 32) & (data < 127) & ~letter & ~((data >= 48) & (data <= 57))
    cut, first = np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=bool)
    first[begin] = True
    if n:
        cut[1:n] = (plain[1:] & word[:-1]) | (letter[:-1] & mark[1:]) | (mark[:-1] & (data[:-1] != 39) & letter[1:])
        before = np.flatnonzero(plain[:-1] & word[1:] & ~first[1:n])
        cut[before] = True
        cut[before[data[before] != 32] + 1] = True
    return np.flatnonzero((cut | first)[:n])


class Encoder:
    """Ids of texts by a tokenizer file. A worker remembers the ids of the pieces that it met last; what it remembers never changes a result."""

    made: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls.made:
            cls.made[path] = cls(path)
        return cls.made[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_file(path)
        # The string of a special token in a text is ordinary text.
        self.t.encode_special_tokens = True
        made_of = json.loads(self.t.to_str())
        plain = made_of["normalizer"] is None and all(x["special"] for x in made_of["added_tokens"])
        #: Whether texts can be cut by piece_starts; otherwise they are encoded whole.
        self.in_pieces = plain and BYTE_LEVEL.items() <= (made_of["pre_tokenizer"] or {}).items()
        self.model, self.letters = self.t.model, byte_letters()
        # Ids as bytes: no garbage collection walks through them.
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.t.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, pieces: list[bytes]) -> None:
        """Remember the ids of the pieces. A word of letters is one for the pattern too and goes straight to the library's model."""
        others = []
        for p in pieces:
            if LATIN_WORD.fullmatch(p):
                self.recent[p] = array("I", [x.id for x in self.model.tokenize(p.decode("latin-1").translate(self.letters))]).tobytes()
            else:
                others.append(p)
        self.recent.update((p, array("I", x).tobytes()) for p, x in zip(others, self.encode([p.decode() for p in others]), strict=True))

    def texts(self, data: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (begin: where each starts in data, and the end), and how many each has."""
        starts = piece_starts(data, begin[:-1][np.diff(begin) > 0]) if self.in_pieces else begin[:-1][np.diff(begin) > 0]
        bounds = pa.array(np.append(starts, len(data)), type=pa.int64())
        cut = pa.Array.from_buffers(pa.large_string(), len(starts), [None, bounds.buffers()[1], pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        raw, ends = cut.dictionary.buffers()[2].to_pybytes() if len(cut.dictionary) else b"", np.frombuffer(cut.dictionary.buffers()[1], dtype=np.int64)[: len(cut.dictionary) + 1].tolist()
        pieces, codes = [raw[a:b] for a, b in pairwise(ends)], cut.indices.to_numpy()
        if self.in_pieces:
            self.recent.update((p, self.older[p]) for p in pieces if p not in self.recent and p in self.older)
            self.learn([p for p in pieces if p not in self.recent])
            known = [self.recent[p] for p in pieces]
            if len(self.recent) > REMEMBERED // 2:
                self.older, self.recent = self.recent, {}
        else:
            known = [array("I", x).tobytes() for x in self.encode([p.decode() for p in pieces])]
        size = np.fromiter(map(len, known), dtype=np.int64, count=len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype=np.uint32)
        first, count = np.cumsum(size) - size, size[codes]
        at = np.arange(count.sum()) + np.repeat(first[codes] - (np.cumsum(count) - count), count)
        total = np.concatenate([[0], np.cumsum(count)])
        return flat[at], np.diff(total[np.searchsorted(starts, begin)])


def portions(batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows whose texts hold PORTION bytes together (or one longer text), their bytes and where each text begins and ends."""
    x = batch.column(column).cast(pa.large_string())
    offsets = np.frombuffer(x.buffers()[1], dtype=np.int64)[x.offset : x.offset + len(x) + 1]
    data = np.frombuffer(x.buffers()[2] or b"", dtype=np.uint8)
    low = 0
    while low < len(x):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + PORTION, side="right")) - 1)
        yield batch.slice(low, high - low), data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def with_end(ids: np.ndarray, counts: np.ndarray, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    return (ids, counts) if end is None else (np.insert(ids, np.cumsum(counts), end), counts + 1)


def bits_for(vocabulary: int) -> int:
    """The bits of the largest id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


# --- tables


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int | None = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of every text to files in `folder` (a URI that driver and executors share); the manifest: file_no, file, n_docs, n_ids, start.

    Documents are in ascending order of id over all files, those without an id first, rows with one id by their text's
    hash; `end` is appended to each. `tokenizer` is a file of the tokenizers library, with byte-level pieces or without.
    Defined results: a null or empty text has the end id alone; identical rows are documents of their own; an empty table
    gives an empty manifest and no files; other columns aren't read; a long text is encoded piece by piece.

    Ranges of ids (quantiles, 2,000 rows or more each) become files; a hot id is split by its text's hash. Texts move
    once. Tasks hold a portion of a range at a time.
    """
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    bits = bits_for(max(vocabulary, (end or 0) + 1))
    for_workers(docs.sparkSession)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    d = id_ranges(d, "doc_id")
    d = d.repartition("range").sortWithinPartitions("range", F.col("doc_id").asc_nulls_first(), "text_hash").select("range", "doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, out, at = Encoder.of(tokenizer), None, None

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"range": at, **out.close()}], schema=pa.schema([("range", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

        for batch in batches:
            ranges = batch.column("range").to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(ranges)) + 1, [len(ranges)]]) if len(ranges) else [0]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if ranges[low] != at:
                    if out:
                        yield done()
                    at = int(ranges[low])
                    out = Writer(f"{folder}/{at + (1 << 20):07d}-{uuid.uuid4().hex}.ids", bits)
                for some, data, begin in portions(batch.slice(low, high - low), "text"):
                    ids, counts = with_end(*encoder.texts(data, begin), end)
                    out.add(some.column("doc_id"), ids, counts)
        if out:
            yield done()
        pa.default_memory_pool().release_unused()

    fs, path = file_at(folder)
    fs.create_dir(path, recursive=True)
    files = written(d.mapInArrow(write, "range int, file string, n_docs long, n_ids long"))
    # A row a file: one task may order them.
    w = W.orderBy("range")
    before = F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return files.select((F.row_number().over(w) - 1).alias("file_no"), "file", "n_docs", "n_ids", before.alias("start"))


def read_ids(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of its ids as little-endian 32-bit numbers) of each document
    in the files, and with_ids the ids themselves (array<int>). Files are read in parallel, a block of documents at a time."""
    kinds = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                f, low = IdFile(uri), 0
                while low < f.n_docs:
                    # Documents that lie in one more block, or a single longer one.
                    high = max(low + 1, int(np.searchsorted(f.starts, f.starts[low] + f.block, side="right")) - 1)
                    begin = f.starts[low : high + 1]
                    ids = f.ids(int(begin[0]), int(begin[-1]))
                    raw = memoryview(ids.astype("<u4").tobytes())
                    at = ((begin - begin[0]) * 4).tolist()
                    columns = [pa.array(f.doc_ids[low:high], mask=~f.has_id[low:high]), pa.array(start + begin[:-1]), pa.array(np.diff(begin)), pa.array([zlib.crc32(raw[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], type=pa.int64())]
                    if with_ids:
                        columns.append(pa.ListArray.from_arrays(pa.array((begin - begin[0]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in kinds.split(", ")])
                    low = high
                f.close()

    for_workers(manifest.sparkSession)
    return manifest.select("file", "start").repartition(F.col("file")).mapInArrow(read, kinds)


def op12_token_ids(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(table(spark, sf_dir, "documents"), folder, tokenizer_path()))
