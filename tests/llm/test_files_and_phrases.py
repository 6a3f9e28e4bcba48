"""The Merkle manifest, files of token ids and phrase collocations against brute force, and rows made to be awkward."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def sha(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and extra columns whose names the operators use inside."""
    rnd = random.Random(9)
    long = " ".join(rnd.choice(["alpha", "beta", "of", "the", "x,", "é", "日本."]) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, long), (5, "a b c. a b c"), (6, "same"), (6, "same"), (6, "other"), (None, "null id"), (None, "null id"), (None, None), (7, "one\ntwo\n"), (8, "x" * 5000), (9, "tab\there  two")]
    d = [Row(doc_id=i, text=t, lang=None if n % 3 == 0 else "xx", source=None if n % 4 == 0 else f"s{n % 3}", n_chars=None if t is None else len(t), pos=1, grp="g", digest="d", kids=None, place=5, p=1, codes="c", n="n", a="a", b="b", k=2, id="i", range=3, file="f", start=7, proof="p") for n, (i, t) in enumerate(rows)]
    return spark.createDataFrame(d, "doc_id long, text string, lang string, source string, n_chars long, pos int, grp string, digest string, kids string, place int, p int, codes string, n string, a string, b string, k int, id string, range int, file string, start int, proof string")


# --- the manifest


def enc(v) -> str:
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def brute_tree(leaves: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """The root of leaves in order, and each leaf's siblings by level."""
    proofs, at, level = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(level) > 1:
        for i, k in enumerate(at):
            first = k - k % 3
            run = level[first : first + 3]
            proofs[i].append(("".join(run[: k - first]), "".join(run[k - first + 1 :])))
        at = [k // 3 for k in at]
        level = [sha("".join(level[k : k + 3])) for k in range(0, len(level), 3)]
    return level[0], proofs


def brute_manifest(rows: list[Row]) -> list[tuple]:
    groups = defaultdict(list)
    for r in rows:
        leaf = sha("".join(map(enc, (r.doc_id, r.source, r.lang, r.n_chars, r.text))))
        groups[r.source].append(((r.doc_id is not None, r.doc_id or 0, leaf), r.doc_id, leaf))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs, own = [], []
    for s in names:
        g = sorted(groups[s])
        sub, proofs = brute_tree([x[2] for x in g])
        subs.append(sub)
        own.append([(x[1], x[2], p) for x, p in zip(g, proofs, strict=True)])
    root, tops = brute_tree(subs)
    return sorted(((i if i is not None else -1, leaf, sub, root, sha("".join(a + b for a, b in p + top))) for g, sub, top in zip(own, subs, tops, strict=True) for i, leaf, p in g))


@pytest.mark.parametrize("rows", [1, 2, 3, 4, 10])
def test_trees_of_few_leaves(spark, rows):
    from tidemark.llm.merkle import folded, manifest, proof_digest

    d = spark.createDataFrame([(k, "s" if k % 2 else None, "en", 1, f"text {k}") for k in range(rows)], "doc_id long, source string, lang string, n_chars long, text string")
    got = manifest(d).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p"), folded(F.col("leaf"), F.col("proof")).alias("again")).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.p) for r in got) == brute_manifest(d.collect()) and all(r.again == r.root for r in got)


def test_manifest(spark, awkward):
    from tidemark.llm.merkle import manifest, op11_merkle_manifest, proof_digest

    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = op11_merkle_manifest(spark, SF).collect()
    assert sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256) for r in got) == brute_manifest(rows)
    tampered = {r.doc_id for r in rows if zlib.crc32(str(r.doc_id).encode()) % 2 == 0 and r.text and "\n" in r.text}
    assert tampered and {r.doc_id for r in got if not r.verified} == tampered
    m = manifest(awkward).select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("p")).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.leaf, r.subroot, r.root, r.p) for r in m) == brute_manifest(awkward.collect())
    assert manifest(awkward.limit(0)).count() == 0


# --- files of token ids


def test_bits_round_trip(tmp_path):
    import pyarrow as pa

    from tidemark.llm import tokenids as ti

    rnd = np.random.default_rng(3)
    for bits in (1, 7, 8, 15, 16, 17, 31):
        x = rnd.integers(0, 1 << bits, 1003).astype(np.uint32)
        data = ti.packed(x, bits)
        assert len(data) == -(-1003 * bits // 8) and (ti.unpacked(data, 1003, bits) == x).all()
    assert [ti.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257)] == [1, 1, 2, 8, 9, 16]
    ids = rnd.integers(0, 1 << 17, 3 * ti.BLOCK + 17).astype(np.uint32)
    counts = np.array([0, 5, ti.BLOCK, 1, 2 * ti.BLOCK + 11])
    w = ti.Writer(f"file://{tmp_path}/a.ids", 17)
    w.add(pa.array([4, None]), ids[:5], counts[:2])
    w.add(pa.array([6, 7, 8]), ids[5:], counts[2:])
    assert w.close() == {"file": f"file://{tmp_path}/a.ids", "n_docs": 5, "n_ids": len(ids)}
    f = ti.IdFile(f"file:{tmp_path}/a.ids")
    ends = np.cumsum(counts)
    assert all((f.document(i) == ids[e - c : e]).all() for i, (c, e) in enumerate(zip(counts, ends, strict=True)))
    assert f.has_id.tolist() == [True, False, True, True, True] and f.doc_ids[[0, 2, 3, 4]].tolist() == [4, 6, 7, 8]
    for low, high in ((0, 0), (3, 70_000), (ti.BLOCK, ti.BLOCK + 1), (len(ids) - 1, len(ids))):
        assert (f.ids(low, high) == ids[low:high]).all()


def test_pieces_give_the_ids_of_whole_texts():
    from tidemark.llm import tokenids as ti

    e, rnd = ti.Encoder(ti.tokenizer_path()), random.Random(1)
    parts = [" ", "  ", "\n", "\t", "\r\n", "a", "b", "the", "'s", "'re", "it's", "1", "23", "!", "?!", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", "　", "é", "×", "日本", "🙂", "<|endoftext|>", "\x00", "​", "﻿", "Straße", "\x0b", "'", "́"]
    assert e.in_pieces
    for _ in range(400):
        texts = ["".join(rnd.choice(parts) for _ in range(rnd.choice([0, 1, 2, 5, 12, 40]))) for _ in range(rnd.randint(1, 6))]
        raw = [t.encode() for t in texts]
        ids, counts = e.texts(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]))
        assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == e.encode(texts)
    other = ti.Encoder(ti.tokenizer_path("word_bpe_49k.json"))
    assert not other.in_pieces
    ids, counts = other.texts(np.frombuffer(b"Hello  worldmore", dtype=np.uint8), np.array([0, 12, 12, 16]))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == other.encode(["Hello  world", "", "more"])


def test_token_ids(spark, awkward, tmp_path):
    from tokenizers import Tokenizer

    from tidemark.llm import tokenids as ti

    t = Tokenizer.from_file(ti.tokenizer_path())
    t.encode_special_tokens = True

    def check(d, got):
        rows = sorted(((r.doc_id is not None, r.doc_id or 0), r.text or "") for r in d.collect())
        want = sorted((k[1] if k[0] else -1, len(i) + 1, zlib.crc32(np.array([*i, 2], dtype="<u4").tobytes())) for (k, _), i in ((r, t.encode(r[1], add_special_tokens=False).ids) for r in rows))
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_crc32) for r in got) == want
        by_start = sorted(got, key=lambda r: r.start)
        assert [r.start for r in by_start] == np.concatenate([[0], np.cumsum([r.n_tokens for r in by_start])[:-1]]).tolist()
        ids = [r.doc_id for r in by_start]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))

    check(spark.read.parquet(f"{SF}/documents.parquet"), ti.op12_token_ids(spark, SF).collect())
    m = ti.write_ids(awkward, f"file://{tmp_path}/ids", ti.tokenizer_path())
    got = ti.read_ids(m, with_ids=True).collect()
    check(awkward, got)
    assert all(r.ids[-1] == 2 and len(r.ids) == r.n_tokens for r in got)
    assert ti.read_ids(ti.write_ids(awkward.limit(0), f"file://{tmp_path}/none", ti.tokenizer_path())).count() == 0


def test_one_id_of_many_rows_is_split(spark):
    from tidemark.llm import neardup

    d = spark.range(30_000).select(F.when(F.col("id") < 20_000, 5).otherwise(F.col("id")).alias("doc_id"), F.xxhash64("id").alias("text_hash"))
    rows = neardup.id_ranges(d, "doc_id").collect()
    assert max(Counter(r.range for r in rows).values()) <= 2 * neardup.IN_RANGE
    order = sorted((r.doc_id, r.text_hash, r.range) for r in rows)
    assert [x[2] for x in order] == sorted(x[2] for x in order)


# --- collocations


def brute_collocations(rows: list[tuple], least: int, top: int, longest: int = 4) -> list[tuple]:
    f, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        kept = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        inside = Counter()
        for p, a in kept.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    inside[p[i : i + m]] = max(inside[p[i : i + m]], a)
        found = []
        for p, a in kept.items():
            if 100 * inside[p] >= 80 * a and inside[p]:
                continue
            score, _, l, r = min((2_000_000 * a // (c[p[:j]] + c[p[j:]]), j, c[p[:j]], c[p[j:]]) for j in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def test_collocations(spark, awkward):
    from tidemark.llm import collocations as co

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, co.collocations(docs, least=3, portion=20_000).collect()))
    assert got == brute_collocations([(r.lang, r.text) for r in docs.collect()], 3, co.TOP) and len(got) > 500
    rows = [(r.lang, r.text) for r in awkward.collect()]
    assert sorted(map(tuple, co.collocations(awkward, least=2, top=20).collect())) == brute_collocations(rows, 2, 20)
    assert co.collocations(awkward.limit(0)).count() == 0
    # A phrase only just inside a longer one, cuts that tie, and words in capitals.
    texts = [("en", "New York City. " * 8 + "new york, " * 2), ("en", "a a a a; " * 5), ("und", "x y z w. " * 3), (None, "x y z w, " * 3), ("", "q r")]
    d = spark.createDataFrame(texts, "lang string, text string")
    assert sorted(map(tuple, co.collocations(d, least=3).collect())) == brute_collocations(texts, 3, co.TOP)


def test_sequences_keep_what_can_be_longer():
    from tidemark.llm.collocations import squeezed, stretches, unsqueezed

    code = np.arange(7)
    assert stretches(code, np.array([True, False, False, True, True, False])).tolist() == [0, 1, -1, 3, 4, 5, -1]
    assert stretches(code[:1], np.zeros(0, dtype=bool)).tolist() == []
    for n in (0, 1, 1000):
        x = np.arange(-1, n - 1, dtype=np.int32)
        assert (unsqueezed(squeezed(x)) == x).all()


def test_entries_move_packed(spark):
    """Few bytes a pair, by which the shuffle of all pairs fits its disk; numbers come back in the portions' own codes."""
    import numpy as np

    from tidemark.llm import collocations as co

    rng = np.random.default_rng(3)
    columns = [np.sort(rng.integers(0, 1 << 50, 1000)), rng.integers(-(1 << 62), 1 << 62, 1000), np.ones(1000, dtype=np.int64)]
    assert np.array_equal(co.unpacked(co.packed(*columns), 3), np.stack(columns)) and co.unpacked(co.packed(*[np.empty(0, dtype=np.int64)] * 2), 2).shape == (2, 0)
    w = 3000
    keys, n = np.unique((rng.zipf(1.2, 400_000) % w) * w + rng.zipf(1.2, 400_000) % w, return_counts=True)
    ids = np.sort(rng.choice(1 << 20, w, replace=False)).astype(np.int64)
    parts = co.in_ranges(ids[keys // w], ids[keys % w], n, 5)
    assert sum(map(len, parts)) < 7 * len(keys)
    back = np.concatenate([co.unpacked(x, 4) for x in parts], axis=1)
    back = back[:, np.argsort(back[0])]
    assert np.array_equal(back, np.stack([np.arange(len(keys)), ids[keys // w], ids[keys % w], n]))
