"""Language identification of words and documents by a linear-chain conditional random field.

A word's features are its byte n-grams with a space on either side (so those at its ends are prefixes and suffixes) and
its membership in the lexicons of frequent words of each language. Transitions between neighbouring words are learned
with them. Forward-backward gives each word its posterior over languages, also where a text switches between them; a
document's language is the one with the largest posterior mass over its letters, and that share is its score.

Training takes a bounded sample of labelled rows (see PER_LANGUAGE, an excerpt of EXCERPT words of each). Prediction
labels every word of every text; a text's words form chains of BLOCK words. Features are computed once for each
different word of a portion.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table, text_of, with_columns_from, words_of

#: Rows of each language that are learned from (about, as they are drawn by hash), and words of each. Beyond
#: MOST_ROWS / PER_LANGUAGE languages each has its share of MOST_ROWS, LEAST at least.
PER_LANGUAGE, MOST_ROWS, LEAST, EXCERPT = 400, 20_000, 20, 48
BLOCK = 32
#: Bits of the tables for n-grams of 2, 3 and 4 bytes; words kept in each lexicon; training steps, rate and decay of the weights.
GRAM_BITS = {2: 16, 3: 17, 4: 18}
LEXICON, STEPS, RATE, DECAY = 400, 40, 0.3, 1e-3
#: Bytes of texts worked on at a time in a task, and cells of an array (words times languages).
PORTION, CELLS = 300_000, 400_000
#: Runs of word characters but decimal digits and _; a few of these characters, such as fractions and Roman numerals, aren't letters.
RUNS = re.compile(r"[^\W\d_]+")


@dataclass
class Words:
    """The different words of several documents in one byte buffer, " a bc d ", with the first place of each one's segment; the words of the documents by number."""

    buffer: np.ndarray
    starts: np.ndarray
    letters: np.ndarray
    ids: np.ndarray
    per_doc: np.ndarray


def read_words(texts: list[str]) -> Words:
    known: dict[str, int] = {}
    ids, per_doc = array("i"), []
    for t in texts:
        before, t = len(ids), t.lower()
        at = 0
        while at < len(t):
            # A piece ends behind a run, so that none is cut.
            end = RUNS.match(t, at + PORTION) if at + PORTION < len(t) else None
            stop = end.end() if end else min(len(t), at + PORTION)
            found = RUNS.findall(t, at, stop)
            fresh = [w for w in dict.fromkeys(found) if w not in known]
            if not all(map(str.isalpha, fresh)):
                found = "".join(c if c.isalpha() else " " for c in t[at:stop]).split()
                fresh = [w for w in dict.fromkeys(found) if w not in known]
            known.update(zip(fresh, range(len(known), len(known) + len(fresh)), strict=True))
            ids.extend(map(known.__getitem__, found))
            at = stop
        per_doc.append(len(ids) - before)
    buffer = np.frombuffer((" " + " ".join(known) + " ").encode("utf-8", "replace"), dtype=np.uint8)
    spaces = np.flatnonzero(buffer == 32)
    starts = spaces[:-1] if known else np.zeros(0, dtype=np.int64)
    letters = np.diff(spaces) - 1 if known else np.zeros(0, dtype=np.int64)
    return Words(buffer, starts, letters, np.frombuffer(ids, dtype=np.int32) if len(ids) else np.zeros(0, dtype=np.int32), np.array(per_doc, dtype=np.int64))


def grams(w: Words) -> dict[int, np.ndarray]:
    """For each place but the last the table index of the n-gram that begins there; -1 where it would leave its word."""
    b = w.buffer.astype(np.uint64)
    n = len(b) - 1
    spaces = w.buffer == 32
    out = {}
    padded = np.concatenate([b, np.full(4, 32, dtype=np.uint64)])
    for size, bits in GRAM_BITS.items():
        h = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            h = h * np.uint64(257) + padded[k : k + n]
        h = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits) if size > 2 else padded[:n] * np.uint64(256) + padded[1 : n + 1]
        h = h.astype(np.int64)
        for k in range(1, size - 1):  # a space inside
            h[: n - k][spaces[k:n]] = -1
        if size > 2:  # behind the last word
            h[max(0, n - size + 2) :] = -1
        out[size] = h
    return out


def word_hashes(w: Words) -> np.ndarray:
    """A 64-bit polynomial hash of each word's bytes."""
    if not len(w.starts):
        return np.zeros(0, dtype=np.uint64)
    at = np.arange(len(w.buffer) - 1) - np.repeat(w.starts, np.diff(np.append(w.starts, len(w.buffer) - 1)))
    with np.errstate(over="ignore"):
        power = np.cumprod(np.full(int(at.max()) + 1, 0x100000001B3, dtype=np.uint64))
        return np.add.reduceat((w.buffer[:-1].astype(np.uint64) + np.uint64(7)) * power[at] * (w.buffer[:-1] != 32), w.starts)


@dataclass
class Model:
    """slots: for each n-gram size the row of `weights` by table index, the last row (of zeros) for those never seen."""

    languages: list[str]
    slots: dict[int, np.ndarray]
    weights: dict[int, np.ndarray]
    lexicon: np.ndarray
    votes: np.ndarray
    transitions: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """(different words, languages)"""
        k, out = len(self.languages), []
        index = grams(w)
        step = max(1, CELLS // (8 * k))
        for low in range(0, len(w.starts), step):
            first = w.starts[low : low + step]
            end = w.starts[low + step] if low + step < len(w.starts) else len(w.buffer) - 1
            total = np.zeros((end - first[0], k), dtype=np.float32)
            for size, at in index.items():
                total += self.weights[size][self.slots[size][at[first[0] : end]]]  # -1 is the last row, which stays zero
            out.append(np.add.reduceat(total, first - first[0], axis=0))
        out = np.concatenate(out) if out else np.zeros((0, k), dtype=np.float32)
        if len(self.lexicon):
            h = word_hashes(w)
            at = np.minimum(np.searchsorted(self.lexicon, h), len(self.lexicon) - 1)
            out += np.where((self.lexicon[at] == h)[:, None], self.votes[at], 0)
        return out


def forward_backward(emissions: np.ndarray, present: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors (chains, length, labels) and the expected transitions summed over all; `present` marks a chain's words, all in front."""
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    t = np.exp(transitions)
    chains, length, labels = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, length):
        a = (alpha[:, k - 1] @ t) * e[:, k]
        alpha[:, k] = a / a.sum(axis=1, keepdims=True)
    moved = np.zeros((labels, labels))
    for k in range(length - 1, 0, -1):
        ahead = e[:, k] * beta[:, k]
        b = ahead @ t.T
        b /= b.sum(axis=1, keepdims=True)
        beta[:, k - 1] = np.where(present[:, k, None], b, 1.0)
        scale = present[:, k] / ((alpha[:, k - 1] @ t) * ahead).sum(axis=1)
        moved += t * (alpha[:, k - 1].T @ (ahead * scale[:, None]))
    post = alpha * beta
    return post / post.sum(axis=2, keepdims=True), moved


def posteriors(emissions: np.ndarray, present: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """As forward_backward, without the expected transitions."""
    e = np.exp(emissions - emissions.max(axis=2, keepdims=True)) + np.float32(1e-12)
    t = np.exp(transitions).astype(e.dtype)
    alpha, beta = np.empty_like(e), np.ones_like(e)
    alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
    for k in range(1, e.shape[1]):
        a = (alpha[:, k - 1] @ t) * e[:, k]
        alpha[:, k] = a / a.sum(axis=1, keepdims=True)
    for k in range(e.shape[1] - 1, 0, -1):
        b = (e[:, k] * beta[:, k]) @ t.T
        beta[:, k - 1] = np.where(present[:, k, None], b / b.sum(axis=1, keepdims=True), 1.0)
    post = alpha * beta
    return post / post.sum(axis=2, keepdims=True)


def chained(values: np.ndarray, per_doc: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of words laid out in chains of `block`, a document's last one padded: (chains, block, labels), present, flat places."""
    blocks = -(-per_doc // block)
    first = np.concatenate([[0], np.cumsum(blocks)[:-1]]) if len(per_doc) else np.zeros(0, dtype=np.int64)
    offset = np.arange(per_doc.sum()) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc)
    flat = np.repeat(first * block, per_doc) + offset
    out = np.zeros((int(blocks.sum()) * block, values.shape[1]), dtype=values.dtype)
    out[flat] = values
    present = np.zeros(len(out), dtype=bool)
    present[flat] = True
    return out.reshape(-1, block, values.shape[1]), present.reshape(-1, block), flat


def train(rows: list[tuple[str, str]]) -> Model:
    """Fit on (language, excerpt) rows by Adagrad on the conditional likelihood of each word's label, its document's language."""
    languages = sorted({x for x, _ in rows})
    k = len(languages)
    number = {x: i for i, x in enumerate(languages)}
    w = read_words([t for _, t in rows])
    label = np.repeat([number[x] for x, _ in rows], w.per_doc)
    hashes = word_hashes(w)
    # The lexicons: each language's most frequent words that occur twice or more.
    known: dict[int, np.ndarray] = {}
    for i in range(k):
        for u, c in Counter(w.ids[label == i].tolist()).most_common(LEXICON):
            if c > 1:
                known.setdefault(int(hashes[u]), np.zeros(k, dtype=np.float32))[i] = 1
    lexicon = np.array(sorted(known), dtype=np.uint64)
    member = np.array([known[h] for h in lexicon.tolist()], dtype=np.float32).reshape(-1, k)
    at = np.minimum(np.searchsorted(lexicon, hashes), max(0, len(lexicon) - 1))
    own = np.where((lexicon[at] == hashes)[:, None], member[at], 0) if len(lexicon) else np.zeros((len(hashes), k), dtype=np.float32)
    # Only n-grams that occur have weights; the last row stands for all others.
    slots, index = {}, {}
    for n, g in grams(w).items():
        seen = np.unique(g[g >= 0])
        slots[n] = np.full((1 << GRAM_BITS[n]) + 1, len(seen), dtype=np.int32)
        slots[n][seen] = np.arange(len(seen))
        index[n] = slots[n][g]
    word = np.repeat(np.arange(len(w.starts)), np.diff(np.append(w.starts, len(w.buffer) - 1)))
    params = {**{n: np.zeros((int(s.max()) + 1, k), dtype=np.float32) for n, s in slots.items()}, "lexicon": np.zeros((k, k)), "moves": np.zeros((k, k))}
    speed = {n: np.full(p.shape, 1e-4, dtype=np.float32) for n, p in params.items()}
    moves = np.zeros((k, k))
    chain_of = np.repeat(np.arange(len(w.per_doc)), w.per_doc)
    inner = chain_of[1:] == chain_of[:-1]
    np.add.at(moves, (label[:-1][inner], label[1:][inner]), 1)
    # Excerpts are worked through a bounded number of words times languages at a time.
    batch = max(1, CELLS // (k * int(max(1, w.per_doc.max()))))
    first = np.concatenate([[0], np.cumsum(w.per_doc)])
    for _ in range(STEPS):
        e = np.add.reduceat(sum(params[n][index[n]] for n in GRAM_BITS), w.starts, axis=0) + own @ params["lexicon"]
        moved, error = np.zeros((k, k)), np.zeros((len(w.starts), k))
        for low in range(0, len(rows), batch):
            sizes, span = w.per_doc[low : low + batch], slice(first[low], first[min(low + batch, len(rows))])
            ids = w.ids[span]
            laid, present, flat = chained(e[ids].astype(np.float64), sizes, int(max(1, sizes.max())))
            post, some = forward_backward(laid, present, params["moves"])
            moved += some
            miss = -post.reshape(-1, k)[flat]
            miss[np.arange(len(ids)), label[span]] += 1
            for j in range(k):
                error[:, j] += np.bincount(ids, miss[:, j], minlength=len(error))
        error = (error / len(rows)).astype(np.float32)
        slopes = {"lexicon": own.T @ error, "moves": (moves - moved) / len(rows)}
        for n in GRAM_BITS:
            spread = error[word]
            slopes[n] = np.stack([np.bincount(index[n], spread[:, j], minlength=len(params[n])) for j in range(k)], axis=1).astype(np.float32)
            slopes[n][-1] = 0
        for n, p in params.items():
            g = slopes[n] - DECAY * p / 10
            speed[n] += g * g
            p += RATE * g / np.sqrt(speed[n])
    return Model(languages, slots, {n: params[n] for n in GRAM_BITS}, lexicon, (member @ params["lexicon"]).astype(np.float32), params["moves"].astype(np.float32))


def predict(model: Model | None, texts: list[str]) -> pd.DataFrame:
    """language, score, n_words and n_other (words labelled as another language) of each text; `und` and 0 without a letter."""
    w = read_words(texts)
    docs = len(texts)
    out = pd.DataFrame({"lang_pred": ["und"] * docs, "score": np.zeros(docs), "n_words": w.per_doc, "n_other": np.zeros(docs, dtype=np.int64)})
    if model is None or not len(w.ids):
        return out
    k = len(model.languages)
    emissions = model.emissions(w)
    mass, labelled = np.zeros((docs, k)), np.zeros((docs, k), dtype=np.int64)
    # Chains don't depend on each other, so a portion of them at a time, cut anywhere between two.
    chains = -(-w.per_doc // BLOCK)
    of_chain = np.repeat(np.arange(docs), chains)
    nth = np.arange(len(of_chain)) - np.repeat(np.cumsum(chains) - chains, chains)
    size = np.minimum(BLOCK, w.per_doc[of_chain] - nth * BLOCK)
    first = np.concatenate([[0], np.cumsum(size)])
    step = max(1, CELLS // (BLOCK * k))
    for low in range(0, len(of_chain), step):
        high = min(low + step, len(of_chain))
        ids, doc = w.ids[first[low] : first[high]], np.repeat(of_chain[low:high], size[low:high])
        laid, present, flat = chained(emissions[ids], size[low:high], BLOCK)
        post = posteriors(laid, present, model.transitions).reshape(-1, k)[flat]
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        mass[doc[begin]] += np.add.reduceat(post * w.letters[ids][:, None].astype(np.float32), begin, axis=0)
        np.add.at(labelled, (doc, post.argmax(axis=1)), 1)
    some = np.flatnonzero(w.per_doc)
    best = mass[some].argmax(axis=1)
    out.loc[some, "lang_pred"] = np.array(model.languages, dtype=object)[best]
    out.loc[some, "score"] = np.minimum(1.0, mass[some, best] / mass[some].sum(axis=1))
    out.loc[some, "n_other"] = w.per_doc[some] - labelled[some, best]
    return out


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(doc_id, lang, excerpt) of a seeded sample of documents that aren't held out: PER_LANGUAGE of each language on average (see there), an excerpt of EXCERPT words each.

    Rows are drawn by their id and their text's hash, so rows without an id, or with one id, are drawn one by one; identical
    rows come together or not at all. Rows without a language, or held out, aren't drawn; a null text is an empty excerpt.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), text_of(text_col).alias("t")).withColumn("h", F.xxhash64("t")).where(~held_out("doc_id") & F.col("lang").isNotNull())
    # One row for each language that the model will hold a column of weights for, so it is small wherever that is; the texts stay where they are.
    found = d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()
    each = max(LEAST, min(PER_LANGUAGE, MOST_ROWS // max(1, len(found))))
    sizes = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in found], "lang string, n long"))
    chance = F.pmod(F.xxhash64(F.lit("sample"), "doc_id", "h"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    picked = d.join(sizes, "lang").where(chance * F.col("n") < each)
    picked = picked.select("doc_id", "h", "lang", words_of(F.col("t")).alias("w"))
    begin = 1 + F.pmod(F.xxhash64(F.lit("begin"), "doc_id", "h"), F.greatest(F.size("w") - EXCERPT + 1, F.lit(1))).cast("int")
    return picked.select("doc_id", "lang", F.array_join(F.slice("w", begin, F.lit(EXCERPT)), " ").alias("excerpt"))


def held_out(id_col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """The model of a bounded sample, the only rows that reach the driver; None without labelled rows."""
    rows = sorted((r["lang"], str(r["doc_id"]), r["excerpt"]) for r in training_rows(docs, id_col, text_col, lang_col).collect() if any(map(str.isalpha, r["excerpt"])))
    return train([(x, t) for x, _, t in rows]) if rows else None


PREDICTED = {"lang_pred": "string", "score": "double", "n_words": "long", "n_other": "long"}


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns (or those in `keep`) followed by lang_pred, score, n_words and n_other, which replace columns of these names.

    Defined results: a null text or one without a letter is `und` with score 0; each row is predicted by itself, from its
    text alone; of languages that tie the first by name is taken; an empty table gives an empty result. Other columns of docs
    are carried as they are, whatever their names.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    d = docs.select(*(c for c in (docs.columns if keep is None else keep) if c not in PREDICTED), text_of(text_col).alias("__text_of_identify"))

    def made(texts: list[str]) -> list:
        out = predict(shipped.value, texts)
        return [out[c].tolist() for c in PREDICTED]

    return with_columns_from(d, "__text_of_identify", made, PREDICTED, PORTION)


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    d = docs.select("doc_id", held_out("doc_id").alias("held_out"), "text")
    return identify(d, fit(docs), keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
