"""Personal data: fixed patterns, and information-theoretic sanitisation of the words that give a protected value away.

Each matched value is a protected entity. The words of the documents that mention it are terms. With document frequencies over the
whole corpus, a term t discloses an entity e by PMI(e; t) = ln(N df(e, t) / (df(e) df(t))), which can't exceed the
entity's information IC(e) = ln(N / df(e)); the ratio of the two is the share of the entity that the term reveals. Terms
of at least GENERALISE of it are generalised to a class, those of at least REMOVE are removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import clear_of, indexed, joined_spans, masked_text, matches_with_places, piece, places, table, text_of, written

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Each pattern starts only where a leftmost match can: at the beginning of a run of its first characters. A start inside
#: the run would fail for the same reason as the beginning does, so the matches are those of the plain pattern, in linear time.
PATTERNS = {
    "email": "(?:(?<![A-Za-z0-9._%+-])|\\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?<![0-9])[0-9]++(?:\\.[0-9]++){3}+",
    "card": "(?<![0-9])(?<![0-9][\\x20-])[0-9](?:[\\x20-]?[0-9]){15,18}+(?![\\x20-]?[0-9])",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
GUARDS = {"email": ["@"], "ip": ["."], "phone": ["+"]}


def luhn(digits: Column) -> Column:
    each = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + F.when(x > 9, x - 9).otherwise(x)) % 10 == 0


CHECKS = {
    "ip": lambda m: m.rlike(f"^{_BYTE}(?:\\.{_BYTE}){{3}}$"),
    "card": lambda m: luhn(F.translate(m, " -", "")),
    "phone": lambda m: F.length(F.translate(m, "+ ().-", "")).between(8, 15),
}
#: A term: a word of three letters or more between white space, one mark of punctuation allowed behind it.
WORD = "\\p{L}[\\p{L}'-]{2,}+"
TERM = f"(?<=[\\x20\\x09-\\x0D]){WORD}(?=[,.;:!?]?[\\x20\\x09-\\x0D])"
#: Code points around a mention that are its context; different contexts that have to hold term and entity (copies of one
#: passage are one piece of evidence); shares of IC(e).
REACH, SUPPORT, GENERALISE, REMOVE = 48, 2, 0.8, 0.95


def mentions(docs: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """doc_id, text_hash, base (spans by kind, then start), around (each span's entity, context and terms near it), and, of
    documents with a span, p (the text between spaces) and words (all its different terms as they stand)."""
    d = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep)), text_of(text_col).alias("t")).withColumn("text_hash", F.xxhash64("t"))
    d = matches_with_places(d, "t", PATTERNS, CHECKS, GUARDS).withColumn("base", F.concat(*(F.col(k) for k in KINDS)))
    # The text with a space on either side, so that every word is between white space; its places are one larger.
    padded = F.when(F.size("base") > 0, F.concat(F.lit(" "), F.col("t"), F.lit(" ")))
    d = d.withColumn("p", padded).withColumns({"p32": indexed(F.col("p")), "n_p": F.length("p")})

    def either_side(s: Column) -> Column:
        low = F.greatest(F.lit(0), s["start"] + 1 - REACH)
        high = F.least(F.col("n_p"), s["end"] + 1 + REACH)
        return F.array(F.struct(piece(F.col("p32"), low, s["start"] + 1).alias("x")), F.struct(piece(F.col("p32"), s["end"] + 1, high).alias("x")))

    def near(sides: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(sides, lambda y: F.transform(F.regexp_extract_all(y["x"], F.lit(TERM), F.lit(0)), F.lower))))

    around = F.transform("base", lambda s: F.struct(F.concat_ws(":", s["kind"], F.lower(s["value"])).alias("entity"), F.xxhash64(F.get(either_side(s), 0)["x"], F.get(either_side(s), 1)["x"]).alias("context"), near(either_side(s)).alias("terms")))
    plain = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    words = F.array_distinct(F.regexp_extract_all("p", F.lit(TERM), F.lit(0)))
    return d.withColumn("around", around).select("doc_id", *(f"keep_{i}" for i in range(len(keep))), "text_hash", plain.alias("base"), "around", "p", words.alias("words"))


def term_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, df): in how many of all documents each term occurs."""
    padded = F.concat(F.lit(" "), F.lower(text_of(text_col)), F.lit(" "))
    return docs.select(F.explode(F.array_distinct(F.regexp_extract_all(padded, F.lit(TERM), F.lit(0)))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.text_hash") == F.col(f"{b}.text_hash"))


def disclosing(found: DataFrame, counts: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, text_hash, term, share) of the terms at or over GENERALISE for an entity of their document, wherever in it they stand.

    Term and entity have to share SUPPORT different contexts: those of mentions near the term, and one of each document. A
    term can pass only if df(t) <= m ** a * N ** (1 - a), where m is the most documents that it can share with one
    entity: common words leave by that bound before they meet the entities of their documents.
    """
    each = found.where(F.size("around") > 0).select("doc_id", "text_hash", F.explode("around").alias("x")).select("doc_id", "text_hash", "x.entity", "x.context", "x.terms")
    own = each.groupBy("doc_id", "text_hash", "entity").agg(F.min("context").alias("context"))
    # An entity of one context alone can't have SUPPORT.
    owners = each.groupBy("entity").agg(F.countDistinct(F.struct("doc_id", "text_hash")).alias("df_e"), F.countDistinct("context").alias("contexts"))
    owners = written(owners.where(F.col("contexts") >= SUPPORT).drop("contexts"))
    own = own.join(owners, "entity").groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("entity", "context", "df_e")).alias("entities"), F.max("df_e").alias("top"))
    own = written(own)
    words = found.where(F.size("around") > 0).select("doc_id", "text_hash", F.array_distinct(F.transform("words", F.lower)).alias("words")).alias("a")
    held = words.join(own.select("doc_id", "text_hash", "top").alias("b"), same_document("a", "b")).select("a.doc_id", "a.text_hash", "top", F.explode("words").alias("term"))
    held = written(held)
    # Rows that are repeated count twice in `most`, which only loosens the bound.
    able = held.groupBy("term").agg(F.least(F.count(F.lit(1)), F.max("top")).alias("most")).join(counts, "term")
    able = written(able.where(F.col("df") <= F.pow(F.col("most").cast("double"), F.lit(GENERALISE)) * F.pow(F.lit(float(n_docs)), F.lit(1 - GENERALISE)) + 1).select("term", "df"))
    left = held.join(able, "term").select("doc_id", "text_hash", "term", "df").distinct().alias("a")
    pairs = left.join(own.alias("b"), same_document("a", "b")).select("a.doc_id", "a.text_hash", "term", "df", F.explode("entities").alias("x"))
    pairs = written(pairs.select("doc_id", "text_hash", "term", "df", "x.entity", "x.context", "x.df_e"))
    near = each.select("entity", "context", F.explode("terms").alias("term")).distinct()
    # In one document the mentions near the term are its contexts, elsewhere the document's first one is.
    seen = lambda d: d.groupBy("entity", "term")
    far = seen(pairs).agg(F.count(F.lit(1)).alias("both"), F.countDistinct("context").alias("far"), F.first("df").alias("df"), F.first("df_e").alias("df_e"))
    close = seen(near.join(able.select("term"), "term")).agg(F.count(F.lit(1)).alias("near"))
    scored = far.join(close, ["entity", "term"], "left").where((F.col("far") >= SUPPORT) | (F.col("near") >= SUPPORT))
    ic = F.ln(F.lit(float(n_docs)) / F.col("df_e"))
    pmi = F.ln(F.lit(float(n_docs)) * F.col("both") / (F.col("df_e").cast("double") * F.greatest("df", "both")))
    bad = scored.select("entity", "term", F.when(ic > 0, pmi / ic).alias("share")).where(F.col("share") >= GENERALISE)
    return pairs.select("doc_id", "text_hash", "entity", "term").join(bad, ["entity", "term"]).groupBy("doc_id", "text_hash", "term").agg(F.max("share").alias("share"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, base (spans of the patterns) and terms (spans of disclosing words with their share, by start).

    `keep` names further columns to carry. Defined results: a null text is empty; identical rows are one document in the
    counts and a row each in the result; rows with one id and different texts are documents of their own; an entity that
    every document holds carries no information and nothing discloses it; an empty table gives an empty result.
    """
    keep = keep or []
    found = written(mentions(docs, id_col, text_col, keep))
    bad = disclosing(found, term_counts(docs, text_col), max(1, docs.count()))
    spans = written(bad.groupBy("doc_id", "text_hash").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares")))
    a, b = found.alias("a"), spans.alias("b")
    joined = a.join(b, same_document("a", "b"), "left")
    # Every place of the document's disclosing words, found by a pattern of just these words (letters, ' and - only).
    forms = F.filter("words", lambda w: F.map_contains_key("shares", F.lower(w)))
    head, tail = (F.lit(x) for x in TERM.split(WORD))
    joined = joined.withColumn("pattern", F.when(F.size("shares") > 0, F.concat(head, F.lit("(?:"), F.array_join(forms, "|"), F.lit(")"), tail)))
    joined = joined.withColumn("matches", F.when(F.col("pattern").isNotNull(), F.regexp_extract_all("p", F.col("pattern"), F.lit(0))))
    joined = joined.withColumn("places", places("term", F.col("matches"), F.transform(F.split("p", F.col("pattern"), -1), F.length)))
    spans_of = F.transform("places", lambda z: F.struct((z["start"] - 1).alias("start"), (z["end"] - 1).alias("end"), z["kind"].alias("kind"), F.element_at("shares", F.lower(z["value"])).alias("share")))
    joined = joined.withColumn("terms", F.sort_array(spans_of))
    # A mention's neighbour can be part of another mention, which the base span covers already.
    free = clear_of(F.col("terms"), F.col("a.base"))
    none = F.array().cast("array<struct<start:int,end:int,kind:string,share:double>>")
    return joined.select(F.col("a.doc_id").alias("doc_id"), *(F.col(f"a.keep_{i}").alias(c) for i, c in enumerate(keep)), F.col("a.base").alias("base"), F.coalesce(free, none).alias("terms"))


def sanitised(text: Column, base: Column, terms: Column) -> Column:
    """The text with base spans replaced by their kind, disclosing words generalised to [WORD] or, at REMOVE or more, removed."""
    both = F.concat(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")).alias("mask"))), F.transform(terms, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["share"] >= REMOVE, "").otherwise("[WORD]").alias("mask"))))
    return masked_text(text, F.sort_array(both), lambda s: s["mask"])


def op1_pii(spark, sf_dir: str) -> DataFrame:
    d = find(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    every = F.concat("base", F.transform("terms", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return d.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(every).alias("spans"))
