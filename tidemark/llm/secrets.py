"""Secret scans: fixed patterns, and a battery of randomness tests for tokens that no pattern names.

A token's encoding is inferred from its characters. Its symbols are tested for uniformity (chi-squared, over symbols and
over digits, small and capital letters), for the number of runs above and below the middle of the alphabet, and for serial correlation. Passing is what a random key does, so
the false discoveries to control are ordinary tokens that pass by chance. An ordinary token of n symbols, from a source
whose entropy falls D bits short of the alphabet's, looks uniform with a probability of about 2 ** (-D n). D comes from
the tokens of the corpus that fail, by encoding, less as many random ones as may fail by chance; that bound is the p-value of a token that passes, and the step-up rule
of Benjamini and Hochberg over all tokens tested sets the cut. So short tokens of a poor encoding need more evidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import LOWER, UPPER, clear_of, joined_spans, masked_text, matches_with_places, table, text_of, written

_VALUE = "[A-Za-z0-9+/_.=-]+"
_NAMED = "(?i)(?:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?"
PATTERNS = {
    "assign": _NAMED + _VALUE,
    "access": "AKIA[A-Z0-9]++",
    "hex": "[0-9a-f]{24,}+",
    "random": "[A-Za-z0-9+/_-]{20,}+={0,2}+",
}
CHECKS = {
    "assign": lambda m: F.length(F.regexp_extract(m, f"^{_NAMED}({_VALUE})", 1)) >= 6,
    "access": lambda m: F.length(m) >= 20,
}
GUARDS = {"assign": ["=", ":"], "access": ["AKIA"]}
BASE = ["assign", "access", "hex"]

#: Encodings from the narrowest: name, pattern, alphabet in the order of its values (fixed values).
ENCODINGS = [
    ("decimal", "^[0-9]+$", "0123456789"),
    ("hex", "^[0-9a-f]+$", "0123456789abcdef"),
    ("hex_upper", "^[0-9A-F]+$", "0123456789ABCDEF"),
    ("base32", "^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base36_upper", "^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", "^[0-9A-Za-z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", "^[0-9A-Za-z+/]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "^[0-9A-Za-z_-]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", "", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
]
#: |z| up to which a test passes: two-sided 1 % shared by three tests. The false-discovery rate. The shortfall D where no token failed.
Z_PASS, RATE, SHORTFALL = 2.94, 0.01, 1.0
#: Share of random tokens that fail by chance, a bound over all encodings and lengths (1.1 to 3.6 % in simulations), and the
#: standard deviations by which their number may exceed it.
CHANCE, MARGIN = 0.04, 3.0
#: Chi-squared of the kinds of characters up to which they pass, at 1.25 % with 1, 2 and 3 degrees of freedom (fixed values).
KINDS_PASS = (6.24, 8.76, 10.87)
#: The p-value falls with the length; from here on a token counts as just so long, which bounds the table of classes.
LONGEST = 512


def _choose(values: list[tuple[str, Column]], body: Column) -> Column:
    out = values[-1][1]
    for pattern, value in reversed(values[:-1]):
        out = F.when(body.rlike(pattern), value).otherwise(out)
    return out


def kinds_pass(body: Column, alphabet: Column) -> Column:
    """Whether digits, small letters, capitals and other characters come in about the alphabet's proportions."""
    held = lambda x, a: (F.length(x) - F.length(F.translate(x, a, ""))).cast("double")
    n, k = F.length(body).cast("double"), F.length(alphabet).cast("double")
    seen, sizes = ([held(x, a) for a in ("0123456789", LOWER, UPPER)] for x in (body, alphabet))
    seen, sizes = [*seen, n - sum(seen, F.lit(0.0))], [*sizes, k - sum(sizes, F.lit(0.0))]
    chi = sum((F.when(z > 0, F.pow(c - n * z / k, F.lit(2.0)) / F.when(z > 0, n * z / k)).otherwise(0.0) for c, z in zip(seen, sizes, strict=True)), F.lit(0.0))
    df = sum(((z > 0).cast("int") for z in sizes), F.lit(0)) - 1
    return F.when(df == 0, F.lit(True)).otherwise(chi <= F.when(df == 1, KINDS_PASS[0]).when(df == 2, KINDS_PASS[1]).otherwise(KINDS_PASS[2]))


def battery(tokens: Column) -> Column:
    """Each token with its encoding, n and `passes`. Runs on a column of array<struct<kind, start, end, value>>."""
    keep = lambda s: [s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")]
    total = lambda a, f: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + f(x))
    t = F.transform(tokens, lambda s: F.struct(*keep(s), F.regexp_replace(s["value"], "=+$", "").alias("body")))
    t = F.transform(t, lambda s: F.struct(*keep(s), s["body"].alias("body"), _choose([(p, F.lit(n)) for n, p, _ in ENCODINGS], s["body"]).alias("enc"), _choose([(p, F.lit(a)) for _, p, a in ENCODINGS], s["body"]).alias("abc")))
    carry = lambda s: [*keep(s), s["enc"].alias("enc"), s["k"].alias("k"), s["kinds"].alias("kinds"), s["v"].alias("v")]
    t = F.transform(t, lambda s: F.struct(*keep(s), s["enc"].alias("enc"), F.length(s["abc"]).cast("double").alias("k"), kinds_pass(s["body"], s["abc"]).alias("kinds"), F.transform(F.filter(F.split(s["body"], ""), lambda c: c != ""), lambda c: (F.call_function("locate", c, s["abc"]) - 1).cast("double")).alias("v")))
    t = F.transform(
        t,
        lambda s: F.struct(
            *carry(s),
            F.size(s["v"]).cast("double").alias("n"),
            (total(s["v"], lambda x: x) / F.size(s["v"])).alias("mean"),
            total(F.array_distinct(s["v"]), lambda x: F.pow(F.size(F.filter(s["v"], lambda y: y == x)).cast("double"), F.lit(2.0))).alias("squares"),
            total(s["v"], lambda x: F.when(x >= s["k"] / 2, F.lit(1.0)).otherwise(F.lit(0.0))).alias("above"),
            (1 + total(F.zip_with(F.slice(s["v"], 2, F.size(s["v"])), F.slice(s["v"], 1, F.size(s["v"]) - 1), lambda a, b: (a >= s["k"] / 2) != (b >= s["k"] / 2)), lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0)))).alias("runs"),
        ),
    )
    t = F.transform(
        t,
        lambda s: F.struct(
            *carry(s),
            s["n"].alias("n"),
            ((s["k"] / s["n"] * s["squares"] - s["n"] - (s["k"] - 1)) / F.sqrt(2 * (s["k"] - 1) * (s["n"] - 1) / s["n"])).alias("z_chi"),
            (2 * s["above"] * (s["n"] - s["above"]) / s["n"] + 1).alias("mu"),
            s["runs"].alias("runs"),
            total(s["v"], lambda x: (x - s["mean"]) * (x - s["mean"])).alias("ss"),
            total(F.zip_with(F.slice(s["v"], 2, F.size(s["v"])), F.slice(s["v"], 1, F.size(s["v"]) - 1), lambda a, b: (a - s["mean"]) * (b - s["mean"])), lambda x: x).alias("lagged"),
        ),
    )

    def passes(s: Column) -> Column:
        runs_ok = F.when((s["mu"] - 1) * (s["mu"] - 2) > 0, F.abs(s["runs"] - s["mu"]) <= Z_PASS * F.sqrt((s["mu"] - 1) * (s["mu"] - 2) / (s["n"] - 1))).otherwise(F.lit(False))
        serial_ok = F.when(s["ss"] > 0, F.abs(s["lagged"] / s["ss"] + 1 / s["n"]) * F.sqrt(s["n"]) <= Z_PASS).otherwise(F.lit(False))
        return s["kinds"] & (F.abs(s["z_chi"]) <= Z_PASS) & runs_ok & serial_ok

    return F.transform(t, lambda s: F.struct(*keep(s), s["enc"].alias("enc"), F.least(s["n"], F.lit(float(LONGEST))).cast("int").alias("n"), passes(s).alias("passes"), s["v"].alias("v")))


def accepted_classes(scanned: DataFrame) -> DataFrame:
    """One row with `accepted`, the "encoding:length" classes whose passing tokens are reported."""
    tokens = scanned.select(F.explode("tested").alias("x")).select("x.*")
    symbols = tokens.where("NOT passes").select("enc", F.explode("v").alias("c")).groupBy("enc", "c").agg(F.count(F.lit(1)).cast("double").alias("m"))
    size = F.create_map(*(x for n, _, a in ENCODINGS for x in (F.lit(n), F.lit(float(len(a))))))
    # Random tokens that fail by chance have all symbols alike. Where most tokens are random they are most of those that fail
    # and would hide what ordinary tokens fall short by, so as many of each symbol as they may hold are taken off.
    lucky = tokens.where("passes").groupBy("enc").agg(F.count(F.lit(1)).cast("double").alias("lucky"), F.avg(F.size("v")).alias("long"))
    failed = F.col("lucky") * (CHANCE / (1 - CHANCE))
    lucky = lucky.select("enc", ((failed + MARGIN * F.sqrt(failed)) * F.col("long") / size[F.col("enc")]).alias("each"))
    left = symbols.join(F.broadcast(lucky), "enc", "left").withColumn("rest", F.greatest(F.col("m") - F.coalesce("each", F.lit(0.0)), F.lit(0.0)))
    bits = lambda c: F.log2(F.sum(c)) - F.sum(F.when(F.col(c) > 0, F.col(c) * F.log2(c)).otherwise(0.0)) / F.sum(c)
    entropy = left.groupBy("enc").agg(bits("m").alias("all"), F.when(F.sum("rest") > 0, bits("rest")).alias("bits"))
    lacks = lambda c: F.greatest(F.log2(size[F.col("enc")]) - F.col(c), F.lit(0.0))
    # Where little is left, its symbols are few and seem to fall short by too much: what lies over all tokens that fail is held to SHORTFALL.
    short = entropy.select("enc", F.least(F.when(F.col("bits").isNotNull(), lacks("bits")).otherwise(SHORTFALL), F.greatest(lacks("all"), F.lit(SHORTFALL))).alias("d"))
    classes = tokens.groupBy("enc", "n").agg(F.count(F.lit(1)).alias("tested"), F.sum(F.col("passes").cast("long")).alias("passing"))
    p = classes.join(F.broadcast(short), "enc", "left").withColumn("p", F.pow(F.lit(2.0), -F.coalesce("d", F.lit(SHORTFALL)) * F.col("n")))
    # At most ten encodings times LONGEST lengths: these windows see a bounded table.
    up = p.where("passing > 0").select("enc", "n", "p", F.sum("passing").over(W.orderBy("p").rangeBetween(W.unboundedPreceding, 0)).alias("found"))
    m = classes.agg(F.coalesce(F.sum("tested"), F.lit(0)).alias("m"))
    cut = up.crossJoin(m).agg(F.max(F.when(F.col("p") <= RATE * F.col("found") / F.col("m"), F.col("p"))).alias("cut"))
    return up.crossJoin(cut).agg(F.coalesce(F.collect_list(F.when(F.col("p") <= F.col("cut"), F.concat_ws(":", "enc", "n"))), F.array()).alias("accepted"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """doc_id, base (array of spans of the fixed patterns) and spans (those and the random tokens), both by start, then kind.

    A token that overlaps a base span isn't reported twice. `keep` names further columns to carry. Defined results: a null
    text is empty and has no spans; repeated rows are scanned one by one; an empty table gives an empty result.
    """
    d = docs.select(F.col(id_col).alias("doc_id"), *(F.col(c).alias(f"keep_{i}") for i, c in enumerate(keep or [])), text_of(text_col).alias("t"))
    d = matches_with_places(d, "t", PATTERNS, CHECKS, GUARDS).drop("t")
    order = {k: i for i, k in enumerate([*BASE, "random"])}
    tagged = lambda a, k: F.transform(a, lambda s: F.struct(s["start"].alias("start"), F.lit(order[k]).alias("o"), s["end"].alias("end"), F.lit(k).alias("kind")))
    d = d.withColumn("base", F.sort_array(F.concat(*(tagged(F.col(k), k) for k in BASE))))
    d = d.withColumn("free", clear_of(F.col("random"), F.col("base"))).drop(*PATTERNS)
    # A very long token's test costs time in proportion to its distinct symbols only.
    d = written(d.withColumn("tested", battery(F.col("free"))).drop("free"))
    d = d.crossJoin(F.broadcast(accepted_classes(d)))
    random = F.filter("tested", lambda s: s["passes"] & F.array_contains(F.col("accepted"), F.concat_ws(":", s["enc"], s["n"])))
    d = d.withColumn("spans", F.sort_array(F.concat("base", tagged(random, "random"))))
    return d.select("doc_id", *(F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep or [])), "base", "spans")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each secret replaced by [SECRET]."""
    return masked_text(text, spans, lambda s: F.lit("[SECRET]"))


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """docs' rows with their secrets redacted; a column of the text's length follows the change, a null text stays null."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    d = scan(docs.toDF(*names), names[docs.columns.index(id_col)], text, keep=names)
    d = d.withColumn("__clean", F.when(F.col(text).isNull() | (F.size("spans") == 0), F.col(text)).otherwise(redacted(F.col(text), F.col("spans"))))
    length = F.when(F.col("__clean").isNotNull() & (F.size("spans") > 0), F.length("__clean"))
    out = []
    for n, f in zip(names, docs.schema, strict=True):
        new = F.col("__clean") if n == text else F.coalesce(length, F.col(n)).cast(f.dataType) if f.name == length_col else F.col(n)
        out.append(new.alias(f.name))
    return d.select(*out)


def op5_secret_scans(spark, sf_dir: str) -> DataFrame:
    d = scan(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return d.select("doc_id", *(count(k) for k in BASE), F.sha2(joined_spans(F.col("base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))
