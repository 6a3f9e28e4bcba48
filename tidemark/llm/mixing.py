"""Mixing sources to target weights by a min-cost flow over membership patterns.

Documents with the same set of sources form a pattern. Words flow from patterns to the sources they belong to, up to each
source's target. A pattern gives its size once for nothing and again at a rising cost, so repeats are spread evenly and
come only where words are short. The flow says how often a pattern's words are taken; documents are then chosen in a
seeded order, of which the last one of each pattern is taken in part so that the words meet the flow.

Targets come from running sums over the sources. Patterns that share no source, directly or over others, don't see each
other's flow, so each connected group of them is solved as a group of its own, wherever Spark puts it.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark import for_workers
from tidemark.llm.common import components, running_before, seeded, table, text_of, words_of, written

#: Weights of the sources in order, repeating; how often a document may be taken; the seed of the order.
WEIGHTS, REPEATS, SEED = (1, 2, 3), 3, "mix"


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """sources (source, source_size) with `target`: shares of the total size by weight; those above `repeats` times their own
    size stop there and the excess is shared again.

    Weights go round in the order of the sources' names, null last. Sources stop in the order of their limits over their
    weights, so with the k that come first stopped, the others' level follows from running sums; the first source that a
    level doesn't fill gives it. Sources, not documents, are put in order here.
    """
    d = sources.withColumn("n", F.row_number().over(W.orderBy(F.col("source").isNull(), "source")) - 1)
    d = d.withColumns({"weight": F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("n") % len(weights)).cast("int")), "most": (repeats * F.col("source_size")).cast("double")})
    before = W.orderBy(F.col("most") / F.col("weight"), "n").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumns({"stopped": F.coalesce(F.sum("most").over(before), F.lit(0.0)), "gone": F.coalesce(F.sum("weight").over(before), F.lit(0.0))})
    total = d.agg(F.sum("source_size").cast("double").alias("total"), F.sum("weight").alias("all"))
    d = d.crossJoin(F.broadcast(total)).withColumn("level", (F.col("total") - F.col("stopped")) / (F.col("all") - F.col("gone")))
    level = d.where(F.col("level") * F.col("weight") <= F.col("most")).agg(F.min_by("level", "gone").alias("last"))
    return d.crossJoin(F.broadcast(level)).select("source", "source_size", F.least(F.coalesce(F.col("last") * F.col("weight"), F.col("most")), F.col("most")).alias("target"))


def flow(patterns: list[tuple[tuple[int, ...], int]], quotas: list[int], repeats: int = REPEATS) -> list[int]:
    """Words to take from each pattern (its sources, its size).

    Only the arcs into patterns cost anything, and the k-th repeat costs more than the one before, so the cheapest
    augmenting path begins at a pattern in its lowest round: each round is opened only when the one before is used up.
    """
    taken = [0] * len(patterns)
    sent: list[dict[int, int]] = [dict.fromkeys(s, 0) for s, _ in patterns]
    into: dict[int, list[int]] = {}
    for p, (s, _) in enumerate(patterns):
        for x in s:
            into.setdefault(x, []).append(p)
    left = list(quotas)
    for k in range(1, repeats + 1):
        for p, (_, size) in enumerate(patterns):
            while taken[p] < k * size:
                came: dict[tuple[str, int], tuple[str, int] | None] = {("p", p): None}
                queue, end = deque([("p", p)]), None
                while queue and end is None:
                    kind, i = queue.popleft()
                    steps = [("s", x) for x in sent[i]] if kind == "p" else [("p", q) for q in into[i] if sent[q][i] > 0]
                    for step in steps:
                        if step not in came:
                            came[step] = (kind, i)
                            if step[0] == "s" and left[step[1]] > 0:
                                end = step
                                break
                            queue.append(step)
                if end is None:
                    break
                path = [end]
                while came[path[-1]] is not None:
                    path.append(came[path[-1]])
                path.reverse()
                back = [sent[b[1]][a[1]] for a, b in zip(path, path[1:], strict=False) if a[0] == "s"]
                amount = min([k * size - taken[p], left[end[1]], *back])
                for a, b in zip(path, path[1:], strict=False):
                    if a[0] == "p":
                        sent[a[1]][b[1]] += amount
                    else:
                        sent[b[1]][a[1]] -= amount
                taken[p] += amount
                left[end[1]] -= amount
    return taken


def name_of(source: Column) -> Column:
    """A number for a source; null is one too."""
    return F.xxhash64(source.isNull(), source)


def pattern_flows(sums: DataFrame, goals: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """(pattern, taken, source_size, target) of sums (pattern, sources, size): the words that the flow takes of each pattern, and the numbers of its first source."""
    for_workers(sums.sparkSession)
    each = sums.where(F.size("sources") > 0).select("pattern", "size", F.posexplode("sources").alias("i", "source")).withColumn("name", name_of(F.col("source")))
    each = each.join(goals.select(name_of(F.col("source")).alias("name"), "source_size", "target"), "name")
    rows = written(each.groupBy("pattern").agg(F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("i", "name", "target", "source_size"))).alias("s")))
    first = F.get("s", 0)
    shared = rows.where(F.size("s") > 1).select(first["name"].alias("a"), F.explode("s").alias("x")).select("a", F.col("x.name").alias("b"))
    rows = rows.withColumn("node", first["name"])
    if shared.limit(1).count():
        rows = rows.join(components(shared), "node", "left").withColumn("node", F.coalesce("label", "node"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pattern")
        quota = {x["name"]: int(x["target"]) for s in pdf["s"] for x in s}
        at = {n: k for k, n in enumerate(sorted(quota))}
        patterns = [(tuple(at[x["name"]] for x in s), int(size)) for s, size in zip(pdf["s"], pdf["size"], strict=True)]
        return pd.DataFrame({"pattern": pdf["pattern"], "taken": flow(patterns, [quota[n] for n in sorted(quota)], repeats), "source_size": [s[0]["source_size"] for s in pdf["s"]], "target": [s[0]["target"] for s in pdf["s"]]})

    return rows.select("node", "pattern", "size", "s").groupBy("node").applyInPandas(solve, "pattern string, taken long, source_size long, target double")


def mix(docs: DataFrame, sources: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, ...] = WEIGHTS, repeats: int = REPEATS, keep: list[str] | None = None) -> DataFrame:
    """`keep` columns, doc_id, text_hash, sources (sorted array), size, taken (words), copies (taken in whole documents, 0 to `repeats`) and the numbers of the document's first source.

    sources: an array column with the sources that a document belongs to; null entries are a source of their own, the
    last. Sources weigh `weights`, repeating, in code point order, and share the whole size. Defined results: a null text
    has size 0 and is taken 0 times, as has one without words; a document without a source is taken 0 times; identical
    rows are chosen one by one; of rows that tie in the seeded order any is as good; an empty table gives an empty result.
    """
    carried = [f"keep_{i}" for i in range(len(keep or []))]
    d = docs.select(*(F.col(c).alias(n) for c, n in zip(keep or [], carried, strict=True)), F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash"), F.sort_array(F.array_distinct(sources)).alias("sources"), F.size(words_of(text_of(text_col))).cast("long").alias("size"))
    d = d.withColumns({"pattern": F.to_json("sources"), "rows": F.lit(1).cast("long"), "part": F.lit(0)})
    if not carried:
        # Equal rows of a task become one with their number, so that a document that is there very often doesn't fill a cell.
        d = d.withColumn("part", F.spark_partition_id()).groupBy("doc_id", "text_hash", "sources", "size", "pattern", "part").agg(F.sum("rows").alias("rows"))
    d = written(d)
    sums = written(d.groupBy("pattern", "sources").agg(F.sum(F.col("size") * F.col("rows")).alias("size")))
    goals = written(targets(sums.select("size", F.explode("sources").alias("source")).groupBy("source").agg(F.sum("size").alias("source_size")), weights, repeats))
    plan = written(sums.select("pattern", F.col("size").alias("pattern_size")).join(pattern_flows(sums, goals, repeats), "pattern"))
    d = running_before(d.withColumns({"key": seeded(SEED, "doc_id", "text_hash"), "words": F.col("size") * F.col("rows")}), "pattern", "key", "words", ["doc_id", "text_hash", "part"])
    d = d.join(plan, "pattern", "left")
    if not carried:
        d = d.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1))).withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    d = d.withColumnRenamed("taken", "flows").withColumn("rounds", F.expr("CASE WHEN pattern_size > 0 THEN flows div pattern_size ELSE 0 END"))
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.coalesce(F.col("flows") - F.col("rounds") * F.col("pattern_size"), F.lit(0)) - F.col("before")))
    d = d.withColumn("taken", F.when(F.col("size") > 0, F.col("rounds") * F.col("size") + part).otherwise(0).cast("long"))
    copies = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("long")
    numbers = (F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"))
    return d.select(*carried, "doc_id", "text_hash", "sources", "size", *numbers, "taken", copies.alias("copies"))


def mixed(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs' rows as often as the mix takes them, each whole; rows that it doesn't take, or less than half of, go."""
    d = mix(docs, F.array(source_col), id_col, text_col, keep=docs.columns)
    d = d.where("copies > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return d.select(*(F.col(f"keep_{i}").alias(c) for i, c in enumerate(docs.columns)))


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    d = mix(table(spark, sf_dir, "documents"), F.array("source"))
    return d.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


#: Levels by the order in which sources reach their limit: with the k smallest ratios of limit to weight stopped, the rest share by weight.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, w) AS k FROM s),
l AS (SELECT a.k, ((SELECT sum(size) FROM d) - coalesce((SELECT sum(3 * source_size) FROM o b WHERE b.k < a.k), 0))::DOUBLE / (SELECT sum(w) FROM o b WHERE b.k >= a.k) AS level, a.source_size, a.w FROM o a),
z AS (SELECT level FROM l WHERE level * w <= 3 * source_size ORDER BY k LIMIT 1),
t AS (SELECT source, source_size, least(coalesce((SELECT level FROM z) * w, 3.0 * source_size), 3.0 * source_size)::DOUBLE AS target FROM s),
g AS (SELECT d.doc_id, d.size, t.source_size, t.target, floor(t.target)::BIGINT AS goal,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id), d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 4) AS target,
       CASE WHEN size = 0 THEN 0 ELSE size * (goal // source_size) + greatest(0, least(size, goal % source_size - before)) END::BIGINT AS taken
FROM g
"""
