"""A Merkle manifest of a table: a tree a source, a tree over the sources' roots, and each row's proof.

Trees are built bottom-up, one level at a time: a level is a written table of nodes, each with its children's digests, and
the next one groups them by their place divided by ARITY. Proofs are pushed top-down: each level joins its nodes to the
proofs that they inherit and hands every child the proof with the child's siblings in front. A group's place in a level is
arithmetic on row ranks, so no task orders a whole source.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from tidemark.llm.common import discard, table, written

ARITY = 3
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(*parts: Column) -> Column:
    """Lowercase hex sha256 of the strings, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    v = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-"))


def leaf_digest(columns: list[Column]) -> Column:
    return digest(*(encoded(c) for c in columns))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `pos`, the place from 0 in the group by `order`, and `n`, the group's size; a written table.

    Rows are dealt by ranges of (group, order) and numbered in each task; what lies before a task's part of a group is a
    sum over a table with a row for each group of each task. Rows that agree in all of these may swap places.
    """
    d = rows.withColumn("__tie", F.monotonically_increasing_id())
    d = d.repartitionByRange(group, *order, "__tie").sortWithinPartitions(group, *order)
    d = written(d.drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33)
    parts = d.groupBy(group, part.alias("__part")).agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__size"))
    before = W.partitionBy(group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(group, "__part", "__first", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__before"), F.sum("__size").over(W.partitionBy(group)).alias("n"))
    out = written(d.withColumn("__part", part).join(parts, [group, "__part"]).withColumn("pos", F.col("__at") - F.col("__first") + F.col("__before")).drop("__part", "__first", "__before", "__at"))
    discard(d)
    return out


@dataclass
class Tree:
    """Levels from the lowest inner one up: (grp, pos, digest, n, kids), n being the nodes of the group in that level; roots: (grp, root)."""

    levels: list[DataFrame] = field(default_factory=list)
    roots: DataFrame | None = None


def built(leaves: DataFrame) -> Tree:
    """The trees of leaves (grp, pos, digest, n), one a group. A group is done at the level where it has a single node."""
    tree, level, roots = Tree(), leaves, leaves.where("n = 1").select("grp", F.col("digest").alias("root"))
    while True:
        parent = F.floor(F.col("pos") / ARITY).alias("pos")
        kids = F.transform(F.array_sort(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])
        above = level.where("n > 1").groupBy("grp", parent).agg(kids.alias("kids"), F.ceil(F.first("n") / ARITY).alias("n"))
        above = written(above.select("grp", "pos", F.sha2(F.array_join("kids", ""), 256).alias("digest"), "n", "kids"))
        if not above.limit(1).count():
            discard(above)
            tree.roots = roots
            return tree
        tree.levels.append(above)
        roots = roots.unionByName(above.where("n = 1").select("grp", F.col("digest").alias("root")))
        level = above.select("grp", "pos", "digest", "n")


def siblings(kids: Column, i: Column) -> Column:
    """The digests left and right of child i, as strings."""
    return F.struct(F.array_join(F.slice(kids, 1, i), "").alias("left"), F.array_join(F.slice(kids, i + 2, ARITY), "").alias("right"))


def pushed(tree: Tree, top: DataFrame, leaves: DataFrame) -> DataFrame:
    """leaves (grp, pos, ...) with their `proof`: siblings by level from the leaf up, then their group's suffix in top (grp, proof).

    Groups of one leaf have no siblings of their own and keep the suffix.
    """
    arrived, held = None, []
    for level in reversed(tree.levels):
        own = level.where("n = 1").join(top, "grp").select("grp", "pos", "kids", "proof")
        here = own if arrived is None else own.unionByName(level.where("n > 1").select("grp", "pos", "kids").join(arrived, ["grp", "pos"]))
        if level is tree.levels[0]:
            d = leaves.withColumn("__parent", F.floor(F.col("pos") / ARITY)).withColumn("__child", (F.col("pos") % ARITY).cast("int"))
            here = here.withColumnRenamed("pos", "__parent")
            many = d.where("n > 1").join(here, ["grp", "__parent"])
            many = many.withColumn("proof", F.concat(F.array(siblings(F.col("kids"), F.col("__child"))), F.col("proof"))).drop("kids", "__parent", "__child")
            return leaves.where("n = 1").join(top, "grp").unionByName(many)
        children = here.select("grp", F.col("pos").alias("up"), "kids", "proof", F.posexplode("kids").alias("i", "x"))
        arrived = written(children.select("grp", (F.col("up") * ARITY + F.col("i")).alias("pos"), F.concat(F.array(siblings(F.col("kids"), F.col("i"))), F.col("proof")).alias("proof")))
        held.append(arrived)
    return leaves.join(top, "grp")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """H of all siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(docs: DataFrame, columns: list[str] | None = None, id_col: str = "doc_id", group_col: str = "source", altered: Column | None = None) -> DataFrame:
    """(doc_id, leaf, other_leaf, subroot, root, proof) of each row of docs; proof is an array of (left, right) from the leaf up.

    A leaf is the digest of `columns`; a group's leaves ascend by id, and rows with one id by leaf; ARITY neighbours become
    one node (a last run may hold fewer, even one) until a single node is left, the subroot; subroots in the order of their
    groups, null first, then by UTF-8 bytes, become the root in the same way. other_leaf is the digest with `altered` in
    place of the last column (default: as it is), to check a copy against the manifest with `folded`.

    Defined results: nulls count as nulls, not as empty; null ids come first; identical rows are leaves of their own, each
    with a proof (they may swap places, which changes nothing but which of them has which proof); an empty table gives an
    empty result; columns that aren't named aren't read; a table of one row has its leaf as root and an empty proof.
    """
    columns = columns or COLUMNS
    values = [F.col(c) for c in columns]
    # A null group sorts before every name, and an equi-join finds it.
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit("-"))
    other = leaf_digest([*values[:-1], altered]) if altered is not None else F.lit(None).cast("string")
    d = docs.select(group.alias("grp"), F.col(id_col).alias("doc_id"), leaf_digest(values).alias("digest"), other.alias("other_leaf"))
    leaves = ranked(d, "grp", ["doc_id", "digest"])
    tree = built(leaves)
    tops = ranked(tree.roots.select(F.lit("").alias("all"), "grp", F.col("root").alias("digest")), "all", ["grp"])
    tops = tops.withColumnRenamed("grp", "name").withColumnRenamed("all", "grp")
    upper = built(tops)
    none = F.array().cast("array<struct<left:string,right:string>>")
    top = pushed(upper, upper.roots.select("grp", none.alias("proof")), tops)
    top = written(top.join(upper.roots, "grp").select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "proof"))
    out = pushed(tree, top.select("grp", "proof"), leaves).join(top.select("grp", "subroot", "root"), "grp")
    return out.select("doc_id", F.col("digest").alias("leaf"), F.coalesce("other_leaf", "digest").alias("other_leaf"), "subroot", "root", "proof")


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    m = manifest(docs, altered=F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    again = folded(F.col("other_leaf"), F.col("proof"))
    m = m.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), again.alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


#: DuckDB has no crc32: bit by bit, with the reversed polynomial 0xEDB88320.
CRC = "xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(string_split(cast(doc_id AS varchar), ''), lambda c: ascii(c)::BIGINT)), lambda a, b: {steps}))"
STEP = "list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"

ORACLE = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, lang, n_chars, text,
    CASE WHEN {CRC.format(steps=STEP)} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS other
  FROM documents),
leaf AS (
  SELECT coalesce('=' || source, '-') AS g, doc_id,
    sha256(concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-'), coalesce(strlen(text) || ':' || text, '-'))) AS h,
    sha256(concat(coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-'), coalesce(strlen(source) || ':' || source, '-'), coalesce(strlen(lang) || ':' || lang, '-'), coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-'), coalesce(strlen(other) || ':' || other, '-'))) AS o
  FROM d),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS pos FROM leaf),
low AS (
  SELECT g, 0 AS k, list(h ORDER BY pos) AS x FROM placed GROUP BY g
  UNION ALL
  SELECT g, k + 1, list_transform(range(0, len(x), {ARITY}), lambda i: sha256(array_to_string(list_slice(x, i + 1, i + {ARITY}), ''))) FROM low WHERE len(x) > 1),
sub AS (SELECT g, k AS height, x[1] AS subroot, row_number() OVER (ORDER BY g) - 1 AS pos FROM low WHERE len(x) = 1),
high AS (
  SELECT 0 AS k, list(subroot ORDER BY pos) AS x FROM sub
  UNION ALL
  SELECT k + 1, list_transform(range(0, len(x), {ARITY}), lambda i: sha256(array_to_string(list_slice(x, i + 1, i + {ARITY}), ''))) FROM high WHERE len(x) > 1),
step AS (
  SELECT p.doc_id, l.k, l.x, p.pos // cast(pow({ARITY}, l.k) AS BIGINT) AS i FROM placed p JOIN low l USING (g) WHERE len(l.x) > 1
  UNION ALL
  SELECT p.doc_id, s.height + t.k, t.x, s.pos // cast(pow({ARITY}, t.k) AS BIGINT) FROM placed p JOIN sub s USING (g) CROSS JOIN high t WHERE len(t.x) > 1),
side AS (SELECT doc_id, k, array_to_string(list_slice(x, i - i % {ARITY} + 1, i), '') AS a, array_to_string(list_slice(x, i + 2, i - i % {ARITY} + {ARITY}), '') AS b FROM step),
proof AS (SELECT doc_id, list(a ORDER BY k) AS a, list(b ORDER BY k) AS b, string_agg(a || b, '' ORDER BY k) AS all_of FROM side GROUP BY doc_id),
fold AS (
  SELECT p.doc_id, 0 AS k, p.o AS h FROM placed p
  UNION ALL
  SELECT f.doc_id, f.k + 1, sha256(q.a[f.k + 1] || f.h || q.b[f.k + 1]) FROM fold f JOIN proof q USING (doc_id) WHERE f.k < len(q.a)),
folded AS (SELECT doc_id, arg_max(h, k) AS folded_root FROM fold GROUP BY doc_id)
SELECT p.doc_id, p.h AS leaf, s.subroot, r.root, sha256(coalesce(q.all_of, '')) AS proof_sha256, f.folded_root, f.folded_root = r.root AS verified
FROM placed p JOIN sub s USING (g) CROSS JOIN (SELECT x[1] AS root FROM high WHERE len(x) = 1) r LEFT JOIN proof q USING (doc_id) JOIN folded f USING (doc_id)
"""
