"""Links between 64-bit fingerprints within a Hamming radius, found by the pigeonhole and verified, without pairing off large groups.

Candidates are cells: rows (cell, base, mask, fp, rep), where the members of a cell agree on `base` and on the bits of
`mask`, and rep is the smallest document id with that fingerprint. Permuted block tables keep blocks minus radius blocks
as a key, in every choice. The generalised pigeonhole groups correlated bits into partitions and gives each a threshold
of its own.

A cell is verified pair by pair while that costs less than splitting it. Otherwise its members can only differ in bits
outside the mask, so the pigeonhole is applied again to those: they are cut into blocks of which all but `radius` agree,
and every such choice is a smaller cell. Each level leaves a third of the open bits, so that after a few levels a cell has
few members, whatever the group's size: no row is compared with a whole group, and no link is lost.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bits_between, written

BITS = 64
#: A probe (a row that is dealt out) costs as much as so many comparisons inside a cell.
PROBE_COST = 4
#: Blocks that a level cuts the bits into, for each bit of the radius.
BLOCKS = 3


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def mask_of(bits) -> int:
    return signed(sum(1 << b for b in bits))


def masked(fp: Column, bits: list[int]) -> Column:
    return fp.bitwiseAND(F.lit(mask_of(bits)).cast("long"))


def celled(base: Column, mask: Column, fp: Column) -> Column:
    """The cell of a fingerprint. A hash that two cells share only brings more candidates."""
    return F.xxhash64(base, mask, fp.bitwiseAND(mask))


def blocks_at(level: int, blocks: int) -> list[list[int]]:
    """The bits in blocks that cut the blocks of each earlier level evenly: the digits of a bit's place, then seeded orders."""
    if blocks**level <= BITS * blocks:
        digit = [(b * blocks**level // BITS) % blocks for b in range(BITS)]
    else:
        order = np.random.default_rng(level).permutation(BITS)
        digit = [int(i) % blocks for i in order]
    return [[b for b in range(BITS) if digit[b] == k] for k in range(blocks)]


def links(cells: DataFrame, radius: int) -> DataFrame:
    """(a, b), in both orders, of all distinct fingerprints that share a cell and are within the radius."""
    blocks = BLOCKS * max(1, radius)
    kept = list(combinations(range(blocks), blocks - radius))
    cells = written(cells.select("cell", "base", "mask", "fp").distinct())
    found, level = None, 1
    while True:
        sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        sized = written(cells.join(sizes, "cell"))
        split = F.col("n") - 1 > 2 * PROBE_COST * len(kept)
        few = sized.where(~split).groupBy("cell").agg(F.collect_list("fp").alias("l"))
        pair = F.flatten(F.transform("l", lambda a: F.transform(F.filter("l", lambda b: (b != a) & (bits_between(a, b) <= radius)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
        pairs = few.select(F.explode(pair).alias("x")).select("x.a", "x.b")
        found = pairs if found is None else found.unionByName(pairs)
        large = sized.where(split)
        if not large.limit(1).count():
            return found.distinct()
        cut = blocks_at(level, blocks)
        masks = F.array(*(F.lit(mask_of(b for k in choice for b in cut[k])).cast("long") for choice in kept))
        wider = large.select("base", F.explode(F.transform(masks, lambda m: F.col("mask").bitwiseOR(m))).alias("mask"), "fp")
        cells = written(wider.select(celled(F.col("base"), F.col("mask"), F.col("fp")).alias("cell"), "base", "mask", "fp").distinct())
        level += 1


def block_tables(fps: DataFrame, radius: int = 2, blocks: int = 4) -> DataFrame:
    """Cells of the permuted block tables: fingerprints within the radius agree on blocks - radius whole blocks in at least one table."""
    width = BITS // blocks
    masks = F.array(*(F.lit(mask_of(b * width + i for b in kept for i in range(width))).cast("long") for kept in combinations(range(blocks), blocks - radius)))
    d = fps.select(F.lit(0).cast("long").alias("base"), F.explode(masks).alias("mask"), "fp")
    return d.select(celled(F.col("base"), F.col("mask"), F.col("fp")).alias("cell"), "base", "mask", "fp")


def bit_correlations(fps: DataFrame) -> tuple[np.ndarray, int]:
    """The 64 x 64 correlations of the bits over all fingerprints, and their number: 64 rows of 64 sums reach the driver."""
    at = F.explode(F.array(*(F.when(F.shiftrightunsigned("fp", i).bitwiseAND(F.lit(1)) == 1, F.lit(i)) for i in range(BITS)))).alias("i")
    sums = [F.sum(F.shiftrightunsigned("fp", j).bitwiseAND(F.lit(1))).alias(f"n{j}") for j in range(BITS)]
    both = np.zeros((BITS, BITS))
    for r in fps.select("fp", at).where("i IS NOT NULL").groupBy("i").agg(*sums).collect():
        both[r["i"]] = [r[f"n{j}"] for j in range(BITS)]
    n = max(1, fps.count())
    p = both.diagonal() / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(cov.diagonal(), 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = np.where(np.outer(sd, sd) > 0, cov / np.outer(sd, sd), 0)
    return np.dstack([r, np.broadcast_to(p, (BITS, BITS))]), n


def partitions(r: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` groups of about equal size: each is grown from the strongest pair left by the bit most correlated with it."""
    left, out, r = set(range(BITS)), [], np.abs(r)
    for k in range(parts):
        size = len(left) // (parts - k)
        a, b = max(combinations(sorted(left), 2), key=lambda x: r[x])
        group = [a, b]
        while len(group) < size:
            group.append(max(sorted(left - set(group)), key=lambda j: r[j, group].mean()))
        left -= set(group)
        out.append(sorted(group))
    return out


def thresholds(costs: list[list[float]], radius: int) -> tuple[float, list[int]] | None:
    """Thresholds t (-1: unused) of least total cost with sum(t + 1) = radius + 1, by dynamic programming; costs[i][t + 1] is that of partition i at t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for c in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for t in range(-1, radius + 1):
                k = used + t + 1
                if k <= radius + 1 and t + 1 < len(c) and (k not in after or total + c[t + 1] < after[k][0]):
                    after[k] = (total + c[t + 1], [*chosen, t])
        best = after
    return best.get(radius + 1)


def pigeonhole_plan(fps: DataFrame, radius: int) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each used partition, the cheapest over all numbers of partitions.

    The candidates at threshold 0 are counted over all fingerprints (the squares of the cell sizes); what comes on top at 1
    and 2 is estimated from each bit's share of ones. Both sides flip one bit, which meets a threshold of 1 and of 2 alike,
    at the same cost; thresholds of 3 would need more probes than they save and aren't offered.
    """
    stats, n = bit_correlations(fps)
    r, p = stats[:, :, 0], stats[0, :, 1]
    choices = []
    # One partition of all bits would be no pigeonhole, and one cell a row for each bit.
    for parts in range(max(2, -(-(radius + 1) // 3)), radius + 3):
        groups = partitions(r, parts)
        keys = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), masked(F.col("fp"), g).alias("key")) for i, g in enumerate(groups)))).alias("c")
        counted = {x["i"]: float(x["pairs"]) for x in fps.select(keys).groupBy("c").count().groupBy("c.i").agg(F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")).collect()}
        costs = []
        for i, g in enumerate(groups):
            differ = 2 * p[g] * (1 - p[g])
            odds = float((differ / np.maximum(1 - differ, 0.5)).sum())
            same = counted.get(i, 0.0)
            # Two keys share 1 + len(g) cells if they are equal, and two if they differ in one bit or in two. How many differ so
            # little follows from the bits' shares; copies, which make equal keys many, don't add to it.
            chance = float(n) * n * float((1 - differ).prod())
            flipped = PROBE_COST * n * (1 + len(g)) + same * (1 + len(g)) + chance * (2 * odds + odds * odds)
            costs.append([0.0, PROBE_COST * n + same, flipped, flipped])
        chosen = thresholds(costs, radius)
        if chosen:
            choices.append((chosen[0], parts, [(g, t) for g, t in zip(groups, chosen[1], strict=True) if t >= 0]))
    return min(choices, key=lambda x: x[:2])[2]


def pigeonhole_cells(fps: DataFrame, plan: list[tuple[list[int], int]], carry: list[str] | None = None) -> DataFrame:
    """Cells of the plan: a partition's bits as they are, and at a threshold of 1 or 2 also with each of them flipped. `carry` names further columns."""
    none, keys = F.lit(0).cast("long"), []
    for k, (bits, t) in enumerate(plan):
        if t == 0:
            keys.append(F.struct(none.alias("base"), F.lit(mask_of(bits)).cast("long").alias("mask")))
        else:
            own = masked(F.col("fp"), bits)
            flips = [F.lit(mask_of([b])).cast("long") for b in bits]
            keys += [F.struct(F.xxhash64(F.lit(k), own.bitwiseXOR(f)).alias("base"), none.alias("mask")) for f in [none, *flips]]
    d = fps.select(F.explode(F.array(*keys)).alias("x"), "fp", *(carry or [])).select("x.base", "x.mask", "fp", *(carry or []))
    return d.select(celled(F.col("base"), F.col("mask"), F.col("fp")).alias("cell"), "base", "mask", "fp", *(carry or []))
