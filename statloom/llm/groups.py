"""Links inside overlapping groups of sets, without pairs of members.

Given groups of sets, in which any two linked sets meet at least once, ``linked`` finds which sets links bring
together. Every member of a group is compared on the full sets to one head, the group's smallest set, and confirmed links
are merged into components. Two members of a head that are still apart can't both be in the head's component; one of
them, a probe, is too far from the head. All members of a head are known by their differences from it, ``m`` shingles
missing and ``a`` added. For two of them with ``s`` differences in common,

    |x & y| = |h| - m(x) - m(y) + s,   so x, y are linked if and only if
    (100 + percent) * s >= w(x) + w(y) - (100 - percent) * |h|   with   w = 100 * m + percent * a

and w > (100 - percent) * |h| for a probe: it can only be linked to what has differences in common with it, and the least
number of them follows from the weights. A head with few members is finished in one task, by counting common
differences as a product of matrices. The members of a larger one are dealt into new groups by their differences, each
to as many of the rarest as the least number allows for; those groups have heads of their own, and so on. A new group
lacks at least its old head. Members of a passage that many texts have, or of a large family of copies, thus meet only
where they have something rarer in common. What is left after ``LEVELS`` rounds is compared block by block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.llm.components import components
from statloom.llm.work import stored

BLOCK = 1024         # members of a head compared to as many others in one task
CELLS = 4_000_000    # and their differences, at most
DIRECT = 4           # blocks of a head that are all compared to each other
COLUMNS = 4096       # differences counted at once
LEVELS = 8


def _stars(members: DataFrame) -> DataFrame:
    """``head, id`` for every member of a group with others, once for each of its heads."""
    heads = (members.groupBy("key").agg(F.min(F.struct("n", "id")).alias("_head"), F.count(F.lit(1)).alias("_members"))
             .filter("_members > 1").select("key", F.col("_head.id").alias("head")))
    return members.join(heads, "key").filter("id != head").select("head", "id").distinct()


def _compared(stars: DataFrame, sets: DataFrame) -> DataFrame:
    """Stars with the sizes of both sets and of what they have in common."""
    of_head = sets.select(F.col("id").alias("head"), F.col("shingles").alias("_head"))
    of_member = sets.select("id", F.col("shingles").alias("_own"))
    return (stars.join(of_member, "id").join(of_head, "head")
            .select("head", "id", F.size("_head").alias("n_head"), F.size("_own").alias("n"),
                    F.size(F.array_intersect("_head", "_own")).alias("common")))


def similar(common: Column, one: Column, other: Column, percent: int) -> Column:
    return common.cast("long") * 100 >= (one + other - common).cast("long") * percent


def _joined_roots(block_ends: np.ndarray, met: np.ndarray, pairs: int) -> list[np.ndarray]:
    """Of linked roots, each component once, tied to its first."""
    near = np.zeros((len(met), len(met)), bool)
    near[block_ends[:pairs], block_ends[pairs:]] = True
    near |= near.T
    out, left = [], np.ones(len(met), bool)
    while left.any():  # everything that the first one left reaches
        start = int(left.argmax())
        reached, edge = np.zeros(len(met), bool), np.array([start])
        reached[start] = True
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & ~reached)
            reached[edge] = True
        left &= ~reached
        others = reached & (np.arange(len(met)) != start)
        out.append(np.stack([np.full(int(others.sum()), met[start]), met[others]], 1))
    return out


def _block_links(table: pa.Table, percent: int) -> pa.Table:
    """Compares the probes of one block with the members of another, of the same head. Of the components that turn out
    linked, directly or by others, each is given once, tied to the first."""
    first, second = table.column("first")[0].as_py(), table.column("second")[0].as_py()
    block, probe = table.column("block").to_numpy(), table.column("probe").to_numpy(zero_copy_only=False)
    one, other = np.flatnonzero(probe & (block == first)), np.flatnonzero(block == second)
    ids, root, n = (table.column(c).to_numpy() for c in ("id", "root", "n"))
    differences = table.column("differences").combine_chunks()
    lengths = np.diff(differences.offsets.to_numpy())
    row = np.repeat(np.arange(len(ids)), lengths)
    _, key, times = np.unique(differences.flatten().to_numpy(), return_inverse=True, return_counts=True)
    several = times[key] > 1
    row, key = row[several], np.unique(key[several], return_inverse=True)[1]
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    shared = np.zeros((len(one), len(other)), np.float32)
    for low in range(0, int(key[-1]) + 1 if len(key) else 0, COLUMNS):
        a, b = np.searchsorted(key, [low, low + COLUMNS])
        held = np.zeros((len(ids), COLUMNS), np.float32)
        held[row[a:b], key[a:b] - low] = 1
        shared += held[one] @ held[other].T
    missing = table.column("missing").to_numpy()
    common = table.column("n_head")[0].as_py() - missing[one][:, None] - missing[other][None, :] + np.rint(shared).astype(np.int64)
    union = n[one].astype(np.int64)[:, None] + n[other][None, :] - common
    linked_ = (100 * common >= percent * union) & (root[one][:, None] != root[other][None, :])
    x, y = np.nonzero(linked_)
    met, ends = np.unique(np.concatenate([root[one][x], root[other][y]]), return_inverse=True)
    links = np.concatenate([np.zeros((0, 2), np.int64), *_joined_roots(ends, met, len(x))]).astype(np.int64)
    return pa.table({"a": links[:, 0], "b": links[:, 1]}, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))


def _dealt(compared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of the heads that have probes and at least two members, with roots and the size of their head's group."""
    def rooted(df: DataFrame, column: str, name: str) -> DataFrame:
        return (df.join(roots.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left")
                .withColumn(name, F.coalesce("_root", column)).drop("_root"))

    members = rooted(rooted(compared, "id", "root"), "head", "_of_head")
    members = members.withColumn("probe", F.col("root") != F.col("_of_head")).drop("_of_head")
    members = stored(members.withColumn("missing", (F.col("n_head") - F.col("common")).cast("long"))
                     .withColumn("added", (F.col("n") - F.col("common")).cast("long")), "members")
    asked = (members.groupBy("head").agg(
        F.count(F.lit(1)).alias("members"), F.max("probe").alias("_asked"), F.sum(F.col("missing") + F.col("added")).alias("cells"))
        .filter("_asked and members > 1").drop("_asked"))
    return members.join(asked, "head")


def _differences(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """``dealt`` with the arrays of missing and added shingles together; a shingle is only ever one or the other."""
    of_head = sets.select(F.col("id").alias("head"), F.col("shingles").alias("_head"))
    of_member = sets.select("id", F.col("shingles").alias("_own"))
    return (dealt.join(of_member, "id").join(of_head, "head")
            .withColumn("differences", F.concat(F.array_except("_head", "_own"), F.array_except("_own", "_head")))
            .drop("_head", "_own"))


def _finished(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links of probes to any member of the same head, in blocks of bounded size."""
    blocks = F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("cells") / CELLS), F.lit(1)).cast("int")
    placed = dealt.withColumn("_blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("_blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("_blocks") - 1)
    as_member = F.transform(every, lambda b: F.struct(b.alias("first"), F.col("block").alias("second")))
    others = F.filter(every, lambda b: b != F.col("block"))
    as_probe = F.transform(F.when(F.col("probe"), others).otherwise(F.array().cast("array<int>")),
                           lambda b: F.struct(F.col("block").alias("first"), b.alias("second")))
    given = (_differences(placed, sets)
             .select("head", "id", "root", "probe", "block", "n", "n_head", "missing", "differences",
                     F.explode(F.concat(as_member, as_probe)).alias("_at"))
             .select("*", "_at.first", "_at.second").drop("_at"))
    return given.groupBy("head", "first", "second").applyInArrow(lambda table: _block_links(table, percent), "a long, b long")


def _regrouped(dealt: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``key, id, n``: new groups of the members of large heads, by their rarest common differences.

    Pairs of probes meet in groups of one kind, probes and the other members in those of another kind, as different
    numbers of common differences are needed.
    """
    weight = 100 * F.col("missing") + percent * F.col("added")
    weighed = dealt.withColumn("w", weight)
    least = weighed.groupBy("head").agg(F.min(F.when(F.col("probe"), F.col("w"))).alias("_of_probes"),
                                        F.min(F.when(~F.col("probe"), F.col("w"))).alias("_of_others"))
    own = stored(_differences(weighed, sets)
                 .select("head", "id", "n", "n_head", "probe", "w", F.explode("differences").alias("d")), "differences")
    held = (own.groupBy("head", "d").agg(F.count(F.when(F.col("probe"), 1)).alias("_probes"),
                                         F.count(F.when(~F.col("probe"), 1)).alias("_others"))
            .filter("_probes >= 2 or (_probes >= 1 and _others >= 1)"))
    sorted_ = lambda number, when: F.sort_array(F.collect_list(F.when(when, F.struct(number.alias("c"), F.col("d")))))
    lists = (own.join(held, ["head", "d"]).groupBy("head", "id", "n", "n_head", "probe", "w")
             .agg(sorted_(F.col("_probes"), F.col("probe") & (F.col("_probes") >= 2)).alias("_among"),
                  sorted_(F.col("_probes") + F.col("_others"), F.col("_others") >= 1).alias("_across"))
             .join(least, "head"))

    def wanted(kind: int, found: str, partner: Column) -> Column:
        """The rarest differences of which a partner of at least that weight must have one; none without a partner."""
        needed = F.ceil((F.col("w") + partner - (100 - percent) * F.col("n_head")) / (100 + percent))
        length = F.size(found) - F.greatest(needed, F.lit(1)) + 1
        some = F.slice(F.col(found), 1, F.greatest(F.coalesce(length, F.lit(0)), F.lit(0)).cast("int"))
        return F.transform(some, lambda x: F.xxhash64(F.lit(kind), F.col("head"), x["d"]))

    among = F.when(F.col("probe"), wanted(1, "_among", F.col("_of_probes"))).otherwise(F.array().cast("array<long>"))
    across = wanted(2, "_across", F.when(F.col("probe"), F.col("_of_others")).otherwise(F.col("_of_probes")))
    return lists.select(F.explode(F.concat(among, across)).alias("key"), "id", "n")


def linked(members: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """``node, root`` of all sets that are linked to another, directly or by others: a root per component.

    ``members`` has ``key, id, n``: the groups of each set and its size. ``sets_of`` gives ``id, shingles`` of wanted
    ``id``s. Two sets are linked if ``percent`` of their union is common.
    """
    stars = stored(_stars(members), "stars")
    sets = stored(sets_of(stars.select("id").unionAll(stars.select(F.col("head").alias("id"))).distinct()), "sets")
    links, roots, level = None, None, 0
    while True:
        compared = stored(_compared(stars, sets), "compared")
        new = compared.filter(similar(F.col("common"), F.col("n"), F.col("n_head"), percent)).select(
            F.col("id").alias("a"), F.col("head").alias("b"))
        if links is None or not new.isEmpty():
            links = new if links is None else links.unionAll(new)
            roots = components(links)
        dealt = stored(_dealt(compared, roots), "dealt")
        large = (F.col("members") > DIRECT * BLOCK) | (F.col("cells") > DIRECT * CELLS)
        small = dealt if level == LEVELS else dealt.filter(~large)
        more = stored(_finished(small, sets, percent), "probed")
        if not more.isEmpty():
            links = links.unionAll(more)
            roots = components(links)
        if level == LEVELS or dealt.filter(large).isEmpty():
            return roots
        stars = stored(_stars(stored(_regrouped(dealt.filter(large), sets, percent), "regrouped")), "stars")
        level += 1
