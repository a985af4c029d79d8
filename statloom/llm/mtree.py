"""Exact top-k search by inner product with M-trees and best-first search.

Vectors are quantised to integers and equal ones become one entry with its smallest ids. They are dealt into trees of a
bounded number of entries. A tree consists of pages: an inner page has routing vectors with covering radius and distance
to the page's own routing vector, a leaf page has vectors with that distance. Pages are a stored table. For a query
``q`` no vector ``x`` within ``r`` of a routing vector ``c`` scores above ``<q,c> + |q| r``, and by the triangle
inequality ``<q,c>`` is at most ``<q,p> + |q| d(c,p)`` for the parent ``p``; so most entries are passed over by the
stored distances, before their own product is computed. A query takes its pages in the order of their bounds and stops
when the next bound is below its k-th score. Every block of queries meets every tree once.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statloom.llm.work import stored

_PAGE = ("tree int, node int, leaf boolean, dim int, entries binary, radius array<double>, parent array<double>, "
         "child array<int>, ids array<array<long>>")


@dataclass(frozen=True)
class SearchPlan:
    k: int = 10
    scale: int = 1024
    tree: int = 8192       # entries of a tree
    page: int = 1024       # entries of a leaf page
    fan: int = 8           # routing vectors that a page is split by
    block: int = 256       # queries searched together


def quantised(vectors: DataFrame, scale: int) -> DataFrame:
    """``vec_id, vector``: floor(scale * x) of each component; no rows of NULL ids, NULL or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return (vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.coalesce(bad, F.lit(True)))
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda v: F.floor(v * scale)).alias("vector")))


def _matrix(lists: pa.ChunkedArray, dim: int) -> np.ndarray:
    return lists.combine_chunks().flatten().to_numpy().reshape(len(lists), dim)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def build_pages(vectors: np.ndarray, ids: list, plan: SearchPlan, seed: int = 8) -> list[dict]:
    """The pages of one tree over distinct vectors, the root first; a page's first routing vector is its parent entry's."""
    exact, rng = vectors.astype(np.float64), np.random.Generator(np.random.PCG64(seed))
    pages: list[dict] = []
    work = [(np.arange(len(vectors)), exact[0], 0)]
    pages.append({})
    while work:
        members, center, node = work.pop()
        if len(members) <= plan.page:
            pages[node] = {"node": node, "leaf": True, "entries": vectors[members].tobytes(), "radius": None, "child": None,
                           "parent": _distances(exact[members], center).tolist(), "ids": [ids[m] for m in members]}
            continue
        routing = rng.choice(members, min(plan.fan, len(members)), replace=False)
        products = exact[members] @ exact[routing].T
        near = ((exact[routing] ** 2).sum(1) - 2 * products).argmin(1)
        routing = routing[np.unique(near)]
        near = np.unique(near, return_inverse=True)[1]
        if len(routing) == 1:  # nothing to tell them apart by; cut in two
            routing, near = np.append(routing, members[-1]), (np.arange(len(members)) * 2 // len(members))
        radius, child = [], []
        for n, r in enumerate(routing):
            part = members[near == n]
            radius.append(float(_distances(exact[part], exact[r]).max()))
            child.append(len(pages))
            pages.append({})
            work.append((part, exact[r], child[-1]))
        pages[node] = {"node": node, "leaf": False, "entries": vectors[routing].tobytes(), "radius": radius, "child": child,
                       "parent": _distances(exact[routing], center).tolist(), "ids": None}
    return pages


class Tree:
    """Pages of one tree, ready for search."""

    def __init__(self, pages: list[dict], dim: int):
        self.pages: dict[int, tuple] = {}
        for p in pages:
            whole = np.frombuffer(p["entries"], np.int64).reshape(-1, dim)
            exact = whole.astype(np.float64)
            greatest = math.sqrt(float((exact ** 2).sum(1).max(initial=0.0)))  # no product exceeds it times the query's
            self.pages[p["node"]] = (p["leaf"], whole, exact, greatest, np.array(p["parent"]),
                                     None if p["leaf"] else np.array(p["radius"]), p["child"], p["ids"])

    def search(self, query: np.ndarray, own: int, k: int) -> tuple[list[tuple[int, int]], int]:
        """The k best (score, id), ids other than ``own``; and how many products were computed."""
        q = query.astype(np.float64)
        length = math.sqrt(float(q @ q))
        slack = 1e-9 * (1.0 + length)         # rounding of bounds; scores are exact
        best: list[tuple[int, int]] = []      # heap of (score, -id), the worst first
        computed = 0
        queue = [(-math.inf, 0, math.inf)]    # bound, page, product with the page's routing vector
        while queue:
            bound, node, product = heapq.heappop(queue)
            worst = best[0][0] if len(best) == k else -math.inf
            if -bound < worst:
                break
            leaf, whole, exact, greatest, parent, radius, child, ids = self.pages[node]
            reach = parent if leaf else parent + radius
            limit = product + length * reach
            some = np.flatnonzero(limit + slack * (1.0 + reach) >= worst)
            if not len(some):
                continue
            computed += len(some)
            every = len(some) == len(exact)
            if leaf and length * greatest >= 2 ** 52:  # too large for exact products of floating-point numbers
                scores = (whole if every else whole[some]) @ query
            else:
                scores = (exact if every else exact[some]) @ q
            if leaf:
                able = np.flatnonzero(scores >= worst)
                for n in able[np.argsort(-scores[able], kind="stable")].tolist():
                    score = int(scores[n])
                    if len(best) == k and score < best[0][0]:
                        break
                    for i in ids[some[n]]:
                        if i == own:
                            continue
                        if len(best) < k:
                            heapq.heappush(best, (score, -i))
                        elif (score, -i) > best[0]:
                            heapq.heapreplace(best, (score, -i))
            else:
                bounds = scores + length * radius[some]
                bounds += slack * (1.0 + np.abs(bounds) + radius[some])
                for n in np.flatnonzero(bounds >= worst).tolist():
                    heapq.heappush(queue, (-float(bounds[n]), int(child[some[n]]), float(scores[n])))
        return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1])), computed


def build_index(entries: DataFrame, trees: int, plan: SearchPlan) -> DataFrame:
    """The stored pages of all trees, from ``vector, ids``; vectors of different lengths get trees of their own."""
    def run(table: pa.Table) -> pa.Table:
        tree, dim = table.column("tree")[0].as_py(), table.column("dim")[0].as_py()
        pages = build_pages(_matrix(table.column("vector"), dim), table.column("ids").to_pylist(), plan)
        return pa.Table.from_pylist([p | {"tree": tree, "dim": dim} for p in pages], schema)

    schema = pa.schema([("tree", pa.int32()), ("node", pa.int32()), ("leaf", pa.bool_()), ("dim", pa.int32()),
                        ("entries", pa.binary()), ("radius", pa.list_(pa.float64())), ("parent", pa.list_(pa.float64())),
                        ("child", pa.list_(pa.int32())), ("ids", pa.list_(pa.list_(pa.int64())))])
    dealt = entries.withColumn("tree", F.pmod(F.xxhash64("vector"), F.lit(trees)).cast("int"))
    return stored(dealt.groupBy("tree", "dim").applyInArrow(run, _PAGE), "pages")


def search(vectors: DataFrame, queries: DataFrame, plan: SearchPlan = SearchPlan()) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``plan.k`` best rows of ``vectors`` for each row of ``queries``.

    Both have ``vec_id, embedding``. The score is the inner product of the quantised vectors, ties go to the smaller
    vec_id, and rows with the query's own vec_id are left out. Rows without a vec_id, NULL vectors and vectors with NULL
    or non-finite components take no part; a row repeated with its vector counts once, a vec_id with several vectors has
    a row for each. Vectors meet those of their own length only. Fewer than k rows are all returned; without rows the
    result is empty. Scores must fit 64 bits.
    """
    given = quantised(vectors, plan.scale).distinct()
    smallest = F.row_number().over(W.partitionBy("vector").orderBy("vec_id"))
    entries = stored(given.withColumn("_n", smallest).filter(F.col("_n") <= plan.k + 1)
                     .groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
                     .withColumn("dim", F.size("vector")), "entries")
    asked = stored(quantised(queries, plan.scale).distinct(), "asked")
    trees = max(1, math.ceil(entries.count() / plan.tree))
    blocks = max(1, math.ceil(asked.count() / plan.block))
    pages = build_index(entries, trees, plan).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    wanted = (asked.withColumn("dim", F.size("vector"))
              .withColumn("block", F.pmod(F.xxhash64("vec_id", "vector"), F.lit(blocks)).cast("int"))
              .withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))))

    def run(held: pa.Table, asked_: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        if held.num_rows and asked_.num_rows:
            dim = held.column("dim")[0].as_py()
            tree = Tree(held.to_pylist(), dim)
            for own, query in zip(asked_.column("vec_id").to_pylist(), _matrix(asked_.column("vector"), dim)):
                found, _ = tree.search(query, own, plan.k)
                rows += [(own, query.tolist(), i, s) for s, i in found]
        columns = list(zip(*rows)) or [(), (), (), ()]
        kinds = [pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["query_id", "vector", "vec_id", "score"])

    keys = ["tree", "dim", "block"]
    found = (pages.groupBy(*keys).cogroup(wanted.groupBy(*keys))
             .applyInArrow(run, "query_id long, vector array<long>, vec_id long, score long"))
    order = W.partitionBy("query_id", "vector").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= plan.k)
            .select("query_id", "rank", "vec_id", "score"))
