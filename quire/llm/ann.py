"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample of vectors; every vector is then assigned to a leaf. A query walks
the tree best bin first: a priority queue holds unopened branches by their centre's distance, the nearest is
opened, and leaves come out in the order to visit. How many leaves a query visits is widened until the
measured recall of calibration queries, whose true neighbours are found by brute force, reaches TARGET.

Neighbouring leaves share a bin of at most BLOCK_ROWS rows (a larger leaf has several), and queries of neighbouring
leaves share a part of at most QUERY_ROWS queries. A bin is sent to those parts alone that visit one of its
leaves, and a query once to each bin that it visits.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.plans.materialize import written

#: Vectors that the tree is fitted on at most, children of a node, and calibration queries at most.
SAMPLE, BRANCH, CALIBRATION = 40_000, 12, 128
#: Leaves are this times the root of the rows, as far as the sample has LEAF_SAMPLE vectors for each.
LEAVES_ROOT, LEAF_SAMPLE = 4, 16
TARGET = 0.97
#: Rows of a bin, and queries of a part of the query set.
BLOCK_ROWS, QUERY_ROWS = 4_096, 4_096


class Tree:
    """Nested k-means: centres of each node's children; children are nodes or leaf numbers."""

    def __init__(self, points: np.ndarray, most: int, branch: int = BRANCH, leaf: int = LEAF_SAMPLE, seed: int = 5):
        self.nodes: list = []
        self.leaves = 0
        rng = np.random.default_rng(seed)
        # the largest part is split next, so the bound on leaves falls on small ones
        self.root = self._leaf()
        heap = [(-len(points), 0, None, 0, np.arange(len(points)))]
        count = 0
        while heap and self.leaves + branch - 1 <= most:
            size, _, parent, slot, rows = heapq.heappop(heap)
            if -size <= max(leaf, branch):
                break
            centres, own = _kmeans(points[rows], branch, rng)
            if len(centres) < 2:
                continue
            reuse = self.root if parent is None else self.nodes[parent][1][slot]
            kids = [reuse] + [self._leaf() for _ in range(len(centres) - 1)]
            self.nodes.append((centres, kids))
            at = len(self.nodes) - 1
            if parent is None:
                self.root = ~at
            else:
                self.nodes[parent][1][slot] = ~at
            for k in range(len(centres)):
                count += 1
                part = rows[own == k]
                heapq.heappush(heap, (-len(part), count, at, k, part))

    def _leaf(self) -> int:
        self.leaves += 1
        return self.leaves - 1

    def assign(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest centre at every level."""
        at = np.full(len(points), self.root)
        while (inner := at < 0).any():
            for node in np.unique(at[inner]):
                rows = np.flatnonzero(at == node)
                centres, kids = self.nodes[~node]
                at[rows] = np.array(kids)[_nearest(points[rows], centres)]
        return at

    def neighbours(self) -> list[int]:
        """All leaves in an order that keeps those of one branch together."""
        out, open_ = [], [self.root]
        while open_:
            at = open_.pop()
            if at >= 0:
                out.append(at)
            else:
                open_.extend(reversed(self.nodes[~at][1]))
        return out

    def order(self, query: np.ndarray, visits: int) -> list[int]:
        """The first `visits` leaves in best-bin-first order."""
        heap, out, n = [(0.0, 0, self.root)], [], 0
        while heap and len(out) < visits:
            _, _, at = heapq.heappop(heap)
            if at >= 0:
                out.append(at)
                continue
            centres, kids = self.nodes[~at]
            for d, kid in zip(((centres - query) ** 2).sum(axis=1).tolist(), kids, strict=True):
                n += 1
                heapq.heappush(heap, (d, n, kid))
        return out


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([np.argmin(half - points[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(points), 4096)]) if len(points) else np.zeros(0, int)


def _kmeans(points: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """At most k distinct centres and each point's nearest; fewer where points coincide."""
    centres = np.unique(points[rng.choice(len(points), min(k, len(points)), replace=False)], axis=0)
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        n = np.bincount(own, minlength=len(centres))
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    centres = np.unique(centres, axis=0)
    own = _nearest(points, centres)
    used = np.unique(own)
    return centres[used], np.searchsorted(used, own)


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def _matrix(rows) -> np.ndarray:
    return np.array([np.asarray(v, np.float64) for v in rows])


def _distances(points: np.ndarray, q: np.ndarray) -> np.ndarray:
    apart = points - q
    d = np.sqrt((apart**2).sum(axis=1))
    if not np.isfinite(d).all():  # squares that overflow are taken of scaled differences
        most = np.abs(apart).max(axis=1, keepdims=True)
        with np.errstate(all="ignore"):
            d = np.where(np.isfinite(d), d, most[:, 0] * np.sqrt(((apart / most) ** 2).sum(axis=1)))
    return d


def _least(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Where the k least distances stand, ties to smaller ids."""
    some = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]) if len(d) > k else np.arange(len(d))
    return some[np.lexsort((ids[some], d[some]))][:k]


def _runs(order: list[int], sizes: dict[int, int], most: int) -> dict[int, tuple[int, int]]:
    """leaf -> (first group, groups): leaves in order fill groups of at most `most` rows; a leaf with more has groups of its own."""
    out, at, held = {}, 0, 0
    for leaf in order:
        n = sizes.get(leaf, 0)
        if held and held + n > most:
            at, held = at + 1, 0
        out[leaf] = (at, max(1, -(-n // most)))
        held += n
        if n > most:
            at, held = at + out[leaf][1], 0
    return out


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of partial results, with rank; each task drops what cannot be among them before rows move."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _scan(binned: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """binned(bin, leaf, vec_id, v) and visits(part, query_id, q, bin, leaves): bins meet the parts that visit them, both bounded."""

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(left) and len(right):
            ids, x, leaf = left["vec_id"].to_numpy(), _matrix(left["v"]), left["leaf"].to_numpy()
            by_leaf = {n: np.flatnonzero(leaf == n) for n in np.unique(leaf).tolist()}
            for qid, q, leaves in zip(right["query_id"], _matrix(right["q"]), right["leaves"], strict=True):
                rows = np.concatenate([np.zeros(0, np.int64), *[by_leaf[n] for n in leaves if n in by_leaf]])
                rows = rows[ids[rows] != qid]
                d = _distances(x[rows], q) if len(rows) else np.zeros(0)
                best = _least(ids[rows], d, k)
                out.append((np.full(len(best), qid), ids[rows][best], d[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    asked = visits.select(F.col("bin").alias("to"), F.col("part").alias("by")).distinct()
    sent = binned.join(asked, F.col("bin") == F.col("to")).select("bin", F.col("by").alias("part"), "leaf", "vec_id", "v")
    return sent.groupBy("bin", "part").cogroup(visits.groupBy("bin", "part")).applyInPandas(meet, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", target: float = TARGET) -> tuple[DataFrame, dict]:
    """(query_id, rank, vec_id, score) of the rows that `queries` picks against all rows but their own, and the calibration report.

    Rows without id, or with a vector that is null, empty, zero, of another length than most rows, or with null or
    non-finite components take no part. Repeated vectors are all candidates. Ties go to the smaller vec_id. A query with
    fewer than k candidates gets all. Scores are exact Euclidean distances in double precision (infinite where a double cannot hold them). Empty tables give empty results.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    widths = rows.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if widths is None:
        return empty, {"rows": 0}
    rows, n = rows.where(F.size("v") == widths["w"]), widths["count"]
    most = max(BRANCH, min(int(LEAVES_ROOT * n**0.5), SAMPLE // LEAF_SAMPLE))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(n, most * LEAF_SAMPLE)).select("v").toArrow()["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    tree = Tree(sample.reshape(-1, widths["w"]), most)

    @F.pandas_udf("int")
    def leaf_of(vs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vs:
            yield pd.Series(tree.assign(_matrix(s)) if len(s) else [], dtype="int32")

    index = written(rows.select("vec_id", "v", "asks", leaf_of("v").alias("leaf")), "leaves")
    counts = index.groupBy("leaf").agg(F.count("*").alias("n"), F.count_if("asks").alias("m")).collect()  # a row a leaf
    leaves = tree.neighbours()
    bins, parts = _runs(leaves, {r["leaf"]: r["n"] for r in counts}, BLOCK_ROWS), _runs(leaves, {r["leaf"]: r["m"] for r in counts}, QUERY_ROWS)
    filled = {r["leaf"] for r in counts}
    places = F.broadcast(spark.createDataFrame([(leaf, *bins[leaf], *parts[leaf]) for leaf in leaves], "leaf int, bin int, bins int, part int, parts int"))
    placed = index.join(places, "leaf")

    def spread(first: str, many: str, seed: int) -> Column:
        return (F.col(first) + F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.col(many))).cast("int")

    binned = placed.select("vec_id", "v", "leaf", spread("bin", "bins", 3).alias("bin"))
    asked = placed.where("asks").select("vec_id", "v", spread("part", "parts", 5).alias("part"))

    def visits_of(asked: DataFrame, visits: int) -> DataFrame:
        @F.pandas_udf("array<struct<bin:int,leaves:array<int>>>")
        def walk(vs: pd.Series) -> pd.Series:
            out = []
            for v in vs:
                by: dict[int, list[int]] = {}
                for leaf in tree.order(np.asarray(v, np.float64), visits):
                    first, many = bins[leaf]
                    for b in range(first, first + many) if leaf in filled else ():
                        by.setdefault(b, []).append(leaf)
                out.append([{"bin": b, "leaves": found} for b, found in by.items()])
            return pd.Series(out)

        seen = asked.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q"), "part", F.explode(walk("v")).alias("s")).select("part", "query_id", "q", "s.bin", "s.leaves")
        return written(seen, "visits")

    probe = written(asked.orderBy(F.xxhash64("vec_id", F.lit(9)), "vec_id").limit(CALIBRATION), "calibration")

    @F.pandas_udf("array<struct<turn:int,leaf:int>>")
    def turns_of(vs: pd.Series) -> pd.Series:
        return pd.Series([[{"turn": i, "leaf": leaf} for i, leaf in enumerate(tree.order(np.asarray(v, np.float64), tree.leaves))] for v in vs])

    # every leaf for the calibration queries: brute force, each hit with the turn at which its leaf came
    truth = _best(_scan(binned, visits_of(probe, tree.leaves), k), k)
    turns = probe.select(F.col("vec_id").alias("query_id"), F.explode(turns_of("v")).alias("t")).select("query_id", "t.turn", "t.leaf").distinct()
    hits = truth.join(index.select("vec_id", "leaf").distinct(), "vec_id").join(turns, ["query_id", "leaf"]).groupBy("turn").count().orderBy("turn").collect()
    total, seen, visits = sum(r["count"] for r in hits), 0, 1
    for r in hits:
        if seen >= target * total:
            break
        seen, visits = seen + r["count"], r["turn"] + 1
    return _best(_scan(binned, visits_of(asked, visits), k), k), {"rows": n, "leaves": tree.leaves, "visits": visits, "recall": seen / max(1, total)}
