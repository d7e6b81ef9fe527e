"""Hard negatives: for an anchor and each of its positives, the best rows of other labels whose score is near the positive's.

Scores are inner products of integer vectors, so |s(child) - s(parent)| <= |child - parent| * |candidate| (Cauchy-Schwarz).
Neighbouring anchors share a part of at most PART rows, whose spanning tree (Prim's, of bounded depth, from the medoid) says for each
anchor its parent and the length of the edge. Candidates are dealt into blocks. Where a block meets a part, the root's scores
are computed for the whole block; going down the tree, a child's score of every candidate lies within its parent's
bounds plus or minus edge times norm, and only candidates whose bounds overlap what the anchor asks for are
scored: for positives those that can be among the best of its label, for negatives those that can be in one of its windows. A score
that is computed is a bound of no width for the anchors below.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, Window as W

from quire.llm.ann import Tree, _runs
from quire.plans.materialize import written

#: Rows of a block and anchors of a part at most; below that they follow the root of the rows. Depth of a spanning tree.
BLOCK, PART, DEPTH = 32_768, 2_048, 8
#: Anchors that the order of neighbourhoods is fitted on, and its leaves, at most. Every anchor is then placed; results do not depend on it.
SAMPLE, LEAVES = 4_096, 256
#: What rounding may add to a bound.
ROUND, LEAST = 1 + 1e-9, 1e-6


def spanning_tree(x: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge, level): rows of x with each parent before its children and subtrees together; parents as places in that order, -1 at the root."""
    m = len(x)
    squares = (x**2).sum(axis=1)
    apart = np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (x @ x.T), 0))
    root = int(apart.sum(axis=1).argmin())
    level, parent = np.full(m, -1), np.full(m, -1)
    level[root] = 0
    near, by = apart[root].copy(), np.full(m, root)
    near[root] = np.inf
    for _ in range(m - 1):
        k = int(near.argmin())
        parent[k], level[k], near[k] = by[k], level[by[k]] + 1, np.inf
        if level[k] < depth:
            closer = (level < 0) & (apart[k] < near)
            near[closer], by[closer] = apart[k][closer], k
    kids: list[list[int]] = [[] for _ in range(m)]
    for k in range(m):
        if k != root:
            kids[parent[k]].append(k)
    order, open_ = [], [root]
    while open_:
        k = open_.pop()
        order.append(k)
        open_ += reversed(kids[k])
    order = np.array(order)
    place = np.empty(m, np.int64)
    place[order] = np.arange(m)
    up = parent[order]
    edge = np.where(up >= 0, np.sqrt(((x[order] - x[np.maximum(up, 0)]) ** 2).sum(axis=1)), 0.0)
    return order, np.where(up >= 0, place[np.maximum(up, 0)], -1), edge, level[order]


def walk(points: np.ndarray, nodes: np.ndarray, parent: np.ndarray, edge: np.ndarray, level: np.ndarray, asks: Callable) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(node, rows, their scores) for each node of a tree: exactly the rows that asks(node, low, high) picks by their bounds."""
    norm = np.sqrt((points.astype(np.float64) ** 2).sum(axis=1))
    low: list = [None] * (int(level.max()) + 1)
    high: list = [None] * len(low)
    for k in range(len(nodes)):
        if parent[k] < 0:
            a = (points @ nodes[k]).astype(np.float64)
            low[0] = high[0] = a
            rows = asks(k, a, a)
            yield k, rows, points[rows] @ nodes[k]
            continue
        at = level[k]
        slack = edge[k] * ROUND * norm + LEAST
        a, b = low[at - 1] - slack, high[at - 1] + slack
        rows = asks(k, a, b)
        score = points[rows] @ nodes[k]
        a[rows] = b[rows] = score
        low[at], high[at] = a, b
        yield k, rows, score


def _matrix(rows: pd.Series, exact: bool) -> np.ndarray:
    """Vectors as rows; as doubles where all sums of products are whole numbers that a double holds."""
    return np.array([np.asarray(v) for v in rows], np.float64 if exact else np.int64)


def _first(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Where the k highest scores stand, ties to smaller ids."""
    some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k]) if len(score) > k else np.arange(len(score))
    return some[np.lexsort((ids[some], -score[some]))][:k]


def _met(rows: DataFrame, nodes: DataFrame, blocks: int, parts: int, of: Callable, schema: str) -> DataFrame:
    """of(block, part) for each of both that meet, every block and every part as a bounded group."""
    sent = rows.select("vec_id", "label", "v", F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(blocks)).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    asked = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return sent.groupBy("block", "part").cogroup(asked.groupBy("block", "part")).applyInPandas(of, schema)


def _prepared(left: pd.DataFrame, right: pd.DataFrame, exact: bool) -> tuple:
    left, right = left.sort_values(["label", "vec_id"]), right.sort_values("place")
    tree = tuple(right[c].to_numpy() for c in ("parent", "edge", "level"))
    return left["vec_id"].to_numpy(), left["label"].to_numpy(), _matrix(left["v"], exact), right["anchor_id"].to_numpy(), right["anchor_label"].to_numpy(), _matrix(right["q"], exact), tree


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, vec_id: str = "vec_id", label: str = "label", vector: str = "vector") -> DataFrame:
    """rows -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    `vector` holds integers; `anchors` picks the anchors. A score is the inner product with the anchor, higher ones first, ties to smaller
    vec_id. An anchor's positives are the first `positives` other rows of its label; a positive's negatives are the first `negatives` rows
    of other labels with low % of its score <= score <= high % of it; fewer are all. Rows without id or label, or with a vector that is
    null, holds null, or is of another length than most rows, take no part; rows that share a vec_id count as the least of them by label
    and vector. Other columns are left aside; an empty table, or one without anchors, gives an empty result. Vectors
    whose scores may exceed 63 bits are an error.
    """
    spark = rows.sparkSession
    base = rows.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"), F.col(f"`{vector}`").cast("array<long>").alias("v"), F.coalesce(anchors, F.lit(False)).alias("asks"))
    base = base.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull()))
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    widths = base.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.min(F.array_min("v")).alias("least")).orderBy(F.desc("n"), "w").first()
    if widths is None:
        return empty
    most = max(abs(widths["most"] or 0), abs(widths["least"] or 0))
    if most >= 1 << 31 or widths["w"] * most**2 >= 1 << 63:
        raise ValueError("scores of these vectors may exceed 63 bits")
    exact = widths["w"] * most**2 < 1 << 53
    least = base.where(F.size("v") == widths["w"]).groupBy("vec_id").agg(F.min(F.struct("label", "v", "asks")).alias("r"))
    points = written(least.select("vec_id", "r.label", F.col("r.v").cast("array<int>").alias("v"), "r.asks"), "points")
    n, m = points.agg(F.count("*"), F.count_if("asks")).first()
    if not m:
        return empty
    blocks = -(-n // min(BLOCK, max(512, int(8 * n**0.5))))
    nodes, parts = _parts(points.where("asks"), min(PART, max(64, int(n**0.5))), m)

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 3]
        if len(left) and len(right):
            ids, labels, x, anchor, own, q, tree = _prepared(left, right, exact)
            first, last = np.searchsorted(labels, own), np.searchsorted(labels, own, side="right")

            def asks(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
                same = np.arange(first[k], last[k])
                same = same[ids[same] != anchor[k]]
                if len(same) > positives:  # those that so many others surely exceed are left out
                    same = same[b[same] >= np.partition(a[same], len(same) - positives)[len(same) - positives]]
                return same

            for k, found, score in walk(x, q, *tree, asks):
                top = _first(score, ids[found], positives)
                out.append((np.full(len(top), anchor[k]), ids[found][top], score[top].astype(np.int64)))
        return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    rank = F.row_number().over(W.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id"))
    found = _met(points, nodes, blocks, parts, best, "anchor_id long, positive_id long, score long")
    found = written(found.withColumn("rank", rank).where(F.col("rank") <= positives), "positives")
    asked = found.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("score", "positive_id"))).alias("wanted"))  # at most `positives` each
    asked = nodes.join(asked, "anchor_id", "left").select("*")

    def near(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64),) * 4]
        if len(left) and len(right):
            ids, labels, x, anchor, own, q, tree = _prepared(left, right, exact)
            wanted = [[(r["positive_id"], r["score"], -(-low * r["score"] // 100), high * r["score"] // 100) for r in (w if w is not None else ())] for w in right.sort_values("place")["wanted"]]

            def asks(k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
                inside = np.zeros(len(a), bool)
                for _, _, lo, hi in wanted[k]:
                    inside |= (b >= lo) & (a <= hi)
                return np.flatnonzero(inside & (labels != own[k]))

            for k, found, score in walk(x, q, *tree, asks):
                for positive, its, lo, hi in wanted[k]:
                    some = np.flatnonzero((score >= lo) & (score <= hi))
                    top = some[_first(score[some], ids[found][some], negatives)]
                    out.append((np.full(len(top), anchor[k]), np.full(len(top), positive), ids[found][top], score[top].astype(np.int64)))
        return pd.DataFrame(dict(zip(("anchor_id", "positive_id", "negative_id", "negative_score"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    hard = _met(points, asked, blocks, parts, near, "anchor_id long, positive_id long, negative_id long, negative_score long")
    rank = F.row_number().over(W.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id"))
    hard = hard.withColumn("rank", rank.cast("int")).where(F.col("rank") <= negatives)
    return hard.join(found.select("anchor_id", "positive_id", F.col("score").alias("positive_score")), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _parts(anchors: DataFrame, most: int, m: int) -> tuple[DataFrame, int]:
    """(part, place, anchor_id, anchor_label, q, parent, edge, level): anchors by parts of neighbours, each with its spanning tree."""
    spark = anchors.sparkSession
    sample = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    tree = Tree(_matrix(sample, True), min(LEAVES, max(1, 2 * m // most)))

    @F.pandas_udf("int")
    def leaf_of(vs: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in vs:
            yield pd.Series(tree.assign(_matrix(s, True)) if len(s) else [], dtype="int32")

    placed = written(anchors.select("vec_id", "label", "v", leaf_of("v").alias("leaf")), "anchors")
    sizes = {r["leaf"]: r["n"] for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # a row a leaf
    runs = _runs(tree.neighbours(), sizes, most)
    of_leaf = F.broadcast(spark.createDataFrame([(leaf, *run) for leaf, run in runs.items()], "leaf int, first int, parts int"))
    part = (F.col("first") + F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("parts"))).cast("int")

    def spanned(some: pd.DataFrame) -> pd.DataFrame:
        some = some.sort_values("vec_id").reset_index(drop=True)
        order, parent, edge, level = spanning_tree(_matrix(some["v"], True))
        some = some.iloc[order]
        return pd.DataFrame({"part": some["part"].to_numpy(), "place": np.arange(len(some)), "anchor_id": some["vec_id"].to_numpy(), "anchor_label": some["label"].to_numpy(), "q": some["v"].to_list(), "parent": parent, "edge": edge, "level": level})

    schema = "part int, place int, anchor_id long, anchor_label long, q array<int>, parent int, edge double, level int"
    return written(placed.join(of_leaf, "leaf").select(part.alias("part"), "vec_id", "label", "v").groupBy("part").applyInPandas(spanned, schema), "trees"), max(first + parts for first, parts in runs.values())


SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score FROM v AS a JOIN v AS b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (SELECT p.*, s.other_id AS negative_id, s.score AS negative_score, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.other_id))::INT AS rank FROM p JOIN s USING (anchor_id) WHERE NOT s.same AND 80 * positive_score <= 100 * s.score AND s.score <= positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""
