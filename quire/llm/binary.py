"""Exact top-k search over binary codes by incremental multi-index hashing.

Blocks of codes meet parts of the queries, both of bounded size, and each meeting is one index. Its codes are cut into m segments of
about log2(n) bits, each indexed by its value. Round r looks up all segment
values that differ from the query's in exactly r bits, in the first a segments that the query still needs. Any code not met
by then differs in more than r bits of those a segments and in at least r of the others, so by at least m r + a bits in all; a
query is done when its kth verified distance is below that, and a is chosen so that it just will be, if a <= m suffices. A code is
taken in the first round and segment that meet it, which its bits tell, so none is met twice, and only if it is no farther than the kth so far.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quire.plans.materialize import written


#: Masks, and probes or candidates, that a task holds at once.
RUN, HELD = 1 << 14, 1 << 18
#: Codes of a block, and queries of a part of the query set.
BLOCK_ROWS, QUERY_ROWS = 1 << 17, 1 << 12


def sign_code(vector: Column, bits: int = 64) -> Column:
    """A long whose bit i is set if component i is above zero; null if the vector is null, of another length, or holds null or NaN."""
    sound = (F.size(vector) == bits) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    parts = [F.when(F.get(vector, F.lit(i)) > 0, F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0)) for i in range(bits)]
    code = parts[0].cast("long")
    for p in parts[1:]:
        code = code.bitwiseOR(p.cast("long"))
    return F.when(sound, code)


def _segments(n: int, bits: int) -> list[tuple[int, int]]:
    """(first bit, length) of segments of about log2(n) bits."""
    m = max(1, min(bits, math.ceil(bits / max(1.0, math.log2(max(2, n))))))
    edges = [bits * i // m for i in range(m + 1)]
    return list(zip(edges, (b - a for a, b in zip(edges, edges[1:], strict=False)), strict=False))


def _masks(length: int, ones: int) -> Iterator[np.ndarray]:
    """All numbers of `length` bits of which `ones` are set, in runs of at most RUN."""
    every = combinations(range(length), ones)
    while some := list(islice(every, RUN)):
        yield (np.uint64(1) << np.array(some, np.uint64)).sum(axis=1, dtype=np.uint64) if ones else np.zeros(1, np.uint64)


class _Index:
    """The codes of a block, by the value of each of their segments."""

    def __init__(self, codes: np.ndarray, bits: int):
        self.codes, self.cuts = codes, _segments(len(codes), bits)
        self.rows, self.starts = [], []
        for s in range(len(self.cuts)):
            value = self.part(codes, s)
            order = np.argsort(value, kind="stable")
            self.rows.append(order)
            self.starts.append(np.searchsorted(value[order], np.arange((1 << self.cuts[s][1]) + 1, dtype=np.uint64)))

    def part(self, codes: np.ndarray, s: int) -> np.ndarray:
        at, length = self.cuts[s]
        return (codes >> np.uint64(at)) & np.uint64((1 << length) - 1)

    def meet(self, codes: np.ndarray, s: int, ones: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(numbers of the given codes, rows) of which segment s differs in `ones` bits, a bounded run at a time."""
        value, starts, rows = self.part(codes, s), self.starts[s], self.rows[s]
        for masks in _masks(self.cuts[s][1], ones):
            step = max(1, HELD // len(masks))
            for lo in range(0, len(codes), step):
                probe = (value[lo : lo + step, None] ^ masks[None, :]).ravel().astype(np.int64)
                first, n = starts[probe], starts[probe + 1] - starts[probe]
                some = np.flatnonzero(n)
                first, n, ends = first[some], n[some], np.cumsum(n[some])
                at = 0
                while at < len(some):  # a probe meets no more rows than a block has
                    to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, side="right")))
                    many, before = n[at:to], ends[at:to] - n[at:to]
                    place = np.arange(before[0], ends[to - 1]) + np.repeat(first[at:to] - before, many)
                    yield lo + np.repeat(some[at:to] // len(masks), many), rows[place]
                    at = to

    def first_met(self, apart: np.ndarray, s: int, ones: int) -> np.ndarray:
        """Of pairs that differ in the bits `apart`: whether segment s is the first of those that differ in the fewest bits, which are `ones`."""
        met = np.bitwise_count(self.part(apart, s)) == ones
        for other in range(len(self.cuts)):
            if other != s:
                n = np.bitwise_count(self.part(apart, other))
                met &= n > ones if other < s else n >= ones
        return met


def _best(query: np.ndarray, distance: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest rows of each query, ties to smaller ids, in order."""
    order = np.lexsort((ids, distance, query))
    query = query[order]
    new = np.ones(len(query), bool)
    new[1:] = query[1:] != query[:-1]
    every = np.arange(len(query))
    kept = every - np.maximum.accumulate(np.where(new, every, 0)) < k
    return query[kept], distance[order][kept], ids[order][kept]


def nearest(codes: np.ndarray, ids: np.ndarray, asked: np.ndarray, k: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(number of the query, distance, id) of the k codes nearest to each of the asked-for ones; all as uint64 but ids."""
    index = _Index(codes, bits)
    m = len(index.cuts)
    kth, upto, live = np.full(len(asked), bits), np.full(len(asked), m), np.arange(len(asked))
    none = np.zeros(0, np.int64)
    state, done = (none, none, none), []
    for r in range(max(length for _, length in index.cuts) + 1):
        for s in range(m):
            some = live[upto[live] > s]
            fresh, held = [state], 0
            for n, row in index.meet(asked[some], s, r):
                query = some[n]
                apart = asked[query] ^ codes[row]
                distance = np.bitwise_count(apart).astype(np.int64)
                near = np.flatnonzero(distance <= kth[query])
                near = near[index.first_met(apart[near], s, r)]
                fresh.append((query[near], distance[near], ids[row[near]]))
                held += len(near)
                if held > HELD:
                    fresh, held = [_best(*map(np.concatenate, zip(*fresh, strict=True)), k)], 0
            state = _best(*map(np.concatenate, zip(*fresh, strict=True)), k)
            ends = np.flatnonzero(np.append(state[0][1:] != state[0][:-1], True)) if len(state[0]) else none
            full = np.diff(ends, prepend=-1) == k
            kth[state[0][ends[full]]] = state[1][ends[full]]
        whole = np.zeros(len(asked), bool)
        whole[state[0][ends[full]]] = True
        over = whole & (kth < m * r + upto)
        out = over[state[0]]
        done.append(tuple(x[out] for x in state))
        state = tuple(x[~out] for x in state)
        live = live[~over[live]]
        if not len(live):
            break
        upto[live] = np.minimum(m, np.maximum(1, kth[live] - m * (r + 1) + 1))
    return tuple(map(np.concatenate, zip(*done, state, strict=True)))


def search(codes: DataFrame, queries: Column, k: int = 10, bits: int = 64) -> DataFrame:
    """codes(vec_id, code) and a condition that picks the queries -> (query_id, rank, vec_id, distance): the k nearest rows but the query's own, ties to smaller vec_id.

    Rows with a null id or code take no part; rows that repeat a vec_id count once for each code. Fewer than k candidates are all
    returned. Equal codes are one class of its k + 1 least ids (more can never be among k nearest), and equal queries are one search.
    """
    rows = written(codes.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("code").cast("long").alias("code"), F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id is not null and code is not null").distinct(), "codes")
    least = F.row_number().over(W.partitionBy("code").orderBy("vec_id"))
    points = written(rows.select("code", "vec_id").distinct().withColumn("r", least).where(F.col("r") <= k + 1).drop("r"), "points")
    live = written(rows.where("asks").select("code").distinct(), "searches")
    blocks, parts = max(1, -(-points.count() // BLOCK_ROWS)), max(1, -(-live.count() // QUERY_ROWS))

    def spread(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))

    left = points.withColumn("block", F.pmod(F.xxhash64("code"), F.lit(blocks))).withColumn("part", spread(parts))
    right = live.withColumn("part", F.pmod(F.xxhash64("code"), F.lit(parts))).withColumn("block", spread(blocks))

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        # at least k + 1 rows are needed: the query's own row may be among them
        asked = b["code"].to_numpy(np.int64)
        query, distance, ids = nearest(a["code"].to_numpy(np.int64).view(np.uint64), a["vec_id"].to_numpy(np.int64), asked.view(np.uint64), k + 1, bits) if len(a) and len(b) else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame({"code": asked[query], "vec_id": ids, "distance": distance})

    met = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(meet, "code long, vec_id long, distance long")
    rank = F.row_number().over(W.partitionBy("code").orderBy("distance", "vec_id"))
    near = met.withColumn("rank", rank).where(F.col("rank") <= k + 1).drop("rank")
    own = rows.where("asks").select(F.col("vec_id").alias("query_id"), "code")
    rank = F.row_number().over(W.partitionBy("query_id", "code").orderBy("distance", "vec_id"))
    return own.join(near, "code").where("vec_id <> query_id").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


SQL = """
WITH c AS (SELECT vec_id, list_reduce(list_transform(generate_series(1, 64), lambda i: CASE WHEN embedding[i] > 0 THEN (CASE WHEN i = 64 THEN (-9223372036854775808)::BIGINT ELSE (1::BIGINT << (i - 1)) END) ELSE 0::BIGINT END), lambda a, b: a | b) AS code FROM embeddings WHERE len(embedding) = 64),
p AS (SELECT q.vec_id AS query_id, c.vec_id, bit_count(xor(q.code, c.code))::INT AS distance FROM c AS q JOIN c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id))::INT AS rank FROM p)
SELECT query_id, rank, vec_id, distance FROM r WHERE rank <= 10
"""
