"""Hard negatives against SQL and brute force, and the bounds of the spanning tree."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import negatives, queries
from tests.compare import duck_rows, rows_of


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query(spark, folder):
    at = f"/root/testdata/{folder}"
    assert rows_of(queries.op12_hard_negatives(spark, at)) == duck_rows(queries.ORACLE["op12_hard_negatives"], at)


def brute(rows, anchors, low=80, high=100):
    """rows: id -> (label, vector)."""
    out = []
    for a in anchors:
        label, v = rows[a]
        score = {k: sum(p * q for p, q in zip(v, w, strict=True)) for k, (_, w) in rows.items() if k != a}
        by = sorted(score, key=lambda k: (-score[k], k))
        for p in [k for k in by if rows[k][0] == label][:5]:
            near = [k for k in by if rows[k][0] != label and low * score[p] <= 100 * score[k] <= high * score[p]][:5]
            out += [(a, p, i, k, score[p], score[k]) for i, k in enumerate(near, 1)]
    return sorted(out)


@pytest.mark.parametrize("block,part,wide", [(negatives.BLOCK, negatives.PART, 300), (64, 9, 300), (64, 9, 90_000_000)])
def test_equals_brute_force(spark, monkeypatch, block, part, wide):
    """Clusters and copies, few rows a block, and scores beyond what a double holds."""
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "PART", part)
    rng = random.Random(6)
    centres = [[rng.randint(-wide, wide) for _ in range(5)] for _ in range(6)]
    rows = {k: (rng.choice([0, 1, 1, 1, 2]), [c + rng.randint(-wide // 20, wide // 20) for c in rng.choice(centres)]) for k in range(500)}
    rows |= {k: (k % 3, centres[0]) for k in range(500, 560)} | {600: (1, [0] * 5), 601: (2, [0] * 5)}
    table = spark.createDataFrame([(k, y, v, "x") for k, (y, v) in rows.items()], "vec_id long, label int, vector array<long>, score string")
    table = table.union(table.where("vec_id % 9 = 0"))  # repeated rows
    got = sorted(map(tuple, negatives.hard_negatives(table, table["vec_id"] % 20 == 0).collect()))
    assert got == brute(rows, [k for k in rows if k % 20 == 0])


def test_nulls_and_empty_tables(spark):
    schema = "vec_id long, label int, vector array<long>"
    rows = [(0, 1, [3, 4]), (1, 1, [3, 3]), (2, 2, [3, 2]), (3, None, [3, 3]), (None, 2, [3, 3]), (4, 2, None), (5, 2, [1, None]), (6, 2, [3, 3, 3]), (7, 2, []), (8, 1, [-9, -9])]
    table = spark.createDataFrame(rows, schema)
    asks = F.col("vec_id") == 0
    assert [tuple(r) for r in negatives.hard_negatives(table, asks, low=85).collect()] == []  # 17 is below 85 % of 21
    assert [tuple(r) for r in negatives.hard_negatives(table, asks).collect()] == [(0, 1, 1, 2, 21, 17)]
    assert negatives.hard_negatives(table.limit(0), asks).count() == 0
    assert negatives.hard_negatives(table, F.col("vec_id") == 99).count() == 0
    with pytest.raises(ValueError):
        negatives.hard_negatives(spark.createDataFrame([(0, 1, [2**40, 1])], schema), asks)


def test_bounds_hold_and_spare_scores():
    rng = np.random.default_rng(3)
    centre = rng.integers(-200, 200, 16)
    anchors, points = centre + rng.integers(-5, 6, (60, 16)), rng.integers(-200, 200, (2000, 16)).astype(float)
    order, parent, edge, level = negatives.spanning_tree(anchors.astype(float))
    assert sorted(order) == list(range(60)) and level.max() <= negatives.DEPTH and (parent[1:] < np.arange(1, 60)).all()
    q, spent = anchors[order].astype(float), 0

    def asks(k, low, high):
        true = points @ q[k]
        assert (low <= true).all() and (true <= high).all()
        return np.flatnonzero(high >= np.sort(true)[-5])

    for k, rows, score in negatives.walk(points, q, parent, edge, level, asks):
        assert (score == points[rows] @ q[k]).all()
        spent += len(rows)
    assert spent < 0.2 * 60 * 2000
