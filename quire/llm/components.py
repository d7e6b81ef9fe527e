"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quire.plans.materialize import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node hooks its larger (large) or smaller-or-equal (small) neighbours onto the least node it sees.

    The least neighbour is a partial aggregate, written as a table and joined back: the join has an exchange on both
    sides, so a node with very many neighbours can be split over tasks.
    """
    both = edges.select(F.col("a").alias("n"), F.col("b").alias("m"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("n"), F.col("a").alias("m")))
    least = written(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")), "least")
    met = both.join(least, "n")
    if large:
        out = met.where("m > n").select(F.col("m").alias("a"), F.col("low").alias("b"))
    else:
        out = met.select(F.col("m").alias("a"), F.col("low").alias("b")).unionByName(least.select(F.col("n").alias("a"), F.col("low").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """edges: pairs of long ids (direction, repeats, nulls and self-loops do not matter) -> (node, component), the least id reachable.

    Only nodes that have an edge to another node appear; an empty table gives an empty table.
    Every round is a table in the shared folder, so a lost executor costs one round at most.
    """
    cur = edges.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b")).where("a <> b").distinct()
    cur = written(cur, "edges")
    state = None
    while True:
        cur = written(_star(_star(cur, True), False), "edges")
        now = cur.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if now == state:
            break
        state = now
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
