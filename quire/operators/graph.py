"""A property graph as two tables, and operators on it."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from quire.plans.materialize import written
from quire.plans.session import small_batches


def build_nodes(papers: DataFrame, authorship: DataFrame) -> DataFrame:
    """papers(work, title) and authorship(work, author, name) -> (node, kind, label); an author has the label that is least."""
    p = papers.select(F.concat(F.lit("paper:"), "work").alias("node"), F.lit("paper").alias("kind"), F.col("title").alias("label"))
    a = authorship.groupBy("author").agg(F.min("name").alias("label")).select(F.concat(F.lit("author:"), "author").alias("node"), F.lit("author").alias("kind"), "label")
    return p.unionByName(a)


def build_authorship_edges(authorship: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct author -> paper edges whose two ends are nodes."""
    e = authorship.select(F.concat(F.lit("author:"), "author").alias("src"), F.concat(F.lit("paper:"), "work").alias("dst")).distinct()
    ends = nodes.select("node")
    return e.join(ends.withColumnRenamed("node", "src"), "src", "left_semi").join(ends.withColumnRenamed("node", "dst"), "dst", "left_semi")


def neighbors(seeds: DataFrame, edges: DataFrame, nodes: DataFrame, direction: str = "both", types: list[str] | None = None, limit: int = 20) -> DataFrame:
    """seeds(seed) -> their edges(edge, src, dst, type, confidence) with both labels, the best `limit` a seed by confidence, type, edge."""
    if direction not in ("in", "out", "both"):
        raise ValueError("direction is in, out or both")
    e = edges if types is None else edges.where(F.col("type").isin(*types))
    out = seeds.join(e, seeds["seed"] == e["src"])
    into = seeds.join(e, seeds["seed"] == e["dst"])
    met = {"out": out, "in": into}.get(direction)
    if met is None:  # a loop is met from both sides
        met = out.unionByName(into.where("src <> dst"))
    w = W.partitionBy("seed").orderBy(F.desc("confidence"), "type", "edge")
    top = met.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    a, b = (nodes.select(F.col("node").alias(k), F.col("label").alias(f"{k}_label")) for k in ("src", "dst"))
    return top.join(a, "src", "left").join(b, "dst", "left")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges by type, and totals."""
    n = nodes.rollup("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), F.coalesce("kind", F.lit("*")).alias("kind"), "n")
    e = edges.rollup("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), F.coalesce("type", F.lit("*")).alias("kind"), "n")
    return n.unionByName(e)


def lineage(pairs: DataFrame, edges: DataFrame, hops: int = 6) -> DataFrame:
    """pairs(src, dst) -> (src, dst, hops, path): the shortest undirected path of at most `hops` edges as `edge>` or `edge<` steps; equal
    ends have an empty path, equal lengths go to the least path.

    Both ends grow in turn, each by nodes it has not seen, so a side has at most half the hops to fan out. What grows belongs to
    an end, not to a pair, so pairs with a common end share it; a pair leaves as soon as its sides meet, an end with its
    last pair. A step writes its frontier and the pairs.
    """
    there, back = F.concat("edge", F.lit(">")), F.concat("edge", F.lit("<"))
    walked = edges.select(F.col("src").alias("at"), F.col("dst").alias("to"), there.alias("src_step"), back.alias("dst_step")).unionByName(edges.select(F.col("dst").alias("at"), F.col("src").alias("to"), back.alias("src_step"), there.alias("dst_step")))
    # a node with one edge lies on no path but at its ends
    leaves = walked.groupBy("to").agg(F.count("*").alias("n")).where("n = 1").select("to", F.lit(True).alias("leaf"))
    steps = written(walked.join(leaves, "to", "left").na.fill(False, ["leaf"]), "steps")
    hubs, tips = steps.where("not leaf").drop("leaf"), steps.where("leaf").drop("leaf")
    empty = F.array().cast("array<string>")
    state = written(pairs.select("src", "dst", F.when(F.col("src") == F.col("dst"), empty).alias("path")).distinct(), "pairs")  # a pair without path is still open
    done, live = [state.where("path is not null").select("src", "dst", F.lit(0).alias("hops"), "path")], state.where("path is null").select("src", "dst")
    near = {k: live.select(F.col(k).alias("end"), F.col(k).alias("at"), empty.alias("path")).distinct() for k in ("src", "dst")}
    seen = {k: v.select("end", "at") for k, v in near.items()}
    for h in range(1, hops + 1):
        side, other = ("src", "dst") if h % 2 else ("dst", "src")
        step = F.array(f"{side}_step")
        grown = F.concat("path", step) if side == "src" else F.concat(step, "path")
        ends = live.select(F.col(side).alias("end"), F.col(other).alias("to"))
        grows = near[side].join(ends.select("end").distinct(), "end", "left_semi")
        # an end that is such a leaf is reached by its one edge: that is looked up by the pair, so a node's leaves are never gone through
        ahead = grows.join(hubs, "at").unionByName(grows.join(ends.join(tips, "to"), ["end", "at"])).select("end", F.col("to").alias("at"), grown.alias("path"))
        near[side] = written(ahead.groupBy("end", "at").agg(F.min("path").alias("path")).join(seen[side], ["end", "at"], "left_anti"), "frontier")
        seen[side] = seen[side].unionByName(near[side].select("end", "at"))
        a = live.join(near["src"].withColumnsRenamed({"end": "src"}), "src")
        met = a.join(near["dst"].withColumnsRenamed({"end": "dst", "path": "rest"}), ["dst", "at"]).groupBy("src", "dst").agg(F.min(F.concat("path", "rest")).alias("path"))
        state = written(live.join(met, ["src", "dst"], "left"), "pairs")
        done.append(state.where("path is not null").select("src", "dst", F.lit(h).alias("hops"), "path"))
        live = state.where("path is null").select("src", "dst")
        if live.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def citations_by_key(refs: DataFrame, papers: DataFrame, first: int = 20, most: int = 200) -> DataFrame:
    """refs(paper, keys) resolved to papers(work, id, squashed): the first `first` keys of each paper by id or squashed title, no self, distinct, the first `most` in order."""
    k = refs.select("paper", F.posexplode(F.slice("keys", 1, first)).alias("pos", "key"))
    by_id = k.join(papers.select("work", F.col("id").alias("key")), "key")
    by_title = k.join(papers.select("work", F.col("squashed").alias("key")), "key")
    hits = by_id.unionByName(by_title).where("paper <> work").groupBy("paper", "work").agg(F.min("pos").alias("pos"))
    return hits.orderBy("paper", "pos", "work").limit(most).select("paper", "work")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """In and out degree of every node, bridge = in * out / (in + out), and whether it is isolated."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    d = both.groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))
    all_ = nodes.select("node").join(d, "node", "left").na.fill(0, ["n_out", "n_in"])
    return all_.select("node", "n_out", "n_in", F.round(F.coalesce(F.try_divide(F.col("n_in") * F.col("n_out"), F.col("n_in") + F.col("n_out")), F.lit(0.0)), 6).alias("bridge"), ((F.col("n_in") + F.col("n_out")) == 0).alias("isolated"))


#: Entries of a list that are paired in one task; longer lists are cut into blocks, and blocks are paired.
LIST = 1_000
#: Pairs that one task counts.
PAIRS = 1_000_000


def _common(links: DataFrame, least: int, most: int = LIST) -> DataFrame:
    """links(at, x) -> (a, b, n): the pairs of x that at least `least` values of `at` have in common.

    A list of more than `most` x of one `at` is cut into blocks by a hash of x; each block is sent to each other, so that a pair meets once
    and no task holds more than about two blocks. All pairs of a list are made: their number is that of the result before counting. It is
    known from the lists, and pairs are dealt to as many tasks as it asks for before they are counted, so a task's counts do not grow with the input.
    """
    lists = written(links.distinct(), "lists")
    wide = lists.groupBy("at").agg(F.count("*").alias("n")).where("n > 1")
    total = wide.agg(F.sum(F.col("n") * (F.col("n") - 1) / 2)).first()[0] or 0
    tasks = max(int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / PAIRS))
    wide = wide.select("at", F.ceil(F.col("n") / most).cast("int").alias("blocks"))
    cut = lists.join(wide, "at").withColumn("block", F.pmod(F.xxhash64("x"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = cut.select("at", F.col("x").alias("a"), F.col("block").alias("i"), every.alias("j"))
    right = cut.select("at", F.col("x").alias("b"), F.col("block").alias("j"), every.alias("i"))
    pairs = left.join(right, ["at", "i", "j"]).where("a < b")
    return pairs.repartition(tasks, "a", "b").groupBy("a", "b").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def cocitation(edges: DataFrame, least: int = 2, most: int = LIST) -> DataFrame:
    """edges(src, dst) -> (a, b, n): targets that at least `least` sources cite together."""
    return _common(edges.select(F.col("src").alias("at"), F.col("dst").alias("x")), least, most)


def coupling(edges: DataFrame, least: int = 2, most: int = LIST) -> DataFrame:
    """edges(src, dst) -> (a, b, n): sources that cite at least `least` targets in common."""
    return _common(edges.select(F.col("dst").alias("at"), F.col("src").alias("x")), least, most)


def concept_pairs(mentions: DataFrame, least: int = 2, most: int = LIST) -> DataFrame:
    """mentions(work, concept) -> (a, b, n): concepts that at least `least` works name together."""
    return _common(mentions.select(F.col("work").alias("at"), F.col("concept").alias("x")), least, most)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links(src, dst), those of a source together -> (src, dsts); a source has a list in each batch that it is in."""
    for batch in batches:
        src, dst = batch["src"], batch["dst"]
        if not len(src):
            continue
        new = np.ones(len(src), bool)
        new[1:] = pc.not_equal(src[1:], src[:-1]).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(new)
        lists = pa.ListArray.from_arrays(np.append(starts, len(src)).astype(np.int32), dst)
        yield pa.RecordBatch.from_arrays([src.take(pa.array(starts)), lists], ["src", "dsts"])


def pagerank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """(node, rank) after `rounds` power steps; nodes without out-edges share their rank among all. Edges with a null end take no part.

    Links are kept as lists by source, each within a batch of Arrow. A round moves lists to their source's rank, hands out the shares and sums
    them by target; it sorts no links.
    """
    small_batches(edges.sparkSession)
    node = edges.schema["src"].dataType.simpleString()
    links = edges.where("src is not null and dst is not null").select("src", F.col("dst").cast(node).alias("dst"))
    links = links.repartition("src").distinct().withColumn("h", F.xxhash64("src")).sortWithinPartitions("h").select("src", "dst")  # a number is sorted faster than the ends
    lists = written(links.mapInArrow(_lists, f"src {node}, dsts array<{node}>"), "lists")
    ends = lists.select(F.col("src").alias("node"), F.size("dsts").cast("long").alias("n")).unionByName(lists.select(F.explode("dsts").alias("node"), F.lit(0).cast("long").alias("n")))
    nodes = written(ends.groupBy("node").agg(F.sum("n").alias("n")), "nodes")
    lists = written(lists.join(nodes, lists["src"] == nodes["node"]).select("src", "n", "dsts"), "lists")
    total, some = nodes.agg(F.greatest(F.count("*"), F.lit(1)), F.count_if(F.col("n") == 0)).first()
    ending = nodes.where("n = 0").select("node")
    rank = nodes.select("node", F.lit(1.0 / total).alias("rank"))
    for _ in range(rounds):
        given = lists.join(rank, lists["src"] == rank["node"]).select(F.explode("dsts").alias("node"), (F.col("rank") / F.col("n")).alias("got"))
        loose = rank.join(ending, "node").agg(F.coalesce(F.sum("rank"), F.lit(0.0))).first()[0] if some else 0.0
        got = given.unionByName(nodes.select("node", F.lit(0.0).alias("got"))).groupBy("node").agg(F.sum("got").alias("got"))
        rank = written(got.select("node", (F.lit((1 - damping) / total + damping * loose / total) + damping * F.col("got")).alias("rank")), "rank")
    return rank
