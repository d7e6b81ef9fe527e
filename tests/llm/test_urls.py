"""All mined rules against brute force, and the registered query with planted labels."""

import random
import shutil
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from quire.llm import queries, urls


def brute_rules(rows, hits, support, confidence):
    """Every combination of tokens, counted one after another."""
    least, found = max(hits, support * len(rows)), {}
    for bad_tokens in [t for t, bad in rows if bad]:
        for n in range(1, len(bad_tokens) + 1):
            for c in combinations(sorted(bad_tokens), n):
                found.setdefault(c, None)
    rules = {}
    for c in found:
        held = [bad for t, bad in rows if set(c) <= t]
        if sum(held) >= least and sum(held) >= confidence * len(held):
            rules[c] = sum(held) / len(held)
    return {c: v for c, v in rules.items() if not any(rules.get(s, 0) >= v for n in range(1, len(c)) for s in combinations(c, n))}


@pytest.mark.parametrize("hits,support,confidence", [(3, 0.0, 0.5), (2, 0.03, 0.8), (5, 0.0, 0.3)])
def test_all_rules(spark, hits, support, confidence):
    rng = random.Random(hits)
    rows = []
    for _ in range(160):
        t = {w for w in "abcdefgh" if rng.random() < 0.45}
        rows.append((t, ("a" in t and "b" in t and "c" in t and "d" in t) or (t >= {"e", "f"} and rng.random() < 0.6) or rng.random() < 0.1))
    got = urls.mine(spark.createDataFrame([(sorted(t), bad) for t, bad in rows], "tokens array<string>, bad boolean"), support, hits, confidence).collect()
    want = brute_rules([(t, b) for t, b in rows if t or not b], hits, support * len(rows) / max(1, len([1 for t, b in rows if t or not b])), confidence)
    assert {tuple(r["tokens"]): round(r["confidence"], 9) for r in got} == {c: round(v, 9) for c, v in want.items()} and len(want) > 3
    assert all(r["size"] == len(r["tokens"]) for r in got)


def test_a_rule_of_four_tokens(spark):
    """Each three of the four are mostly clean."""
    rows = [(list("abcd"), True)] * 60 + [([x for x in "abcd" if x != y], False) for y in "abcd" for _ in range(200)]
    got = urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()
    assert [(r["tokens"], r["confidence"]) for r in got] == [(list("abcd"), 1.0)]


def test_query_with_planted_labels(spark, tiny, tmp_path):
    """Pages of a planted site and path are labelled bad: the registered query learns it and blocks the pages without a label too."""
    pages = [(10_000 + k, f"http://www.planted.org/{'offer' if k % 4 == 0 else 'news'}/{k}") for k in range(200)]
    shutil.copytree(tiny, tmp_path / "in")
    own = spark.read.parquet(f"{tiny}/pages.parquet")
    more = spark.createDataFrame(pages, "page_id long, url string").withColumn("html", F.lit("<p>x</p>"))
    own.unionByName(more.select(*own.columns)).coalesce(1).write.parquet(str(tmp_path / "pages"))
    labels = spark.read.parquet(f"{tiny}/labels.parquet")
    told = spark.createDataFrame([(k, 0 if k % 4 == 0 else 1, 0) for k, _ in pages if k % 5], "doc_id long, quality long, toxic long")
    labels.unionByName(told.select(*[F.col(c).cast(labels.schema[c].dataType) for c in labels.columns])).coalesce(1).write.parquet(str(tmp_path / "labels"))
    for name in ("pages", "labels"):
        (tmp_path / "in" / f"{name}.parquet").unlink()
        shutil.copytree(tmp_path / name, tmp_path / "in" / f"{name}.parquet")
    got = {r["page_id"]: r for r in queries.op4_url_filter(spark, str(tmp_path / "in")).collect()}
    assert len(got) == own.count() + len(pages)
    for k, _ in pages:
        assert got[k]["rule"] is None and got[k]["verdict"] == ("block" if k % 4 == 0 else "allow"), k
