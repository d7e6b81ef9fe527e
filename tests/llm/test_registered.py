"""The registered queries without SQL, as they are registered, against brute force over the smallest tables."""

import math

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from quire.llm import ann, factors, mixing, pieces, queries, urls
from tests.llm.test_small import brute_scores, brute_substrings, brute_targets, docs, exact, split_url, words


def test_op1_scores_and_round_trip(spark, tiny):
    units = pieces.Lattice()
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall())
    got = {r["doc_id"]: r for r in queries.op1_sentencepiece(spark, tiny).collect()}
    assert set(got) == set(texts) and all(r["round_trip"] for r in got.values())
    short = sorted((k for k, t in texts.items() if t), key=lambda k: len(texts[k]))[:40]
    for k in short:
        assert [n["score"] for n in got[k]["nbest"]] == pytest.approx(brute_scores(units, texts[k], 4), abs=1e-6)
        assert got[k]["score"] == got[k]["nbest"][0]["score"]


def test_op4_rules(spark, tiny):
    pages = dict(duckdb.sql(f"SELECT page_id, url FROM '{tiny}/pages.parquet'").fetchall())
    got = queries.op4_url_filter(spark, tiny).collect()
    assert sorted(r["page_id"] for r in got) == sorted(pages)
    for r in got:
        host, path = split_url(pages[r["page_id"]])
        fits = sorted((-len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p))
        assert (r["host"], r["path"], r["rule"]) == (host, path, fits[0][1] if fits else None)
        assert r["verdict"] == (fits[0][2] if fits else "block" if r["n_rules"] else "allow")


def test_op5_neighbours(spark, tiny):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM '{tiny}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float64)
    got = {}
    for r in queries.op5_nearest(spark, tiny).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    asked = [int(i) for i in ids if i % 100 == 0]
    assert sorted(got) == asked
    hit = 0
    for q in asked:
        at = int(np.flatnonzero(ids == q)[0])
        true = {v for v, _ in exact(ids, x, at, 10)}
        assert sorted(got[q]) == list(range(1, 11))
        for v, s in got[q].values():
            assert s == pytest.approx(math.sqrt(((x[at] - x[int(np.flatnonzero(ids == v)[0])]) ** 2).sum()), abs=1e-12)
        hit += len(true & {v for v, _ in got[q].values()})
    assert hit >= 0.9 * 10 * len(asked)


def test_op6_targets(spark, tiny):
    rows = duckdb.sql(f"SELECT doc_id, source, text FROM '{tiny}/documents.parquet'").fetchall()
    got = queries.op6_mixing(spark, tiny).collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((k, len((t or "").split())) for k, _, t in rows)
    sizes, taken = {}, {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    target = brute_targets(sizes)
    assert all(r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) for r in got)
    assert all(abs(taken[s] - target[s]) <= 4 * mixing.BLOCK_WORDS for s in sizes)


def test_recall_at_another_size(spark):
    """Three times the rows of the other test, in few dimensions: still found, each vector once a part that visits its bin."""
    rng = np.random.default_rng(7)
    x = rng.normal(0, 1, (5000, 6)) + rng.normal(0, 5, (20, 6))[rng.integers(0, 20, 5000)]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found, report = ann.nearest(table, table["vec_id"] % 100 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    hit = sum(len(got[q] & {v for v, _ in exact(np.arange(5000), x, q, 10)}) for q in got)
    assert len(got) == 50 and hit >= 0.95 * 500 and report["visits"] < report["leaves"]


def test_ties_and_overflow(spark):
    rows = [(100 + i, [1.0, 0.0]) for i in range(40)] + [(200, [0.0, 1.0]), (900, [1e200, 0.0]), (901, [-1e200, 0.0])]
    got = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), ann.F.col("vec_id").isin(200, 900))[0].collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    assert [got[200][k][0] for k in range(1, 11)] == list(range(100, 110))
    few = ann.nearest(spark.createDataFrame(rows[-3:], "vec_id long, embedding array<double>"), ann.F.col("vec_id") == 900)[0].orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(200, 1e200), (901, pytest.approx(2e200))]


def test_one_id_with_two_texts(spark):
    """A row whose text is unique keeps its words though another row of its doc_id repeats itself."""
    rows = [(1, "a b c " * 10), (1, " ".join(f"u{i}" for i in range(40))), (2, " ".join(f"v{i}" for i in range(30))), (2, " ".join(f"v{i}" for i in range(30)))]
    got = factors.factored(docs(spark, [(k, t, "en", "s") for k, t in rows])).collect()
    by = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got)
    assert len(by) == 4 and (1, 40, 0) in by and by.count((2, 30, 0)) == 2
    alone = brute_substrings(rows[:1])[1]
    assert [r for r in by if r[:2] == (1, 30)][0][2] in (0, alone[1])


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _d string, _times int, row string, component int, text_key long"


def test_stages_on_repeats_nulls_and_clashing_names(spark):
    import random

    rng = random.Random(5)
    a, b, c = (words(rng, 80) for _ in range(3))
    rows = [(1, a, "s"), (1, b, "s"), (1, a, "s"), (2, a, "s"), (None, c, "s"), (None, c, None), (None, None, None), (7, None, "s")]
    frame = spark.createDataFrame([(k, t, "en", s, n, "x", 3, "r", 9, 8) for n, (k, t, s) in enumerate(rows)], SCHEMA)
    left = corpus_pipeline.near_dedup(spark, frame, "")
    assert left.columns == frame.columns
    found = sorted(((r["doc_id"], r["text"]) for r in left.collect()), key=repr)
    # one row a text: the least id, rows without id last
    assert found == sorted([(1, a), (1, b), (None, c), (7, None)], key=repr)
    assert found == sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, frame.orderBy("n_chars", ascending=False), "").collect()), key=repr)
    mixed = corpus_pipeline.mix(spark, frame, "")
    assert mixed.columns == frame.columns
    taken, read = mixing.mix(frame)
    passes = {}
    for r in read.groupBy("doc_id", "key", "source", "size", "copy", "pass").agg({"n": "sum"}).collect():
        passes[r["doc_id"], r["key"], r["source"]] = passes.get((r["doc_id"], r["key"], r["source"]), 0) + (2 * r["sum(n)"] >= r["size"])
    assert mixed.count() == sum(passes.values()) and taken.count() == len(rows)
