"""Periodic runs against their definition, on the query and on random words."""

import hashlib
import random
import zlib
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from quire.llm import queries, runs


def brute_runs(w):
    """(start, length, period) by start and period: for each period, the longest stretches that keep it and no smaller one."""
    n, out = len(w), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(w[i : j + q - d] == w[i + d : j + q] for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(w, found):
    gone = {k for s, n, q in found for k in range(s + q, s + n)}
    return " ".join(x for k, x in enumerate(w) if k not in gone)


def random_text(rng):
    n = rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 20]))}" for _ in range(n)]
    for _ in range(rng.randrange(3)):
        if n:
            a = rng.randrange(n)
            p = rng.randint(1, max(1, (n - a) // rng.randint(2, 6)))
            for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randrange(p))):
                w[i] = w[a + (i - a) % p]
    return " ".join(w)


@pytest.mark.parametrize("together,kept", [(runs.TOGETHER, runs.KEPT), (50, 10)])
def test_equals_the_definition(monkeypatch, together, kept):
    monkeypatch.setattr(runs, "TOGETHER", together)
    monkeypatch.setattr(runs, "KEPT", kept)
    rng = random.Random(4)
    texts = [random_text(rng) for _ in range(1500)]
    for t, got in zip(texts, [g for lo in range(0, 1500, 100) for g in runs.judged(texts[lo : lo + 100])], strict=True):
        w = t.split()
        assert got == (len(w), brute_runs(w), collapsed(w, brute_runs(w))), t


def test_wavelet_tree():
    x = np.random.default_rng(2).permutation(300).astype(np.int32)
    tree = runs.Wavelet(x)
    rng = random.Random(3)
    for _ in range(300):
        lo = rng.randrange(300)
        hi, v = rng.randint(lo + 1, 300), rng.randrange(300)
        n = rng.randrange(hi - lo)
        a, b = np.array([lo], np.int32), np.array([hi], np.int32)
        assert tree.below(a, b, np.array([v], np.int32))[0] == (x[lo:hi] < v).sum()
        assert tree.nth(a, b, np.array([n], np.int32))[0] == sorted(x[lo:hi])[n]


def test_long_texts():
    w = [f"u{k}" for k in range(9000)] + [f"v{k % 2500}" for k in range(11000)] + ["z"] * 30000
    assert runs.judged([" ".join(w), None, "a " * 6])[0][1] == [(9000, 11000, 2500), (20000, 30000, 1)]


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    w = [x.decode() for x in w]
    found = brute_runs(w)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return len(found), *four, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(collapsed(w, found).encode()).hexdigest()


NAMES = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_query(spark, tiny):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()
    got = {r["doc_id"]: tuple(r[n] for n in NAMES) for r in queries.op11_periodic_runs(spark, tiny).collect()}
    assert sorted(got) == sorted(k for k, _ in rows) and sum(r[0] > 0 for r in got.values()) > 3
    for k, text in rows:
        assert got[k] == brute_row(k, text), k


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, {"k": 1}), (None, "", None), (2, "a\tb " * 5, {}), (2, "a\tb " * 5, {}), (3, " x", {"y": 2})]
    frame = spark.createDataFrame([(*r, "z") for r in rows], ["doc_id", "text", "m", "start"]).withColumnRenamed("m", "a.b")
    got = sorted(((r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"], r["a.b"]) for r in runs.periodic_runs(frame, keep=("doc_id", "a.b")).collect()), key=repr)
    want = [(1, 0, [], "", {"k": 1}), (None, 0, [], "", None), (2, 10, [(0, 10, 2)], "a b", {}), (2, 10, [(0, 10, 2)], "a b", {}), (3, 1, [], "x", {"y": 2})]
    assert got == sorted(want, key=repr)
    assert runs.periodic_runs(frame.limit(0)).count() == 0
