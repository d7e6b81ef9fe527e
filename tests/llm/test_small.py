"""Each operator on small tables: brute force, nulls, empty and long texts, ties, repeats, clashing columns, empty tables."""

import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import ann, binary, components, factors, langid, lines, mixing, pieces, simhash, urls, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, host string, n_lines int"


def docs(spark, rows):
    """(doc_id, text, lang, source) with extra columns whose names operators use."""
    return spark.createDataFrame([(*r, 1, 0.5, "h", 9) for r in rows], DOCS)


def words(rng, n, kinds=400):
    return " ".join(f"w{int(rng.random() ** 2 * kinds)}" for _ in range(n))


# ---- components -------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(80)] + [(200, k) for k in range(201, 260)] + [(7, 7), (None, 3)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: root(n) for n in parent}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# ---- 3 ----------------------------------------------------------------------------------------------------------


def brute_print(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_golay_keys_meet_within_one_bit():
    x = np.random.default_rng(0).integers(0, 1 << 23, 4000).astype(np.uint32)
    near, count = simhash.near_indices(x)
    assert set(count.tolist()) <= {1, 6}
    for y in [x, *(x ^ np.uint32(1 << b) for b in range(23))]:
        assert (near == simhash.own_index(y)[:, None]).any(axis=1).all()


def test_links_lose_none(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    near = [b ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, n, replace=False))) for b in base for n in (1, 2, 3, 4)]
    prints = np.unique(np.concatenate([base, np.array(near, np.uint64)])).view(np.int64).tolist()
    got = {(r["left"], r["right"]) for r in simhash.links(spark.createDataFrame([(p,) for p in prints], "print long")).collect()}
    want = {(min(a, b), max(a, b)) for i, a in enumerate(prints) for b in prints[:i] if bin((a ^ b) & (2**64 - 1)).count("1") <= 3}
    assert got == want and len(want) > 150


def test_near_duplicates(spark):
    rng = random.Random(1)
    base = words(rng, 300)
    rows = [(1, base, "en", "s"), (2, base.upper() + "  ", "en", "s"), (3, base.replace("w1 ", "w2 ", 1), None, None), (9, None, None, None), (4, "", "en", "s"), (5, " \t\n", "en", "s"), (6, "two words", "en", "s"), (7, words(rng, 60_000), "en", "s"), (1, base, "en", "s"), (None, base, "en", "s")]
    got = {}
    for r in simhash.near_duplicates(docs(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["print"] & (2**64 - 1), r["component_id"]))
    prints = [brute_print(t) for _, t, *_ in rows]
    for (k, *_), p in zip(rows, prints, strict=True):
        assert all(x == p for x, _ in got[k])
    assert {k: v[0][1] for k, v in got.items()} == {1: 1, 2: 1, 3: 1 if bin(prints[0] ^ prints[2]).count("1") <= 3 else 3, 9: 4, 4: 4, 5: 4, 6: 6, 7: 7, None: 1}
    assert len(got[1]) == 2
    assert simhash.near_duplicates(docs(spark, [])).count() == 0


# ---- 8 ----------------------------------------------------------------------------------------------------------


def test_language_id(spark):
    rng = random.Random(4)
    syllables = {"aa": ["tion", "ing", "the", "ed"], "bb": ["ung", "keit", "der", "sch"]}
    text = lambda k, n: " ".join("".join(rng.choice(syllables[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    train = [(i, text("aa" if i % 2 else "bb", 80), "aa" if i % 2 else "bb", None) for i in range(60)] + [(100, None, "aa", None), (101, "123", "aa", None), (102, "x", None, None)]
    model = langid.learn(docs(spark, train))
    assert sorted(model) == ["aa", "bb"]
    test = [(1, text("aa", 60), None, None), (2, text("bb", 60), None, None), (3, None, None, None), (4, "12 34 !", None, None), (5, "", None, None), (6, text("bb", 9000), None, None), (1, text("aa", 60), None, None)]
    got = [(r["doc_id"], r["lang_pred"], r["accepted"]) for r in langid.identify(docs(spark, test), model).collect()]
    assert got == [(1, "aa", True), (2, "bb", True), (3, "und", False), (4, "und", False), (5, "und", False), (6, "bb", True), (1, "aa", True)]
    tie = langid.identify(docs(spark, [(1, "q", None, None)]), model).first()
    assert tie["lang_pred"] == "aa" and 0 <= tie["score"] <= 1 and not tie["accepted"]
    assert langid.learn(docs(spark, [])) == {} and langid.identify(docs(spark, test[:1]), {}).first()["lang_pred"] == "und"
    assert langid.identify(docs(spark, []), model).count() == 0
    import zlib

    ids = spark.createDataFrame([(k,) for k in (0, 7, -3, 10**12)], "doc_id long")
    assert [r["f"] for r in ids.select(langid.fold(F.col("doc_id")).alias("f")).collect()] == [zlib.crc32(str(k).encode()) % 3 for k in (0, 7, -3, 10**12)]


# ---- 7 ----------------------------------------------------------------------------------------------------------


def test_line_dedup(spark):
    rows = [(i, f"menu\nown line {i}\n\n menu ", "en", "a") for i in range(8)] + [(20 + i, f"menu\nother {i}", "en", "b") for i in range(3)] + [(30, None, "en", "a"), (31, "", "en", "a"), (32, "x\n" * 20_000, "en", "c"), (40, "menu\nq", "en", None), (0, "menu\nown line 0\n\n menu ", "en", "a")]
    out = {}
    for r in lines.drop_boilerplate(docs(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append((r["text"], r["n_lines"], r["n_dropped"]))
    assert out[3] == [("own line 3\n", 4, 2)]
    assert out[21] == [("menu\nother 1", 2, 0)]
    assert out[30] == [(None, 0, 0)] and out[31] == [("", 1, 0)] and out[32] == [("x\n" * 20_000, 20_001, 0)] and out[40] == [("menu\nq", 2, 0)]
    assert len(out[0]) == 2
    clashing = docs(spark, rows).withColumns({c: F.lit(c) for c in ("_bad", "_host", "_kept", "row", "bad", "pages")})
    again = lines.drop_boilerplate(clashing).collect()
    assert sorted((r["doc_id"], r["text"] or "", r["n_dropped"]) for r in again) == sorted((k, t or "", n) for k, v in out.items() for t, _, n in v)
    assert all(r["_bad"] == "_bad" and r["row"] == "row" and r["pages"] == "pages" for r in again)
    assert lines.drop_boilerplate(docs(spark, [])).count() == 0
    plan = lines.drop_boilerplate(docs(spark, rows))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan


# ---- 6 ----------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1)):
    """Caps the fullest sources and shares the rest again until none is above its cap."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, live, out = 1.5 * sum(sizes.values()), set(names), {}
    while live:
        share = {s: left * w[s] / sum(w[x] for x in live) for s in live}
        over = [s for s in live if share[s] >= 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2.0 * sizes[s]
            left -= out[s]
            live.remove(s)
    return out


def test_targets_fill_like_water(spark):
    rng = random.Random(8)
    for n in (1, 2, 3, 7, 20):
        sizes = {**{f"s{k}é" if k % 2 else f"S{k}": rng.choice([0, 5, 100, 1000, 40_000]) for k in range(n)}, None: 50}
        got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
        assert got == pytest.approx(brute_targets(sizes))


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 900)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(300)]
    rows += [(500, None, "en", "a"), (501, "", "en", "b"), (502, words(rng, 30_000), "en", "b"), (0, rows[0][1], "en", rows[0][3]), (0, "short one", "en", rows[0][3])]
    taken, read = mixing.mix(docs(spark, rows))
    got = taken.collect()
    assert len(got) == len(rows) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sorted(r["size"] for r in got) == sorted(len((t or "").split()) for _, t, *_ in rows)
    by = {}
    for r in got:
        by.setdefault(r["source"], [0, r["source_size"], r["target"]])[0] += r["taken"]
    assert {s: v[2] for s, v in by.items()} == pytest.approx(brute_targets({s: v[1] for s, v in by.items()}))
    assert all(abs(v[0] - v[2]) <= 4 * mixing.BLOCK_WORDS for v in by.values())
    again, _ = mixing.mix(docs(spark, rows[::-1]))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got), key=repr)
    slots = [r["slot"] for r in read.select("slot").distinct().collect()]
    assert sorted(slots) == list(range(len(slots)))
    assert mixing.mix(docs(spark, []))[0].count() == 0


def test_schedule_is_spread_evenly(spark):
    aims = spark.createDataFrame([("a", 64_000.0), ("b", 12_800.0), ("c", 51_200.0)], "source string, target double")
    rows = sorted((r["slot"], r["source"], r["rank"]) for r in mixing.schedule(aims, 128).collect())
    assert [r[0] for r in rows] == list(range(1000))
    seen, share = {}, {"a": 0.5, "b": 0.1, "c": 0.4}
    for t, s, rank in rows:
        assert rank == seen.get(s, 0)
        seen[s] = rank + 1
        assert all(abs(seen.get(x, 0) - share[x] * (t + 1)) < 5 for x in share)


# ---- 1 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def units():
    return pieces.Lattice()


def brute_scores(units, text, n):
    t = "▁" + text.replace(" ", "▁")
    best = [[0.0]] + [[] for _ in t]
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - 16), j):
            hit = units.table.get(t[i:j])
            gain = hit[0] if hit else units.unknown if j == i + 1 else None
            if gain is not None:
                best[j] += [s + gain for s in best[i]]
        best[j] = sorted(best[j], reverse=True)[:n]
    return best[-1]


def test_nbest_against_dynamic_programme(units):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    for text in ("the cat sat on the mat", "a  b   c", " lead", "tail ", "x.\n\ny, z!", "日本語 a1é", "ééé" * 30, "straßen" * 9, "q", "\n", "12 345"):
        found = units.encode(text, 6)
        assert [s for s, _ in found] == brute_scores(units, text, 6)
        paths = [b"".join(c) for _, c in found]
        assert len(set(paths)) == len(paths)
        for (score, _), raw in zip(found, paths, strict=True):
            ids = np.frombuffer(raw, np.int32).tolist()
            assert units.decode(ids) == text == sp.decode(ids)
    assert units.encode("", 3) == [(0.0, [])]


def test_arrays_agree_with_a_star(units):
    rng = random.Random(6)
    cells = sorted({pieces.SPACE * rng.randint(0, 1) + "".join(rng.choice("etaoinshré") for _ in range(rng.randint(1, 20))) for _ in range(800)})
    units.best.clear()
    units.learn(cells)
    for c in cells[::5]:
        two = units.search(c, 2)
        assert units.best[c] == (two[0][0], two[0][1], two[0][0] - two[1][0] if len(two) > 1 else math.inf)


def test_encode_table(spark):
    rng = random.Random(2)
    rows = [(1, "the the", "en", "s"), (2, None, "en", "s"), (3, "", "en", "s"), (4, words(rng, 30_000), "en", "s"), (1, "the the", "en", "s"), (5, "▁x", "en", "s")]
    got = {r["doc_id"]: r for r in pieces.encode(docs(spark, rows), n=3).collect()}
    assert got[2]["ids"] is None and got[2]["nbest"] is None and got[2]["round_trip"] is None
    assert got[3]["ids"] == [] and len(got[3]["nbest"]) == 1
    assert all(got[k]["round_trip"] for k in (1, 3, 4, 5))
    assert got[1]["nbest"][0]["sha256"] == hashlib.sha256(np.array(got[1]["ids"], np.int32).tobytes()).hexdigest()
    scores = [x["score"] for x in got[4]["nbest"]]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)
    back = {r["doc_id"]: r["t"] for r in pieces.encode(docs(spark, rows), n=1).select("doc_id", pieces.decoded(F.col("ids")).alias("t")).collect()}
    assert back[4] == rows[3][1] and back[2] is None and back[5] == " x"
    assert pieces.encode(docs(spark, [])).count() == 0


# ---- 4 ----------------------------------------------------------------------------------------------------------


def split_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
    tail = rest[cut:]
    end = min([tail.index(c) for c in "?#" if c in tail], default=len(tail))
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut]), tail[:end]


def test_urls(spark):
    urls_ = ["http://A.Example.NET/en/x?q=1", "https://example.net/enx", "http://b.example.com/de/", "http://x.org/fr/1#t", "http://net/", "http://internet/", "ftp://É.net", "no url", None, "", "http://example.com?x=/de/", "a://b://c/d", "http:///p", "http://h#f?x"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls_)] + [(0, urls_[0], 2)], "page_id long, url string, verdict int")
    none = spark.createDataFrame([], "id long, bad boolean")
    got = urls.judge(pages, none).collect()
    assert len(got) == len(urls_) + 1
    want = {0: ("example.net/en/", "allow"), 1: ("net/", "block"), 2: ("example.com/de/", "block"), 3: ("org/fr/", "allow"), 4: ("net/", "block")}
    for r in got:
        assert (r["host"], r["path"]) == split_url(urls_[r["page_id"]])
        assert (r["rule"], r["verdict"]) == want.get(r["page_id"], (None, "allow"))
    assert urls.judge(pages.limit(0), none).count() == 0


def test_mined_rules(spark):
    rows = [(i, f"http://spam{i // 45}.example.org/casino/{i}") for i in range(90)] + [(100 + i, f"http://good{i % 5}.example.org/news/{i}") for i in range(200)] + [(400 + i, f"http://good1.example.org/casino/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(k, k < 100) for k, _ in rows if k % 2 == 0] + [(1, None)], "id long, bad boolean")
    got = {r["page_id"]: r["verdict"] for r in urls.judge(pages, labels).collect()}
    assert all(got[k] == ("block" if k < 100 else "allow") for k, _ in rows)
    t = pages.select(urls.tokens(urls.host_of(F.col("url")), urls.path_of(F.col("url")), F.col("url")).alias("tokens"), (F.col("page_id") < 100).alias("bad"))
    rules = urls.mine(t).collect()
    facts = [(set(r["tokens"]), r["bad"]) for r in t.collect()]
    assert rules
    for r in rules:
        hit = [bad for tok, bad in facts if set(r["tokens"]) <= tok]
        assert r["confidence"] == pytest.approx(sum(hit) / len(hit)) and r["confidence"] >= urls.CONFIDENCE and sum(hit) >= urls.MIN_HITS


# ---- 10 ---------------------------------------------------------------------------------------------------------


def test_warc_round_trip(spark, tmp_path):
    big = "é<p>" * 400_000
    html = ["x" * 100, "x" * 100, "x" * 99, "x" * 99, None, "", big, big, "a\r\n\r\nWARC/1.1\r\n" * 20]
    pages = spark.createDataFrame([(10 - i, f"http://h/{i}\nq" if i % 2 else None, h, "z") for i, h in enumerate(html)] + [(None, "u", "h", "z"), (None, None, html[0], "z"), (None, None, "q" * 200, "z"), (None, None, "q" * 200, "z")], "page_id long, url string, html string, record_type string")
    paths = warc.archive(pages)
    chunks = warc.read_archives(paths).collect()
    bodies = {}
    for c in sorted((c for c in chunks if c["page_id"] is not None), key=lambda c: (c["page_id"], c["chunk_no"])):
        bodies.setdefault(c["page_id"], []).append(c)
    for i, h in enumerate(html):
        rows, raw = bodies[10 - i], (h or "").encode()
        assert [r["chunk_no"] for r in rows] == list(range(len(rows))) and [r["is_last"] for r in rows] == [False] * (len(rows) - 1) + [True]
        if rows[0]["record_type"] == "response":
            assert b"".join(bytes(r["payload"]) for r in rows) == raw and len(rows) == max(1, -(-len(raw) // warc.CHUNK_BYTES))
            for r in rows:
                assert r["digest_upto"] == hashlib.sha256(raw[: r["payload_upto"]]).hexdigest()
    rows = warc.round_trip(pages).collect()
    got = {r["page_id"]: tuple(r)[1:] for r in rows if r["page_id"] is not None}
    first = {}
    for i, h in sorted(enumerate(html), key=lambda x: 10 - x[0]):
        first.setdefault((h or "").encode(), 10 - i)
    for i, h in enumerate(html):
        raw = (h or "").encode()
        kept = first[raw] if len(raw) >= 100 else 10 - i
        assert got[10 - i] == (len(raw), hashlib.sha256(raw).hexdigest(), "response" if kept == 10 - i else "revisit", None if kept == 10 - i else kept)
    assert len(got) == len(html)
    # pages without id become records too
    without = sorted((r["payload_bytes"], r["record_type"], r["refers_to"]) for r in rows if r["page_id"] is None)
    assert without == [(1, "response", None), (100, "revisit", 9), (200, "response", None), (200, "response", None)]
    assert len({c["record_id"] for c in chunks}) == len(rows)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_truncated_file_is_told():
    import gzip
    import io

    record = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <u>\r\nWARC-Payload-Digest: sha256:x\r\nX-Page-ID: 1\r\nX-Payload-Length: 50\r\nContent-Length: 69\r\n\r\nHTTP/1.1 200 OK\r\n\r\n" + b"y" * 20
    with pytest.raises(EOFError):
        list(warc.records_of(io.BytesIO(gzip.compress(record))))


# ---- 5 ----------------------------------------------------------------------------------------------------------


def exact(ids, x, q, k):
    d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
    order = [i for i in np.lexsort((ids, d)) if i != q][:k]
    return [(int(ids[i]), float(d[i])) for i in order]


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 1, (300, 8)) for c in rng.normal(0, 6, (5, 8))] + [np.ones((200, 8))]).astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9000, None, 0), (9100, [0.0] * 8, 0), (9200, [float("nan")] * 8, 0), (9300, [1.0, None] * 4, 0), (9400, [float("inf")] * 8, 0), (9500, [1.0], 0), (None, [1.0] * 8, 0)]
    vectors = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, rank int")
    found, report = ann.nearest(vectors, F.col("vec_id") % 100 == 0)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    ids, d = np.arange(len(x)), x.astype(np.float64)
    assert set(got) == {i for i in range(len(x)) if i % 100 == 0} and report["recall"] >= 0.9
    hit = sum(len({v for _, v, _ in got[q]} & {v for v, _ in exact(ids, d, q, 10)}) for q in got)
    assert hit / (10 * len(got)) >= 0.9
    for q, rs in got.items():
        assert [r[0] for r in sorted(rs)] == list(range(1, 11))
        for _, v, s in rs:
            assert s == pytest.approx(math.sqrt(((d[q] - d[v]) ** 2).sum()), abs=1e-12)
    assert sorted(v for _, v, s in got[1600] if s == 0) == list(range(1500, 1510))


def test_nearest_few_rows(spark):
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    found, _ = ann.nearest(v, F.col("vec_id") == 0)
    assert [tuple(r) for r in found.orderBy("rank").collect()] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.nearest(v.limit(0), F.col("vec_id") == 0)[0].count() == 0


# ---- 2 ----------------------------------------------------------------------------------------------------------


def test_hamming_search(spark):
    rng = random.Random(9)
    codes = [rng.getrandbits(64) for _ in range(150)] + [5] * 60 + [5 ^ 1, 5 ^ 3]
    rows = [(i, c - 2**64 if c >= 2**63 else c) for i, c in enumerate(codes)] + [(7000, None), (None, 3), (3, rows_code(codes[3]))]
    table = spark.createDataFrame(rows, "vec_id long, code long")
    got = {}
    for r in binary.search(table, F.col("vec_id") % 10 == 0, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["distance"])
    for q in range(0, len(codes), 10):
        want = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:5]
        assert got[q] == {n: (i, d) for n, (d, i) in enumerate(want, 1)}
    assert binary.search(table.limit(0), F.col("vec_id") == 0).count() == 0
    few = binary.search(spark.createDataFrame([(0, 1), (1, 2)], "vec_id long, code long"), F.col("vec_id") == 0, k=10)
    assert [tuple(r) for r in few.collect()] == [(0, 1, 1, 2)]


def test_hamming_search_by_blocks(spark, monkeypatch):
    """Probes stay in the tasks: before, they were rows that a plan took for few and sent to the driver. Small blocks, parts and runs give what brute force gives, far queries too."""
    rng = random.Random(10)
    near = [rng.getrandbits(64) for _ in range(20)]
    codes = [rng.getrandbits(64) for _ in range(300)] + [near[k % 20] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for k in range(300)] + [0, 2**64 - 1] + [7] * 30
    table = spark.createDataFrame([(i, rows_code(c)) for i, c in enumerate(codes)], "vec_id long, code long")
    plans, kept = [], binary.written
    monkeypatch.setattr(binary, "written", lambda df, name: plans.append(df._jdf.queryExecution().toString()) or kept(df, name))
    for name, value in ((None, None), ("BLOCK_ROWS", 100), ("QUERY_ROWS", 7), ("HELD", 9), ("RUN", 5)):
        if name:
            monkeypatch.setattr(binary, name, value, raising=False)
        if name in (None, "QUERY_ROWS", "RUN"):
            got = {}
            found = binary.search(table, F.col("vec_id") % 20 == 0, k=5)
            plans.append(found._jdf.queryExecution().toString())
            for r in found.collect():
                got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["distance"])
            for q in range(0, len(codes), 20):
                want = sorted((bin(codes[q] ^ c).count("1"), i) for i, c in enumerate(codes) if i != q)[:5]
                assert got[q] == {n: (i, d) for n, (d, i) in enumerate(want, 1)}
            assert not any("MapInPandas" in p for p in plans)


def rows_code(c):
    return c - 2**64 if c >= 2**63 else c


def test_sign_codes(spark):
    v = spark.createDataFrame([(1, [1.0, -1.0, 0.0, 2.0]), (2, None), (3, [1.0]), (4, [1.0, None, 1.0, 1.0]), (5, [float("nan")] * 4)], "vec_id long, e array<double>")
    assert [r["c"] for r in v.select(binary.sign_code(F.col("e"), 4).alias("c")).collect()] == [9, None, None, None, None]


# ---- 9 ----------------------------------------------------------------------------------------------------------


def brute_substrings(rows):
    first, parts = {}, {}
    for k, t in sorted((k, t) for k, t in rows if t is not None):
        w = parts[k] = t.encode().split()
        for i in range(len(w) - 19):
            first.setdefault(tuple(w[i : i + 20]), (k, i))
    out = {}
    for k, w in parts.items():
        gone = set()
        for i in range(len(w) - 19):
            if first[tuple(w[i : i + 20])] != (k, i):
                gone |= set(range(i, i + 20))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out[k] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("kinds", [3, 400])
def test_substrings(spark, kinds):
    rng = random.Random(kinds)
    passage, long = words(rng, 55, kinds), words(rng, 300, kinds)
    rows = [(k, words(rng, rng.randint(0, 120), kinds)) for k in range(40)]
    rows += [(100 + k, f"{words(rng, rng.randint(0, 30), kinds)}  {passage}\n{words(rng, rng.randint(0, 30), kinds)}") for k in range(30)]
    rows += [(200 + k, " ".join(w if i != 7 * k else "edit" for i, w in enumerate(long.split()))) for k in range(20)]
    rows += [(300, passage + " " + passage), (301, " ".join(passage.split()[:20])), (302, " ".join(passage.split()[:19])), (303, ""), (305, "same " * 400), (306, "é" * 3000), (307, long), (308, long)]
    table = docs(spark, [(k, t, "en", "s") for k, t in rows] + [(400, None, "en", "s"), (None, long, "en", "s")])
    got = factors.factored(table).collect()
    want = brute_substrings(rows)
    for r in got:
        if r["doc_id"] is None:
            assert (r["n_words"], r["n_removed"]) == (300, 0)
        elif r["doc_id"] == 400:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (0, 0, hashlib.sha256(b"").hexdigest())
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
    assert len(got) == len(rows) + 2
    texts = {k: t.split() for k, t in rows}
    for r in got:
        for f in r["factors"] or []:
            assert f["length"] >= 20 and texts[r["doc_id"]][f["start"] : f["start"] + f["length"]] == texts[f["ref_doc"]][f["ref_start"] : f["ref_start"] + f["length"]]
            assert (f["ref_doc"], f["ref_start"]) < (r["doc_id"], f["start"])


def test_substrings_across_bounds(spark, monkeypatch):
    """Hash pieces and phrase steps that cut documents change nothing."""
    rng = random.Random(12)
    x = words(rng, 700)
    text = [(1, x), (2, "a b " + x), (3, x[: len(x) // 2])]
    whole = [list(zip(*(v.tolist() for v in part), strict=True)) for part in factors._stretches(factors._hashes(text[0][1].encode()), np.full(700, 700))]
    monkeypatch.setattr(factors, "HASH_BYTES", 64)
    assert (factors._hashes(x.encode()) == np.concatenate([factors._hashes(w.encode()) for w in x.split()])).all()
    monkeypatch.setattr(factors, "STEP", 50)
    cut = [r for part in factors._stretches(factors._hashes(x.encode()), np.full(700, 700)) for r in zip(*(v.tolist() for v in part), strict=True)]
    assert sum(r[3] for r in cut) == sum(r[3] for r in whole[0]) == 681
    assert {r[0] for r in cut} == {r[0] for r in whole[0]}


def test_substrings_empty(spark):
    assert factors.factored(docs(spark, [])).count() == 0
