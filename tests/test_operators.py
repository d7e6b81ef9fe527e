"""Operators against brute force and expected rows on small frames."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.operators import graph as G
from quire.operators import jobs as J
from quire.operators import matching as M
from quire.operators import registry as Q
from quire.operators import reports as R_
from quire.operators import retrieval as R
from quire.sources import readers, sinks
from quire.streaming import accounting as S


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_block_loses_no_match(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("abcde ") for _ in range(rng.randint(4, 40))) for _ in range(60)]
    edited = []
    for t in base:
        s = list(t)
        for _ in range(rng.randint(0, 6)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "yz"])
        edited.append("".join(s))
    key = lambda t: " ".join(sorted(" ".join(t.lower().split()).split(" ")))
    refs = spark.createDataFrame(list(enumerate(edited)), "ref_id long, title string")
    papers = spark.createDataFrame(list(enumerate(base)), "work long, title string")
    got = {r["ref_id"]: r["score"] for r in M.resolve_refs_fuzzy(refs, papers, partial=None).collect()}
    want = {}
    for i, e in enumerate(edited):
        scores = [100 * (1 - levenshtein(key(e), key(b)) / max(len(key(e)), len(key(b)))) for b in base if key(e) and key(b)]
        if scores and max(scores) >= 85 - 1e-9:
            want[i] = round(max(scores), 6)
    assert got == pytest.approx(want)


def test_contained_titles_of_all_lengths(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "xxalpha beta gamma delta epsilon zeta etayy"), (2, "aa supercalifragilisticexpialidociously bb"), (3, "one longlonglonglongmiddle threeish x")], "text_id long, norm string")
    titles = spark.createDataFrame([(10, "alpha beta gamma delta epsilon zeta eta"), (20, "califragilisticexpialidocious"), (30, "ne longlonglonglongmiddle thr"), (40, "short")], "title_id long, norm string")
    for most in (M.AUTOMATON_TITLES, 2):  # in one pass over the texts, and by joins
        monkeypatch.setattr(M, "AUTOMATON_TITLES", most)
        assert {(r["text_id"], r["title_id"]) for r in M.contained_titles(texts, titles).collect()} == {(1, 10), (2, 20), (3, 30)}


def test_lineage_takes_the_least_shortest_path(spark):
    edges = spark.createDataFrame([("e1", "a", "b"), ("e2", "b", "c"), ("e3", "a", "d"), ("e4", "d", "c"), ("e5", "c", "z")], "edge string, src string, dst string")
    pairs = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a"), ("a", "z"), ("a", "q")], "src string, dst string")
    got = {(r["src"], r["dst"]): (r["hops"], r["path"]) for r in G.lineage(pairs, edges).collect()}
    assert got == {("a", "c"): (2, ["e1>", "e2>"]), ("c", "a"): (2, ["e2<", "e1<"]), ("a", "a"): (0, []), ("a", "z"): (3, ["e1>", "e2>", "e5>"])}


def test_pagerank_sums_to_one(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    rank = {r["node"]: r["rank"] for r in G.pagerank(e, 30).collect()}
    assert sum(rank.values()) == pytest.approx(1) and rank["a"] == max(rank.values()) and rank["d"] == min(rank.values())


def brute_chunks(prefix, texts, most):
    out, cur, n = [], [], len(prefix)
    for t in texts:
        if cur and n + len(t) + 2 > most:
            out.append(prefix + "\n\n".join(cur))
            cur, n = [], len(prefix)
        cur.append(t)
        n += len(t) + 2
    return out + [prefix + "\n\n".join(cur)] if cur else out


def test_chunks_pack_greedily(spark):
    rng = random.Random(1)
    texts = {(d, s): ["w" * rng.randint(1, 90) for _ in range(rng.randint(1, 12))] for d in range(4) for s in range(3)}
    rows = [(d, s, i, t, f"[{d}] ") for (d, s), ts in texts.items() for i, t in enumerate(ts)]
    got = J.chunked(spark.createDataFrame(rows, "doc_id long, section int, pos int, text string, prefix string"), 120)
    want = sorted((d, s, c) for (d, s), ts in texts.items() for c in brute_chunks(f"[{d}] ", ts, 120))
    assert sorted((r["doc_id"], r["section"], r["content"]) for r in got.collect()) == want


def test_page_rows():
    html = "<title>T &amp; U</title><h2>Head</h2><p>one <a href='/x'>two</a><p>three<table><tr><td>a<td>b<tr><td>c</table><script>no</script>"
    rows = J.page_rows(7, html)
    assert [(r[1], r[5]) for r in rows] == [("section", "T & U"), ("section", "Head"), ("node", "one two"), ("link", ""), ("node", "three"), ("cell", "a"), ("cell", "b"), ("cell", "c")]
    assert [(r[7], r[8]) for r in rows if r[1] == "cell"] == [(0, 0), (0, 1), (1, 0)]
    assert rows[3][3] == rows[2][2] and rows[3][6] == "/x"
    assert J.page_rows(1, "<<<>&#x; <p") is not None
    rows = J.page_rows(8, '<section><title>S</title><p>as <Math tex="x^2"><mi>x</mi></Math> in <cite><bibref bibrefs="a,b"/></cite> and <ref labelref="eq1"/>.</p><bibliography><bibitem key="a">A. Lee, <i>Title</i></bibitem></bibliography></section>')
    assert [(r[1], r[5], r[6]) for r in rows] == [("section", "S", None), ("node", "as $x^2$ in [a,b] and [eq1].", None), ("math", "", "x^2"), ("cite", "", "a,b"), ("cite", "", "eq1"), ("reference", "A. Lee, Title", "a")]
    assert [r[3] for r in rows if r[1] in ("math", "cite")] == [1, 1, 1]


def test_lexical_forms(spark):
    p = spark.createDataFrame([(1, "red fox runs"), (2, "red dog sleeps"), (3, "fox and red dog"), (4, None)], "id long, text string")
    q = spark.createDataFrame([(1, "red fox"), (2, "fox or dog -sleeps"), (3, '"red dog"'), (4, ""), (5, "absent")], "query_id long, q string")
    got = {}
    for r in R.lexical_search(q, p, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    assert got == {1: {1, 3}, 2: {1, 3}, 3: {2, 3}}


def test_hybrid_degrades_without_vectors(spark):
    p = spark.createDataFrame([(1, "red fox"), (2, "blue fox")], "id long, text string")
    q = spark.createDataFrame([(1, "fox", None)], "query_id long, q string, v array<float>")
    assert [(r["id"], r["degraded"]) for r in R.hybrid_search(q, p, None, 5).orderBy("rank").collect()] == [(1, True), (2, True)]


def test_registry(spark):
    reg = spark.createDataFrame([("r1", "rel", "relational", "h", "sealed", None), ("g1", "rel", "graph", "h2", "sealed", "r1"), ("v1", "rel", "vector", "h3", "failed", "r1"), ("x1", "old", "graph", "h4", "sealed", "r0")], "build_id string, release string, kind string, config_hash string, status string, parent string")
    want = lambda *rows: spark.createDataFrame(rows, "kind string, build_id string")
    faults = {(r["build_id"], r["fault"]) for r in Q.validate_builds(reg, want(("relational", "r1"), ("vector", "v1"), ("graph", "x1"), ("lexical", "zz"))).collect()}
    assert faults == {("v1", "not_sealed"), ("x1", "other_release"), ("zz", "unknown")}
    snap = Q.create_snapshot(reg, want(("relational", "r1"), ("graph", "g1")), "s1")
    with pytest.raises(ValueError, match="not_sealed"):
        Q.create_snapshot(reg, want(("relational", "r1"), ("vector", "v1")), "s2")
    assert Q.sealed_build(reg, "rel", "graph", "h2") == "g1" and Q.sealed_build(reg, "rel", "graph", "no") is None
    proj = spark.createDataFrame([(1, "g1"), (2, "g0")], "id long, build_id string")
    channels = spark.createDataFrame([("live", "s1")], "channel string, snapshot string")
    assert [r["id"] for r in Q.read_as_of(proj, snap, channels, "live", "graph").collect()] == [1]
    counts = spark.createDataFrame([("r1", 5), ("g1", 0)], "build_id string, n long")
    assert {r["kind"]: r["state"] for r in Q.readiness(snap, counts, ["relational", "graph", "vector"]).collect()} == {"relational": "ready", "graph": "empty", "vector": "missing"}
    assert Q.config_hash("a", {"x": 1, "y": 2}) == Q.config_hash("a", {"y": 2, "x": 1})


def test_readers(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.json").write_text('{\n"paper_id": "p1", "title": "T", "authors": ["A"], "year": 2020}')
    (tmp_path / "docs" / "b.json").write_text("{broken")
    assert [r["paper_id"] for r in readers.read_parsed_docs(spark, str(tmp_path / "docs")).collect()] == ["p1"]
    (tmp_path / "logs" / "proj").mkdir(parents=True)
    (tmp_path / "logs" / "proj" / "week-2024-W01.jsonl").write_text('{"text": "hi", "role": "user"}\nnot json\n{"text": "yo", "project": "own"}\n')
    assert sorted(r["project"] for r in readers.read_week_logs(spark, str(tmp_path / "logs")).collect()) == ["own", "proj"]
    (tmp_path / "m.csv").write_text("﻿paper_id,title,size_bytes,sha256,quality_tier\np1,T,3,ab,clean\n")
    r = readers.read_manifest(spark, str(tmp_path / "m.csv")).first()
    assert (r["paper_id"], r["size_bytes"]) == ("p1", 3)
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A\n  B</title><author><name>X Y</name></author><published>2023-05-01T00:00:00Z</published><id>http://arxiv.org/abs/2305.00001v2</id><summary>s</summary><link title="pdf" href="u"/></entry></feed>'
    (tmp_path / "f.xml").write_text(atom)
    r = readers.read_arxiv_atom(spark, str(tmp_path / "f.xml")).first()
    assert (r["title"], r["authors"], r["year"], r["arxiv_id"], r["pdf_url"]) == ("A B", ["X Y"], 2023, "2305.00001", "u")
    assert readers.read_documents_xml(spark, str(tmp_path / "f.xml")).count() == 1
    (tmp_path / "facts.txt").write_text("paper p1 2020\n-- comment\ninnovation i1 l1 c1 2021 3 4 5\nreplaces i1 i2\n")
    got = {r["kind"]: (r["id"], r["year"], r["a"], r["target"]) for r in readers.read_innovation_facts(spark, str(tmp_path / "facts.txt")).collect()}
    assert got == {"paper": ("p1", 2020, None, None), "innovation": ("i1", 2021, 3, None), "replaces": (None, None, None, "i2")}
    (tmp_path / "chat.jsonl").write_text('{"role": "user", "content": [{"type": "text", "text": "a <b>x</b>"}, {"type": "image"}]}\n{"role": "assistant", "content": "plain"}\n{"role": "user", "content": ""}\nbroken\n')
    assert [(r["role"], r["text"]) for r in readers.read_transcripts(spark, str(tmp_path / "chat.jsonl")).collect()] == [("user", "a x"), ("assistant", "plain")]


def test_sinks(spark, tmp_path):
    g = spark.createDataFrame([("b", "clean", []), ("a", "failed", ["x", "y"]), ("c", "degraded", ["z"])], "paper_id string, tier string, reasons array<string>")
    sinks.write_manifest(g, str(tmp_path / "m"))
    sinks.write_failed(g, str(tmp_path / "f"))
    assert [r["paper_id"] for r in spark.read.csv(str(tmp_path / "m"), header=True).collect()] == ["b", "c"]
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "f"), header=True).collect()] == [("a", "x;y")]
    sinks.write_notes(spark.createDataFrame([(1, "T", "An abstract.", "s")], "doc_id long, title string, abstract string, source string"), str(tmp_path / "n"))
    assert "# T" in "".join(r["value"] for r in spark.read.text(str(tmp_path / "n")).collect())
    t = spark.createDataFrame([("p", "w", "s", i) for i in range(4)], "project string, week string, session string, seq int")
    sinks.append_week_log(t, t.where("seq < 3").select("project", "week", "session"), str(tmp_path / "log"))
    assert [r["seq"] for r in spark.read.json(str(tmp_path / "log")).collect()] == [3]


def stream_rows(spark, tmp_path, rows, schema, make, batches=2):
    """Runs a stream over rows in several files, one a micro-batch."""
    for b in range(batches):
        spark.createDataFrame(rows[b::batches] if batches == 1 else rows[len(rows) * b // batches : len(rows) * (b + 1) // batches], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{b}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = make(s)
    S.drained(out, str(tmp_path / "out"), str(tmp_path / "state"))
    return spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()


def at(seconds):
    import datetime as dt

    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def test_leases_end_once(spark, tmp_path):
    rows = [(1, at(0), "a", "reserve"), (2, at(5), "a", "refresh"), (3, at(12), "a", "complete"), (4, at(13), "a", "fail"), (5, at(0), "b", "reserve"), (6, at(30), "b", "complete")]
    got = {r["event_id"]: r["result"] for r in stream_rows(spark, tmp_path, rows, "event_id long, ts timestamp, lease string, action string", lambda s: S.stream_leases(s, 10))}
    assert got == {1: "active", 2: "extended", 3: "completed", 4: "ignored_completed", 5: "active", 6: "ignored_expired"}


def test_circuit_opens_probes_and_closes(spark, tmp_path):
    rows = [(1, at(0), 1, False), (2, at(1), 1, False), (3, at(2), 1, True), (4, at(12), 1, True), (5, at(13), 1, True)]
    got = {r["event_id"]: (r["state"], r["allowed"]) for r in stream_rows(spark, tmp_path, rows, "event_id long, ts timestamp, backend long, ok boolean", lambda s: S.stream_circuit(s, 2, 10))}
    assert got == {1: ("closed", True), 2: ("closed", True), 3: ("open", False), 4: ("half_open", True), 5: ("closed", True)}


def test_admission_limits_concurrency(spark, tmp_path):
    rows = [(1, at(0), 1), (2, at(1), 1), (3, at(2), 1), (4, at(11), 1), (5, at(61), 1)]
    got = {r["event_id"]: r["reason"] for r in stream_rows(spark, tmp_path, rows, "event_id long, ts timestamp, tenant long", lambda s: S.stream_admission(s, 3, 60, concurrency=2, ttl=10))}
    assert got == {1: "ok", 2: "ok", 3: "concurrency_limit", 4: "ok", 5: "ok"}


def test_ingest_again_adds_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "doc_id long, text string").write.parquet(str(tmp_path / "in"))
    for k in range(2):
        s = spark.readStream.schema("doc_id long, text string").parquet(str(tmp_path / "in"))
        S.stream_ingest(s, lambda x: x.withColumn("n", F.length("text")), str(tmp_path / "out"), str(tmp_path / f"state{k}")).awaitTermination()
    assert sorted(r["doc_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1, 2]


def test_title_matches_against_all_pairs(spark):
    rng = random.Random(11)
    word = lambda: rng.choice(["the", "of", "a", "deep", "nets", "fast", "graph", "x1", "y2", "z3", "learning"])
    left = {i: " ".join(word() for _ in range(rng.randint(1, 6))) for i in range(80)} | {900: "", 901: "deep"}
    right = {i: " ".join(word() for _ in range(rng.randint(1, 7))) for i in range(60)} | {800: "eep net", 801: "deep"}
    table = lambda rows, k: spark.createDataFrame(list(rows.items()), f"{k} long, title string")
    got = {r["a"]: (r["tier"], r["score"]) for r in M.match_titles_overlap(table(left, "a"), table(right, "b")).collect()}
    jac = {r["a"]: r["score"] for r in M.match_metadata_jaccard(table(left, "a"), table(right, "b")).collect()}
    want, want_jac = {}, {}
    for a, s in left.items():
        ws = set(s.split())
        for t in right.values():
            wt, common = set(t.split()), ws & set(t.split())
            tier = (3, 1.0) if s == t and s else (2, float(min(len(s), len(t)))) if s and (s in t or t in s) else (1, round(len(common) / max(len(ws), len(wt)), 6)) if common and len(common) / max(len(ws), len(wt)) > 0.7 else None
            if tier:
                want[a] = max(want.get(a, tier), tier)
            score = len(common) / len(ws | wt) if ws else 0
            if score > (0.5 if len(ws) <= 4 else 0.6):
                want_jac[a] = max(want_jac.get(a, 0), round(score, 6))
    assert got == want
    assert jac == pytest.approx(want_jac)


def test_titles_inside_words_and_short_keys(spark):
    """Containment needs no common word, and a slug may hold a query with blanks or of few characters."""
    left = spark.createDataFrame([(1, "net"), (2, "ab"), (3, "zzz")], "a long, title string")
    right = spark.createDataFrame([(10, "resnet"), (11, "x cab y")], "b long, title string")
    assert {r["a"]: (r["b"], r["tier"]) for r in M.match_titles_overlap(left, right).collect()} == {1: (10, 2), 2: (11, 2)}
    papers = spark.createDataFrame([(1, "2401.00001", "10.1/A", "a-deep-net"), (2, None, None, "no_hyphen"), (3, None, None, "10.x-deep")], "paper_id long, arxiv_id string, doi string, slug string")
    q = spark.createDataFrame([("deep net",), (" Deep-NET ",), ("ne",), ("p",), ("a-deep-net",), ("2401.00001",), ("10.1/A",), ("hyphen",), ("",), (None,)], "q string")
    got = {r["q"]: (r["paper_id"], r["way"]) for r in M.resolve_paper_keys(q, papers).collect()}
    assert got == {"deep net": (1, 3), " Deep-NET ": (1, 3), "ne": (1, 3), "p": (1, 3), "a-deep-net": (1, 0), "2401.00001": (1, 0), "10.1/A": (1, 0), "hyphen": (None, None), "": (None, None), None: (None, None)}


def brute_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_partial(a, b):
    short, long = sorted((a, b), key=len)
    n = len(short)
    windows = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
    return max(200.0 * brute_common(short, w) / (n + len(w)) for w in windows)


def test_fuzzy_titles_against_all_pairs(spark):
    rng = random.Random(21)
    base = ["deep residual learning for images", "graph networks of many kinds", "a study of fast attention", "on word vectors"]

    def changed(t):
        t = list(t)
        for _ in range(rng.randint(0, 3)):
            t[rng.randrange(len(t))] = rng.choice("abcxyz ")
        return "".join(t)

    papers = {i: changed(rng.choice(base)) for i in range(30)}
    refs = {100 + i: rng.choice([lambda t: t, lambda t: t[4:], lambda t: t + " and more", lambda t: " ".join(reversed(t.split())), lambda t: t[: len(t) // 3]])(changed(rng.choice(base))) for i in range(60)} | {900: "", 901: "unlike all"}
    norm = lambda t: " ".join(t.split())
    tokens = lambda t: " ".join(sorted(norm(t).split()))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {}
    for r, t in refs.items():
        if not norm(t):
            continue
        scored = [(round(100 * (1 - distance(tokens(t), tokens(p)) / max(len(tokens(t)), len(tokens(p)))), 6), -w) for w, p in papers.items()]
        best = max(x for x in scored)
        if best[0] < 85:
            n = len(norm(t))
            scored = [(round(brute_partial(norm(t), norm(p)), 6), -w) for w, p in papers.items() if 2 * min(n, len(norm(p))) > max(n, len(norm(p)))]
            best = max(scored, default=(0, 0))
            if best[0] < 95:
                continue
        want[r] = (-best[1], best[0])
    table = lambda rows, k: spark.createDataFrame(list(rows.items()), f"{k} long, title string")
    got = {r["ref_id"]: (r["work"], r["score"]) for r in M.resolve_refs_fuzzy(table(refs, "ref_id"), table(papers, "work")).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx({k: v[1] for k, v in want.items()})
    assert all(norm(papers[got[k][0]]) == norm(papers[v[0]]) or got[k] == v for k, v in want.items())


def test_lease_expires_by_the_watermark(spark, tmp_path):
    """No event of lease b comes after its time, and one of lease c comes too late."""
    rows = [(1, at(0), "b", "reserve"), (2, at(0), "a", "reserve"), (3, at(9000), "a", "refresh"), (4, at(9001), "d", "reserve"), (7, at(9001), "e", "reserve"), (8, at(9001), "e", "fail"), (5, at(1), "c", "reserve"), (6, at(9002), "d", "complete")]
    got = {(r["event_id"], r["lease"]): r["result"] for r in stream_rows(spark, tmp_path, rows, "event_id long, ts timestamp, lease string, action string", lambda s: S.stream_leases(s, 10), batches=4)}
    assert got[(None, "b")] == "expired" and (5, "c") not in got and got[(6, "d")] == "completed"


def test_late_events_are_counted(spark, tmp_path):
    schema = "ts timestamp, tenant long, outcome string, bytes long"
    for b, rows in enumerate([[(at(10_000), 1, "forwarded", 1)], [(at(20_000), 1, "forwarded", 1)], [(at(5), 1, "failed", 1), (at(20_001), 1, "failed", 1)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{b}"))
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    assert S.drained(S.stream_usage(s, 3600), str(tmp_path / "out"), str(tmp_path / "state")) == 1


def test_reports(spark):
    sections = spark.createDataFrame([(1, 0, "method"), (1, 1, "limitations"), (2, 0, "method"), (3, 0, "conclusion")], "doc_id long, ordinal int, role string")
    assert sorted(r["doc_id"] for r in R_.compare_methods(sections, [1, 2]).collect()) == [1, 2]
    with pytest.raises(ValueError, match="2 to 10"):
        R_.compare_methods(sections, [1])
    assert sorted((r["doc_id"], r["role"]) for r in R_.gap_evidence(sections).collect()) == [(1, "limitations"), (3, "conclusion")]
    assert R_.method_sections(sections, spark.createDataFrame([(2,)], "doc_id long")).count() == 1
    events = spark.createDataFrame([(1, "forwarded", 5.0, 10, 1), (1, "failed", None, None, None)], "tenant long, outcome string, latency double, bytes long, quota long")
    got = {r["tenant"]: (r["n"], r["latencies"], r["avg_latency"], r["bytes"], r["quota"]) for r in R_.usage_by_tenant(events, spark.createDataFrame([(1,), (2,)], "tenant long")).collect()}
    assert got == {1: (2, 1, 5.0, 10, 1), 2: (0, 0, None, 0, 0)}


def test_common_neighbours_are_bounded(spark):
    e = spark.createDataFrame([(s, t) for s in (1, 2, 3) for t in (10, 11, 12)] + [(3, 13)], "src long, dst long")
    assert {(r["a"], r["b"]): r["n"] for r in G.coupling(e).collect()} == {(1, 2): 3, (1, 3): 3, (2, 3): 3}
    assert {(r["a"], r["b"]) for r in G.cocitation(e, 3).collect()} == {(10, 11), (10, 12), (11, 12)}
    assert G.concept_pairs(e.select(F.col("src").alias("work"), F.col("dst").alias("concept"))).count() == 3
    for most in (1, 2):
        assert sorted(map(tuple, G.cocitation(e, 1, most=most).collect())) == sorted(map(tuple, G.cocitation(e, 1).collect()))


def test_words_that_are_operators_or_repeated(spark):
    """A quoted `or` is a word; a term that is asked for twice in one group counts twice; words that cancel out still give a unit vector."""
    from quire.operators import retrieval as R

    p = spark.createDataFrame([(1, "annt or oferen"), (2, "annt oferen")], "id long, text string")
    q = spark.createDataFrame([(1, 'annt "or" oferen'), (2, "annt or annt"), (3, "annt"), (4, '"or" or "zz"'), (5, '"annt oferen"')], "query_id long, q string")
    got = {(r["query_id"], r["id"]): r["score"] for r in R.lexical_search(q, p, 9).collect()}
    assert set(got) == {(1, 1), (2, 1), (2, 2), (3, 1), (3, 2), (4, 1), (5, 2)}
    assert got[2, 1] == round(2 * got[3, 1], 6)
    text = spark.createDataFrame([("[Ereaea.] Ereaea.",), ("",)], "text string")
    lengths = [round(sum(x * x for x in r["v"]), 6) for r in text.select(R.hashed_embedding(text["text"]).alias("v")).collect()]
    assert lengths == [1.0, 0.0]


def test_slugs_by_rare_substrings(spark):
    """What all slugs have in common joins nothing: 400 queries that begin like all of 400 slugs meet their own slug alone."""
    from quire.operators import matching as M

    p = spark.range(400).selectExpr("id as paper_id", "cast(null as string) as arxiv_id", "cast(null as string) as doi", "concat('slug-src-', id + 1000, '-end') as slug")
    q = p.selectExpr("concat('SRC ', paper_id + 1000, ' e') as q").unionByName(spark.createDataFrame([("src-1",), ("nowhere-1",), ("ug",), ("1007-en",)], "q string"))
    got = {r["q"]: (r["paper_id"], r["way"]) for r in M.resolve_paper_keys(q, p).collect()}
    assert all(got[f"SRC {k + 1000} e"] == (k, 3) for k in range(400))
    assert (got["src-1"], got["nowhere-1"], got["ug"], got["1007-en"]) == ((0, 3), (None, None), (0, 3), (7, 3))


def test_lineage_does_not_go_through_leaves(spark):
    """A hub with 20,000 leaves: pairs of leaves of two hubs are found, and no step makes more rows than there are pairs and edges."""
    from quire.operators import graph as G

    e = spark.range(20_000).selectExpr("concat('e', id) as edge", "concat('c', id) as src", "concat('n', id % 2) as dst").unionByName(spark.createDataFrame([("r0", "n0", "r"), ("r1", "n1", "r")], "edge string, src string, dst string"))
    pairs = spark.range(19_999).selectExpr("concat('c', id) as src", "concat('c', id + 1) as dst")
    got = G.lineage(pairs, e)
    assert got.where("hops = 4").count() == 19_999
    assert got.where("src = 'c4'").first()["path"] == ["e4>", "r0>", "r1<", "e5<"]


def brute_covers(words, groups):
    last, low, score = [-1] * len(groups), -1, 0.0
    for at, w in enumerate(words):
        if any(w in g for g in groups):
            last = [at if w in g else x for x, g in zip(last, groups, strict=True)]
            if min(last) > low:
                low = min(last)
                score += 1 / (1 + max(0, at - low + 1 - len(groups)))
    return score


def test_search_by_segments(spark, tmp_path):
    """Postings are made without a shuffle; segments, searched apart, give what a search of each text gives, with an index and without."""
    rng = random.Random(5)
    texts = [(k, " ".join(rng.choice(["a", "b", "c", "or", f"w{rng.randint(0, 3)}"]) for _ in range(rng.randint(0, 30)))) for k in range(120)] + [(500, None), (501, ""), (502, "?!")]
    p = spark.createDataFrame(texts, "id long, text string").repartition(3)
    assert "Exchange" not in R.postings(spark.createDataFrame(texts, "id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert R.postings(p).where("term = ''").count() == 3
    asked = {1: ("a b", [["a"], ["b"]], [], None), 2: ("a or b -w1", [["a", "b"]], ["w1"], None), 3: ("a a w2", [["a"], ["a"], ["w2"]], [], None), 4: ('"a b c"', [["a"], ["b"], ["c"]], [], "a b c"), 5: ("a or b b or c", [["a", "b"], ["b", "c"]], [], None), 6: ("zz a", [["zz"], ["a"]], [], None)}
    asked[7] = ('"a or b"', [["a", "b"]], [], "a or b")  # `or` is an operator, but a word of the phrase
    want = {}
    for qid, (_, groups, never, phrase) in asked.items():
        for k, t in texts:
            words = (t or "").split()
            if all(set(g) & set(words) for g in groups) and not set(never) & set(words) and (phrase is None or f" {phrase} " in f" {t} "):
                want[qid, k] = round(brute_covers(words, groups), 6)
    q = spark.createDataFrame([(k, v[0]) for k, v in asked.items()], "query_id long, q string")
    index = R.index_passages(p, str(tmp_path / "index"))
    for rows in (R.cover_search(q, p, 200), R.cover_search(q, p, 200, index)):
        assert {(r["query_id"], r["id"]): r["score"] for r in rows.collect()} == pytest.approx(want)
    assert {qid for qid, _ in want} == {1, 2, 3, 4, 5, 7}
    best = {(r["query_id"], r["rank"]): r["id"] for r in R.cover_search(q, p, 3).collect()}
    for qid in (1, 2, 3, 4, 5):
        assert [best[qid, n] for n in (1, 2, 3)] == [k for _, k in sorted((-s, k) for (i, k), s in want.items() if i == qid)[:3]]


def test_millionths_round_as_spark_does(spark):
    rng = random.Random(6)
    x = [rng.randint(0, 10**9) / 2e6 for _ in range(2000)] + [rng.random() * 100 for _ in range(2000)] + [0.0, 1.0000005, 2.0000015]
    got = [r["y"] for r in spark.createDataFrame([(v,) for v in x], "x double").select(F.round("x", 6).alias("y")).collect()]
    assert (R.millionths(np.array(x)) / 1e6).tolist() == got


def test_pagerank_by_lists(spark):
    """Repeated links count once, also over batches; hubs, nodes without links out and null ends are as a plain loop has them."""
    rng = random.Random(8)
    e = [(0, k) for k in range(1, 12_000)] + [(rng.randint(1, 400), rng.randint(0, 400)) for _ in range(3_000)]
    rank = {r["node"]: r["rank"] for r in G.pagerank(spark.createDataFrame(e * 3 + [(None, 5), (5, None)], "src long, dst long"), 4).collect()}
    links = set(e)
    nodes = {x for pair in links for x in pair}
    out = {}
    for a, b in links:
        out.setdefault(a, []).append(b)
    want = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(4):
        base = (0.15 + 0.85 * sum(want[x] for x in nodes if x not in out)) / len(nodes)
        new = dict.fromkeys(nodes, base)
        for a, to in out.items():
            for b in to:
                new[b] += 0.85 * want[a] / len(to)
        want = new
    assert rank == pytest.approx(want, rel=1e-9)
    assert G.pagerank(spark.createDataFrame([], "src long, dst long"), 2).count() == 0


def test_texts_are_embedded_whole(spark):
    """Words of every place in a long text count: its vector is that of all its words, whatever their order, and differs from that of its beginning."""
    from quire.operators import retrieval as R

    words = [f"w{k * 7919 % 5003}" for k in range(6_000)]
    long, again = " ".join(words), " ".join(reversed(words))
    texts = spark.createDataFrame([(0, long), (1, again), (2, long[:8_000]), (3, f"{'same ' * 1_700}end"), (4, f"{'same ' * 1_700}other")], "k int, text string")
    got = {r["k"]: list(r["v"]) for r in texts.select("k", R.hashed_embedding(texts["text"]).alias("v")).collect()}
    assert got[0] == got[1] != got[2]
    assert got[3] != got[4]
