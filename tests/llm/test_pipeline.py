"""The numbered queries with SQL, and the pipeline against a brute-force version, over the smallest tables."""

import hashlib
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import langid, mixing, pieces, queries
from quire.plans.materialize import shared_dir
from tests.compare import duck_rows, rows_of
from tests.llm.test_resemblance import brute_groups
from tests.llm.test_small import brute_print, brute_targets


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, tiny, name):
    assert rows_of(queries.QUERIES[name](spark, tiny)) == duck_rows(queries.ORACLE[name], tiny)


def brute_dictionaries(docs, sample=langid.SAMPLE_TEXTS):
    """Texts by the hash of doc_id; pieces by hash, one of each text a turn."""
    out = {}
    for lang in {d["lang"] for d in docs} - {None}:
        mine = [d for d in docs if d["lang"] == lang and any(c.isalpha() for c in d["text"] or "")]
        signed = lambda h: h - 2**64 if h >= 2**63 else h
        key = lambda d: (signed(xxhash.xxh64_intdigest(d["doc_id"].to_bytes(8, "little"), 42)), d["doc_id"], d["text"])
        parts = []
        for r, d in enumerate(sorted(mine, key=key)[:sample]):
            cut = [(k, d["text"][at : at + langid.PIECE].lower()) for k, at in enumerate(range(0, len(d["text"]), langid.PIECE))]
            hashed = sorted((signed(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), xxhash.xxh64_intdigest(x.encode(), 42))), k, x) for k, x in cut)
            parts += [(turn, r, x) for turn, (_, _, x) in enumerate(hashed)]
        found = b"".join(x.encode() + b"\n" for _, _, x in sorted(parts, key=lambda p: p[:2])[: langid.DICT_BYTES // langid.PIECE])
        out[lang] = found[: langid.DICT_BYTES]
    return out


def brute_language(dictionaries, text):
    """Every block of the text with a compressor of its own."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    raw, sizes = text.lower().encode(), []
    for lang in sorted(dictionaries):
        params = zstandard.ZstdCompressionParameters.from_level(6, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False)
        d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append((sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress(raw[at : at + 2048])) for at in range(0, len(raw), 2048)), lang))
    (best, lang), (second, _) = sorted(sizes)[:2]
    return lang, (second - best) / second


def test_langid_against_brute_force(spark, tiny):
    docs = [dict(zip(("doc_id", "text", "lang"), r, strict=True)) for r in duckdb.sql(f"SELECT doc_id, text, lang FROM '{tiny}/documents.parquet'").fetchall()]
    taught = brute_dictionaries([d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 3 != 1])
    assert langid.learn(spark.read.parquet(f"{tiny}/documents.parquet").where(langid.fold(F.col("doc_id")) != 1)) == taught
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in queries.op8_langid(spark, tiny).collect()}
    assert len(got) == len(docs)
    some = sorted(docs, key=lambda d: len(d["text"] or ""))[:60]
    for d in some:
        assert got[d["doc_id"]] == brute_language(taught, d["text"]), d["doc_id"]


def test_held_out_accuracy(spark, tiny):
    lang = dict(duckdb.sql(f"SELECT doc_id, lang FROM '{tiny}/documents.parquet'").fetchall())
    held = [r for r in queries.op8_langid(spark, tiny).collect() if r["held_out"]]
    assert held and sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) >= 0.95


def test_simhash_components(spark, tiny):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall()
    prints = {k: brute_print(t) for k, t in docs}
    component = {k: k for k in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            low = min(component[b] for b in prints if bin(prints[a] ^ prints[b]).count("1") <= 3)
            if low < component[a]:
                component[a], changed = low, True
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op3_simhash(spark, tiny).collect()}
    assert got == {k: (f"{prints[k]:016x}", component[k]) for k in prints}


def brute_mix(spark, docs):
    """(doc_id -> passes that take at least half) with slots drawn one after another."""
    sizes = {}
    for d in docs:
        d["size"] = len((d["text"] or "").split())
        sizes[d["source"]] = sizes.get(d["source"], 0) + d["size"]
    target = brute_targets(sizes)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())
    total, block = sum(target.values()), mixing.BLOCK_WORDS
    upto = np.cumsum([target[s] for s in order]) / total
    slots = {s: 0 for s in order}
    for t in range(1, round(total / block) + 1):
        u = float(t * mixing.GOLDEN % 1)
        slots[order[min(int(np.searchsorted(upto, u, side="right")), len(order) - 1)]] += 1
    frame = spark.createDataFrame([(d["doc_id"], d["text"], 0) for d in docs], "doc_id long, text string, copy int")
    h = {r["doc_id"]: r["h"] for r in frame.select("doc_id", F.xxhash64(F.lit(7), "doc_id", F.xxhash64("text"), "copy").alias("h")).collect()}
    times = {}
    for s in order:
        mine = sorted((d for d in docs if d["source"] == s), key=lambda d: (h[d["doc_id"]], d["doc_id"]))
        reach = slots[s] * block
        for turn in range(2):
            at = turn * sizes[s]
            for d in mine:
                n = max(0, min(at + d["size"], reach) - at)
                times[d["doc_id"]] = times.get(d["doc_id"], 0) + (d["size"] > 0 and n > 0 and 2 * n >= d["size"])
                at += d["size"]
    return times


def test_pipeline(spark, tiny):
    docs = [dict(zip(("doc_id", "text", "source", "lang"), r, strict=True)) for r in duckdb.sql(f"SELECT doc_id, text, source, lang FROM '{tiny}/documents.parquet' ORDER BY doc_id").fetchall()]
    frame = spark.read.parquet(f"{tiny}/documents.parquet")
    model = langid.Classifier(langid.learn(frame.where(langid.fold(F.col("doc_id")) != 1)))
    docs = [d for d in docs if (f := model.classify(d["text"]))[0] != "und" and f[1] >= langid.MARGIN]
    pages, seen = {}, {}
    for d in docs:
        pages[d["source"]] = pages.get(d["source"], 0) + 1
        for x in {x.strip(" ") for x in d["text"].split("\n")} - {""}:
            seen[d["source"], x] = seen.get((d["source"], x), 0) + 1
    for d in docs:
        d["text"] = "\n".join(x for x in d["text"].split("\n") if not (x.strip(" ") and seen[d["source"], x.strip(" ")] >= 5 and seen[d["source"], x.strip(" ")] > 0.1 * pages[d["source"]]))
    component = brute_groups({d["doc_id"]: d["text"] for d in docs})
    docs = [d for d in docs if component[d["doc_id"]] == d["doc_id"]]
    times, units = brute_mix(spark, docs), pieces.Lattice()
    want = []
    for d in docs:
        score, cells = units.encode(d["text"], 1)[0]
        raw = b"".join(cells)
        want += [(d["doc_id"], len(raw) // 4, score, hashlib.sha256(raw).hexdigest())] * times[d["doc_id"]]
    tables = lambda: {p.name for p in Path(shared_dir(spark).removeprefix("file:"), "quire").glob("*")}
    before = tables()
    got = sorted((r["doc_id"], r["n_pieces"], r["score"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, tiny).collect())
    assert [n.split("-")[0] for n in tables() - before] == ["encode"]
    assert got == sorted(want) and len(got) > 200


def test_stages_keep_columns_and_take_odd_rows(spark, tiny):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "s", 0), (None, "some words here", "en", "s", 3), (3, "the and of " * 50, "en", None, 9), (3, "the and of " * 50, "en", None, 9)], schema)
    for df in (odd, odd.limit(0)):
        out = df
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, out, tiny)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == df.columns
        out.collect()


def test_stages_leave_every_other_column(spark, tiny):
    """Columns named as the stages' own, with dots, and maps pass through all stages unchanged."""
    docs = spark.read.parquet(f"{tiny}/documents.parquet").limit(40)
    own = {"score": F.col("doc_id") + 7.0, "accepted": F.lit("x"), "n_lines": -F.col("doc_id"), "_found": F.lit("f"), "lang_pred": F.lit("p"), "row": F.lit("r"), "m": F.create_map(F.lit("k"), F.col("doc_id")), "text_key": F.lit("t"), "kept": F.lit("z")}
    wide = docs.withColumns(own).withColumn("a.b", F.lit("dot"))
    wide = wide.unionByName(wide.limit(3)).unionByName(wide.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    out = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, tiny)
        assert out.columns == wide.columns
    rows = out.collect()
    assert len(rows) > 10
    for r in rows:
        k = r["m"]["k"]
        assert (r["score"], r["accepted"], r["n_lines"], r["_found"], r["lang_pred"], r["row"], r["text_key"], r["kept"], r["a.b"]) == (k + 7.0, "x", -k, "f", "p", "r", "t", "z", "dot")
