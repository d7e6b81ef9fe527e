"""BPE against the tokenizers library, on the query and on odd texts."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import bpe, queries

LIBRARY = Tokenizer.from_file(bpe.MODEL)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd_texts(rng, count):
    """Texts of special tokens and parts of them, spaces of all kinds, characters of all planes, and long words."""
    bits = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "a", "the", "\n", "\t", "'s", "'", "\x1c", "\x85", "　", "1", "é", "!", "\U000105c0", "Ɤ", "՘"]
    out = []
    for _ in range(count):
        n, kind = rng.choice([0, 1, 2, 3, 5, 9, 40, 200]), rng.randrange(4)
        if kind == 0:
            out.append("".join(chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x800), rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(n)))
        elif kind == 1:
            out.append("".join(rng.choice(bits) for _ in range(n)))
        elif kind == 2:
            out.append(rng.choice("ab ") * n * 5)
        else:
            out.append("".join(rng.choice("abcdefgh") for _ in range(n * 3)))
    return out


@pytest.mark.parametrize("words", [bpe.CACHE_WORDS, 50])
def test_equals_the_library(monkeypatch, words):
    monkeypatch.setattr(bpe, "CACHE_WORDS", words)
    units, texts = bpe.Codec(), odd_texts(random.Random(1), 3000)
    for lo in range(0, len(texts), 300):
        for text, got in zip(texts[lo : lo + 300], units.encode_all(texts[lo : lo + 300]), strict=True):
            ids = np.frombuffer(got, np.int32).tolist()
            assert ids == ids_of(text), text
            assert units.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False) == text


def test_decodes_any_ids():
    rng, units = random.Random(2), bpe.Codec()
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(30)]
        assert units.decode(ids) == LIBRARY.decode(ids, skip_special_tokens=False)


def test_trees_in_arrays_and_lists_agree():
    rng, units = random.Random(3), bpe.Codec()
    raws = ["".join(rng.choice("abcdehinrst ") for _ in range(rng.randint(1, 64))).encode() for _ in range(400)]
    assert units._merge_many(raws, 64) == [units._merge_one(r) for r in raws]
    long = "x" * 20000 + "".join(rng.choice("abcdefgh") for _ in range(30000))
    assert units.encode(long) == ids_of(long)


def test_query(spark, tiny):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{tiny}/documents.parquet'").fetchall())
    got = queries.op13_bpe(spark, tiny).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = ids_of(text)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids, skip_special_tokens=False)))


def test_nulls_repeats_and_clashing_names(spark):
    rows = [(1, None, {"k": 1}), (None, "", None), (2, "a b", {}), (2, "a b", {}), (3, " <|endoftext|>x", {"y": 2})]
    frame = spark.createDataFrame([(*r, "z") for r in rows], ["doc_id", "text", "m", "words"]).withColumnRenamed("m", "a.b")
    got = sorted(((r["doc_id"], tuple(r["ids"]), r["decoded"], r["a.b"]) for r in bpe.encode(frame, keep=("doc_id", "a.b")).collect()), key=repr)
    assert got == sorted(((k, tuple(ids_of(t or "")), t or "", m) for k, t, m in rows), key=repr)
    assert bpe.encode(frame.limit(0)).count() == 0
    back = bpe.encode(frame).select(bpe.decoded(bpe.F.col("ids")).alias("t"), "decoded").collect()
    assert all(r["t"] == r["decoded"] for r in back)
