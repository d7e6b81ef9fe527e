"""Words and phrases made so that sums of powers modulo 2^64 collide stay apart."""

from quire.llm import factors
from tests.llm.test_small import docs


def thue_morse(n, a, b):
    return [a if bin(k).count("1") % 2 == 0 else b for k in range(n)]


def test_long_words_of_a_thue_morse_sequence(spark):
    one, two = "".join(thue_morse(1024, "a", "b")), "".join(thue_morse(1024, "b", "a"))
    same = " ".join(f"w{k}" for k in range(19))
    got = {r["doc_id"]: r["n_removed"] for r in factors.factored(docs(spark, [(1, f"{same} {one}", "en", "s"), (2, f"{same} {two}", "en", "s"), (3, f"{same} {two}", "en", "s")])).collect()}
    assert got == {1: 0, 2: 0, 3: 20}


def test_phrases_of_a_thue_morse_sequence(spark):
    one, two = " ".join(thue_morse(64, "x", "y")), " ".join(thue_morse(64, "p", "q"))
    x, y = (factors._phrases(factors._hashes(t.encode()), factors._B1) for t in (one, two))
    assert not set(x.tolist()) & set(y.tolist())
    windows = [tuple(one.split()[k : k + 20]) for k in range(45)]
    assert len(set(x.tolist())) == len(set(windows))
