"""Pairs of texts by the Jaccard similarity of their 5-word shingles, without losing any.

Two sets of similarity t or more, in one order of all shingles, share one of the first n - ceil(t n) + 1 of
each (prefix filter). Any order is right; shingles that a sample of texts holds often come last, so that
common passages are hardly ever keys. Texts of equal sets are one class.

A key that many classes hold does not pair them all: each class meets one class of its keys, and what
links is put together; then only classes of different components meet. Every pair that is left out stands in one
component already, so the components are those of all pairs.

Candidates are judged before texts move. Where a key has many classes, its join compares 512 parity bits of both sets: no
more of them differ than shingles do; and it gives a pair at the first of the frequent keys that both hold, not at all of
them. Pairs that are left are judged by counts of their shingles' low bits, about a third of a byte a word: the
sum of the lesser counts bounds the common shingles from above. Only pairs that this lets through move their (compressed)
texts and are verified on whole sets.

Work that remains: classes of one frequent key that no link has put together yet are compared in pairs, on 64 bytes each. A
group of copies that are all near the similarity asked for is such a case; pairs that come out of it are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm.components import components
from quire.plans.materialize import written

SHINGLE = 5
LEAST = 0.8
#: Texts that are sampled for the order (one of so many), hits there from which a shingle comes late, and how many of these are known to all tasks.
SAMPLED, OFTEN, KNOWN = 16, 3, 200_000
#: Classes of a key from which its join compares parity bits, and frequent keys of a class that tell where a pair was met before.
HOT, HEAD = 16, 16
#: Characters (or bytes) of texts that a worker handles together; results leave in batches of this size too.
TOGETHER = 500_000
_BLOCK = 1 << 15
_EPS = 1e-9


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of the text (A-Z lower-cased); fewer words are one shingle, none give an empty set."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in words), np.uint64, len(words))
    width = min(n, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out = (out * np.uint64(0x9E3779B97F4A7C15)) ^ (out >> np.uint64(29))
        out += h[i : i + len(out)]
    out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(out ^ (out >> np.uint64(30)))


def class_of(found: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), 7)).view(np.int64)) if len(found) else 0


def majority(hashes: np.ndarray) -> int:
    """The signed 64-bit number whose bits are those that over half of the hashes set; 0 of none."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        ones += np.unpackbits(hashes[lo : lo + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def ordered(found: np.ndarray, often: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """found in the order of all shingles: ones that are not known as frequent first, then by hits; equal ones by hash."""
    if not len(often):
        return found
    at = np.minimum(np.searchsorted(often, found), len(often) - 1)
    return found[np.lexsort((found, np.where(often[at] == found, hits[at], 0)))]


def prefix(n: int, least: float) -> int:
    return n - int(np.ceil(least * n - _EPS)) + 1 if n else 0


def sketch(found: np.ndarray) -> bytes:
    """How many shingles have each value of their low bits, in half bytes; as many bits as the set's size has, more while a count is above 15."""
    bits = max(3, len(found).bit_length() - 1)
    while True:
        counts = np.bincount((found & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits)
        if counts.max() < 16:
            return (counts[0::2] | counts[1::2] << 4).astype(np.uint8).tobytes()
        bits += 1


def parity(found: np.ndarray) -> np.ndarray:
    """512 bits as eight signed longs: whether an odd number of shingles falls on each."""
    odd = np.bincount((found >> np.uint64(20) & np.uint64(511)).astype(np.int64), minlength=512) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def most_common(a: bytes, b: bytes) -> int:
    """No fewer than the shingles that two sets with these sketches share; a finer sketch is summed up to the coarser one."""
    halves = [np.frombuffer(x, np.uint8) for x in (a, b)]
    counts = [np.stack([x & 15, x >> 4], axis=1).ravel().astype(np.int64) for x in halves]
    width = min(map(len, counts))
    return int(np.minimum(*[c.reshape(-1, width).sum(axis=0) for c in counts]).sum())


def _batches(s: pd.Series) -> Iterator[pd.Series]:
    """s in runs of about TOGETHER characters, so that little is held beside the texts of an Arrow batch."""
    lo = size = 0
    for k, t in enumerate(s):
        size += len(t) if t is not None else 0
        if size >= TOGETHER:
            yield s.iloc[lo : k + 1]
            lo, size = k + 1, 0
    if lo < len(s):
        yield s.iloc[lo:]


def _sets(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in (x for whole in texts for x in _batches(whole)):
            yield pd.Series([shingles(t if isinstance(t, str) else None).view(np.int64) for t in s], dtype=object)

    return of(text)


def marks(text: Column, often: np.ndarray, hits: np.ndarray, least: float) -> Column:
    """struct of a text's class, its set's size, fingerprint, sketch, parity bits and prefix keys."""

    @F.pandas_udf("class long, n int, print long, sketch binary, parity array<long>, keys array<long>")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in (x for whole in texts for x in _batches(whole)):
            rows = []
            for t in s:
                found = shingles(t if isinstance(t, str) else None)
                keys = ordered(found, often, hits)[: prefix(len(found), least)].copy()  # else the whole set is held
                rows.append((class_of(found), len(found), majority(found), sketch(found), parity(found), keys.view(np.int64)))
            yield pd.DataFrame(rows, columns=["class", "n", "print", "sketch", "parity", "keys"])

    return of(text)


def frequent(text: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, hits) of at most KNOWN shingles, the most frequent of a sample of texts."""
    some = text.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0).select(F.explode(_sets(F.col("text"))).alias("key"))
    top = some.groupBy("key").agg(F.count("*").alias("hits")).where(F.col("hits") >= OFTEN).orderBy(F.desc("hits"), "key").limit(KNOWN).toPandas()
    often = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(often)
    return often[order], top["hits"].to_numpy(np.int64)[order]


def _reaches(least: float):
    @F.pandas_udf("boolean")
    def of(na: pd.Series, a: pd.Series, nb: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([most_common(x, y) * (1 + least) >= (n + m) * least - _EPS for n, x, m, y in zip(na, a, nb, b, strict=True)], dtype=bool)

    return of


def _similar(least: float):
    @F.pandas_udf("boolean")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        unpack = zstandard.ZstdDecompressor()

        @lru_cache(32)
        def held(packed: bytes) -> np.ndarray:
            return shingles(unpack.decompress(packed).decode("utf-8", "surrogatepass"))

        out = []
        for x, y in zip(a, b, strict=True):
            p, q = held(bytes(x)), held(bytes(y))
            out.append(len(np.intersect1d(p, q, assume_unique=True)) * (1 + least) >= (len(p) + len(q)) * least - _EPS)
        return pd.Series(out, dtype=bool)

    return of


def _packed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pack = zstandard.ZstdCompressor(level=3)
    for p in (whole.loc[x.index] for whole in parts for x in _batches(whole["text"])):
        yield pd.DataFrame({"text_key": p["text_key"], "packed": [pack.compress(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else pack.compress(b"") for t in p["text"]]})


def _near_in_size(a: str, b: str, least: float) -> Column:
    return F.least(a, b) >= F.greatest(a, b) * least - _EPS


def _ends(pairs: DataFrame, of: DataFrame, value: str, *more: str) -> DataFrame:
    """pairs(a, b) with `value` of both classes as <value>_a and <value>_b."""
    for s in ("a", "b"):
        pairs = pairs.join(of.select(F.col("class").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in (value, *more)]), s)
    return pairs


def verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of classes(class, n, sketch, text_key) whose sets, made anew of texts(text_key, text), are similar enough."""
    met = _ends(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), classes, "n").where(_near_in_size("n_a", "n_b", least))
    met = _ends(met, classes, "sketch").where(_reaches(least)("n_a", "sketch_a", "n_b", "sketch_b"))
    likely = written(met.select("a", "b"), "likely")
    wanted = likely.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "text_key"), "class")
    wanted = written(wanted, "wanted")
    # texts are packed by the tasks that read them, and only those of such pairs are moved
    held = texts.join(written(wanted.select("text_key"), "wanted"), "text_key", "left_semi").mapInPandas(_packed, "text_key long, packed binary")
    held = held.groupBy("text_key").agg(F.first("packed").alias("packed")).join(wanted, "text_key").select("class", "packed")
    return written(_ends(likely, written(held, "texts"), "packed").where(_similar(least)("packed_a", "packed_b")).select("a", "b"), "links")


def completed(marked: DataFrame, classes: DataFrame, texts: DataFrame, first: DataFrame, least: float) -> DataFrame:
    """(node, component) of all classes that a link of similarity `least` or more has; first(a, b) are candidates to begin with, marked(class, keys) has the prefixes."""
    places = marked.select("class", F.explode("keys").alias("key"))
    again = written(places.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "again")
    keys = written(places.join(again, "key"), "places").distinct()  # as tables: the join can split a frequent key

    def mixed(rows: DataFrame, of: str) -> DataFrame:
        """The rows of keys that have more than one value of `of`."""
        rows = written(rows, "keys")
        several = rows.groupBy("key").agg(F.min(of).alias("low"), F.max(of).alias("high")).where("low <> high").select("key")
        return written(rows.join(written(several, "mixed"), "key"), "keys")

    # every class meets one class of each of its keys, by a hash so that the same classes serve many keys
    keys = mixed(keys, "class")
    one = keys.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.pmod("key", F.lit(4)), "class").alias("h"), "class")).alias("o")).select("key", F.col("o.class").alias("b"))
    star = keys.select("key", F.col("class").alias("a")).join(written(one, "one"), "key").select("a", "b")
    links = verified(first.select("a", "b").unionByName(star), classes, texts, least)
    groups = components(links, "a", "b")
    # then the classes outside the commonest component of a key meet all others of the key
    known = mixed(keys.join(groups, keys["class"] == groups["node"], "left").select("key", "class", F.coalesce("component", "class").alias("of")), "of")
    counts = known.groupBy("key", "of").agg(F.count("*").alias("c"))
    main = counts.groupBy("key").agg(F.max(F.struct("c", "of")).alias("m"), F.sum("c").alias("c")).select("key", F.col("m.of").alias("main"), "c")
    sides = written(known.join(written(main, "main"), "key").join(classes.select("class", "n"), "class"), "sides")
    hot = sides.where(F.col("c") >= HOT)
    heads = hot.groupBy("class").agg(F.slice(F.array_sort(F.collect_set("key")), 1, HEAD).alias("head"))
    hot = written(hot.join(written(heads, "heads"), "class").join(classes.select("class", "parity"), "class"), "hot")

    def meet(rows: DataFrame, more: list[str]) -> DataFrame:
        a, b = (rows.select("key", "main", *[F.col(c).alias(f"{c}_{s}") for c in ("class", "of", "n", *more)]) for s in "ab")
        b = b.where("of_b <> main").drop("main")
        return a.join(b, "key").where("of_a <> of_b and (of_a = main or class_a < class_b)").where(_near_in_size("n_a", "n_b", least))

    apart = sum((F.bit_count(F.get("parity_a", F.lit(i)).bitwiseXOR(F.get("parity_b", F.lit(i)))) for i in range(8)), F.lit(0))
    before = F.array_min(F.array_intersect("head_a", "head_b"))
    close = meet(hot, ["parity", "head"]).where(apart * (1 + least) <= (F.col("n_a") + F.col("n_b")) * (1 - least) + _EPS).where(before.isNull() | (before >= F.col("key")))
    rest = meet(sides.where(F.col("c") < HOT), []).unionByName(close, allowMissingColumns=True).select(F.col("class_a").alias("a"), F.col("class_b").alias("b"))
    return components(links.unionByName(verified(rest, classes, texts, least)), "a", "b")
