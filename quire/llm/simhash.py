"""SimHash near-duplicates found with Golay-code fuzzy keys.

A 64-bit fingerprint is cut into three segments of at most 23 bits. The perfect binary Golay code
puts every 23-bit word within 3 bits of exactly one codeword. With `near(x)` the codewords within
4 bits of x (six of them or one) and `own(y)` the single codeword within 3 bits of y, two words that
differ in at most one bit always have own(y) in near(x): the distance from x to own(y) is at most 3 + 1.

Of three or fewer differing bits spread over three segments, the two least hit segments have at most
one each (three errors as 3+0+0, 2+1+0 or 1+1+1). So for one of the three pairs of segments, both
codeword indices of y are among those of x. For the first pair all near indices of both are looked up. If that
pair misses y, one of its segments has two or more errors and the others have one at most between them, so for the two
other pairs one own index goes with near ones of the other. One fingerprint gives 3 index keys of 24 bits and
about 47 probe keys; equal keys are joined and the distance is verified. No link is missed.

Such links are no measure of the similarity of shingle sets: at a Jaccard similarity of 0.8 about 10 of 64 bits
differ. `resembling` takes them as first candidates only and adds the pairs of a prefix filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from quire.llm import resemblance
from quire.llm.components import components
from quire.plans.materialize import written
from quire.plans.session import small_batches

#: Generator polynomial of the binary Golay code [23, 12, 7]: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1. A fixed value.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
SHINGLE = 3
LINK_BITS = 3
_BLOCK = 1 << 15


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator: 0 for codewords, equal for words of one coset."""
    rest = words.astype(np.uint32)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> np.uint32(bit) & np.uint32(1), rest ^ np.uint32(GENERATOR << (bit - 11)), rest)
    return rest


def _coset_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each syndrome: the lightest error, all errors of up to 4 bits (padded by repeats), and how many these are."""
    errors = np.array([sum(1 << i for i in c) for n in range(5) for c in combinations(range(23), n)], dtype=np.uint32)
    syn = _syndromes(errors)
    order = np.lexsort((np.bitwise_count(errors), syn))
    errors, syn = errors[order], syn[order]
    first = np.searchsorted(syn, np.arange(2048))
    count = np.searchsorted(syn, np.arange(2048), side="right") - first
    at = first[:, None] + np.minimum(np.arange(count.max())[None, :], count[:, None] - 1)
    return errors[first], errors[at], count


LIGHTEST, ERRORS, COUNTS = _coset_tables()


def own_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the one codeword within 3 bits (the code is systematic in its high bits)."""
    return (words ^ LIGHTEST[_syndromes(words)]) >> np.uint32(11)


def near_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the codewords within 4 bits, a row per word, and how many of the row count."""
    syn = _syndromes(words)
    return (words[:, None] ^ ERRORS[syn]) >> np.uint32(11), COUNTS[syn]


def _segments(prints: np.ndarray) -> list[np.ndarray]:
    return [(prints >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.uint32) for at, n in SEGMENTS]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits over the XXH64 (seed 42) of all shingles of the lower-cased text; 0 without words. Memory is bounded by blocks of shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    ones = np.zeros(64, np.int64)
    for lo in range(0, n, _BLOCK):
        some = words[lo : min(n, lo + _BLOCK) + shingle - 1]
        grams = zip(*(some[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big", signed=True)


def fingerprints(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t if isinstance(t, str) else None, shingle) for t in s], dtype="int64")

    return of(text)


def _index_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        prints = p["print"].to_numpy(np.int64)
        own = [own_index(s) for s in _segments(prints.view(np.uint64))]
        for k, (i, j) in enumerate(combinations(range(3), 2)):
            yield pd.DataFrame({"key": (k << 24 | own[i].astype(np.int64) << 12 | own[j]).astype(np.int32), "right": prints})


def _probe_keys(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        for lo in range(0, len(p), 2000):
            prints = p["print"].to_numpy(np.int64)[lo : lo + 2000]
            segments = _segments(prints.view(np.uint64))
            near, own = [near_indices(s) for s in segments], [own_index(s) for s in segments]
            for k, (i, j) in enumerate(combinations(range(3), 2)):
                (a, na), (b, nb) = near[i], near[j]
                live = (np.arange(a.shape[1])[None, :, None] < na[:, None, None]) & (np.arange(b.shape[1])[None, None, :] < nb[:, None, None])
                if k:  # one segment has no error
                    live &= (a == own[i][:, None])[:, :, None] | (b == own[j][:, None])[:, None, :]
                keys = k << 24 | a.astype(np.int64)[:, :, None] << 12 | b[:, None, :]
                yield pd.DataFrame({"key": keys[live].astype(np.int32), "left": np.repeat(prints, live.sum(axis=(1, 2)))})


def links(prints: DataFrame, bits: int = LINK_BITS) -> DataFrame:
    """prints: distinct fingerprints in column print -> every unordered pair (left < right) at 1..bits differing bits, once; bits may be 0 to 3."""
    if not 0 <= bits <= 3:
        raise ValueError("the keys are complete for at most 3 differing bits")
    prints = prints.select("print").repartition("print")  # a table of few files would be few tasks, which make many rows
    index = prints.mapInPandas(_index_keys, "key int, right long")
    probes = prints.mapInPandas(_probe_keys, "key int, left long")
    near = (F.col("left") < F.col("right")) & (F.bit_count(F.col("left").bitwiseXOR(F.col("right"))) <= bits)
    return probes.join(index, "key").where(near).select("left", "right").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, bits: int = LINK_BITS) -> DataFrame:
    """docs -> (doc_id, print, component_id): documents whose fingerprints link within `bits`, directly or over others, share the least doc_id of them.

    Null or word-free texts have fingerprint zero and link like any other. A row whose doc_id is null
    keeps its fingerprint and gets the component of its class (null if no named document is in it).
    Repeated rows each give a row. Other columns of docs are left aside; an empty table gives an empty table.
    Equal fingerprints are one class before keys are made, so copies never meet in pairs.
    """
    small_batches(docs.sparkSession)
    marked = written(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(F.col(text), shingle).alias("print")), "prints")
    classes = written(marked.groupBy("print").agg(F.min("doc_id").alias("first")), "classes")
    named = classes.where("first is not null")
    found = links(named, bits)
    ends = found.join(named.select(F.col("print").alias("left"), F.col("first").alias("a")), "left").join(named.select(F.col("print").alias("right"), F.col("first").alias("b")), "right")
    groups = components(ends, "a", "b")
    of_print = classes.join(groups, classes["first"] == groups["node"], "left").select("print", F.coalesce("component", "first").alias("component_id"))
    return marked.join(of_print, "print").select("doc_id", "print", "component_id")


def resembling(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = resemblance.LEAST) -> DataFrame:
    """docs -> (doc_id, text_key, component), a row each: texts whose 5-word shingles have a Jaccard similarity of `least` or more, directly or over others, share the component.

    Candidates are pairs whose fingerprints of the shingle sets link within LINK_BITS, and those of a prefix filter, which
    make the links complete; every link is verified on whole sets. text_key is the XXH64 of the text. Null and word-free texts are one class. Null doc_ids and repeated rows
    stay as they are; other columns are left aside. An empty table gives an empty table.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(text).cast("string").alias("text"), F.xxhash64(F.col(text).cast("string")).alias("text_key"))
    often, hits = resemblance.frequent(texts)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(text).cast("string")).alias("text_key"), resemblance.marks(F.col(text).cast("string"), often, hits, least).alias("m"))
    marked = written(rows.select("doc_id", "text_key", "m.*"), "marked")
    classes = written(marked.groupBy("class", "n", "print", "sketch", "parity").agg(F.min("text_key").alias("text_key")), "classes")
    # classes of one print meet its least class, and the least classes of linked prints meet
    least_of = written(classes.groupBy("print").agg(F.min("class").alias("b")), "prints")
    same = classes.select("print", F.col("class").alias("a")).join(least_of, "print").where("a <> b").select("a", "b")
    near = links(least_of).join(least_of.select(F.col("print").alias("left"), F.col("b").alias("a")), "left").join(least_of.select(F.col("print").alias("right"), "b"), "right").select("a", "b")
    groups = resemblance.completed(marked, classes, texts, same.unionByName(near), least)
    return marked.join(groups, marked["class"] == groups["node"], "left").select("doc_id", "text_key", F.coalesce("component", "class").alias("component"))
