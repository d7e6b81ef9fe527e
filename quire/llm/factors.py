"""Substring dedup by relative Lempel-Ziv factoring against the whole corpus.

Every document is a reference block. A phrase is a window of 20 words; the index says where a phrase starts first
(smallest doc_id, then earliest start). A document is factored greedily: a factor opens at the first phrase that has an
earlier start and grows word by word while the following phrases continue the same reference; the phrases that straddle
two factors are looked up like any other. What the factors of at least 20 words cover is duplicate.

The index is exact but small. Each phrase holds 14 runs of 7 words; the run of the least hash is its anchor, so equal phrases
have equal anchors, and consecutive phrases mostly share one. Only one row for each anchor and its stretch of phrases
is moved: (hash of the anchor, hash of all words of its phrases). Anchors that occur once end there. Stretches that are equal as a
whole are resolved as one; single phrases are compared only where an anchor stands in different stretches,
and only for the first place of each.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from quire.plans.materialize import written

PHRASE, RUN = 20, 7
#: Bytes that are hashed at once, and phrases that are looked at at once.
HASH_BYTES, STEP = 1 << 20, 1 << 19
_U = np.uint64
#: Odd multipliers.
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_RUN_FACTORS = [(_B2 * (2 * k + 1) ** 3) & (2**64 - 1) | 1 for k in range(RUN)]
_GAP = re.compile(rb"[\x20\x09-\x0d]")


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> _U(32))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(29))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """The XXH3 of each word."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), _U)


def _phrases(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of the PHRASE words from each place on: of 1, 2, 4, 8 and 16 words, then of 16 and 4, mixed between, so nothing cancels out."""
    factor, by = _U(seed), {1: _mix(x + _U(seed))}
    for k in (1, 2, 4, 8):
        low = by[k]
        by[2 * k] = _mix(low[: len(low) - k] * factor + low[k:]) if len(low) > k else low[:0]
    n = max(0, len(x) - PHRASE + 1)
    return _mix(by[16][:n] * factor + by[4][16 : 16 + n])


def _slices(raw: bytes) -> Iterator[bytes]:
    """raw in pieces of about HASH_BYTES that end at white space."""
    at = 0
    while at < len(raw):
        gap = _GAP.search(raw, at + HASH_BYTES) if at + HASH_BYTES < len(raw) else None
        to = gap.start() if gap else len(raw)
        yield raw[at:to]
        at = to


def _hashes(raw: bytes) -> np.ndarray:
    parts = [_word_hashes(piece.split()) for piece in _slices(raw)]
    return np.concatenate(parts) if parts else np.zeros(0, _U)


def _stretches(x: np.ndarray, last: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For each anchor of a run of documents: its hash, its stretch's hash, the first phrase and how many phrases.

    x: hashes of the documents' words, one after the other; last: for each word, where its document ends. A stretch that is cut by the
    bound on phrases looked at at once is two, which costs a comparison of its phrases, not a match.
    """
    width = PHRASE - RUN + 1
    for lo in range(0, len(x) - PHRASE + 1, STEP):
        own = x[lo : lo + STEP + PHRASE - 1]
        grams = own[: len(own) - RUN + 1] * _U(_RUN_FACTORS[0])
        for k in range(1, RUN):
            grams = grams + own[k : k + len(grams)] * _U(_RUN_FACTORS[k])
        grams = _mix(grams)
        low = (grams & _U(2**64 - 2**20)) | np.arange(len(grams), dtype=_U)  # the least hash, then the first place
        for k in (1, 2, 4, width - 8):  # minima of 2, 4, 8, then width
            low = np.minimum(low[:-k], low[k:]) if k else low
        at = (low & _U(2**20 - 1)).astype(np.int64)
        starts = np.flatnonzero(np.arange(lo + PHRASE, lo + PHRASE + len(at)) <= last[lo : lo + len(at)])
        if not len(starts):
            continue
        at = at[starts]
        opens = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.concatenate([opens, [len(at)]]))
        first, anchor = starts[opens], at[opens]
        # a stretch has fewer phrases than a phrase has words, so its first and last phrase hold all its words
        whole = _phrases(own, _B1)
        stretch = _mix(_mix(whole[first] * _U(_B2) + whole[first + count - 1]) + (count * 64 + anchor - first).astype(_U))
        yield grams[anchor], stretch, first + lo, count


def _packed_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts compressed before they are moved."""
    pack = zstandard.ZstdCompressor(level=3)
    for p in parts:
        p["packed"] = [pack.compress(t.encode("utf-8", "surrogatepass")) if isinstance(t, str) else None for t in p["text"]]
        yield p[["doc_id", "shown", "packed"]].astype({"doc_id": "Int64", "shown": "Int64"})


def _unpacked(packed, unpack: zstandard.ZstdDecompressor) -> bytes:
    return unpack.decompress(packed) if isinstance(packed, (bytes, bytearray)) else b""


def _groups(docs: np.ndarray, texts) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Documents together up to HASH_BYTES: (ids, hashes of all words, words of each document); a longer one is alone."""
    ids, raws, size = [], [], 0

    def flush() -> Iterator[tuple]:
        if ids:
            split = [r.split() for r in raws]
            yield np.array(ids), _word_hashes([w for words in split for w in words]), np.array(list(map(len, split)), np.int64)

    for doc, text in zip(docs, texts, strict=True):
        if not isinstance(text, str):
            continue
        raw = text.encode("utf-8", "surrogatepass")
        if len(raw) >= HASH_BYTES:
            x = _hashes(raw)
            yield np.array([doc]), x, np.array([len(x)])
            continue
        if size + len(raw) > HASH_BYTES:
            yield from flush()
            ids, raws, size = [], [], 0
        ids.append(doc)
        raws.append(raw)
        size += len(raw) + 1
    yield from flush()


def _anchor_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in parts:
        for ids, x, lengths in _groups(p["doc_id"].to_numpy(np.int64), p["text"]):
            ends = np.cumsum(lengths)
            of = np.repeat(np.arange(len(ids)), lengths)
            for g, c, first, count in _stretches(x, np.repeat(ends, lengths)):
                doc = of[first]
                local = first - (ends - lengths)[doc]
                yield pd.DataFrame({"anchor": g.view(np.int64), "stretch": c.view(np.int64), "doc": ids[doc], "first": local.astype(np.int32), "count": count.astype(np.int32)})


def _parse(starts: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> tuple[np.ndarray, ...]:
    """The factors (start, length, ref_doc, ref_start) of a document from its phrases with an earlier start, in order.

    A factor opens at the first such phrase that no factor holds and grows word by word while the next phrase goes on in its
    reference block; where it ends, the phrases over its border are looked up as all others, and open the next factor.
    """
    opens = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(ref_doc) != 0) | (np.diff(ref_start) != 1)])) if len(starts) else np.zeros(0, np.int64)
    length = np.diff(np.concatenate([opens, [len(starts)]])) + PHRASE - 1
    return starts[opens], length, ref_doc[opens], ref_start[opens]


def _finish(words: list[bytes], starts: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray) -> tuple:
    """n_words, n_removed, digest of what is left, and the factors: the words that factors cover are removed."""
    found = _parse(starts, ref_doc, ref_start)
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, found[0], 1)
    np.add.at(change, found[0] + found[1], -1)
    kept = np.cumsum(change)[:-1] == 0
    factors = [{"start": int(s), "length": int(k), "ref_doc": int(d), "ref_start": int(r)} for s, k, d, r in zip(*found, strict=True)]
    return len(words), int(len(words) - kept.sum()), hashlib.sha256(b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k])).hexdigest(), factors


def _spread(first: np.ndarray, count: np.ndarray, ref_doc: np.ndarray, ref_start: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches to single phrases: starts (sorted, distinct, within the document) with their references."""
    step = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    starts = np.repeat(first, count) + step
    starts, pick = np.unique(starts, return_index=True)
    ok = starts <= n - PHRASE
    return starts[ok], np.repeat(ref_doc, count)[pick][ok], (np.repeat(ref_start, count) + step)[pick][ok]


_FACTORS = "array<struct<start:int,length:int,ref_doc:bigint,ref_start:int>>"
_RESULT = f"doc_id long, n_words long, n_removed long, kept_sha256 string, factors {_FACTORS}"
_OPEN = f"{_RESULT}, packed binary, starts array<int>, ref_docs array<bigint>, ref_starts array<int>, open_starts array<int>, open_x array<bigint>, open_y array<bigint>"


def _ints(x) -> np.ndarray:
    return np.asarray(x if x is not None else [], np.int64)


def _judge_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents with their stretches: done ones leave with their result, the others with the hashes of the phrases still to be compared."""
    names, unpack = [x.split()[0] for x in _OPEN.split(", ")], zstandard.ZstdDecompressor()
    for p in parts:
        rows = []
        for doc, packed, first, count, ref_doc, ref_start in zip(p["doc_id"], p["packed"], p["firsts"], p["counts"], p["ref_docs"], p["ref_firsts"], strict=True):
            raw = _unpacked(packed, unpack)
            words, first, count, ref_doc, ref_start = raw.split(), _ints(first), _ints(count), _ints(ref_doc), _ints(ref_start)
            own = ref_start < 0
            starts, docs, refs = _spread(first[~own], count[~own], ref_doc[~own], ref_start[~own], len(words))
            doc = None if pd.isna(doc) else int(doc)
            if not own.any():
                rows.append((doc, *_finish(words, starts, docs, refs), *[None] * 7))
                continue
            opens, _, _ = _spread(first[own], count[own], ref_doc[own], ref_start[own], len(words))
            x = _hashes(raw)
            hx, hy = _phrases(x, _B1)[opens], _phrases(x, _B2)[opens]
            rows.append((doc, len(words), None, None, None, packed, starts, docs, refs, opens, hx.view(np.int64), hy.view(np.int64)))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({"doc_id": "Int64", "n_words": "Int64", "n_removed": "Int64"})


def _close_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for p in parts:
        rows = []
        for r in p.itertuples(index=False):
            words = _unpacked(r.packed, unpack).split()
            starts, docs, refs = (np.concatenate([_ints(a), _ints(b)]) for a, b in ((r.starts, r.more_starts), (r.ref_docs, r.more_docs), (r.ref_starts, r.more_refs)))
            starts, pick = np.unique(starts, return_index=True)
            rows.append((int(r.doc_id), *_finish(words, starts, docs[pick], refs[pick])))
        yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "kept_sha256", "factors"])


def factored(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs -> (doc_id, n_words, n_removed, kept_sha256, factors), one row a row of docs.

    A word is removed if a phrase of 20 words that covers it also starts earlier in the corpus; factors tell where. Words are
    runs of characters other than ASCII white space; kept words are joined by one space. Null, empty and shorter texts lose
    nothing. Rows without doc_id lose nothing and are no reference. Rows that repeat a doc_id with the same text stand for one
    document and are not duplicates of each other; if a doc_id has several texts, the one of the least hash is its document, and
    the others are treated as rows without doc_id. Other columns are left aside; an empty table gives an empty table.
    """
    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    key = F.xxhash64("text")
    told = base.where("doc_id is not null and text is not null").select("doc_id", key.alias("key"))
    several = written(told.groupBy("doc_id").agg(F.min("key").alias("own"), F.max("key").alias("last")).where("own <> last").select("doc_id", "own"), "several")
    # ids that other texts share are few, so this is a broadcast; their other texts go through without id
    other = base.join(several, "doc_id", "left").select("doc_id", "text", (key != F.col("own")).alias("other"))
    base = other.select(F.when(~F.coalesce("other", F.lit(False)), F.col("doc_id")).alias("doc_id"), "text", F.col("doc_id").alias("shown"))
    named = base.where("doc_id is not null and text is not null")
    anchors = named.mapInPandas(_anchor_rows, "anchor long, stretch long, doc long, first int, count int")
    again = anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor")
    again = written(again, "again")  # as a table, so that a join with many rows of one key can be split
    shared = written(anchors.join(again, "anchor"), "anchors")
    kinds = shared.groupBy("anchor", "stretch").agg(F.min(F.struct("doc", "first")).alias("at"), F.count("*").alias("n"))
    kinds = written(kinds, "stretches")
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1").select("anchor", F.lit(True).alias("mixed"))
    kinds = kinds.join(written(mixed, "mixed"), "anchor", "left").where("n > 1 or mixed")
    place = F.struct("doc", "first")
    told = shared.join(kinds.select("anchor", "stretch", "at", "mixed"), ["anchor", "stretch"]).where((place != F.col("at")) | F.coalesce("mixed", F.lit(False)))
    # a later place of a stretch refers to its first; the first place itself is open (-1) if other stretches share its anchor
    later = place != F.col("at")
    runs = told.select("doc", F.struct("first", "count", F.when(later, F.col("at.doc")).otherwise(F.lit(-1)).alias("ref_doc"), F.when(later, F.col("at.first")).otherwise(F.lit(-1)).alias("ref_first")).alias("run"))
    runs = runs.groupBy("doc").agg(F.collect_list("run").alias("runs")).select("doc", F.col("runs.first").alias("firsts"), F.col("runs.count").alias("counts"), F.col("runs.ref_doc").alias("ref_docs"), F.col("runs.ref_first").alias("ref_firsts"))
    packed = base.mapInPandas(_packed_rows, "doc_id long, shown long, packed binary")
    judged = packed.join(runs, packed["doc_id"] == runs["doc"], "left").select(F.col("shown").alias("doc_id"), "packed", "firsts", "counts", "ref_docs", "ref_firsts")
    judged = written(judged.mapInPandas(_judge_rows, _OPEN), "judged")
    undone = judged.where("open_starts is not null")
    phrases = undone.select("doc_id", F.explode(F.arrays_zip("open_starts", "open_x", "open_y")).alias("p")).select("doc_id", F.col("p.open_starts").alias("start"), F.col("p.open_x").alias("x"), F.col("p.open_y").alias("y"))
    firsts = phrases.groupBy("x", "y").agg(F.min(F.struct("doc_id", "start")).alias("at"), F.count("*").alias("n")).where("n > 1").select("x", "y", "at")
    firsts = written(firsts, "firsts")
    more = phrases.join(firsts, ["x", "y"]).where(F.struct("doc_id", "start") != F.col("at")).select(F.col("doc_id").alias("doc"), F.struct("start", F.col("at.doc_id").alias("d"), F.col("at.start").alias("s")).alias("p"))
    more = more.groupBy("doc").agg(F.collect_list("p").alias("p")).select("doc", F.col("p.start").alias("more_starts"), F.col("p.d").alias("more_docs"), F.col("p.s").alias("more_refs"))
    closed = undone.select("doc_id", "packed", "starts", "ref_docs", "ref_starts").join(more, undone["doc_id"] == more["doc"], "left").drop("doc").mapInPandas(_close_rows, _RESULT)
    return judged.where("open_starts is null").select("doc_id", "n_words", "n_removed", "kept_sha256", "factors").unionByName(closed)


SQL = """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
p AS (SELECT doc_id, s, array_to_string(ws[s:s + 19], ' ') AS phrase FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 19)) AS s FROM w WHERE len(ws) >= 20)),
d AS (SELECT doc_id, s, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, s) > 1 AS dup FROM p),
c AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 19)) AS k FROM d WHERE dup),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS k FROM w),
k AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.k) FILTER (WHERE c.k IS NULL) AS kept, count(*) FILTER (WHERE c.k IS NOT NULL) AS n_removed FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.k = c.k GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
