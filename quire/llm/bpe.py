"""Byte-level BPE encoding and decoding with a segment tree over the ranks of adjacent pairs.

A text is cut at special tokens and then into words by the pattern of byte-level models. The symbols of a word are its bytes. A
leaf of the word's segment tree holds (rank, place) of the pair that begins there, or nothing if the pair does not
merge; every inner node holds the least of its two, so the root is the leftmost pair of the lowest rank. Merging it changes three
leaves (the pair, its right symbol, the pair before it), each put right on its way to the root in logarithmic
time, until the root is empty. Words of one tree size are merged together, a tree a row of an array; few or long words
have their tree in lists. Results of words are remembered within a worker up to a bound.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from quire.plans.session import small_batches

MODEL = "/opt/tokenizers/byte_bpe_50k.json"
#: How byte-level models cut text into words. A fixed value.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a worker remembers, their longest, characters of texts encoded together, and the most leaves of a tree in an array.
CACHE_WORDS, CACHED, TOGETHER, LEAVES = 400_000, 256, 2_000_000, 64
#: Words of one tree size from which arrays are used.
SEVERAL = 8
NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: printable bytes for themselves, the others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def _newer() -> frozenset[str]:
    """Characters that the pattern takes for letters or numbers, but that Python's tables don't have yet: the library may not have them either."""
    found = regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, sys.maxunicode + 1)])))
    return frozenset(c for c in found if unicodedata.category(c) == "Cn")


class _Slots:
    """Rows of distinct 32-bit keys by a first table of slots, and a second one for keys whose slot is taken."""

    def __init__(self, keys: np.ndarray, bits: int = 20):
        self.keys, self.shift, self.slots = np.append(keys, [0]).astype(np.uint32), np.uint32(32 - bits), np.full((2, 1 << bits), len(keys), np.int32)
        one = self._at(keys, 0x9E3779B1)
        _, first = np.unique(one, return_index=True)
        self.slots[0, one[first]] = first
        rest = np.setdiff1d(np.arange(len(keys)), first)
        for self.factor in range(0x85EBCA6B, 0x85EBCA6B + 2_000_000, 2):
            two = self._at(keys[rest], self.factor)
            if len(np.unique(two)) == len(rest):
                break
        else:
            raise ValueError("no second table tells all pairs apart")
        self.slots[1, two] = rest

    def _at(self, keys: np.ndarray, factor: int) -> np.ndarray:
        return (keys * np.uint32(factor)) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key; where there is none, any row, so that the key is to be compared."""
        one = self.slots[0][self._at(keys, 0x9E3779B1)]
        return np.where(self.keys[one] == keys, one, self.slots[1][self._at(keys, self.factor)])


class Codec:
    """Vocabulary and merges of a byte-level BPE file of the tokenizers library, with special tokens found in texts as that library does by default."""

    def __init__(self, path: str = MODEL):
        with open(path, encoding="utf-8") as f:
            known = json.load(f)
        model, cut = known["model"], known["pre_tokenizer"] or {}
        odd = [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
        if model["type"] != "BPE" or any(odd) or known["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("not a plain byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in known["added_tokens"]):
            raise ValueError("special tokens must match as they are")
        self.path, vocab, letters = path, model["vocab"], byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int32)  # the token of each byte
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        left, right, self.made = (np.array([vocab[f(p)] for p in pairs], np.int64) for f in (lambda p: p[0], lambda p: p[1], "".join))
        if max(vocab.values()) >= 1 << 16:
            raise ValueError("more than 65536 tokens")
        self.slots = _Slots((left << 16 | right).astype(np.uint32))
        self.rank_of = {(int(a) << 16 | int(b)): r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        self.special = {t["content"]: t["id"] for t in known["added_tokens"]}
        self.raw = {k: bytes(value[c] for c in t) for t, k in vocab.items()} | {k: t.encode() for t, k in self.special.items()}
        self.words, self.newer, self.library = regex.compile(WORDS), _newer(), None
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=lambda t: (-len(t), t)))) + ")") if self.special else None
        self.best: dict[str, bytes] = {}

    # ---- words ------------------------------------------------------------------------------------------------------

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of tokens, NONE if they do not merge."""
        keys = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        row = self.slots.find(keys)
        return np.where((self.slots.keys[row] == keys) & (row < len(self.made)), row.astype(np.int64), NONE)

    def _merge_many(self, raws: list[bytes], leaves: int) -> list[bytes]:
        """Token ids of words of at most `leaves` bytes, each with a tree of `leaves` leaves in a row of an array."""
        rows, size = len(raws), np.array(list(map(len, raws)))
        grid = np.zeros((rows, leaves), np.int32)
        grid[np.arange(leaves) < size[:, None]] = self.first[np.frombuffer(b"".join(raws), np.uint8)]
        # one column more on both sides, so that every symbol has neighbours: -1 ends a word
        token = np.full((rows, leaves + 1), -1, np.int32)
        token[:, :leaves] = np.where(np.arange(leaves) < size[:, None], grid, -1)
        after = np.tile(np.arange(1, leaves + 2, dtype=np.int32), (rows, 1))
        before = np.tile(np.arange(-1, leaves, dtype=np.int32), (rows, 1))
        tree = np.full((rows, 2 * leaves), NONE)
        rank = np.where(token[:, 1:] >= 0, self._ranks(token[:, :-1], token[:, 1:]), NONE)
        tree[:, leaves:] = np.where(rank < NONE, rank << 16 | np.arange(leaves), NONE)
        for k in range(leaves.bit_length() - 2, -1, -1):
            tree[:, 1 << k : 2 << k] = np.minimum(tree[:, 2 << k : 4 << k : 2], tree[:, (2 << k) + 1 : 4 << k : 2])
        token, after, before, tree = token.ravel(), after.ravel(), before.ravel(), tree.ravel()
        wide, live = leaves + 1, np.flatnonzero(tree[1 :: 2 * leaves] < NONE)
        while len(live):
            trunk, base = live * (2 * leaves), live * wide
            least = tree[trunk + 1]
            at = least & 0xFFFF
            new = self.made[least >> 16]
            gone = after[base + at]
            end = after[base + gone]
            token[base + at], after[base + at] = new, end
            token[base + gone] = -1
            before[base + end] = at
            ahead = before[base + at]
            right = token[base + end]
            left = np.where(ahead >= 0, token[base + np.maximum(ahead, 0)], -1)
            both = self._ranks(np.concatenate([new, np.maximum(left, 0)]), np.concatenate([np.maximum(right, 0), new]))
            after_rank, before_rank = both[: len(live)], both[len(live) :]
            self._put(tree, trunk, leaves, gone, np.full(len(live), NONE))
            self._put(tree, trunk, leaves, at, np.where((right >= 0) & (after_rank < NONE), after_rank << 16 | at, NONE))
            some = np.flatnonzero(ahead >= 0)
            spot = ahead[some].astype(np.int64)
            self._put(tree, trunk[some], leaves, spot, np.where(before_rank[some] < NONE, before_rank[some] << 16 | spot, NONE))
            live = live[tree[trunk + 1] < NONE]
        kept = token.reshape(rows, wide)
        there = kept >= 0
        flat, ends = kept[there].tobytes(), np.cumsum(there.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    @staticmethod
    def _put(tree: np.ndarray, trunk: np.ndarray, leaves: int, leaf: np.ndarray, value: np.ndarray) -> None:
        """A new value at one leaf of each tree, and the least of both children on its way to the root."""
        node = leaf.astype(np.int64) + leaves
        tree[trunk + node] = value
        while leaves > 1:
            leaves >>= 1
            value = np.minimum(value, tree[trunk + (node ^ 1)])
            node >>= 1
            tree[trunk + node] = value

    def _merge_one(self, raw: bytes) -> bytes:
        """Token ids of a word of any length, with its tree in a list."""
        n, rank_of, none = len(raw), self.rank_of, int(NONE)
        token = self.first[np.frombuffer(raw, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        leaves = 1 << max(1, n - 1).bit_length()
        tree = [none] * (2 * leaves)
        for i in range(n - 1):
            r = rank_of.get(token[i] << 16 | token[i + 1])
            if r is not None:
                tree[leaves + i] = r << 32 | i
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(leaf: int, value: int) -> None:
            k = leaves + leaf
            tree[k] = value
            while k > 1:
                value = min(value, tree[k ^ 1])
                k >>= 1
                if tree[k] == value:
                    return
                tree[k] = value

        made = self.made.tolist() if n > 1000 else self.made
        while tree[1] < none:
            at, rank = tree[1] & 0xFFFFFFFF, tree[1] >> 32
            gone = after[at]
            end = after[gone]
            token[at], after[at], token[gone] = int(made[rank]), end, -1
            put(gone, none)
            r = None
            if end < n:
                before[end] = at
                r = rank_of.get(token[at] << 16 | token[end])
            put(at, none if r is None else r << 32 | at)
            if before[at] >= 0:
                r = rank_of.get(token[before[at]] << 16 | token[at])
                put(before[at], none if r is None else r << 32 | before[at])
        return np.array([t for t in token if t >= 0], np.int32).tobytes()

    def learn(self, words: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(word, its token ids as int32 bytes)."""
        by_size: dict[int, list[tuple[str, bytes]]] = defaultdict(list)
        for w in words:
            raw = w.encode()
            by_size[(len(raw) - 1 or 1).bit_length()].append((w, raw))
        for bits, same in by_size.items():
            for lo in range(0, len(same), 8192):
                some = same[lo : lo + 8192]
                if 1 << bits > LEAVES or len(some) < SEVERAL:
                    yield from ((w, self._merge_one(raw)) for w, raw in some)
                else:
                    yield from zip((w for w, _ in some), self._merge_many([raw for _, raw in some], 1 << bits), strict=True)

    # ---- texts ------------------------------------------------------------------------------------------------------

    def _by_library(self, text: str) -> list[str]:
        """The words of a text as the library itself cuts it."""
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def _parts(self, texts: list[str]) -> list[tuple[int, str, list[str]]]:
        """(number of the text, part between special tokens or one of these, its words: none for a special token)."""
        out = []
        for n, t in enumerate(texts):
            for k, part in enumerate(self.cuts.split(t) if any(x in t for x in self.special) else (t,)):
                out.append((n, part, [] if k % 2 else self.words.findall(part)))
        return out

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """The token ids of each text as int32 bytes; the words of all are merged together."""
        parts, best = self._parts(texts), self.best
        new = {w for _, _, words in parts for w in words if w not in best}
        odd = {w for w in new if not self.newer.isdisjoint(w)} if not self.newer.isdisjoint("".join(new)) else set()
        if odd:  # such words are never remembered, so a text that has one always comes here
            parts = [(n, part, self._by_library(part) if not odd.isdisjoint(words) else words) for n, part, words in parts]
        if odd or len(best) + len(new) > CACHE_WORDS:
            if len(best) + len(new) > CACHE_WORDS:
                best.clear()
            new = {w for _, _, words in parts for w in words if w not in best}
        once: dict[str, bytes] = {}
        for w, ids in self.learn(new):
            (once if len(w) > CACHED or odd and not self.newer.isdisjoint(w) else best)[w] = ids
        look = (lambda w: best.get(w) or once[w]) if once else best.__getitem__
        found: list[list[bytes]] = [[] for _ in texts]
        for n, part, words in parts:
            found[n].append(b"".join(map(look, words)) if words or not part else np.array([self.special[part]], np.int32).tobytes())
        yield from map(b"".join, found)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(next(self.encode_all([text])), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ids, special tokens kept; bytes that are no UTF-8 become U+FFFD. Unknown ids raise KeyError."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(path: str = MODEL) -> Codec:
    """One codec a worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def _together(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Texts in runs of about TOGETHER characters."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text", model: str = MODEL) -> DataFrame:
    """docs -> the `keep` columns, ids (array<int>) and decoded (the text that the ids give back), one row a row of docs.

    A null text is encoded as an empty one: no ids, and an empty text comes back. Special tokens in a text become their id, as in the
    library; a text of any length is encoded whole. Repeated rows give a row each; other columns are left aside; an empty table
    gives an empty table. `ids` and `decoded` must not be among `keep`.
    """
    small_batches(docs.sparkSession)
    # numbered names, as names with dots do not pass through mapInArrow
    some = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = T.StructType([*some.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = codec(model)
        for batch in batches:
            at = 0
            for run in _together(batch.column(batch.num_columns - 1).to_pylist()):
                found = list(units.encode_all([t or "" for t in run]))
                flat = np.frombuffer(b"".join(found), np.int32)
                ends = np.cumsum([0] + [len(x) // 4 for x in found]).astype(np.int32)
                texts = [units.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                held = [c.slice(at, len(run)) for c in batch.columns[:-1]]
                at += len(run)
                yield pa.RecordBatch.from_arrays([*held, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(texts, pa.string())], names=[*batch.schema.names[:-1], "ids", "decoded"])

    return some.mapInArrow(of, schema).select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "ids", "decoded")


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of a column of id arrays (null: null)."""
    @F.pandas_udf("string")
    def of(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = codec(model)
        for s in rows:
            yield pd.Series([None if r is None else units.decode(r.tolist()) for r in s], dtype=object)

    return of(ids)
