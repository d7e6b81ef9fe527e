"""Periodic runs of words, found by internal pattern matching.

A run is a stretch of words with smallest period q, longer than EXPONENT periods, that no neighbour extends. A dyadic block
is a stretch of L = 2^k words at a multiple of L. With L/2 < q <= L, a run of at least 4 q words holds such a block whole,
and as the block is at least one period long, its occurrences within the run are exactly q apart: they are an arithmetic
progression. One of its two neighbouring occurrences is in the run, so each block asks for its next and its previous
occurrence, and the difference, if L/2 < d <= L, is a candidate period. Blocks that stand at a candidate's distance one
after the other are put together, and what they cover is extended to the words that break the period.

Occurrences come from the suffix array of the words: those of a block are an interval of it, and the next one after a place
is a range successor in that interval, answered by a wavelet tree over the suffix array for all blocks of a level at once.
The array is built by prefix doubling, whose ranks after k rounds are the intervals of the blocks of level k.

Texts are taken together up to a number of words, with a word of its own after each, so a run never leaves its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from quire.plans.session import small_batches

#: Least periods in a run, and its least length.
EXPONENT, LEAST = 4, 6
#: Words of texts taken together, and words from which the levels of a wavelet tree are made anew for each pass rather than kept.
TOGETHER, KEPT = 1 << 16, 1 << 20


class Wavelet:
    """Wavelet tree of a sequence of numbers below 2^bits, its levels as counts of zeros before each place."""

    def __init__(self, values: np.ndarray):
        self.values, self.bits = values, max(1, int(values.max()).bit_length())
        self.made = list(self._build()) if len(values) <= KEPT else None

    def _build(self) -> Iterator[tuple[int, np.ndarray]]:
        now = self.values
        for bit in range(self.bits - 1, -1, -1):
            one = (now >> bit & 1).astype(bool)
            zeros = np.zeros(len(now) + 1, np.int32)
            np.cumsum(~one, out=zeros[1:])
            yield bit, zeros
            now = np.concatenate([now[~one], now[one]])

    def _levels(self):
        return self.made if self.made is not None else self._build()

    def below(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """How many of values[lo:hi] are less than value."""
        found = np.zeros(len(lo), np.int32)
        for bit, zeros in self._levels():
            a, b = zeros[lo], zeros[hi]
            one = (value >> bit & 1).astype(bool)
            found += np.where(one, b - a, 0)
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return found

    def nth(self, lo: np.ndarray, hi: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of rank n (from 0) among values[lo:hi]."""
        found = np.zeros(len(lo), np.int32)
        for bit, zeros in self._levels():
            a, b = zeros[lo], zeros[hi]
            one = n >= b - a
            n = np.where(one, n - (b - a), n)
            found |= one.astype(np.int32) << bit
            lo, hi = np.where(one, zeros[-1] + lo - a, a), np.where(one, zeros[-1] + hi - b, b)
        return found


def suffixes(x: np.ndarray, longest: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
    """The suffixes of x in order of their first words, and per level (L, first words, interval starts, interval ends) of the dyadic blocks that stand more than once.

    The order tells apart suffixes by their first 2 * longest words at least; levels go up to blocks of `longest` words.
    """
    n = len(x)
    order = np.argsort(x, kind="stable").astype(np.int32)
    opens = np.flatnonzero(np.concatenate([[True], x[order[1:]] != x[order[:-1]]]))
    sizes = np.diff(np.append(opens, n))
    rank, size = np.empty(n, np.int32), np.empty(n, np.int32)  # where a suffix's class begins in the order, and how many it has
    rank[order], size[order] = np.repeat(opens, sizes), np.repeat(sizes, sizes)
    levels, length = [], 1
    while True:
        blocks = np.arange(0, n - length + 1, length)
        blocks = blocks[size[blocks] > 1].astype(np.int32)
        if length <= longest and len(blocks):
            levels.append((length, blocks, rank[blocks], rank[blocks] + size[blocks]))
        open_ = np.flatnonzero(size > 1)
        if length > longest or not len(open_):
            return order, levels
        # classes of several suffixes are sorted by the class that stands `length` further on; one past the end is least
        further = open_ + length
        key = rank[open_].astype(np.int64) * (n + 1) + np.where(further < n, rank[np.minimum(further, n - 1)] + 1, 0)
        by = np.argsort(key, kind="stable")
        some, key = open_[by], key[by]
        old = rank[some]
        first = np.concatenate([[True], old[1:] != old[:-1]])
        place = old + np.arange(len(some)) - np.maximum.accumulate(np.where(first, np.arange(len(some)), 0))
        order[place] = some
        fresh = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(fresh, len(some)))
        rank[some], size[some] = np.repeat(place[fresh], sizes), np.repeat(sizes, sizes)
        length *= 2


def _candidates(tree: Wavelet, length: int, blocks: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period): words place .. place + length - 1 stand again `period` words later, length/2 < period <= length."""
    own = tree.below(lo, hi, blocks)
    later = np.flatnonzero(own + 1 < hi - lo)
    step = tree.nth(lo[later], hi[later], own[later] + 1) - blocks[later]
    some = (step <= length) & (2 * step > length)
    places, periods = [blocks[later[some]]], [step[some]]
    before = np.flatnonzero(own > 0)
    step = blocks[before] - tree.nth(lo[before], hi[before], own[before] - 1)
    some = (step <= length) & (2 * step > length)
    places.append(blocks[before[some]] - step[some])
    periods.append(step[some])
    return np.concatenate(places).astype(np.int64), np.concatenate(periods).astype(np.int64)


def _extended(x: np.ndarray, length: int, places: np.ndarray, periods: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Candidates put together and extended: (starts, ends, period) of stretches that no neighbour extends."""
    by = np.lexsort((places, periods))
    places, periods = places[by], periods[by]
    edges = np.flatnonzero(np.concatenate([[True], np.diff(periods) != 0, [True]])) if len(places) else np.zeros(1, np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        q, at = int(periods[a]), places[a:b]
        apart = np.flatnonzero(np.diff(at) > length)
        lo, hi = at[np.append(0, apart + 1)], at[np.append(apart, len(at) - 1)] + length
        # the words that break the period, around these stretches
        left, right = max(0, int(lo[0]) - 2 * length), min(len(x) - q, int(hi[-1]) + 2 * length)
        broken = np.flatnonzero(x[left:right] != x[left + q : right + q]) + left
        broken = np.concatenate([[left - 1], broken, [right]])
        starts, ends = broken[np.searchsorted(broken, lo) - 1] + 1, broken[np.searchsorted(broken, hi)] + q
        starts, pick = np.unique(starts, return_index=True)
        yield starts, ends[pick], q


def runs_of(x: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of all runs of x, whose texts have at most `longest` words and a number of their own at each end."""
    none = np.zeros(0, np.int64)
    if longest < LEAST:
        return none, none, none
    order, levels = suffixes(x, max(1, longest // 2))
    out = [(none, none, none)]
    if levels:
        tree = Wavelet(order)
        for length, blocks, lo, hi in levels:
            for starts, ends, q in _extended(x, length, *_candidates(tree, length, blocks, lo, hi)):
                long = ends - starts >= max(LEAST, EXPONENT * q)
                out.append((starts[long], (ends - starts)[long], np.full(int(long.sum()), q)))
    starts, lengths, periods = map(np.concatenate, zip(*out, strict=True))
    by = np.lexsort((periods, starts))
    return starts[by], lengths[by], periods[by]


def _taken(texts: list[str | None]) -> Iterator[tuple[list[int], list[list[str]]]]:
    """Texts with words, the shorter ones first, in runs of about TOGETHER words: (their numbers, their words)."""
    numbers, held, size = [], [], 0
    for k in sorted(range(len(texts)), key=lambda k: len(texts[k] or "")):
        words = (texts[k] or "").encode("utf-8", "surrogatepass").split()
        if not words:
            continue
        if numbers and size + len(words) > TOGETHER:
            yield numbers, held
            numbers, held, size = [], [], 0
        numbers.append(k)
        held.append(words)
        size += len(words) + 1
    if numbers:
        yield numbers, held


def judged(texts: list[str | None]) -> list[tuple[int, list[tuple[int, int, int]], str]]:
    """For each text: how many words it has, its runs (start, length, period) by start and period, and its words without the repeats of runs."""
    out: list[tuple] = [(0, [], "")] * len(texts)
    for numbers, held in _taken(texts):
        known: dict[bytes, int] = {}
        fresh, flat, opens = count(len(held)), [], []
        for own, words in enumerate(held):
            opens.append(len(flat))
            flat += [known[w] if w in known else known.setdefault(w, next(fresh)) for w in words]
            flat.append(own)  # no word has the number of a text
        x = np.array(flat, np.int64)
        starts, lengths, periods = runs_of(x, max(map(len, held)))
        change = np.zeros(len(x) + 1, np.int32)
        np.add.at(change, starts + periods, 1)
        np.add.at(change, starts + lengths, -1)
        kept = np.cumsum(change)[:-1] == 0
        cuts = np.searchsorted(starts, [*opens, len(x)]).tolist()
        for k, words, at, a, b in zip(numbers, held, opens, cuts[:-1], cuts[1:], strict=True):
            left = words if a == b else [w for w, keep in zip(words, kept[at : at + len(words)].tolist(), strict=True) if keep]
            found = list(zip((starts[a:b] - at).tolist(), lengths[a:b].tolist(), periods[a:b].tolist(), strict=True))
            out[k] = (len(words), found, b" ".join(left).decode("utf-8", "surrogatepass"))
    return out


_RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])


def periodic_runs(docs: DataFrame, keep: tuple = ("doc_id",), text: str = "text") -> DataFrame:
    """docs -> the `keep` columns, n_words, runs (array of start, length, period by start, then period) and collapsed, one row a row of docs.

    Words are runs of characters other than ASCII white space, numbered from 0. `collapsed` holds the words, joined by one space,
    without those that a run has after its first period. Null and empty texts have no words and no runs, and an
    empty `collapsed`. Repeated rows give a row each; other columns are left aside; an empty table gives an empty table. A text of any
    length is taken whole; a task holds one at a time, with about 60 bytes a word beside it. The three names must not be among `keep`.
    """
    small_batches(docs.sparkSession)
    # numbered names, as names with dots do not pass through mapInArrow
    some = docs.select(*[F.col(f"`{c}`").alias(f"_{k}") for k, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("_text"))
    schema = T.StructType([*some.schema.fields[:-1], T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(_RUN)), T.StructField("collapsed", T.StringType())])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()]
        for batch in batches:
            n_words, runs, collapsed = zip(*judged(batch.column(batch.num_columns - 1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            runs = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in found] for found in runs]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(v, k) for v, k in zip((n_words, runs, collapsed), kinds, strict=True)]], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    return some.mapInArrow(of, schema).select(*[F.col(f"_{k}").alias(c) for k, c in enumerate(keep)], "n_words", "runs", "collapsed")
