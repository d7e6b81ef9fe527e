"""SentencePiece encoding and decoding with the N best segmentations.

The pieces of a public SentencePiece model and their scores span a lattice over the text (`▁` for a
space, one put before the text). A forward Viterbi pass gives the best score from the start to
every position; these are exact heuristics for an A* search from the end backwards, which hands out
segmentations from best to worst.

No piece holds a `▁` after another character, a line break among others, or letters next to other
characters than `▁`, so every path of the lattice goes through the cuts there. The search therefore runs on
cells between cuts; a text's N best are the N best sums over its cells, and only the N - 1 cells whose second
segmentation costs least can differ in them. A Viterbi pass that keeps two scores a position runs on many distinct
cells at once, over the arcs of their lattices in arrays, and gives each cell's best path and the cost of its second;
A* then runs on the few cells that can differ. Equal scores go to the longer last piece, in the arrays as in A*.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, functions as F

from quire.plans.session import small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Cells that a worker remembers, characters of texts encoded together, and the longest cell that goes through arrays.
CACHE_CELLS, TOGETHER, LONGEST = 60_000, 400_000, 32
UNKNOWN_COST = 10.0
#: Cells that go through arrays together, the kinds of characters where cells are cut, and bits of the table of pieces.
CELLS, LETTER, BLANK, BREAK, BITS = 16_384, 1, 2, 3, 19
_U = np.uint64


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class _Numbers(dict):
    """Cells by number; a cell that is asked for the first time gets the next."""

    def __missing__(self, cell: str) -> int:
        self[cell] = number = len(self)
        return number


class Best:
    """The best segmentation of each known cell: its score, what the second costs more, and where its ids are."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.numbers, self.used = _Numbers(), 0
        self.scores, self.losses = np.zeros(1024), np.zeros(1024)
        self.lows, self.sizes, self.ids = np.zeros(1024, np.int64), np.zeros(1024, np.int64), np.zeros(4096, np.int32)

    def __len__(self) -> int:
        return len(self.numbers)

    def __getitem__(self, cell: str) -> tuple[float, bytes, float]:
        if cell not in self.numbers:
            raise KeyError(cell)
        k = self.numbers[cell]
        return float(self.scores[k]), self.ids[self.lows[k] : self.lows[k] + self.sizes[k]].tobytes(), float(self.losses[k])

    def numbered(self, cells: list[str]) -> np.ndarray:
        return np.fromiter(map(self.numbers.__getitem__, cells), np.int64, len(cells))

    def put(self, at: np.ndarray, scores, losses, sizes, ids: np.ndarray) -> None:
        """Results of the cells with these numbers; ids one cell after another."""
        if (n := len(self.numbers)) > len(self.scores):
            for name in ("scores", "losses", "lows", "sizes"):
                old = getattr(self, name)
                grown = np.zeros(2 * n, old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(self.used + 2 * len(ids), np.int32)])
        self.ids[self.used : self.used + len(ids)] = ids
        self.scores[at], self.losses[at], self.sizes[at] = scores, losses, sizes
        self.lows[at] = self.used + np.cumsum(sizes) - sizes
        self.used += len(ids)

    def taken(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the cells with these numbers, one after another, and where each cell's end."""
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.lows[at] - ends + sizes, sizes) + np.arange(sizes.sum())], ends


class Lattice:
    """The pieces of a model as a prefix table, and searches on it."""

    def __init__(self, model: str = MODEL):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.texts, self.table, self.bytes_of = {}, {}, {}
        low = 0.0
        for k in range(sp.get_piece_size()):
            piece = sp.id_to_piece(k)
            if sp.is_byte(k):
                self.bytes_of[int(piece[1:-1], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                self.table[piece] = (sp.get_score(k), k)
                self.texts[k] = piece
                if sp.get_score(k) > -1e8:
                    low = min(low, sp.get_score(k))
        if len(self.bytes_of) != 256:
            raise ValueError("the model needs pieces for all bytes")
        self.unknown = low - UNKNOWN_COST
        self.prefixes = {p[:n]: None for p in self.table for n in range(1, len(p) + 1)} | self.table
        if any(regex.search(rf"[^{SPACE}]{SPACE}|\n.|.\n|\p{{L}}[^\p{{L}}]|[^\p{{L}}{SPACE}]\p{{L}}", p, regex.S) for p in self.table):
            raise ValueError("pieces cross the cuts at spaces, line breaks or letters")
        self.kinds = np.zeros(0x110000, np.uint8)
        for m in regex.finditer(r"\p{L}+", np.arange(len(self.kinds), dtype=np.uint32).tobytes().decode("utf-32-le", "surrogatepass")):
            self.kinds[m.start() : m.end()] = LETTER
        self.kinds[ord(SPACE)], self.kinds[ord("\n")] = BLANK, BREAK
        self._index()
        self.raw = {k: p.encode() for k, p in self.texts.items()} | {k: bytes([b]) for b, k in self.bytes_of.items()}
        self.best = Best()
        self.several: dict[tuple, list] = {}

    def _index(self) -> None:
        """A number for every prefix of a piece, found by that of the prefix without its last character and this character:
        in a table of slots, and in a second one if the slot is taken."""
        self.longest = max(map(len, self.table))
        number = {p: n for n, p in enumerate(self.prefixes, 1)} | {"": 0}
        self.keys = np.array([0] + [number[p[:-1]] << 32 | ord(p[-1]) for p in self.prefixes], _U)
        self.keys[0] = _U(0xFFFFFFFFFFFFFFFF)
        self.scores = np.array([0.0] + [hit[0] if hit else 0.0 for hit in self.prefixes.values()])
        self.ids = np.array([-1] + [hit[1] if hit else -1 for hit in self.prefixes.values()], np.int32)
        rng = np.random.default_rng(1)
        self.slots, left = [], np.arange(1, len(self.keys))
        while len(left):  # of two pieces with one slot the later has it
            if len(self.slots) == 8:
                raise ValueError("the pieces do not fit the tables")
            factor, slots = _U(rng.integers(1 << 62) * 2 + 1), np.zeros(1 << BITS, np.int32)
            at = (self.keys[left] * factor >> _U(64 - BITS)).astype(np.int64)
            slots[at] = left
            self.slots.append((factor, slots))
            left = left[slots[at] != left]

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """The number of the prefix with each key, 0 if none."""
        out, left = None, None
        for factor, slots in self.slots:
            some = keys if left is None else keys[left]
            hit = slots[(some * factor >> _U(64 - BITS)).astype(np.int64)]
            wrong = self.keys[hit] != some
            if left is None:
                out, left = hit, np.flatnonzero(wrong & (hit > 0))
                out[wrong] = 0
            else:
                out[left] = np.where(wrong, 0, hit)
                left = left[wrong & (hit > 0)]
            if not len(left):
                break
        return out

    def learn(self, cells: list[str]) -> None:
        """Puts the best segmentation of each cell, and what its second costs more, into `best`."""
        short = sorted((c for c in cells if len(c) <= LONGEST), key=len, reverse=True)
        alone = [c for c in cells if len(c) > LONGEST]
        for lo in range(0, len(short), CELLS):
            some = short[lo : lo + CELLS]
            alone += some if len(some) < 4 else self._learn_many(some)
        for c in alone:
            two = self.search(c, 2)
            ids = np.frombuffer(two[0][1], np.int32)
            self.best.put(self.best.numbered([c]), two[0][0], two[0][0] - two[1][0] if len(two) > 1 else np.inf, np.array([len(ids)]), ids)

    def _arcs(self, cells: list[str], sizes: np.ndarray, have: np.ndarray) -> list[tuple]:
        """The arcs of all cells, by the length of their pieces less one: (cells, scores, ids, where those from each position begin), by position, then cell.

        `have` is how many cells, the longest first, have a character at each position.
        """
        n = sizes[0]
        at, first = np.repeat(np.arange(n), have), np.cumsum(have) - have
        cell = np.arange(len(at)) - first[at]
        codes = _codes("".join(cells))[(np.cumsum(sizes) - sizes)[cell] + at].astype(_U)
        have, first = np.append(have, np.zeros(self.longest, np.int64)), np.append(first, np.zeros(self.longest, np.int64))
        node, out = self._find(codes), []
        ids = self.ids[node]  # a character without a piece becomes its bytes
        out.append((cell, np.where(ids >= 0, self.scores[node], self.unknown), ids, np.searchsorted(at, np.arange(n + 1)).tolist()))
        for k in range(1, self.longest):
            on = np.flatnonzero((node > 0) & (cell < have[at + k]))
            if not len(on):
                break
            at, cell = at[on], cell[on]
            node = self._find(node[on].astype(_U) << _U(32) | codes[first[at + k] + cell])
            hit = np.flatnonzero(self.ids[node] >= 0)
            out.append((cell[hit], self.scores[node[hit]], self.ids[node[hit]], np.searchsorted(at[hit], np.arange(n + 1)).tolist()))
        return out

    def _learn_many(self, cells: list[str]) -> list[str]:
        """Learns cells, the longest first, in arrays with a row for each position and a column for each cell; those that need bytes are handed back."""
        count, sizes = len(cells), np.fromiter(map(len, cells), np.int64, len(cells))
        n, every = int(sizes[0]), np.arange(len(cells))
        have = np.searchsorted(-sizes, -np.arange(n))
        best, second = np.full((n + 1, count), -np.inf), np.full((n + 1, count), -np.inf)
        start, piece = np.zeros((n + 1, count), np.int16), np.zeros((n + 1, count), np.int32)
        best[0] = 0.0
        arcs = self._arcs(cells, sizes, have)
        for i in range(n):
            for j, (where, gains, ids, begin) in enumerate(arcs, i + 1):
                lo, hi = begin[i], begin[i + 1]
                if lo == hi:
                    continue
                c, gain = where[lo:hi], gains[lo:hi]
                one, two, had = best[i, c] + gain, second[i, c] + gain, best[j, c]
                better = one > had
                second[j, c] = np.maximum(np.minimum(one, had), np.where(better, two, second[j, c]))
                best[j, c] = np.maximum(one, had)
                c = c[better]
                start[j, c], piece[j, c] = i, ids[lo:hi][better]
        on = np.zeros((n + 1, count), bool)
        on[sizes, every] = True
        for j in range(n, 0, -1):
            c = np.flatnonzero(on[j])
            on[start[j, c], c] = True
        taken = np.ascontiguousarray(on[1:].T)
        ids, pieces = piece[1:].T[taken], taken.sum(axis=1)
        odd = np.zeros(count, bool)
        odd[np.repeat(every, pieces)[ids < 0]] = True
        ids, known = ids[~np.repeat(odd, pieces)], np.flatnonzero(~odd)
        top = best[sizes, every]
        self.best.put(self.best.numbered(cells)[known], top[known], (top - second[sizes, every])[known], pieces[known], ids)
        return [cells[k] for k in np.flatnonzero(odd).tolist()]

    def _lattice(self, cell: str) -> tuple[list, list]:
        """Viterbi scores of all positions, and the arcs that end at each: (start, score, ids)."""
        n, look = len(cell), self.prefixes
        score: list = [None] * (n + 1)
        score[0] = 0.0
        into: list = [[] for _ in range(n + 1)]
        for i in range(n):
            here, single = score[i], False
            for j in range(i + 1, n + 1):
                hit = look.get(cell[i:j], 0)
                if hit == 0:
                    break
                if hit is None:
                    continue
                single |= j == i + 1
                into[j].append((i, hit[0], hit[1]))
                if score[j] is None or here + hit[0] > score[j]:
                    score[j] = here + hit[0]
            if not single:  # a character without a piece becomes its bytes
                into[i + 1].append((i, self.unknown, -1))
                if score[i + 1] is None or here + self.unknown > score[i + 1]:
                    score[i + 1] = here + self.unknown
        return score, into

    def search(self, cell: str, n: int) -> list[tuple[float, bytes]]:
        """The n best segmentations of one cell: (score, ids as int32 bytes), best first; equal scores in a fixed order."""
        score, into = self._lattice(cell)
        end, count, out = len(cell), 0, []
        queue = [(-score[end], 0, 0, end, 0.0, None)]
        while queue and len(out) < n:
            _, _, _, at, behind, tail = heapq.heappop(queue)
            if at == 0:
                ids, walk = [], tail
                while walk is not None:
                    start, k, walk = walk
                    ids += [k] if k >= 0 else [self.bytes_of[b] for b in cell[start].encode("utf-8", "replace")]
                out.append((behind, np.array(ids, np.int32).tobytes()))
                continue
            for start, gain, k in into[at]:
                count += 1
                total = behind + gain
                heapq.heappush(queue, (-(total + score[start]), start, count, start, total, (start, k, tail)))
        return out

    def alternatives(self, cell: str, n: int) -> list[tuple[float, bytes]]:
        hit = self.several.get((cell, n))
        if hit is None:
            if len(self.several) >= CACHE_CELLS // 8:
                self.several.clear()
            hit = self.several[cell, n] = self.search(cell, n)
        return hit

    def split(self, texts: list[str]) -> tuple[list[str], list[int]]:
        """The cells of texts, one text after another, and how many there are up to the end of each.

        A cell is a run of letters, or of others, with the `▁` before it; a line break; or `▁` without either after them.
        """
        whole = "".join([SPACE + t if t else t for t in texts]).replace(" ", SPACE)
        kind = self.kinds[_codes(whole)]
        new = kind == BREAK
        new[1:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != BLANK)
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        new[np.append(0, ends[:-1])[np.diff(ends, prepend=0) > 0]] = True
        begin = np.flatnonzero(new)
        cells = [whole[lo:hi] for lo, hi in itertools.pairwise([*begin.tolist(), len(whole)])]
        return cells, np.searchsorted(begin, ends).tolist()

    def encode_all(self, texts: list[str], n: int = 1) -> Iterator[list[tuple[float, list[bytes]]]]:
        """encode() of several texts; their cells are learned together."""
        if not texts:
            return
        if len(self.best) > CACHE_CELLS:
            self.best.clear()
        cells, ends = self.split(texts)
        known = len(self.best)
        at = self.best.numbered(cells)
        self.learn(list(itertools.islice(self.best.numbers, known, None)))
        ids, stops = self.best.taken(at)
        scores, losses, stops = self.best.scores[at], self.best.losses[at], np.append(0, stops)
        for lo, hi in itertools.pairwise([0, *ends]):
            yield self._segmentations(cells[lo:hi], scores[lo:hi], losses[lo:hi], ids[stops[lo] : stops[hi]].tobytes(), stops[lo : hi + 1] - stops[lo], n)

    def encode(self, text: str, n: int = 1) -> list[tuple[float, list[bytes]]]:
        """The n best segmentations of a whole text: (score, ids as int32 bytes, in runs). An empty text has one, without pieces."""
        return next(self.encode_all([text], n))

    def _segmentations(self, cells: list[str], scores: np.ndarray, loss: np.ndarray, raw: bytes, stops: np.ndarray, n: int) -> list[tuple[float, list[bytes]]]:
        """The n best of a text from the best of its cells, whose ids are `raw`, cut at `stops`."""
        if not cells:
            return [(0.0, [])]
        total = float(scores.sum())
        if n == 1:
            return [(total, [raw])]
        # sums: {cell number: choice} and what they cost, least cost first
        combined: list = [(0.0, ())]
        near = np.flatnonzero(loss <= np.partition(loss, n - 2)[n - 2]) if len(loss) > n else np.arange(len(loss))
        for at in sorted(near[np.argsort(loss[near], kind="stable")][: n - 1].tolist()):
            options = self.alternatives(cells[at], n)
            grown = [(cost + options[0][0] - s, (*picked, (at, k)) if k else picked) for cost, picked in combined for k, (s, _) in enumerate(options)]
            combined = heapq.nsmallest(n, grown)
        out = []
        for cost, picked in combined:
            runs, done = [], 0
            for at, k in picked:
                runs += [raw[done : 4 * stops[at]], self.alternatives(cells[at], n)[k][1]]
                done = 4 * stops[at + 1]
            out.append((total - cost, [*runs, raw[done:]]))
        return out

    def decode(self, ids) -> str:
        """The text of ids: pieces and bytes put together, `▁` back to spaces, the one before the text taken off. Unknown ids raise KeyError."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


_lattices: dict[str, Lattice] = {}


def lattice(model: str = MODEL) -> Lattice:
    """One lattice a worker and model."""
    if model not in _lattices:
        _lattices[model] = Lattice(model)
    return _lattices[model]


def encode(docs: DataFrame, text: str = "text", n: int = 4, model: str = MODEL, keep: tuple = ("doc_id",), ids: bool = True) -> DataFrame:
    """docs -> the `keep` columns, ids (the best segmentation), nbest: array of (score, n_pieces, sha256 of its little-endian int32 ids), best
    first, and round_trip: whether decoding the ids gives the text back.

    A null text gives null in all three; an empty text has one segmentation without pieces. A `▁` in a text is read
    as a space, as SentencePiece does. Texts are encoded whole; fewer than n entries mean that there are no more. Without
    `ids` that column is null, which spares moving it.
    """

    @F.pandas_udf("ids array<int>, nbest array<struct<score:double,n_pieces:int,sha256:string>>, round_trip boolean")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        units = lattice(model)
        for s in texts:  # results leave in smaller batches than texts come, so few ids are held at once
            for lo, hi in _together(s):
                some = s.iloc[lo:hi].tolist()
                rows: list = [(None, None, None)] * len(some)
                real = [k for k, t in enumerate(some) if isinstance(t, str)]
                for k, found in zip(real, units.encode_all([some[k] for k in real], n), strict=True):
                    raws = [b"".join(cells) for _, cells in found]
                    best = np.frombuffer(raws[0], np.int32)
                    nbest = [{"score": score, "n_pieces": len(raw) // 4, "sha256": hashlib.sha256(raw).hexdigest()} for (score, _), raw in zip(found, raws, strict=True)]
                    rows[k] = (best if ids else None, nbest, units.decode(best.tolist()) == some[k].replace(SPACE, " "))
                yield pd.DataFrame(rows, columns=["ids", "nbest", "round_trip"])
        # the worker may serve other stages next: it keeps the model, not what it remembered of these texts
        units.best.clear()
        units.several.clear()

    small_batches(docs.sparkSession)
    return docs.select(*keep, of(F.col(text)).alias("_e")).select(*keep, "_e.ids", "_e.nbest", "_e.round_trip")


def _together(s: pd.Series) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about TOGETHER characters in all."""
    lo = size = 0
    for k, t in enumerate(s):
        size += len(t) if isinstance(t, str) else 0
        if size >= TOGETHER:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(s):
        yield lo, len(s)


def decoded(ids: Column, model: str = MODEL) -> Column:
    """The text of a column of id arrays (null: null)."""

    @F.pandas_udf("string")
    def of(rows: Iterator[pd.Series]) -> Iterator[pd.Series]:
        units = lattice(model)
        for s in rows:
            yield pd.Series([None if r is None else units.decode(r.tolist()) for r in s], dtype=object)

    return of(ids)
