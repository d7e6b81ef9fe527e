"""Cells of a text, and how they are learned."""

import random

import regex

from quire.llm import pieces


def test_cells_are_those_of_the_expression():
    units, rng = pieces.Lattice(), random.Random(8)
    letters = regex.compile(r"▁*\p{L}+|▁*[^\p{L}▁\n]+|\n|▁+")
    texts = ["", " ", "\n", "▁x", "  \n  a", "a1é 日本.\n\nb"] + ["".join(rng.choice("aé語 \n▁.1²ª́😀") for _ in range(rng.randint(0, 40))) for _ in range(500)]
    cells, ends = units.split(texts)
    want = [letters.findall("▁" + t.replace(" ", "▁")) if t else [] for t in texts]
    assert cells == [c for some in want for c in some]
    assert [hi - lo for lo, hi in zip([0, *ends], ends)] == [len(some) for some in want]
    assert list(units.encode_all([], 2)) == []


def test_cells_of_all_lengths_are_learned_together(monkeypatch):
    """One pass for many lengths; before, each length had its own over all stretches of its cells."""
    units, rng, calls = pieces.Lattice(), random.Random(9), []
    cells = sorted({pieces.SPACE * rng.randint(0, 1) + "".join(rng.choice("etaoinshré") for _ in range(rng.randint(1, 30))) for _ in range(2000)})
    many = units._learn_many
    monkeypatch.setattr(units, "_learn_many", lambda some, *n: calls.append(len(some)) or many(some, *n))
    units.learn([*cells, "\U0010ffff" * 3, "x" * 40])
    assert calls == [len(cells) + 1]
    for c in [*cells[::9], "\U0010ffff" * 3, "x" * 40]:
        two = units.search(c, 2)
        assert units.best[c] == (two[0][0], two[0][1], two[0][0] - two[1][0] if len(two) > 1 else float("inf"))
