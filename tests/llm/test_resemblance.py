"""The near-duplicate stage against brute force over all pairs."""

import random

import pytest

import corpus_pipeline
from quire.llm import resemblance


def brute_set(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([tuple(w)] if w else [])


def brute_groups(texts):
    sets = {k: brute_set(t) for k, t in texts.items()}
    of = {k: k for k in texts}
    for a in texts:
        for b in texts:
            if a < b and 9 * len(sets[a] & sets[b]) >= 4 * (len(sets[a]) + len(sets[b])):
                low, high = sorted((of[a], of[b]))
                of = {k: low if g == high else g for k, g in of.items()}
    return of


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("sampled,often", [(resemblance.SAMPLED, resemblance.OFTEN), (1, 2)])
def test_near_dedup_keeps_one_of_each_similar_group(spark, monkeypatch, sampled, often):
    monkeypatch.setattr(resemblance, "SAMPLED", sampled)
    monkeypatch.setattr(resemblance, "OFTEN", often)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, texts = [word() for _ in range(30)], {}
    for base in ([word() for _ in range(n)] for n in (9, 40, 120, 200, 200, 400)):
        for n in (0, 1, 1, 2, 4, 6, 9):
            texts[len(texts)] = " ".join(changed(rng, base, min(n, len(base))))
    for n in (10, 20, 60, 100):
        texts[len(texts)] = " ".join(passage + [word() for _ in range(n)])
    base, step = [word() for _ in range(300)], 0
    for _ in range(12):  # a chain whose ends are not similar
        texts[len(texts)] = " ".join(base[step : step + 200])
        step += 9
    for _ in range(60):  # one large group of near copies
        texts[len(texts)] = " ".join(changed(rng, base[:150], 2))
    texts |= {len(texts): "a b", len(texts) + 1: "A  b", len(texts) + 2: "", len(texts) + 3: " "}
    groups = brute_groups(texts)
    assert len(set(groups.values())) < len(texts) - 60
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_dedup(spark, frame, "")
    blank = {k for k, t in texts.items() if not t.split()}
    want = {k for k, g in groups.items() if k == g and k not in blank} | {min(blank)}
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(want)
