"""Small expected values of text functions and accounting."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quire.functions import accounting as A
from quire.functions import text as T


def one(spark, make, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{i}" for i in range(len(values))])
    return df.select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("make", "text", "want"),
    [
        (T.normalized_title, "  The Quick-Brown: Fox! ", "the quick brown fox"),
        (T.normalized_name, "Ｊｏｓé  García", "josé garcía"),
        (T.normalized_cite, "Deep-Learning  for A.I.", "deeplearning for ai"),
        (T.squash_title, "A b-C 1", "abc1"),
        (T.title_identifier, "attention is all YOU need", "Attention_Is_All_You_Need"),
        (T.title_identifier, "!!!", "Untitled"),
        (T.semantic_role, "3. Related Work and more", "related_work"),
        (T.semantic_role, "Thanks", None),
        (T.detect_venue, "Proceedings of ICLR 2021, OpenReview", "ICLR"),
        (T.arxiv_id, "see arXiv:2401.12345v2.", "2401.12345"),
        (T.normalized_doi, "https://doi.org/10.1/AbC", "10.1/abc"),
        (T.infer_year, "in 2021 and 2019, again 2019 but 2015 2015 2015", 2019),
        (T.first_sentence, "Short one. This sentence is surely long enough to count. More.", "This sentence is surely long enough to count."),
        (T.dehyphenate, "multi-\nline ﬁx", "multiline fix"),
        (T.heading_level, "2.1.3 Training Details", 3),
        (T.heading_level, "REFERENCES:", 1),
        (T.heading_level, "2 of the mice were ill", None),
        (T.is_affiliation, "MIT", True),
        (T.is_affiliation, "Oquab Maxime", False),
        (T.is_affiliation, "Mountain View, CA", True),
        (T.replace_citations, "\\cite{" + ",".join(f"k{i}" for i in range(25)) + "} \\cite{ }", "[cite:" + "; ".join(f"k{i}" for i in range(25)) + "] [cite]"),
        (T.heading_level, "ABSTRACT", None),
        (T.heading_level, "Limitations", 1),
        (T.heading_level, "EXPERIMENTAL SETUP:", 1),
        (T.heading_level, "3 a Method", None),
        (T.is_affiliation, "Group of Engineering", True),
        (T.is_affiliation, "Acme inc. of", False),
        (T.is_affiliation, "Ann New York", True),
        (A.confidence, "title", 0.85),
        (A.confidence, "venue", 0.4),
        (A.confidence, "normalized-title-substring", 0.92),
        (A.confidence, "lang", 0.0),
        (lambda x: T.year_of(x)["year"], "\\usepackage{a2009b2017-2021}", 2017),
        (lambda x: T.year_of(x)["year"], "\\documentclass[draft1999]{x2012}", 1999),
        (T.replace_citations, "a \\citep[see][]{x, y,z} b \\ref{s:1}", "a [cite:x; y; z] b [ref:s:1]"),
    ],
)
def test_text(spark, make, text, want):
    assert one(spark, make, text) == want


def test_lists(spark):
    assert one(spark, T.cite_keys, "\\cite{b,a} \\citet{c} \\cite{a}") == ["a", "b", "c"]
    assert one(spark, T.bibtex_authors, "Knuth, Donald and van Dyk, Jr, Bo and {Plato}") == ["Donald Knuth", "Bo van Dyk Jr", "Plato"]
    assert one(spark, T.contributions, "We propose a new way of counting sheep. Fine.") == ["We propose a new way of counting sheep"]
    got = {m["name"]: m["value"] for m in one(spark, T.paper_metrics, "accuracy of 92.3% and F1: 0.87, F1: 0.9. | BLEU | 31.5 | loss = 0.4, loss = 0.2")}
    assert got == {"accuracy": pytest.approx(0.923), "f1_score": 0.9, "bleu": pytest.approx(0.315), "loss": 0.2}
    got = {m["name"]: m["value"] for m in one(spark, T.run_metrics, "loss: 3.0\nloss: 1.5 accuracy=88")}
    assert got == {"accuracy": pytest.approx(0.88), "loss": 1.5}


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "c string")
    for f in (T.normalized_title, T.normalized_cite, T.semantic_role, T.detect_venue, T.first_sentence, T.clean_title):
        assert df.select(f(F.col("c")).alias("x")).first()["x"] is None


def test_year_places(spark):
    df = spark.createDataFrame([("\\date{June 2017}",), ("arXiv:9901.00001",), ("none",)], "c string")
    got = [tuple(r["y"]) if r["y"] else None for r in df.select(T.year_of(F.col("c")).alias("y")).collect()]
    assert got == [(2017, "tex:date"), (1999, "tex:arxiv_submission"), None]


def test_accounting(spark):
    us = lambda h, m, s: int(dt.datetime(2024, 1, 1, h, m, s, tzinfo=dt.UTC).timestamp() * 1_000_000)
    assert one(spark, lambda a, b: A.retry_after(a, b), us(0, 37, 42), us(1, 0, 0)) == 1338
    assert one(spark, lambda a, b: A.retry_after(a, b), us(0, 0, 0), us(0, 0, 0) + 10**13) == 86_400
    assert one(spark, lambda t: A.iso_week_id(t), dt.datetime(2024, 12, 30)) == "2025-W01"
    assert one(spark, lambda r: A.rrf(r), 1) == pytest.approx(0.016393)
    assert one(spark, A.cosine, [1.0, 0.0], [0.0, 0.0]) is None
