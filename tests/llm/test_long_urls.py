"""Rules on the last tokens of long URLs."""

from quire.llm import urls


def test_rules_on_late_tokens_of_long_urls(spark):
    long = [f"path=w{k}" for k in range(14)]
    rows = [([*long, "key=late", "fragment"], True)] * 30 + [([*long, "key=late"], False)] * 10 + [(["key=late"], False)] * 25 + [([*long], False)] * 60
    got = {tuple(r["tokens"]): (r["size"], round(r["confidence"], 6)) for r in urls.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean")).collect()}
    assert got[("fragment",)] == (1, 1.0)
    assert got == {("fragment",): (1, 1.0)} | {("key=late", w): (2, 0.75) for w in long}
