"""Time windows, quotas and scores over columns."""

from __future__ import annotations

from pyspark.sql import Column, Window as W, functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch; times without a zone are UTC (the session's zone)."""
    return F.unix_micros(ts.cast("timestamp"))


def window_start(ts: Column, seconds: int) -> Column:
    """The start of the fixed window, an epoch floor in UTC, as microseconds."""
    return micros(ts) - F.pmod(micros(ts), F.lit(seconds * 1_000_000))


def retry_after(now: Column, end: Column) -> Column:
    """Whole seconds until a window ends (both in microseconds), rounded up, 1 to 86400."""
    return F.greatest(F.lit(1), F.least(F.lit(86_400), F.ceil((end - now) / 1_000_000))).cast("int")


def remaining(limit: Column, used: Column) -> Column:
    return F.greatest(limit - used, F.lit(0))


def iso_week_id(ts: Column) -> Column:
    """YYYY-Www with the ISO year."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def to_utc(ts: Column, zone: Column) -> Column:
    return F.to_utc_timestamp(ts, zone)


def cosine(a: Column, b: Column) -> Column:
    """In double precision, in index order; null if a vector has no length."""
    x, y = a.cast("array<double>"), b.cast("array<double>")

    def dot(p: Column, q: Column) -> Column:
        return F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda acc, v: acc + v)

    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def rrf(rank: Column, k: int = 60) -> Column:
    return F.round(F.lit(1.0) / (k + rank), 6)


def merge_json(a: Column, b: Column) -> Column:
    """Two maps as one, the second's values winning."""
    return F.map_concat(F.map_filter(a, lambda k, v: ~F.array_contains(F.map_keys(b), k)), b)


def evidence_ids(lists: Column) -> Column:
    """Lists of ids as one sorted list of distinct ids."""
    return F.array_sort(F.array_distinct(F.flatten(lists)))


# Confidence by field of a metadata assertion, and by the rule that matched a reference.
CONFIDENCE = {"title": 0.85, "authors": 0.65, "year": 0.35, "venue": 0.4, "arxiv_id": 0.8, "abstract": 0.8}
MATCHED = {"normalized-title-exact": 0.99, "normalized-title-substring": 0.92}


def confidence(rule: Column) -> Column:
    """Of a field or a matching rule; 0 of any other."""
    out = F.lit(0.0)
    for k, v in (CONFIDENCE | MATCHED).items():
        out = F.when(rule == k, F.lit(v)).otherwise(out)
    return out


def first_in_order(partition: list, order: list, most: int = 1) -> Column:
    """Whether a row is among the first `most` of its partition."""
    return F.row_number().over(W.partitionBy(*partition).orderBy(*order)) <= most
