"""The quota processor against a simulation, in one batch and in several, and ingest by keys."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quire.streaming import accounting as S, quota as Q

SCHEMA = "event_id long, ts timestamp, tenant long, lease string, action string, request_limit int, concurrency_limit int"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def run(spark, tmp_path, rows, batches, seconds=100, ttl=10, late="10 seconds"):
    n = len(rows)
    for b in range(batches):
        spark.createDataFrame(rows[n * b // batches : n * (b + 1) // batches], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in" / f"{b:03d}"))
    s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = Q.stream_quota(s, seconds, ttl, late)
    S.drained(out, str(tmp_path / "out"), str(tmp_path / "state"))
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]


def simulated(rows, seconds=100, ttl=10, late=10):
    """One event after another; leases still there expire if the last watermark has passed them."""
    out, held, used = [], {}, {}
    epoch = dt.datetime(1970, 1, 1)
    for e, ts, tenant, lease, action, most, places in sorted(rows, key=lambda r: (r[1], r[0])):
        now = int((ts - epoch).total_seconds())
        start = now - now % seconds
        for k in [k for k, (_, x) in held.items() if k[0] == tenant and x <= now]:
            del held[k]
            out.append((None, *k, "expired", None, None, None))
        key, remaining, again = (tenant, lease), None, None
        if action == "reserve":
            active = sum(k[0] == tenant and w == start for k, (w, _) in held.items())
            if most is None:
                result = "unlimited"
            else:
                if key in held:
                    result = "ignored"
                elif used.get((tenant, start), 0) >= most:
                    result, again = "request_limit_exceeded", start + seconds - now
                elif places is not None and active >= places:
                    result, again = "concurrency_limit_exceeded", 1
                else:
                    result = "admitted"
                    used[tenant, start] = used.get((tenant, start), 0) + 1
                    held[key] = (start, now + ttl)
                if result != "ignored":
                    remaining = max(0, most - used.get((tenant, start), 0))
        elif key not in held:
            result = "ignored"
        elif action == "refresh":
            result, held[key] = "extended", (held[key][0], now + ttl)
        else:
            result = {"complete": "completed", "fail": "failed"}[action]
            del held[key]
        out.append((e, tenant, lease, result, remaining, sum(k[0] == tenant and w == start for k, (w, _) in held.items()), again))
    last = int((max(r[1] for r in rows) - epoch).total_seconds()) - late
    return out + [(None, *k, "expired", None, None, None) for k, (_, x) in held.items() if x <= last]


@pytest.mark.parametrize("batches", [1, 7])
def test_quota_equals_a_simulation(spark, tmp_path, batches):
    rng, rows, now = random.Random(5), [], 0
    for k in range(400):
        now += rng.choice([0, 1, 1, 2, 30])
        tenant = rng.randrange(3)
        rows.append((k, at(now), tenant, f"l{rng.randrange(12)}", rng.choice(["reserve", "reserve", "refresh", "complete", "fail"]), None if tenant == 2 and k % 2 else 4, None if tenant == 1 else 2))
    got = run(spark, tmp_path, rows, batches)
    want = simulated(rows)
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {r[3] for r in got} == {"admitted", "ignored", "unlimited", "request_limit_exceeded", "concurrency_limit_exceeded", "extended", "completed", "failed", "expired"}


def test_completion_frees_a_place_and_late_events_are_told(spark, tmp_path):
    rows = [(1, at(0), 1, "a", "reserve", 9, 1), (2, at(1), 1, "b", "reserve", 9, 1), (3, at(2), 1, "a", "complete", 9, 1), (4, at(3), 1, "b", "reserve", 9, 1), (5, at(50), 1, "b", "complete", 9, 1), (6, at(51), 1, "c", "reserve", 9, 1), (7, at(1), 1, "d", "reserve", 9, 1), (8, at(52), 1, "c", "fail", 9, 1)]
    got = run(spark, tmp_path, rows, 4)
    assert {r[0]: r[3] for r in got if r[0]} == {1: "admitted", 2: "concurrency_limit_exceeded", 3: "completed", 4: "admitted", 5: "ignored", 6: "admitted", 7: "late", 8: "failed"}
    assert [r[2] for r in got if r[3] == "expired"] == ["b"]


def test_ingest_keeps_each_row_once(spark, tmp_path):
    schema = "doc_id long, text string"
    rows = [[(1, "a"), (2, "b"), (2, "b"), (None, "x"), (None, "y"), (3, None)], [(1, "a"), (1, "other"), (None, "x"), (4, "d"), (3, None), (3, "")]]
    for b, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{b}"))

    def ingest(k, buckets=S.BUCKETS):
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        S.stream_ingest(s, lambda x: x.withColumn("n", F.length("text")), str(tmp_path / "out"), str(tmp_path / k), buckets=buckets).awaitTermination()
        return sorted((repr((r["doc_id"], r["text"])) for r in spark.read.parquet(str(tmp_path / "out")).collect()))

    want = sorted({repr(r) for some in rows for r in some})
    assert ingest("one") == want
    assert ingest("two") == want  # another stream over the same rows
    spark.createDataFrame([(9, "z"), (4, "d")], schema).coalesce(1).write.parquet(str(tmp_path / "in" / "2"))
    assert ingest("one") == sorted([*want, repr((9, "z"))])


def test_many_leases_share_few_states(spark, tmp_path):
    """5,000 leases of one event each are held in no more states than there are buckets, and each expires once."""
    from pyspark.sql import functions as F

    from quire.streaming import accounting as S

    e = spark.range(5_001).select(F.col("id").alias("event_id"), F.timestamp_seconds(1_700_000_000 + F.when(F.col("id") < 5_000, F.col("id") % 60).otherwise(100_000)).alias("ts"), F.concat(F.lit("l"), "id").alias("lease"), F.lit("reserve").alias("action"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = S.stream_leases(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress) <= S.LEASE_BUCKETS
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("event_id is not null and result = 'active'").count() == 5_001
    assert got.where("event_id is null and result = 'expired'").select("lease").distinct().count() == got.where("event_id is null").count() == 5_000
