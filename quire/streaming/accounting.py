"""Event accounting as Structured Streaming: usage windows, admission, leases, circuits, idempotency and ingest.

State is kept by key. Times are event times; events later than the watermark are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

EVENT = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream_usage(events: DataFrame, seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """events(ts, tenant, outcome, bytes) -> counts and bytes of each tenant and tumbling window, once the watermark has passed it."""
    e = events.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", f"{seconds} seconds").alias("w"), "tenant").agg(F.count("*").alias("n"), F.count_if(F.col("outcome") == "forwarded").alias("forwarded"), F.sum("bytes").alias("bytes"))
    return g.select(F.unix_micros(F.col("w.start")).alias("window_start"), "tenant", "n", "forwarded", "bytes")


def stream_dedup(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first event of each idempotency key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


#: Events that go through a step together, and buckets of leases.
STEP_ROWS, LEASE_BUCKETS = 20_000, 1_024


def _stateful(events: DataFrame, keys: list[str], late: str, step: Callable, timer: Callable, out: str, state: str, sweeps: bool = False) -> DataFrame:
    """Runs `step(key, rows, state)` for each key over its events in (ts, event_id) order of a micro-batch, and `timer(key, state, now)`
    once the watermark has passed the time that the last call asked for.

    Both return (rows out, state, time): a state of None is forgotten; a time (microseconds) of None sets no timer. Events behind the watermark
    are dropped. A key's events of one micro-batch are held together as columns, to be put in order, and go through in steps of STEP_ROWS;
    maxFilesPerTrigger or the like bounds them. With `sweeps` a key's timer also runs after its events.
    """

    def run(k: tuple, parts: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            got, now, at = timer(k[0], held.get, held.getCurrentWatermarkMs() * 1000)
        else:
            frames = [p for p in parts if len(p)]
            if not frames:
                return
            rows = pd.concat(frames, ignore_index=True)
            frames.clear()
            order = np.lexsort((rows["event_id"], rows["ts"]))
            now = held.get if held.exists else None
            for lo in range(0, len(rows), STEP_ROWS):
                got, now, at = step(k[0], rows.iloc[order[lo : lo + STEP_ROWS]], now)
                if got is not None and len(got):
                    yield got
            got = None
            if sweeps and now is not None:
                got, now, at = timer(k[0], now, held.getCurrentWatermarkMs() * 1000)
        if now is None:
            if held.exists:
                held.remove()
        else:
            held.update(now)
            if at is not None:
                held.setTimeoutTimestamp(max(at // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        if got is not None and len(got):
            yield got

    return events.withWatermark("ts", late).groupBy(*keys).applyInPandasWithState(run, out, state, "append", "EventTimeTimeout")


def stream_admission(events: DataFrame, limit: int, seconds: int, concurrency: int = 0, ttl: int = 600, late: str = "10 minutes") -> DataFrame:
    """events(event_id, ts, tenant) -> (event_id, tenant, admitted, reason, remaining, retry_after): a request and a concurrency limit for each fixed
    window of a tenant. A concurrency of 0 is no limit; else an admitted request holds its place for ttl seconds.

    The state of a tenant is its newest window, the count in it, and the expiry times of held places (at most `concurrency`); it is
    forgotten when the watermark has passed the window and all places. Without concurrency windows share nothing: each is a key of its own.
    """
    import json
    import math

    def step(tenant, rows: pd.DataFrame, held):
        window, used, places = (held[0], held[1], json.loads(held[2])) if held else (-1, 0, [])
        out = []
        for event, ts in zip(rows["event_id"], rows["ts"], strict=True):
            us = ts.value // 1000
            start = us - us % (seconds * 1_000_000)
            if start > window:
                window, used = start, 0
            places = [p for p in places if p > us]
            end = start + seconds * 1_000_000
            if used >= limit:
                out.append((event, tenant, False, "request_limit", 0, max(1, min(86_400, math.ceil((end - us) / 1e6)))))
            elif concurrency and len(places) >= concurrency:
                out.append((event, tenant, False, "concurrency_limit", limit - used, max(1, math.ceil((min(places) - us) / 1e6))))
            else:
                used += 1
                if concurrency:
                    places.append(us + ttl * 1_000_000)
                out.append((event, tenant, True, "ok", limit - used, None))
        frame = pd.DataFrame(out, columns=["event_id", "tenant", "admitted", "reason", "remaining", "retry_after"]).astype({"retry_after": "Int32"})
        return frame, (int(window), int(used), json.dumps(places)), int(max([window + seconds * 1_000_000, *places]))

    def timer(tenant, held, now):
        return None, None, None

    asked, keys = events.select("event_id", "ts", "tenant"), ["tenant"]
    if not concurrency:
        asked, keys = asked.withColumn("window", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / (seconds * 1_000_000))), ["tenant", "window"]
    return _stateful(asked, keys, late, step, timer, "event_id long, tenant long, admitted boolean, reason string, remaining int, retry_after int", "start long, used int, places string")


def stream_leases(events: DataFrame, ttl: int = 600, keep: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """events(event_id, ts, lease, action) with actions reserve, refresh, complete, fail -> (event_id, lease, result).

    A lease ends once; a refresh within its time extends it. When the watermark has passed its time it expires without
    another event, told by a row without event_id. An ended lease is remembered for `keep` seconds, so that what
    comes later is told so, then forgotten. Leases are many and have few events each, so those of a bucket (a hash of the lease) share a
    state, a mapping of lease to its state and expiry, and a timer, the first time of any.
    """
    import json

    def due(state: str, expiry: int) -> int:
        return expiry if state == "active" else expiry + keep * 1_000_000

    def told(rows: list[tuple], leases: dict):
        frame = pd.DataFrame(rows, columns=["event_id", "lease", "result"]).astype({"event_id": "Int64"})
        return (frame, (json.dumps(leases),), min(due(*x) for x in leases.values())) if leases else (frame, None, None)

    def step(bucket, rows: pd.DataFrame, held):
        leases, out = json.loads(held[0]) if held else {}, []
        for event, us, lease, action in zip(rows["event_id"].tolist(), (rows["ts"].astype("int64") // unit(rows["ts"])).tolist(), rows["lease"].tolist(), rows["action"].tolist(), strict=True):
            state, expiry = leases.get(lease, ("none", 0))
            if state == "active" and us >= expiry:
                state = "expired"
            if action == "reserve" and state == "none":
                state, expiry, result = "active", us + ttl * 1_000_000, "active"
            elif action == "refresh" and state == "active":
                expiry, result = us + ttl * 1_000_000, "extended"
            elif action in ("complete", "fail") and state == "active":
                state, expiry = "completed" if action == "complete" else "failed", us
                result = state
            else:
                result = f"ignored_{state}"
            out.append((event, lease, result))
            if state != "none":
                leases[lease] = state, expiry
        return told(out, leases)

    def unit(ts: pd.Series) -> int:
        """Its steps in a microsecond."""
        return 1_000 if "ns" in str(ts.dtype) else 1

    def timer(bucket, held, now):
        leases, out = json.loads(held[0]), []
        for lease, (state, expiry) in list(leases.items()):
            if state == "active" and expiry // 1000 + 1 < now // 1000:
                state = "expired"
                leases[lease] = state, expiry
                out.append((None, lease, "expired"))
            if state != "active" and due(state, expiry) // 1000 + 1 < now // 1000:
                del leases[lease]
        return told(out, leases)

    dealt = events.select("event_id", "ts", "lease", "action", F.pmod(F.xxhash64("lease"), F.lit(LEASE_BUCKETS)).alias("bucket"))
    return _stateful(dealt, ["bucket"], late, step, timer, "event_id long, lease string, result string", "leases string", sweeps=True)


def stream_circuit(events: DataFrame, threshold: int = 3, open_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """events(event_id, ts, backend, ok) -> (event_id, backend, state, allowed): `threshold` failures in a row open the circuit for a time; then one
    probe is let through, whose success closes it and whose failure opens it again. Only backends with failures have a state."""

    def step(backend, rows: pd.DataFrame, held):
        failures, until = held if held else (0, 0)
        out = []
        for event, ts, ok in zip(rows["event_id"], rows["ts"], rows["ok"], strict=True):
            us = ts.value // 1000
            state = "closed" if failures < threshold else ("open" if us < until else "half_open")
            out.append((event, backend, state, state != "open"))
            if state == "open":
                continue
            if ok:
                failures, until = 0, 0
            else:
                failures += 1
                if failures >= threshold:
                    until = us + open_seconds * 1_000_000
        return pd.DataFrame(out, columns=["event_id", "backend", "state", "allowed"]), (int(failures), int(until)) if failures else None, None

    def timer(backend, held, now):
        return None, held, None

    return _stateful(events.select("event_id", "ts", "backend", "ok"), ["backend"], late, step, timer, "event_id long, backend long, state string, allowed boolean", "failures int, until long")


#: Folders that the rows of an ingest are dealt into by their key.
BUCKETS = 64


def row_key(*columns: str) -> Column:
    """A SHA-256 that tells rows apart by these columns; nulls are values of their own."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def stream_ingest(docs: DataFrame, enrich: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, keys: tuple = ("doc_id", "text"), buckets: int = BUCKETS):
    """New rows -> enriched -> kept in `path`, each once: rows equal in `keys` are one, in a batch, across batches and across streams.

    enrich gets rows with a column row_key, which its result must keep. What is kept lies in folders by batch and bucket of the key, so
    a batch reads, of what is there, only the keys in the buckets that it touches, and one that runs again replaces what it had
    written. Rows without doc_id or with a doc_id of several texts are all kept, once each.
    """
    own = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    bucket = F.pmod(F.xxhash64("row_key"), F.lit(buckets)).cast("int")

    def put(batch: DataFrame, number: int) -> None:
        spark, name = batch.sparkSession, f"{own}-{number}"
        fresh = batch.withColumn("row_key", row_key(*keys)).dropDuplicates(["row_key"])
        if _has_batches(spark, path, name):
            touched = [r["b"] for r in fresh.select(bucket.alias("b")).distinct().collect()]  # at most `buckets`
            known = spark.read.schema("row_key string, batch string, bucket int").parquet(path).where((F.col("batch") != name) & F.col("bucket").isin(touched))
            fresh = fresh.join(known.select("row_key"), "row_key", "left_anti")
        enrich(fresh).withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={name}")

    return docs.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _has_batches(spark, path: str, but: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and any(s.getPath().getName() not in (f"batch={but}", "_temporary") for s in fs.listStatus(p))


def drained(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Runs a stream over all that is there into Parquet files; how many late events its stateful operators dropped in all batches."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    dropped, over = {}, False
    while not over:  # the query itself remembers its last batches only
        over = query.awaitTermination(1)
        dropped |= {p["batchId"]: sum(s["numRowsDroppedByWatermark"] for s in p["stateOperators"]) for p in query.recentProgress}
    return sum(dropped.values())
