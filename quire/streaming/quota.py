"""A tenant's quota as one stateful stream: requests, places held at the same time, their extension, end and expiry."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "event_id long, tenant long, lease string, result string, remaining int, active int, retry_after int"
_NAMES = [x.split()[0] for x in OUT.split(", ")]


class Quota(StatefulProcessor):
    """State of a tenant: its active leases (window, expiry), and what each open window has counted. An event-time timer stands at the expiry of each lease and at the end of each window."""

    def __init__(self, seconds: int, ttl: int):
        self.period, self.ttl = seconds * 1_000_000, ttl * 1_000_000

    def init(self, handle) -> None:
        self.handle = handle
        self.leases = handle.getMapState("leases", "lease string", "start long, expiry long")
        self.windows = handle.getMapState("windows", "start long", "reserved int, completed int, failed int")

    def _load(self) -> tuple[dict, dict]:
        return {k[0]: list(v) for k, v in self.leases.iterator()}, {k[0]: list(v) for k, v in self.windows.iterator()}

    def _save(self, leases: dict, windows: dict, before: tuple[dict, dict], now: int) -> None:
        """Only what has changed; windows that have ended and hold no lease are forgotten."""
        held = {start for start, _ in leases.values()}
        windows = {k: v for k, v in windows.items() if k in held or k + self.period > now}
        for state, new, old in ((self.leases, leases, before[0]), (self.windows, windows, before[1])):
            for k in old.keys() - new.keys():
                state.removeKey((k,))
            for k, v in new.items():
                if old.get(k) != v:
                    state.updateValue((k,), tuple(v))

    @staticmethod
    def _expire(leases: dict, windows: dict, us: int, tenant: int, out: list) -> None:
        """An expired lease gives its place back, not its request."""
        for lease in sorted((k for k, v in leases.items() if v[1] <= us), key=lambda k: (leases[k][1], k)):
            start, _ = leases.pop(lease)
            windows[start][2] += 1
            out.append((None, tenant, lease, "expired", None, None, None))

    def _step(self, row, leases: dict, windows: dict, tenant: int, out: list, timers: set) -> None:
        us = row.ts.value // 1000
        start = us - us % self.period
        self._expire(leases, windows, us, tenant, out)
        own, remaining, again = leases.get(row.lease), None, None
        if row.action == "reserve":
            if pd.isna(row.request_limit):
                result = "unlimited"
            elif own is not None:
                result = "ignored"
            else:
                counts = windows.setdefault(start, [0, 0, 0])
                timers.add(start + self.period)
                if counts[0] >= row.request_limit:
                    result, again = "request_limit_exceeded", max(1, min(86_400, math.ceil((start + self.period - us) / 1e6)))
                elif not pd.isna(row.concurrency_limit) and sum(s == start for s, _ in leases.values()) >= row.concurrency_limit:
                    result, again = "concurrency_limit_exceeded", 1
                else:
                    result = "admitted"
                    counts[0] += 1
                    leases[row.lease] = [start, us + self.ttl]
                    timers.add(us + self.ttl)
                remaining = max(0, int(row.request_limit) - counts[0])
        elif own is None or row.action not in ("refresh", "complete", "fail"):
            result = "ignored"
        elif row.action == "refresh":
            result, own[1] = "extended", us + self.ttl
            timers.add(own[1])
        else:
            result = "completed" if row.action == "complete" else "failed"
            windows[own[0]][1 if result == "completed" else 2] += 1
            del leases[row.lease]
        out.append((int(row.event_id), tenant, row.lease, result, remaining, sum(s == start for s, _ in leases.values()), again))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frames = [p for p in rows if len(p)]
        if not frames:
            return
        (leases, windows), tenant, out, timers = self._load(), int(key[0]), [], set()
        before = {k: list(v) for k, v in leases.items()}, {k: list(v) for k, v in windows.items()}
        seen = timerValues.getCurrentWatermarkInMs()
        for row in pd.concat(frames).sort_values(["ts", "event_id"]).itertuples(index=False):
            if row.ts.value // 1000 < seen * 1000:  # the operator itself lets late events through
                out.append((int(row.event_id), tenant, row.lease, "late", None, None, None))
            else:
                self._step(row, leases, windows, tenant, out, timers)
        self._save(leases, windows, before, seen * 1000)
        ends = {v[1] for v in leases.values()}
        for at in timers:
            if at in ends or at - self.period in windows:
                self.handle.registerTimer(max(-(-at // 1000), seen + 1))
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (leases, windows), out, now = self._load(), [], expiredTimerInfo.getExpiryTimeInMs() * 1000
        before = {k: list(v) for k, v in leases.items()}, {k: list(v) for k, v in windows.items()}
        self._expire(leases, windows, now, int(key[0]), out)
        self._save(leases, windows, before, now)
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(out: list) -> pd.DataFrame:
        return pd.DataFrame(out, columns=_NAMES).astype({"event_id": "Int64", "remaining": "Int32", "active": "Int32", "retry_after": "Int32"})

    def close(self) -> None:
        pass


def stream_quota(events: DataFrame, seconds: int, ttl: int = 600, late: str = "10 minutes") -> DataFrame:
    """events(event_id, ts, tenant, lease, action, request_limit, concurrency_limit) -> (event_id, tenant, lease, result, remaining, active, retry_after).

    Fixed windows of `seconds`. A reserve is admitted while its window has admitted fewer than request_limit and fewer than concurrency_limit of its
    leases are active (a null concurrency_limit: no such bound; a null request_limit: not enforced). A lease holds its place until it is completed,
    fails, or `ttl` seconds pass since its reserve or last refresh; then a row `expired` without event_id tells so, on the next event of the
    tenant or when the watermark passes, whichever is first. Requests are never given back. A lease ends once: what names
    no active lease, or reserves one again, is ignored. active counts leases of the event's window after it.

    Limits are columns, so a policy table can be joined before. Events of a tenant in one micro-batch are put in (ts, event_id) order; one behind the
    watermark changes nothing and has the result `late`. State needs the RocksDB provider, which is set for the session if it has another.
    """
    spark = events.sparkSession
    if spark.conf.get(PROVIDER, "") != ROCKSDB:
        spark.conf.set(PROVIDER, ROCKSDB)
    some = events.select("event_id", "ts", "tenant", "lease", "action", "request_limit", "concurrency_limit")
    return some.withWatermark("ts", late).groupBy("tenant").transformWithStateInPandas(statefulProcessor=Quota(seconds, ttl), outputStructType=OUT, outputMode="append", timeMode="eventTime")
