"""A sliding-window rate limiter by key: a rejected hit isn't counted, so no range window can express it."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW_MS = 60_000
MOST = 12


def decide(hits: deque, now: int, window: int, most: int) -> int:
    """0 if a hit at ``now`` is let through (and then kept), else the seconds to wait; times in microseconds."""
    while hits and hits[0] <= now - window:
        hits.popleft()
    if len(hits) >= most:
        return max(1, math.ceil((hits[0] + window - now) / 1_000_000))
    hits.append(now)
    return 0


def rate_limit(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """(key, tie, ok, retry_after_s) for every event; nothing to wait (0) for those let through.

    A key's events pass through one task in order of time, then tie, but are never held together: the task keeps
    the last ``most`` accepted times of the key at hand, so a hot key costs time and not memory. Null keys are one key;
    events without a time are left out.
    """
    kinds = dict(events.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hits = object(), deque()
        for b in batches:
            wait = []
            for k, t in zip(b.column("key").to_pylist(), b.column("us").to_pylist()):
                if k != last:
                    last, hits = k, deque()
                wait.append(decide(hits, t, window_ms * 1000, most))
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("tie"), pa.array([w == 0 for w in wait], pa.bool_()), pa.array(wait, pa.int64())], ["key", "tie", "ok", "retry_after_s"])

    rows = events.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us is not null")
    out = rows.repartition("key").sortWithinPartitions("key", "us", "tie").mapInArrow(run, f"key {kinds[key]}, tie {kinds[tie]}, ok boolean, retry_after_s long")
    return out.withColumnsRenamed({"key": key, "tie": tie})
