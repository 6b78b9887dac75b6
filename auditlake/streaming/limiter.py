"""The sliding-window rate limiter over a stream: each key keeps the times of its accepted hits as state."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from auditlake.operators.limiter import MOST, WINDOW_MS, decide


def rate_limit_stream(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", window_ms: int = WINDOW_MS, most: int = MOST, expire: bool = False) -> DataFrame:
    """(key, tie, ok, retry_after_s) for every event of a stream, in append mode.

    A micro-batch's events of a key are taken in order of time, then tie; an event older than one of an earlier batch is
    judged by what that batch left. State is ``most`` times a key at most; with ``expire`` it goes once the key was idle for
    a window of processing time, for which the query must run on (such a query doesn't end by itself when all input is
    read). Events without key or time are left out.
    """
    kinds = dict(events.dtypes)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        hits = deque(state.get[0]) if state.exists else deque()
        rows = pd.concat(list(batches)).sort_values(["us", "tie"], kind="stable")
        wait = [decide(hits, t, window_ms * 1000, most) for t in rows["us"].tolist()]
        state.update((list(hits),))
        if expire:
            state.setTimeoutDuration(max(1, window_ms))
        yield pd.DataFrame({"key": rows["key"], "tie": rows["tie"], "ok": [w == 0 for w in wait], "retry_after_s": wait})

    rows = events.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us")).where("us is not null and key is not null")
    out = rows.groupBy("key").applyInPandasWithState(
        run, f"key {kinds[key]}, tie {kinds[tie]}, ok boolean, retry_after_s long", "hits array<bigint>", "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    )
    return out.withColumnsRenamed({"key": key, "tie": tie})


STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Hits(StatefulProcessor):
    """A key's accepted times, oldest first, as list state; with ``ttl_ms`` a time goes by itself once it has lain so long."""

    def __init__(self, window_us: int, most: int, kinds: tuple[str, str], ttl_ms: int | None):
        self.window_us, self.most, self.kinds, self.ttl_ms = window_us, most, kinds, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", T.StructType([T.StructField("t", T.LongType())]), self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        had = [x[0] for x in self.times.get()] if self.times.exists() else []
        hits = deque(had)
        batch = pd.concat(list(rows)).sort_values(["us", "tie"], kind="stable")
        wait = [decide(hits, t, self.window_us, self.most) for t in batch["us"].tolist()]
        if list(hits) != had:
            self.times.put([(t,) for t in hits])
        yield pd.DataFrame({"key": batch["key"], "tie": batch["tie"], "ok": [w == 0 for w in wait], "retry_after_s": wait})

    def close(self) -> None:
        pass


def rate_limit_state(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", window_ms: int = WINDOW_MS, most: int = MOST, ttl_ms: int | None = None) -> DataFrame:
    """(key, tie, ok, retry_after_s) for every event of a stream, by list state that can expire; null keys share one window, as in a batch.

    Needs the state store ``STATE_STORE`` (spark.sql.streaming.stateStore.providerClass). A micro-batch's events of a key are held together and
    taken in order of time, then tie; an event older than one of an earlier batch is judged by what that batch left. State is ``most``
    times a key at most; ``ttl_ms`` (processing time; a window or more) bounds how long an idle key keeps any, in place of a bound on
    the number of keys, which would need all keys in one task; such a query runs on until it is stopped. Events without a time are left out.
    """
    kinds = dict(events.dtypes)
    nameless = F.coalesce(F.col(key), F.lit(0).cast(kinds[key]))
    rows = events.select(F.col(key).alias("key"), F.col(tie).alias("tie"), F.unix_micros(F.col(ts).cast("timestamp")).alias("us"), F.col(key).isNull().alias("no_key"), nameless.alias("name")).where("us is not null")
    out = rows.groupBy("no_key", "name").transformWithStateInPandas(
        Hits(window_ms * 1000, most, (kinds[key], kinds[tie]), ttl_ms), f"key {kinds[key]}, tie {kinds[tie]}, ok boolean, retry_after_s long", "append", "ProcessingTime" if ttl_ms else "None"
    )
    return out.withColumnsRenamed({"key": key, "tie": tie})
