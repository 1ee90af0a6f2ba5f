"""Retries that come due by the clock, also while no further event arrives.

Ids are dealt to shards by a hash.  The failed events of a shard are its state, read and written in
one go, with a processing-time timer at the time the first of them is due.  When it fires, what is due
is tried again where it lies; success and the last failure leave the state.  A shard's waiting events
and its rows of one micro-batch are in memory together.  Spark runs micro-batches for timers on every
trigger, so the stream needs a ``processingTime`` trigger: its interval is the precision of the due times.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.schemas import RETRY

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DONE, EXHAUSTED = "done", "exhausted"
OUTCOME = "id string, outcome string, tries int, value string, waited_ms long"
_OUTCOME = Row("id", "outcome", "tries", "value", "waited_ms")
SHARDS = 2048  # keys of the state: calls to the store are per shard, not per event
_WAITING = T.StructType([T.StructField(name, T.ArrayType(kind)) for name, kind in (
    ("ids", T.StringType()), ("bodies", T.StringType()), ("tries", T.IntegerType()),
    ("due_ms", T.LongType()), ("failed_ms", T.LongType()))])

#: ``attempt(id, body, tries so far)`` gives the value of a success and raises on a failure.
Attempt = Callable[[str, str, int], str]


def delay_ms(tries: int, retry: dict, jitter: float) -> int:
    """Wait after that many failed tries: exponential up to a limit, of which jitter takes up to half."""
    whole = min(retry["base_ms"] * retry["multiplier"] ** (tries - 1), retry["max_ms"])
    return int(whole * (0.5 + 0.5 * jitter))


class _Retries(StatefulProcessor):
    def __init__(self, attempt: Attempt, retry: dict) -> None:
        self.attempt, self.retry = attempt, retry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", _WAITING)

    def _held(self) -> dict:
        """What waits in this shard: id -> (body, tries, due, failed)."""
        if not self.waiting.exists():
            return {}
        ids, *fields = self.waiting.get()
        return dict(zip(ids, zip(*fields)))

    def _keep(self, held: dict) -> None:
        """Write what waits, and a timer for the first of it; a timer that is there already stays one."""
        if not held:
            self.waiting.clear()
            return
        self.waiting.update((list(held), *map(list, zip(*held.values()))))
        self.handle.registerTimer(min(due for _, _, due, _ in held.values()))

    def _try(self, held: dict, key: str, body: str, tries: int, failed_ms: int, now_ms: int) -> Iterator[Row]:
        held.pop(key, None)
        try:
            value = self.attempt(key, body, tries)
        except Exception:  # noqa: BLE001 - whatever an attempt raises is a failed try
            tries += 1
            if tries > self.retry["max_retries"]:
                yield _OUTCOME(key, EXHAUSTED, tries, None, now_ms - failed_ms)
                return
            held[key] = (body, tries, now_ms + max(1, delay_ms(tries, self.retry, random.random())), failed_ms)
            return
        yield _OUTCOME(key, DONE, tries + 1, value, now_ms - failed_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        """The first try of events; one that waits already is not tried before its time."""
        now, held, fresh = timerValues.getCurrentProcessingTimeInMs(), self._held(), {}
        for row in rows:
            body = (row.body is not None, row.body or "")
            fresh[row.id] = min(fresh.get(row.id, body), body)
        before = len(held)
        for name, (_, body) in fresh.items():
            if name not in held:
                yield from self._try(held, name, body, 0, now, now)
        if len(held) > before:
            self._keep(held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now, held = timerValues.getCurrentProcessingTimeInMs(), self._held()
        for name, (body, tries, due, failed) in list(held.items()):
            if due <= now:
                yield from self._try(held, name, body, tries, failed, now)
        self._keep(held)

    def close(self) -> None:
        pass


def with_retries(events: DataFrame, attempt: Attempt, retry: dict = RETRY, shards: int = SHARDS) -> DataFrame:
    """(id, outcome, tries, value, waited_ms) of a stream of (id, body), once per id that ends.

    Give it the events whose first, vectorised try failed, or all of them: state is held only
    for those that fail.  Of several rows of one id in a micro-batch the least body counts.
    ``shards`` must stay the same for a checkpoint; more of them hold less each.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    dealt = events.select("id", "body", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").transformWithState(
        statefulProcessor=_Retries(attempt, dict(retry)), outputStructType=OUTCOME, outputMode="Append", timeMode="ProcessingTime")
