"""Live feeds: a bounded buffer of undelivered alerts per subscriber that outlives micro-batches.

Input rows are of three kinds: ``alert`` adds an alert to its owner's buffer, or drops it when the
buffer is full; ``take`` delivers the ``n`` oldest buffered alerts to a consumer that is ready for
them; ``leave`` ends the subscription and clears the buffer.  Rows of a user are handled in order
of (at, kind, id), micro-batch after micro-batch.  What is dropped from the feed stays in the
alerts table.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.operators.alerts import alert_json
from tidewatch.schemas import FEED_BUFFER
from tidewatch.streaming.ordered import HELD_BYTES, in_order
from tidewatch.streaming.retry import ROCKSDB

ALERT, LEAVE, TAKE = "alert", "leave", "take"
FEED = "user_id string, id string, status string, seq long, payload string"
_FEED = ["user_id", "id", "status", "seq", "payload"]
_ROW_BYTES = 400     # of a row besides its payload
_FRAME_BYTES = 1 << 20  # of what is handed on at once
_EARLIEST = -(1 << 63)  # a row without a time comes first
_ENTRY = T.StructType([T.StructField("id", T.StringType()), T.StructField("payload", T.StringType())])
_COUNTS = T.StructType([T.StructField("delivered", T.LongType()), T.StructField("dropped", T.LongType())])


class _Buffer(StatefulProcessor):
    def __init__(self, size: int) -> None:
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pending = handle.getListState("pending", _ENTRY)
        self.counts = handle.getValueState("counts", _COUNTS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """Holds a bounded part of the user's rows of one micro-batch and of what follows from them."""
        columns = ("at", "kind", "id", "payload", "n")
        entries = (row for frame in rows for row in zip(*(frame[name].tolist() for name in columns)))
        ordered = in_order(entries, lambda r: (r[0], r[1], r[2] or ""), lambda r: _ROW_BYTES + len(r[3] or ""), HELD_BYTES)
        found, size = [], 0
        for entry in self._handled(ordered):
            found.append((key[0], *entry))
            size += _ROW_BYTES + len(entry[-1] or "")
            if size >= _FRAME_BYTES:
                yield pd.DataFrame(found, columns=_FEED)
                found, size = [], 0
        if found:
            yield pd.DataFrame(found, columns=_FEED)

    def _handled(self, ordered: Iterator[tuple]) -> Iterator[tuple]:
        pending = deque(self.pending.get() if self.pending.exists() else ())
        delivered, dropped = self.counts.get() if self.counts.exists() else (0, 0)
        for _, kind, name, payload, n in ordered:
            if kind == ALERT and len(pending) < self.size:
                pending.append((name, payload))
            elif kind == ALERT:
                dropped += 1
                yield name, "dropped", dropped, payload
            elif kind == TAKE:
                for _ in range(min(n, len(pending))):
                    found, held = pending.popleft()
                    delivered += 1
                    yield found, "delivered", delivered, held
            elif kind == LEAVE:
                pending.clear()
        if pending:
            self.pending.put(list(pending))
        else:
            self.pending.clear()
        self.counts.update((delivered, dropped))

    def close(self) -> None:
        pass


def alert_entries(alerts: DataFrame) -> DataFrame:
    """Rows of the alerts table as feed input."""
    return alerts.select("user_id", F.col("created_at").alias("at"), F.lit(ALERT).alias("kind"), "id",
                         alert_json().alias("payload"), F.lit(None).cast("int").alias("n"))


def live_feed(entries: DataFrame, size: int = FEED_BUFFER) -> DataFrame:
    """(user_id, id, status, seq, payload) of a stream of (user_id, at, kind, id, payload, n).

    ``status`` is delivered or dropped, ``seq`` counts each per user.  State is at most ``size``
    alerts and two counts per user.  A user's rows of a micro-batch are sorted within a bound of memory.
    """
    entries.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    at = F.coalesce(F.unix_micros("at"), F.lit(_EARLIEST)).alias("at")
    dealt = entries.select("user_id", at, "kind", "id", "payload", F.coalesce("n", F.lit(0)).alias("n"))
    return dealt.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=_Buffer(size), outputStructType=FEED, outputMode="Append", timeMode="None")
