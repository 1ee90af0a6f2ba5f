"""Run counters of streams that survive replays: observed per batch, stored per (query, batch).

Every micro-batch observes its counts while it runs, without another pass.  A listener stores
them as one small file named by the query and the batch; a batch that runs again overwrites its
file, so adding up all files counts every batch once.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidewatch.operators.counters import NAMES

OBSERVED = "run_counters"


class CounterStore:
    """Counters of batches in a shared folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _hadoop(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, query: str, batch: int, counts: dict[str, int]) -> None:
        path, system = self._hadoop(f"query={query}/batch={batch}.json")
        stream = system.create(path, True)
        stream.write(json.dumps(counts).encode())
        stream.close()

    def batches(self) -> DataFrame:
        """(query, batch, counters) of all stored batches."""
        rows = self.spark.read.text(f"{self.path}/*/*.json").select("value", F.col("_metadata.file_path").alias("file"))
        counts = F.from_json("value", "map<string,bigint>")
        return rows.select(F.regexp_extract("file", r"query=([^/]+)/", 1).alias("query"),
                           F.regexp_extract("file", r"batch=(\d+)\.json", 1).cast("long").alias("batch"), counts.alias("counters"))

    def totals(self) -> DataFrame:
        """One row with the six counters."""
        return self.batches().agg(*[F.coalesce(F.sum(F.col("counters")[name]), F.lit(0)).alias(name) for name in NAMES])


class StoredCounters(StreamingQueryListener):
    """Stores what streams observe under ``OBSERVED``; register with ``spark.streams.addListener``.

    ``seen`` counts the stored batches per query, replays included."""

    def __init__(self, store: CounterStore) -> None:
        self.store, self.seen = store, Counter()

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        found = event.progress.observedMetrics.get(OBSERVED)
        if found is not None:
            query = str(event.progress.id)
            self.store.put(query, event.progress.batchId, {name: value or 0 for name, value in found.asDict().items()})
            self.seen[query] += 1

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def observed(rows: DataFrame, **counts: Column) -> DataFrame:
    """The stream, observed by aggregates named like the counters."""
    return rows.observe(OBSERVED, *[column.cast("bigint").alias(name) for name, column in counts.items()])
