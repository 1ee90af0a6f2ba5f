"""The matcher under a stream of registry edits, against a walk over everything in order."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.streaming import ingest, registry_stream

T0 = dt.datetime(2024, 1, 1)
REGISTRY = "id string, source array<string>, tickers array<string>, query_vector array<float>, similarity_threshold double, is_active boolean, at timestamp"
ARRIVAL = "event_id string, source string, tickers array<string>, ingested_at timestamp, vector array<float>"


def brute(events, changes, registry, k):
    known, seen, found = {r[0]: r for r in registry}, {}, set()
    for at, edit, row in sorted([(c[6], 0, c) for c in changes] + [(e[3], 1, e) for e in events], key=lambda x: (x[0], x[1], x[2][0])):
        if edit == 0:
            before = known.pop(row[0], None)
            if not before or before[1:4] != row[1:4]:
                seen.pop(row[0], None)
            if row[3] is not None:
                known[row[0]] = row
            continue
        for name, sources, tickers, vector, threshold, active, _ in known.values():
            if sources and row[1] not in sources or tickers and not set(row[2] or []) & set(tickers) or len(vector) != len(row[4]):
                continue
            a, b = (np.array(np.array(v, np.float32), float) for v in (vector, row[4]))
            score = round(float(a @ b / np.sqrt((a @ a) * (b @ b))), 6)
            above = sum(s > score for s in seen.get(name, []))
            seen.setdefault(name, []).append(score)
            if above < k and active and score >= (threshold or 0):
                found.add((name, row[0], above + 1))
    return found


@pytest.mark.parametrize("shards", [1, 3])
def test_edits_take_effect_at_their_time(spark, tmp_path, shards):
    g = random.Random(shards)
    vector = lambda n=4: [float(g.randint(1, 9)) for _ in range(n)]
    events = [(f"e{i:03}", g.choice(["a", "b", None]), g.choice([["X"], ["Y", None], [], None]), T0 + dt.timedelta(minutes=i // 2),
               vector(3 if i % 11 == 0 else 4)) for i in range(90)]
    registry = [(f"s{i}", [[], ["a"], None][i % 3], [[], ["X"]][i % 2], vector(), 0.8, i % 4 != 0, None) for i in range(8)]
    changes = []
    for step, minute in enumerate((5, 16, 25, 33)):
        at = T0 + dt.timedelta(minutes=minute)
        off, on, new = registry[1], registry[4], registry[2]
        changes += [(*off[:5], step % 2 == 1, at), (*on[:4], 0.9, True, at),  # toggled; switched on with another threshold
                    (new[0], new[1], new[2], vector(), 0.5, True, at), (f"n{step}", [], [], vector(), None, True, at)]
    changes.append(("s3", None, None, None, None, None, T0 + dt.timedelta(minutes=20)))
    for n in range(3):
        lo, hi = T0 + dt.timedelta(minutes=15 * n), T0 + dt.timedelta(minutes=15 * n + 15)
        spark.createDataFrame([e for e in events if lo <= e[3] < hi], ARRIVAL).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        mine = spark.createDataFrame([c for c in changes if lo <= c[6] < hi], REGISTRY)
        registry_stream.edits(mine, F.col("at")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/edits")
    schema = spark.read.parquet(f"{tmp_path}/edits").schema
    stream = registry_stream.stream_matches(
        ingest.read_events(spark, f"{tmp_path}/in", spark.createDataFrame([], ARRIVAL).schema, files_per_trigger=1),
        ingest.read_events(spark, f"{tmp_path}/edits", schema, files_per_trigger=1),
        registry_stream.edits(spark.createDataFrame(registry, REGISTRY), F.col("at")), shards, k=5)
    stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").trigger(
        availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    got = {(r.strategy_id, r.event_id, r["rank"]) for r in rows}
    assert got == brute(events, changes, registry, 5) and len(got) == len(rows) > 40
    assert {"s1", "s4", "n0"} <= {s for s, _, _ in got}


def test_only_what_may_rank_is_ranked_and_repeats_replace_themselves(monkeypatch):
    """Against a walk over every pair; most pairs never reach the walk of the matcher."""
    g = random.Random(7)
    vector = lambda: np.array([g.uniform(-1, 1) for _ in range(6)], np.float32)
    events = [registry_stream._Event(T0 + dt.timedelta(seconds=i), "event", f"e{i if i % 40 else i // 2}", g.choice(["a", None]), g.choice([("X",), ()]), vector())
              for i in range(1200)]
    fresh = lambda: {f"s{i}": registry_stream._Strategy([[], ["a"]][i % 2], [None, ["X"]][i % 3 == 0], list(vectors[i]), 0.3, i % 5 != 0)
                     for i in range(20)}
    vectors = [vector() for _ in range(20)]
    unit = lambda v: np.asarray(v, float) / np.sqrt(np.asarray(v, float) @ np.asarray(v, float))
    expected, calls = set(), []
    walked = fresh()
    for name, s in walked.items():
        for e in events:
            if s.sources and e.source not in s.sources or s.tickers and not set(e.tickers) & set(s.tickers):
                continue
            calls.append(name)
            score = round(float(unit(e.vector) @ unit(s.vector)), 6)
            rank = s.rank(score, e.id, 10)
            if rank is not None and s.active and score >= s.threshold:
                expected.add((name, e.id, e.at, score, rank))
    pairs, whole = len(calls), registry_stream._Strategy.rank
    calls.clear()
    monkeypatch.setattr(registry_stream._Strategy, "rank", lambda *a: calls.append(1) or whole(*a))
    mine, shard = fresh(), registry_stream._Shard(10)
    got = {tuple(row) for row in shard._match(mine, events, set())}
    assert got == expected and {n: s.best for n, s in mine.items()} == {n: s.best for n, s in walked.items()}
    assert len(calls) < pairs / 3 and len(got) > 200


class Kept:
    """State variables outside of Spark."""

    def __init__(self):
        self.values = {}

    def exists(self):
        return bool(self.values)

    def update(self, value):
        self.values["value"] = value

    def iterator(self):
        return iter(list(self.values.items()))

    def updateValue(self, key, value):
        self.values[key] = value

    def containsKey(self, key):
        return key in self.values

    def removeKey(self, key):
        del self.values[key]


def test_a_shard_holds_a_run_of_events_and_hands_on_pieces(monkeypatch):
    """Rows of a micro-batch in any order, far more than are held; the registry counts when a shard begins."""
    monkeypatch.setattr(registry_stream, "RUN", 16)
    monkeypatch.setattr(registry_stream, "HELD_BYTES", 20_000)
    longest, whole = [], registry_stream._Shard._match
    monkeypatch.setattr(registry_stream._Shard, "_match", lambda self, strategies, events, *a: longest.append(len(events)) or whole(self, strategies, events, *a))
    g = random.Random(5)
    vector = lambda: np.array([g.uniform(-1, 1) for _ in range(6)], np.float32)
    columns = ["at", "kind", "id", "sources", "tickers", "vector", "threshold", "active"]
    seeds = [(registry_stream._BEGINNING, "seed", f"s{i}", [[], ["a"], None][i % 3], [], vector(), 0.2, True) for i in range(6)]
    events = [(i, "event", f"e{i % 350}", [g.choice(["a", None])], None, vector(), 0.0, False) for i in range(400)]
    shard = registry_stream._Shard(10)
    shard.kept, shard.seeded = Kept(), Kept()

    def handled(rows):
        g.shuffle(rows)
        return list(shard.handleInputRows((0,), (pd.DataFrame(rows[i:i + 90], columns=columns) for i in range(0, len(rows), 90)), None))

    frames = handled([*seeds, *events])
    assert max(longest) <= 16 and max(map(len, frames)) <= 16 < sum(map(len, frames))
    walked = {s[2]: registry_stream._Strategy(s[3], s[4], s[5], s[6], s[7]) for s in seeds}
    run = [registry_stream._Event(at, "event", name, sources[0], (), v) for at, _, name, sources, _, v, _, _ in sorted(events, key=lambda e: e[0])]
    expected = {tuple(row) for row in whole(shard, walked, run, set())}
    assert {tuple(row) for frame in frames for row in frame.itertuples(index=False)} == expected and len(expected) > 100
    again = handled([(*seeds[0][:5], vector(), 0.2, True), (500, "event", "f", ["a"], None, walked["s1"].vector, 0.0, False)])
    assert ("s1", "f", 1.0) in {(r.strategy_id, r.event_id, r.score) for frame in again for r in frame.itertuples()}
    kept = {key[0]: value for key, value in shard.kept.values.items()}
    assert kept["s0"][2] == seeds_vector(seeds, "s0") and set(kept) == set(walked)


def seeds_vector(seeds, name):
    return next(s[5].tobytes() for s in seeds if s[2] == name)
