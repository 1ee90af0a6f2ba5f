"""Landed polls as a stream whose offset is the cursor: the last-seen id of every source.

A poller lands each poll as a folder ``<root>/<source>/<poll number>`` of text files, read in
order of their names, one JSON item per line, newest first.  ``_SUCCESS`` marks a complete poll.
Of a poll only the items above the last-seen id are new; a marker that is no longer in the poll
releases all of it.  If an item above the marker cannot be read or has no id, the whole poll is
discarded: its items come again with a later poll, because the cursor stays where it was.

The driver walks over what is new of a poll once, a line at a time, keeping only the newest id and
counts per file; rows are made by the tasks, one per file, so that a long poll is read in parallel.
Offsets are a function of the landed polls, so a restarted or replayed batch gives the same rows.
``cursor`` names a file that remembers the last committed offset: a restart then need not walk
over old polls again.
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tidewatch.session import ship_package

FORMAT = "landed_polls"
SCHEMA = "source string, poll long, pos long, id string, body string, error string"


def _file_system(path: str):
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and "://" not in path else path)
    return fs.LocalFileSystem(), path


def _children(system, path: str) -> list[str]:
    from pyarrow import fs

    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(info.base_name for info in found if not info.base_name.startswith((".", "_")))


def _lines(system, path: str) -> Iterator[str]:
    with system.open_input_stream(path) as stream:
        rest = b""
        while chunk := stream.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from (line.decode("utf-8", "replace") for line in whole)
        if rest:
            yield rest.decode("utf-8", "replace")


def _item_id(line: str, key: str) -> str | None:
    """The id of an item, None if it cannot be read."""
    try:
        item = json.loads(line)
    except ValueError:
        return None
    found = item.get(key) if isinstance(item, dict) else None
    return None if found in (None, "") else str(found)


@dataclass
class Slice(InputPartition):
    """The first ``rows`` items of one file of a poll, or the error that discarded the poll."""

    source: str
    poll: int
    path: str
    first: int
    rows: int
    error: str | None = None


@dataclass
class _Walk:
    last_id: str
    slices: list[Slice]


class _PollReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.root, self.key = options["path"], options.get("idfield", "id")
        self.cursor, self.only = options.get("cursor"), options.get("source")
        self.polls_per_batch = int(options.get("pollsperbatch", 0))
        self.at: dict | None = None
        self.walked: dict[tuple[str, int, str], _Walk] = {}  # until their offset is committed

    def initialOffset(self) -> dict:
        return {"cursors": {}}

    def latestOffset(self) -> dict:
        """Walks on from the last offset given out, or from the committed one after a restart."""
        system, root = _file_system(self.root)
        cursors = dict((self.at or self._committed() or self.initialOffset())["cursors"])
        for source in _children(system, root):
            if self.only not in (None, source):
                continue
            done = 0
            for poll in self._complete(system, root, source, cursors.get(source)):
                if self.polls_per_batch and done == self.polls_per_batch:
                    break
                last_id = cursors.get(source, {}).get("last_id", "")
                cursors[source] = {"poll": poll, "last_id": self._walk(system, root, source, poll, last_id).last_id}
                done += 1
        self.at = {"cursors": cursors}
        return self.at

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        system, root = _file_system(self.root)
        slices = []
        for source, upto in end["cursors"].items():
            before = start["cursors"].get(source)
            last_id = before["last_id"] if before else ""
            for poll in self._complete(system, root, source, before):
                if poll > upto["poll"]:
                    break
                walk = self._walk(system, root, source, poll, last_id)
                slices += walk.slices
                last_id = walk.last_id
        return slices

    def read(self, partition: Slice) -> Iterator[tuple]:
        if partition.error:
            yield partition.source, partition.poll, None, None, None, partition.error
            return
        system, path = _file_system(partition.path)
        for place, line in zip(range(partition.rows), _lines(system, path)):
            yield partition.source, partition.poll, partition.first + place, _item_id(line, self.key), line, None

    def commit(self, end: dict) -> None:
        upto = {source: at["poll"] for source, at in end["cursors"].items()}
        self.walked = {key: walk for key, walk in self.walked.items() if key[1] > upto.get(key[0], -1)}
        if self.cursor:
            system, path = _file_system(self.cursor)
            system.create_dir(posixpath.dirname(path), recursive=True)
            with system.open_output_stream(path) as stream:
                stream.write(json.dumps(end).encode())

    def _committed(self) -> dict | None:
        if not self.cursor:
            return None
        system, path = _file_system(self.cursor)
        try:
            with system.open_input_stream(path) as stream:
                return json.loads(stream.read())
        except (FileNotFoundError, ValueError):  # none yet, or broken off: the walk starts over
            return None

    def _complete(self, system, root: str, source: str, after: dict | None) -> list[int]:
        """Numbers of the complete polls after the given cursor, in order, up to the first incomplete one."""
        numbers = sorted(int(name) for name in _children(system, f"{root}/{source}") if name.isdigit())
        found = []
        for number in numbers:
            if after is None or number > after["poll"]:
                if not system.get_file_info(f"{root}/{source}/{number}/_SUCCESS").is_file:
                    break
                found.append(number)
        return found

    def _walk(self, system, root: str, source: str, poll: int, last_id: str) -> _Walk:
        """What is new of one poll; the walk that found an offset also serves its partitions."""
        key = source, poll, last_id
        if key not in self.walked:
            self.walked[key] = self._walk_over(system, root, source, poll, last_id)
        return self.walked[key]

    def _walk_over(self, system, root: str, source: str, poll: int, last_id: str) -> _Walk:
        folder, slices, newest, count = f"{root}/{source}/{poll}", [], None, 0
        for name in _children(system, folder):
            rows, met = 0, False
            for line in _lines(system, f"{folder}/{name}"):
                found = _item_id(line, self.key)
                if found is None:
                    error = f"item {count + rows} of poll {poll} cannot be read"
                    return _Walk(last_id, [Slice(source, poll, "", 0, 0, error)])
                if found == last_id:
                    met = True
                    break
                newest = newest or found
                rows += 1
            if rows:
                slices.append(Slice(source, poll, f"{self.root}/{source}/{poll}/{name}", count, rows))
            count += rows
            if met:
                break
        return _Walk(newest or last_id, slices)


class LandedPolls(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> _PollReader:
        return _PollReader({key.lower(): value for key, value in self.options.items()})


def poll_stream(spark: SparkSession, root: str, source: str | None = None, cursor: str | None = None,
                polls_per_batch: int | None = None, id_field: str = "id") -> DataFrame:
    """(source, poll, pos, id, body, error) of the new items of all landed polls, or of one source's.

    ``pos`` counts from the newest item of a poll.  A discarded poll is one row with ``error``.
    """
    ship_package(spark)
    spark.dataSource.register(LandedPolls)
    options = {"path": root, "source": source, "cursor": cursor, "pollsPerBatch": polls_per_batch, "idField": id_field}
    return spark.readStream.format(FORMAT).options(**{k: str(v) for k, v in options.items() if v is not None}).load()


def split_discarded(polled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(items with ``emit_order``, oldest first within their poll; discarded polls)."""
    items = polled.where("error is null").withColumn("emit_order", -F.col("pos")).drop("error", "pos")
    return items, polled.where("error is not null").select("source", "poll", "error")


def land_poll(items: DataFrame, root: str, source: str, poll: int, body: str = "body", pos: str = "pos") -> None:
    """Write one poll of (``pos``, ``body``) as a poller would; ``pos`` 0 is the newest item."""
    ordered = items.repartitionByRange(pos).sortWithinPartitions(pos)
    ordered.select(F.col(body).cast("string").alias("value")).write.text(f"{root}/{source}/{poll}")
