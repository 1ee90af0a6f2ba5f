"""Rows of one key in order, however many a micro-batch has of them.

A stream cannot be sorted before it meets its state, so a state sorts for itself.  Beyond a bound of memory sorted
runs of rows go to a file of the task, which goes with it, and are merged from there.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterable, Iterator
from heapq import merge

HELD_BYTES = 16 << 20  # of rows that are sorted in memory
PIECE_BYTES = 1 << 18  # of a run that are read at once


def in_order(rows: Iterable[tuple], key: Callable[[tuple], tuple], weight: Callable[[tuple], int], held_bytes: int = HELD_BYTES) -> Iterator[tuple]:
    """The rows by ``key``, equal ones as they came; ``weight`` tells about how many bytes a row holds."""
    held, size, runs = [], 0, []
    with tempfile.TemporaryFile() as file:
        for row in rows:
            held.append(row)
            size += weight(row)
            if size >= held_bytes:
                held.sort(key=key)
                runs.append(_written(file, held, max(1, len(held) * PIECE_BYTES // size)))
                held, size = [], 0
        held.sort(key=key)
        yield from merge(*(_pieces(file, places) for places in runs), held, key=key) if runs else held


def _written(file, rows: list[tuple], step: int) -> list[tuple[int, int]]:
    """Where in the file the pieces of a run begin and how long they are."""
    places = []
    for start in range(0, len(rows), step):
        piece = pickle.dumps(rows[start:start + step], pickle.HIGHEST_PROTOCOL)
        places.append((file.tell(), len(piece)))
        file.write(piece)
    return places


def _pieces(file, places: list[tuple[int, int]]) -> Iterator[tuple]:
    for start, length in places:
        file.seek(start)
        yield from pickle.loads(file.read(length))
