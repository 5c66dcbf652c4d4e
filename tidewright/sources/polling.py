"""A streaming source that polls a function: poll(cursor, limit) -> (rows, next cursor). Its offset is the cursor, so a restart goes
on from the last committed one. Stands for callbacks, queues, change feeds and remote streams; buffer() bounds push sources."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Callable, Iterator
from threading import Condition
from typing import Any

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

Poll = Callable[[Any, int], tuple[list[tuple], Any]]


def poll_source(name: str, schema: str, poll: Poll, start: Any = 0, batch: int = 1000) -> type[DataSource]:
    """A class for spark.dataSource.register(); then spark.readStream.format(name).load()."""

    class Reader(SimpleDataSourceStreamReader):
        def initialOffset(self) -> dict:
            return {"cursor": start}

        def read(self, offset: dict) -> tuple[Iterator[tuple], dict]:
            rows, cursor = poll(offset["cursor"], batch)
            return iter(rows), {"cursor": cursor}

        def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
            cursor, done = start["cursor"], json.dumps(end["cursor"])
            while json.dumps(cursor) != done:
                rows, cursor = poll(cursor, batch)
                yield from rows

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def simpleStreamReader(self, schema: Any) -> Reader:
            return Reader()

    return Source


class PushBuffer:
    """A bounded buffer between a callback and a poll; `overflow` is backpressure, dropNewest or dropOldest."""

    def __init__(self, capacity: int = 1024, overflow: str = "backpressure"):
        if overflow not in ("backpressure", "dropNewest", "dropOldest"):
            raise ValueError(overflow)
        self.capacity, self.overflow = capacity, overflow
        self.rows: deque = deque()
        self.first, self.dropped, self.closed = 0, 0, False
        self.room = Condition()

    def push(self, row: tuple, timeout: float | None = None) -> bool:
        with self.room:
            if len(self.rows) >= self.capacity:
                if self.overflow == "dropNewest":
                    self.dropped += 1
                    return False
                if self.overflow == "dropOldest":
                    self.rows.popleft()
                    self.first, self.dropped = self.first + 1, self.dropped + 1
                elif not self.room.wait_for(lambda: len(self.rows) < self.capacity or self.closed, timeout):
                    return False
            self.rows.append(row)
            return True

    def poll(self, cursor: int, limit: int) -> tuple[list[tuple], int]:
        """Rows from the cursor on; those before it are released."""
        with self.room:
            while self.rows and self.first < cursor:
                self.rows.popleft()
                self.first += 1
            self.room.notify_all()
            out = list(self.rows)[: max(0, limit)]
            return out, self.first + len(out)

    def close(self) -> None:
        with self.room:
            self.closed = True
            self.room.notify_all()
