"""Live frame sources as a stream: an offset for each source, sources that go away and come back."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition


class Capture(Protocol):
    """An open source.  Both calls raise OSError where the source is lost."""

    def place(self) -> tuple[str, int]:
        """Name of the session, which a restart of the source changes, and the number of its frames so far."""

    def frames(self, session: str, low: int, high: int) -> Iterator[tuple[int, float, str]]:
        """Number, time and content of the frames from ``low`` to before ``high`` that the source still has."""


@dataclass
class Frames(InputPartition):
    """Frames of one source's session that a task reads."""

    source: str
    session: str
    low: int
    high: int


class LiveReader(DataSourceStreamReader):
    """Offsets are ``{source: [session, frames]}``, null where the source has never been reached.

    A source that is lost keeps its place and is opened again at each batch.  In a new
    session reading begins with its first frame.  A source whose place is not
    known, since it was lost when the query started, is joined where it is when it comes
    back: frames may be left out, none is read twice.
    """

    def __init__(self, open_source: Callable[[str], Capture], sources: list[str], newest_only: bool, stride: int):
        self.open_source, self.sources, self.newest_only, self.stride = open_source, sources, newest_only, stride
        self.open: dict[str, Capture] = {}
        self.known: dict[str, list | None] = dict.fromkeys(sources)

    def _place(self, source: str) -> list | None:
        for _ in range(2):
            try:
                if source not in self.open:
                    self.open[source] = self.open_source(source)
                session, count = self.open[source].place()
                return [session, count]
            except OSError:
                self.open.pop(source, None)
        return self.known[source]

    def initialOffset(self) -> dict:
        self.known = {s: self._place(s) for s in self.sources}
        return {s: None if k is None else [k[0], 0] for s, k in self.known.items()}

    def latestOffset(self) -> dict:
        self.known = {s: self._place(s) for s in self.sources}
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Frames]:
        out = []
        for source in self.sources:
            before, now = start.get(source), end.get(source)
            if before is None or now is None:
                continue
            low = before[1] if before[0] == now[0] else 0
            low = max(low, now[1] - self.stride) if self.newest_only else low
            if low < now[1]:
                out.append(Frames(source, now[0], low, now[1]))
        return out

    def read(self, partition: Frames) -> Iterator[tuple]:
        found = self.open_source(partition.source).frames(partition.session, partition.low, partition.high)
        # As a grabber counts: the n-th frame, from 1, counts if the stride divides n.
        rows = [(partition.source, partition.session, n, t, c) for n, t, c in found if not (n + 1) % self.stride]
        yield from rows[-1:] if self.newest_only else rows

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        self.open.clear()


def live_source(open_source: Callable[[str], Capture], name: str = "live_frames") -> type[DataSource]:
    """A data source for ``spark.dataSource.register`` that reads through ``open_source``.

    Options: ``sources`` (a JSON list), ``newestOnly`` (only the newest frame of each
    source and batch, as a display needs; default false), ``stride`` (every n-th frame).
    """

    class LiveFrames(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return "source string, session string, frame bigint, time double, content string"

        def streamReader(self, schema) -> DataSourceStreamReader:
            sources = list(dict.fromkeys(json.loads(self.options["sources"])))
            return LiveReader(open_source, sources, self.options.get("newestOnly", "false").lower() == "true", int(self.options.get("stride", "1")))

    return LiveFrames
