"""A streaming source for log files that grow in place.

The driver lists sizes, folder by folder at the same time, and opens no log. An offset is the number of a manifest
(``line_index``), which holds what changed; a tick moves it by at most ``maxBytesPerTrigger`` over all
files. What a listing found is given out tick by tick before the next listing, so a capped tick costs what it
reads, however many files there are. A range of bytes stands for the lines whose *end* lies in it: an unfinished line waits, no partial text
is carried, and a range may be cut anywhere. A file that shrank gives nothing until it is longer than before, and then whole lines.

Lines have the numbers that a scan of the file gives them. A task takes the number at the start of its range
from the line index, where the task of the range before left it, so a tick reads what is new and not what was. Where the
index has nothing (the first tick of a file that was there before) the task counts once from the last place known.
A file is one session's log; its range of a tick is read by one task. A task reads many short ranges, so that
tasks and files written grow with the bytes of a tick and not with its files.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threadloom.sources.stores import open_store
from threadloom.streaming.line_index import LineIndex, Manifests, lines_ending_in

MAX_BYTES = 64 << 20
LISTERS = 16
#: What a task reads at least, and what a range weighs besides its bytes, for opening its file and its places.
TASK_BYTES = 4 << 20
OPEN_BYTES = 16 << 10
#: A large tick makes about so many tasks, and more once they would read more than ``MOST_BYTES`` each.
TASKS = 96
MOST_BYTES = 64 << 20


def list_logs(root: str) -> dict[str, int]:
    """Size of every ``<root>/<project>/<session>.jsonl``, side files left out."""
    store, base = open_store(root)

    def inside(folder: str) -> list[fs.FileInfo]:
        return store.get_file_info(fs.FileSelector(folder, allow_not_found=True))

    folders = [f.path for f in inside(base) if f.type == fs.FileType.Directory]
    with ThreadPoolExecutor(LISTERS) as pool:
        found = [f for files in pool.map(inside, folders) for f in files]
    return {f.path: f.size for f in found if f.type == fs.FileType.File and f.path.endswith(".jsonl") and not f.base_name.startswith("agent-")}


class Span(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class Spans(InputPartition):
    """Ranges of several files, read one after another by a task."""

    def __init__(self, spans: list[Span]):
        self.spans = spans


def dealt(spans: list[Span]) -> list[InputPartition]:
    """Ranges as tasks of about the same weight; a range that has a task to itself stays as it is."""
    weights = [s.stop - s.start + OPEN_BYTES for s in spans]
    full = min(max(TASK_BYTES, sum(weights) // TASKS), MOST_BYTES)
    tasks, held = [[]], 0
    for span, weight in zip(spans, weights):
        if tasks[-1] and held + weight > full:
            tasks.append([])
            held = 0
        tasks[-1].append(span)
        held += weight
    return [t[0] if len(t) == 1 else Spans(t) for t in tasks if t]


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        if "index" not in options:
            raise ValueError("index: name a folder for the offsets and line numbers of this query, beside its checkpoint")
        self.index = options["index"].rstrip("/")
        self.cap = int(options.get("maxBytesPerTrigger", MAX_BYTES))
        self.replay = options.get("startingOffsets", "latest") == "earliest"
        self._manifests = None
        self._behind: deque[tuple[str, int]] = deque()

    def __getstate__(self) -> dict:
        """Tasks get the options, not the driver's offsets."""
        return {**self.__dict__, "_manifests": None, "_behind": deque()}

    @property
    def manifests(self) -> Manifests:
        """Read on the driver only, when first asked for."""
        if self._manifests is None:
            self._manifests = Manifests(self.index)
        return self._manifests

    def _begin(self) -> int:
        """The number this query starts from; whichever of the two offsets is asked for first writes it."""
        if self.manifests.number < 0:
            self.manifests.start({} if self.replay else list_logs(self.root))
        return self.manifests.first()

    def initialOffset(self) -> dict:
        return {"manifest": self._begin()}

    def latestOffset(self) -> dict:
        """Where this tick ends: files that are furthest behind go first, all files together stay within the cap.

        Logs are listed again once all that the last listing found is given out.
        """
        if self.manifests.number < 0:
            self._begin()
        seen = self.manifests.sizes
        listed = not self._behind
        if listed:
            found = list_logs(self.root).items()
            behind = [(size - seen.get(p, 0), p, size) for p, size in found if size > seen.get(p, 0)]
            self._behind = deque((p, size) for _, p, size in sorted(behind, key=lambda x: (-x[0], x[1])))
        left, changes = self.cap, {}
        while self._behind and (left > 0 or self.cap <= 0):
            path, size = self._behind.popleft()
            start = seen.get(path, 0)
            if not listed:  # it may have shrunk since, or be gone
                size = min(size, open_store(self.root)[0].get_file_info(path).size or 0)
                if size <= start:
                    continue
            stop = size if self.cap <= 0 else min(size, start + left)
            changes[path] = [start, stop]
            left -= stop - start
            if stop < size:
                self._behind.appendleft((path, size))
        return {"manifest": self.manifests.advance(changes)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return dealt([Span(path, *span) for path, span in self.manifests.between(start["manifest"], end["manifest"]).items()])

    def read(self, part: InputPartition) -> Iterator[tuple]:
        for span in part.spans if isinstance(part, Spans) else [part]:
            yield from self._read(span)

    def _read(self, span: Span) -> Iterator[tuple]:
        match = re.search(r"([^/]+)/([^/]+)\.jsonl$", span.path)
        index, found = LineIndex(self.index), []
        known = index.places(span.path) if span.start else []
        try:
            file = open_store(self.root)[0].open_input_file(span.path)
        except FileNotFoundError:  # deleted since it was listed
            return
        with file:
            for number, line in lines_ending_in(file, known, span.start, span.stop, found):
                if line.strip():
                    yield match.group(1), match.group(2), number, line.decode("utf-8", "replace")
        index.add(span.path, known, found)

    def commit(self, end: dict) -> None:
        self.manifests.forget(end["manifest"])


class GrowingJsonl(DataSource):
    """``spark.readStream.format("growing_jsonl").option("index", folder).load(root)``: the columns of a line.

    Options: ``index`` (a folder of this query alone, kept with its checkpoint), ``startingOffsets`` (``latest``, or ``earliest`` for all there is) and
    ``maxBytesPerTrigger`` (0: no bound).
    """

    @classmethod
    def name(cls) -> str:
        return "growing_jsonl"

    def schema(self) -> str:
        return "project_key string, session_id string, line_no bigint, value string"

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingJsonl)
