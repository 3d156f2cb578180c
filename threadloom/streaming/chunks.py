"""A streaming source for closed chunks that holds no list of them on the driver.

Spark's file source keeps the name of every chunk on the driver's heap, several times over, and lists files in jobs of a task each.
Here folders are listed as ticks ask for chunks, a few folders ahead, and what a tick gives out is a manifest in a folder of the query. Of the
chunks given out the driver keeps a print of 16 bytes each, in one sorted array, so a million take 16 MB.

A tick takes at most ``maxFilesPerTrigger`` chunks. Sessions come folder by folder, the chunks of a session by the number of
their first line. A listing that is at its end is followed by the next, which gives what has come since. As with the file source a chunk is
known by its name alone, and names that begin with ``.`` or ``_`` are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import islice

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from threadloom.sources.stores import open_store, read_json, write_json

LISTERS = 16
#: Session folders listed at the same time; no more than these are in memory.
FOLDERS_AHEAD = 512
#: Chunks given out since the last sorting, and tick manifests between two states written whole.
RECENT = 1 << 16
WHOLE = 64
PRINT = 16
#: Chunks a task reads at least, how many tasks a large tick makes, and the bytes of a batch.
TASK_CHUNKS = 64
TASKS = 16
BATCH_BYTES = 4 << 20


def _print(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=PRINT).digest()


def _in_order(name: str) -> tuple:
    number = re.search(r"(\d+)\.jsonl$", name)
    return (int(number.group(1)) if number else -1, name)


def _looked_at(name: str) -> bool:
    """What the file source looks at, too."""
    return name.endswith(".jsonl") and not name.startswith(".") and (not name.startswith("_") or "=" in name)


def list_chunks(root: str) -> Iterator[list[str]]:
    """The chunks of one session folder after the other, as paths below ``root``."""
    store, base = open_store(root)

    def names(folder: str, kind: fs.FileType) -> list[str]:
        found = store.get_file_info(fs.FileSelector(f"{base}/{folder}", allow_not_found=True))
        return [f.base_name for f in found if f.type == kind]

    def chunks(folder: str) -> list[str]:
        return [f"{folder}/{n}" for n in sorted(filter(_looked_at, names(folder, fs.FileType.File)), key=_in_order)]

    with ThreadPoolExecutor(LISTERS) as pool:
        for project in sorted(names("", fs.FileType.Directory)):
            sessions = iter(sorted(names(project, fs.FileType.Directory)))
            while some := list(islice(sessions, FOLDERS_AHEAD)):
                yield from pool.map(chunks, [f"{project}/{s}" for s in some])


class Given:
    """Prints of the chunks given out: a sorted array, and those since it was sorted."""

    def __init__(self, prints: bytes = b""):
        self.sorted = np.frombuffer(prints, dtype=f"S{PRINT}")
        self.recent: set[bytes] = set()

    def new(self, chunks: list[str]) -> list[str]:
        if not chunks:
            return []
        prints = [_print(c) for c in chunks]
        known = np.zeros(len(chunks), dtype=bool)
        if len(self.sorted):
            asked = np.array(prints, dtype=f"S{PRINT}")
            at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
            known = self.sorted[at] == asked
        return [c for c, p, k in zip(chunks, prints, known) if not k and p not in self.recent]

    def add(self, chunks: list[str]) -> None:
        self.recent.update(map(_print, chunks))
        if len(self.recent) >= RECENT:
            self._sort()

    def _sort(self) -> None:
        if self.recent:
            recent = np.array(list(self.recent), dtype=f"S{PRINT}")
            self.sorted, self.recent = np.sort(np.concatenate([self.sorted, recent])), set()

    def __len__(self) -> int:
        return len(self.sorted) + len(self.recent)

    def dump(self) -> bytes:
        self._sort()
        return self.sorted.tobytes()


class ChunkLog:
    """Numbered ticks: the chunks each gave out, and now and then the prints of all before."""

    def __init__(self, folder: str):
        self.store, base = open_store(folder)
        self.base = f"{base}/chunks"
        self.store.create_dir(self.base, recursive=True)
        wholes, ticks = self._numbers("whole"), set(self._numbers("json"))
        self.number = self.last_whole = max(wholes, default=0)
        self.given, self.changed, self.forgotten = Given(self._prints(self.number) if wholes else b""), 0, 0
        while self.number + 1 in ticks:
            self.number += 1
            chunks = self.chunks(self.number)
            self.given.add(chunks)
            self.changed += len(chunks)

    def _path(self, number: int, kind: str) -> str:
        return f"{self.base}/{number:012d}.{kind}"

    def _numbers(self, kind: str) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return [int(f.base_name.split(".")[0]) for f in found if re.fullmatch(rf"\d+\.{kind}", f.base_name)]

    def _prints(self, number: int) -> bytes:
        with self.store.open_input_stream(self._path(number, "whole")) as f:
            return f.read()

    def chunks(self, number: int) -> list[str]:
        return read_json(self.store, self._path(number, "json"))

    def advance(self, chunks: list[str]) -> int:
        """Give out some chunks. All prints are written once half as many were given out as they are, so writing them costs no more than the ticks did."""
        if chunks:
            write_json(self.store, self._path(self.number + 1, "json"), chunks)
            self.number += 1
            self.given.add(chunks)
            self.changed += len(chunks)
            if self.number - self.last_whole >= WHOLE and 2 * self.changed >= len(self.given):
                path = self._path(self.number, "whole")
                with self.store.open_output_stream(f"{path}.part") as f:
                    f.write(self.given.dump())
                self.store.move(f"{path}.part", path)
                self.last_whole, self.changed = self.number, 0
        return self.number

    def forget(self, upto: int) -> None:
        """Delete what no restart needs once ``upto`` is done; the folder is listed only after all prints were written anew."""
        if self.forgotten < self.last_whole <= upto:
            for kind in ("json", "whole"):
                for number in self._numbers(kind):
                    if number < self.last_whole or (number == self.last_whole and kind == "json"):
                        self.store.delete_file(self._path(number, kind))
            self.forgotten = self.last_whole


class Chunks(InputPartition):
    def __init__(self, chunks: list[str]):
        self.chunks = chunks


class ChunkReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")
        if "index" not in options:
            raise ValueError("index: name a folder for the offsets of this query, beside its checkpoint")
        self.index = options["index"].rstrip("/")
        self.most = int(options.get("maxFilesPerTrigger", 1000))
        self._log, self._listing, self._behind = None, None, []

    def __getstate__(self) -> dict:
        """Tasks get the options, not the driver's offsets."""
        return {**self.__dict__, "_log": None, "_listing": None, "_behind": []}

    @property
    def log(self) -> ChunkLog:
        """Read on the driver only, when first asked for."""
        if self._log is None:
            self._log = ChunkLog(self.index)
        return self._log

    def initialOffset(self) -> dict:
        return {"tick": 0}

    def latestOffset(self) -> dict:
        """Where this tick ends; a listing at its end gives a shorter tick, and the next tick lists anew."""
        if self._listing is None:
            self._listing = list_chunks(self.root)
        while self.most <= 0 or len(self._behind) < self.most:
            chunks = next(self._listing, None)
            if chunks is None:
                self._listing = None
                break
            self._behind += self.log.given.new(chunks)
        cut = self.most if self.most > 0 else len(self._behind)
        tick, self._behind = self._behind[:cut], self._behind[cut:]
        return {"tick": self.log.advance(tick)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        chunks = [c for n in range(start["tick"] + 1, end["tick"] + 1) for c in self.log.chunks(n)]
        each = max(TASK_CHUNKS, -(-len(chunks) // TASKS))
        return [Chunks(chunks[at : at + each]) for at in range(0, len(chunks), each)]

    def read(self, part: InputPartition) -> Iterator[pa.RecordBatch]:
        store, base = open_store(self.root)
        paths, values, held = [], [], 0
        for chunk in part.chunks:
            with store.open_input_stream(f"{base}/{chunk}") as f:
                value = f.read()
            if held + len(value) > BATCH_BYTES and paths:
                yield _batch(paths, values)
                paths, values, held = [], [], 0
            paths.append(chunk)
            values.append(value)
            held += len(value)
        if paths:
            yield _batch(paths, values)

    def commit(self, end: dict) -> None:
        self.log.forget(end["tick"])


def _batch(paths: list[str], values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(values, pa.binary())], ["path", "value"])


class ClosedChunks(DataSource):
    """``spark.readStream.format("closed_chunks").option("index", folder).load(root)``: path below ``root`` and bytes of a chunk.

    Options: ``index`` (a folder of this query alone, kept with its checkpoint) and ``maxFilesPerTrigger`` (0: no bound).
    """

    @classmethod
    def name(cls) -> str:
        return "closed_chunks"

    def schema(self) -> str:
        return "path string, value binary"

    def streamReader(self, schema) -> ChunkReader:
        return ChunkReader(self.options)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(ClosedChunks)
