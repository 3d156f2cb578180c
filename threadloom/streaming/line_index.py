"""What a tail remembers of growing files: how far each was given out, and which line stands where.

Both live in a folder of the query, beside its checkpoint.

*Offsets.* ``Manifests`` numbers the states of the tail. A number stands for the sizes given out so far; its
file holds only what changed since the number before. All sizes are written after ``WHOLE`` numbers and no sooner than as many
changes as there are sizes, so an idle file costs nothing per tick, writing them all costs no more than the changes did, and old numbers can go.

*Lines.* ``LineIndex`` holds a few places of a file: how many lines end before a byte, and where the line open there began. With the
place a range starts at, a task reads the range itself and, once, the open line before it. A place carries a checksum of the bytes
before it; one that does not fit the file (rewritten, or cut and grown again) is ignored, and lines are counted from the last that fits.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator
from typing import NamedTuple

from pyarrow import fs

from threadloom.sources.stores import open_store

WHOLE = 64
#: Bytes between the places that are kept for good.
SPARSE = 8 << 20
#: Latest places kept besides, for ranges that are read again.
LATEST = 8
CHUNK = 1 << 20
MARK = 64


class Place(NamedTuple):
    """Before ``byte`` end ``lines`` lines, the line open there began at ``start``; ``mark`` is the checksum of the bytes before."""

    byte: int
    lines: int
    start: int
    mark: int


FIRST = Place(0, 0, 0, 0)


def _mark(file, byte: int) -> int:
    return zlib.crc32(file.read_at(min(byte, MARK), max(0, byte - MARK))) if byte else 0


def _blocks(file, start: int, stop: int) -> Iterator[tuple[int, bytes]]:
    while start < stop:
        data = file.read_at(min(CHUNK, stop - start), start)
        if not data:
            return
        yield start, data
        start += len(data)


def place_at(file, places: list[Place], byte: int) -> Place:
    """The place of ``byte``, counted on from the last known one that fits the file."""
    known = next((p for p in sorted(places, reverse=True) if p.byte <= byte and _mark(file, p.byte) == p.mark), FIRST)
    lines, start = known.lines, known.start
    for at, data in _blocks(file, known.byte, byte):
        ends = data.count(b"\n")
        if ends:
            lines, start = lines + ends, at + data.rfind(b"\n") + 1
    return Place(byte, lines, start, 0)


def lines_ending_in(file, places: list[Place], start: int, stop: int, found: list[Place]) -> Iterator[tuple[int, bytes]]:
    """Number and bytes of the lines whose line end lies in ``[start, stop)``; the places passed go to ``found``.

    What is before ``start`` of the first line is read when its end is there, so a line that stays open over many ranges is read twice.
    """
    at = place_at(file, places, start)
    lines, line_start, read_to = at.lines, at.start, start
    parts: list[bytes] | None = None if line_start < start else []
    next_place = start + SPARSE
    for begin, data in _blocks(file, start, stop):
        *ended, rest = data.split(b"\n")
        if ended and parts is None:
            parts = [block for _, block in _blocks(file, line_start, start)]
        for piece in ended:
            yield lines, b"".join([*parts, piece])
            parts, lines = [], lines + 1
        if parts is not None:
            parts.append(rest)
        read_to = begin + len(data)
        if ended:
            line_start = read_to - len(rest)
        if read_to >= next_place or read_to == stop:
            found.append(Place(read_to, lines, line_start, _mark(file, read_to)))
            next_place = read_to + SPARSE


def _write(store: fs.FileSystem, path: str, content: object) -> None:
    """Readers see the old file or the new one, whole."""
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(f"{path}.new") as f:
        f.write(json.dumps(content).encode())
    store.move(f"{path}.new", path)


def _read(store: fs.FileSystem, path: str) -> object:
    try:
        with store.open_input_file(path) as f:
            return json.loads(f.read())
    except (FileNotFoundError, ValueError):
        return None


class LineIndex:
    """Places of single files; lost or torn entries cost a recount and nothing else."""

    def __init__(self, folder: str):
        self.store, base = open_store(folder)
        self.base = f"{base}/lines"

    def _path(self, log: str) -> str:
        name = hashlib.sha256(log.encode()).hexdigest()
        return f"{self.base}/{name[:2]}/{name}.json"

    def places(self, log: str) -> list[Place]:
        return [Place(*p) for p in _read(self.store, self._path(log)) or []]

    def add(self, log: str, known: list[Place], found: list[Place]) -> None:
        """Keep the latest places and, of the older ones, the last of every ``SPARSE`` bytes."""
        if found:
            stop = found[-1].byte
            merged = sorted({p.byte: p for p in [*(p for p in known if p.byte <= stop), *found]}.values())
            sparse = {p.byte // SPARSE: p for p in merged[:-LATEST]}
            _write(self.store, self._path(log), [*sparse.values(), *merged[-LATEST:]])


class Manifests:
    """Numbered states of a tail: sizes given out per file."""

    def __init__(self, folder: str):
        self.store, base = open_store(folder)
        self.base = f"{base}/offsets"
        self.number, self.sizes = -1, {}
        self.last_whole, self.changed, self.forgotten = 0, 0, -1
        numbers = self._numbers("whole")
        if numbers:
            self.number = self.last_whole = max(numbers)
            self.sizes = _read(self.store, self._path(self.number, "whole"))
            later = set(self._numbers("change"))
            while self.number + 1 in later:
                self.number += 1
                changes = _read(self.store, self._path(self.number, "change"))
                self.sizes |= {path: stop for path, (_, stop) in changes.items()}
                self.changed += len(changes)

    def _path(self, number: int, kind: str) -> str:
        return f"{self.base}/{number:012d}.{kind}.json"

    def _numbers(self, kind: str) -> list[int]:
        found = self.store.get_file_info(fs.FileSelector(self.base, allow_not_found=True))
        return [int(f.base_name.split(".")[0]) for f in found if f.base_name.endswith(f".{kind}.json")]

    def start(self, sizes: dict[str, int]) -> int:
        """A new query: these bytes count as given out."""
        self.number, self.sizes = 0, dict(sizes)
        _write(self.store, self._path(0, "whole"), self.sizes)
        return 0

    def first(self) -> int:
        return min(self._numbers("whole"))

    def advance(self, changes: dict[str, list[int]]) -> int:
        """Give out ``[from, to)`` of some files."""
        if changes:
            self.number += 1
            self.sizes |= {path: stop for path, (_, stop) in changes.items()}
            _write(self.store, self._path(self.number, "change"), changes)
            self.changed += len(changes)
            if self.number - self.last_whole >= WHOLE and self.changed >= len(self.sizes):
                _write(self.store, self._path(self.number, "whole"), self.sizes)
                self.last_whole, self.changed = self.number, 0
        return self.number

    def between(self, after: int, upto: int) -> dict[str, list[int]]:
        """What was given out between two numbers, one range per file."""
        ranges: dict[str, list[int]] = {}
        for number in range(after + 1, upto + 1):
            for path, (start, stop) in _read(self.store, self._path(number, "change")).items():
                ranges[path] = [ranges[path][0] if path in ranges else start, stop]
        return ranges

    def forget(self, upto: int) -> None:
        """Delete what no restart needs once ``upto`` is done; the folder is listed only after all sizes were written anew."""
        if self.forgotten == self.last_whole:
            return
        last = max((n for n in self._numbers("whole") if n <= upto), default=0)
        for kind in ("whole", "change"):
            for number in self._numbers(kind):
                if number < last or number == last and kind == "change":
                    self.store.delete_file(self._path(number, kind))
        self.forgotten = last
