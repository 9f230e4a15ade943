"""Streaming source of files that grow: histories and journals as shells append to them.

Every batch has a *plan*: for each file that has grown, from which byte to which. Plans are
kept in a folder of the stream's own, beside its checkpoint, and the stream's offset is only
the number of the last plan; so it stays small, whatever the number of files, and a batch that
is run again reads the same bytes. Every ``_FOLD`` plans the ends of all files are written as
one, and older plans go.

A record belongs to the batch that holds the line feed which ends it. A reader looks back
from its first byte to where the record starts, and leaves what follows the last line feed to
a later batch. So records arrive once, however plans cut the files, and long ranges are cut
into parts that are read side by side. A file that has become shorter is read anew.

The driver lists files and keeps one number for each; it never reads them. The module imports
nothing of the package but ``files``; both are sent to workers by value.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from fnmatch import fnmatchcase
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from cmdlode.sources import files
from cmdlode.sources.files import file_system

FORMAT = "growing_files"
SCHEMA = "scope string, path string, position bigint, line string"
_FOLD = 100
_PART_BYTES = 64 << 20
_PART_FILES = 1000
_STEP = 1 << 20
_NO_LIMIT = 1 << 62


def matching(path: str) -> dict[str, int]:
    """Sizes of the files at a path or glob, by their path inside the store; hidden ones are skipped."""
    store, inside = file_system(path)
    segments = inside.split("/")
    fixed = next((i for i, s in enumerate(segments) if re.search(r"[*?\[]", s)), None)
    if fixed is None:
        info = store.get_file_info(inside)
        if info.type == pafs.FileType.File:
            return {inside: info.size}
        fixed, segments = len(segments), [*segments, "*"]
    selector = pafs.FileSelector("/".join(segments[:fixed]) or "/", allow_not_found=True, recursive=True)
    found = {}
    for info in store.get_file_info(selector):
        names = info.path.split("/")
        if info.type != pafs.FileType.File or len(names) != len(segments) or names[-1].startswith((".", "_")):
            continue
        if all(fnmatchcase(name, pattern) for name, pattern in zip(names[fixed:], segments[fixed:])):
            found[info.path] = info.size
    return found


def ends_record(data: bytes, at: int, mark: bytes) -> bool:
    """Whether the line feed at ``at`` ends a record: not if its line ends in ``mark``, which may
    have one carriage return behind it."""
    stop = at - 1 if at and data[at - 1] == 13 else at
    return not mark or data[max(0, stop - len(mark)) : stop] != mark


def record_end(data: bytes, start: int, mark: bytes) -> int:
    """Index of the first line feed from ``start`` that ends a record, or -1."""
    at = data.find(b"\n", start)
    while at >= 0 and not ends_record(data, at, mark):
        at = data.find(b"\n", at + 1)
    return at


def _record_start(stream, first: int, mark: bytes) -> int:
    """Where the record starts that goes on at byte ``first``."""
    upper = first
    while upper:
        lower = max(0, upper - _STEP)
        lead = min(lower, len(mark) + 1)  # what decides about a line feed at ``lower``
        stream.seek(lower - lead)
        data = stream.read(upper - lower + lead)
        at = len(data)
        while (at := data.rfind(b"\n", lead, at)) >= 0:
            if ends_record(data, at, mark):
                return lower - lead + at + 1
        upper = lower
    return 0


def records(stream, first: int, last: int, mark: bytes = b"") -> Iterator[tuple[int, bytes]]:
    """Records that end in bytes ``first`` to ``last``, with the byte at which each starts."""
    start = _record_start(stream, first, mark)
    stream.seek(start)
    held, searched = b"", max(0, first - start)
    left = last - start
    while left > 0:
        more = stream.read(min(_STEP, left))
        if not more:
            return
        left -= len(more)
        held += more
        done = 0
        while (at := record_end(held, max(done, searched), mark)) >= 0:
            yield start + done, held[done:at]
            done = searched = at + 1
        start += done
        held = held[done:]
        searched = len(held)


def parts_of(ranges: list[tuple[str, int, int]], most_bytes: int = _PART_BYTES, most_files: int = _PART_FILES) -> list[InputPartition]:
    """Ranges of bytes dealt into parts of bounded size, each a list of ranges; long ones are cut."""
    parts, current, size = [], [], 0
    for path, first, last in ranges:
        while first < last:
            step = min(last, first + most_bytes - size)
            current.append((path, first, step))
            size, first = size + step - first, step
            if size >= most_bytes or len(current) >= most_files:
                parts.append(InputPartition(current))
                current, size = [], 0
    return [*parts, InputPartition(current)] if current else parts


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.progress = options["progress"]
        self.most = int(options.get("maxbytesperbatch", _NO_LIMIT))
        self.mark = options.get("continuation", "").encode()
        self.ends: dict[str, int] | None = None
        self.number = 0

    def __getstate__(self) -> dict:
        """What workers need: the numbers of all files stay on the driver."""
        return self.__dict__ | {"ends": None, "number": 0}

    # -- plans ----------------------------------------------------------------

    def _place(self, name: str) -> tuple[pafs.FileSystem, str]:
        store, inside = file_system(self.progress)
        return store, f"{inside.rstrip('/')}/{name}"

    def _write(self, name: str, content: object) -> None:
        store, inside = self._place(name)
        store.create_dir(inside.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(f"{inside}.new") as out:
            out.write(json.dumps(content).encode())
        store.move(f"{inside}.new", inside)

    def _read(self, name: str) -> dict:
        store, inside = self._place(name)
        with store.open_input_stream(inside) as stream:
            return json.loads(stream.read())

    def _numbers(self, kind: str) -> list[int]:
        store, inside = self._place("x")
        selector = pafs.FileSelector(inside.rsplit("/", 1)[0], allow_not_found=True)
        names = [info.base_name for info in store.get_file_info(selector)]
        return sorted(int(n.split("-")[1]) for n in names if re.fullmatch(rf"{kind}-\d+", n))

    def _load(self) -> None:
        """Ends of all files as of the last plan: the newest fold, and the plans after it."""
        if self.ends is not None:
            return
        folds = self._numbers("fold")
        self.number = folds[-1] if folds else 0
        self.ends = self._read(f"fold-{self.number}") if folds else {}
        for number in self._numbers("plan"):
            if number > self.number:
                self.ends |= {path: last for path, (_, last) in self._read(f"plan-{number}").items()}
                self.number = number

    def _plan(self) -> None:
        """A new plan, if files have grown."""
        plan, left = {}, self.most
        for path, size in sorted(matching(self.path).items()):
            first = self.ends.get(path, 0)
            first = 0 if size < first else first
            if size > first and left > 0:
                last = min(size, first + left)
                plan[path], left = (first, last), left - (last - first)
        if plan:
            self._write(f"plan-{self.number + 1}", plan)
            self.number += 1
            self.ends |= {path: last for path, (_, last) in plan.items()}

    # -- what Spark calls -----------------------------------------------------

    def initialOffset(self) -> dict:
        return {"plan": 0}

    def latestOffset(self) -> dict:
        self._load()
        self._plan()
        return {"plan": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        ranges = []
        for number in range(start["plan"] + 1, end["plan"] + 1):
            ranges += [(path, first, last) for path, (first, last) in self._read(f"plan-{number}").items()]
        return parts_of(ranges)

    def commit(self, end: dict) -> None:
        """Every so many plans, keep the ends of all files as one; plans before it are done with."""
        self._load()
        folds = self._numbers("fold")
        if end["plan"] != self.number or end["plan"] < (folds[-1] if folds else 0) + _FOLD:
            return
        self._write(f"fold-{self.number}", self.ends)
        for kind, numbers in (("plan", self._numbers("plan")), ("fold", folds)):
            for number in numbers:
                if number < self.number:
                    store, inside = self._place(f"{kind}-{number}")
                    store.delete_file(inside)

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        store, _ = file_system(self.path)
        names = ["scope", "path", "position", "line"]
        rows: list[tuple] = []
        for path, first, last in partition.value:
            scope = re.search(r"/scope=([^/]*)/", path)
            scope = unquote(scope.group(1)) if scope else ""
            with store.open_input_file(path) as stream:
                for position, record in records(stream, first, last, self.mark):
                    rows.append((scope, path, position, record.decode("utf-8", "replace").removesuffix("\r")))
                    if len(rows) >= 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=names)


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files")`` with the options ``path`` (file, folder or glob),
    ``progress`` (a folder of this stream alone), ``maxBytesPerBatch`` and ``continuation``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader({key.lower(): value for key, value in self.options.items()})


def stream_lines(
    spark: SparkSession, path: str, progress: str, continuation: str = "", max_bytes: int | None = None
):
    """Stream of ``(scope, path, position, line)`` of the records appended to files at ``path``."""
    import sys

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(files)
    spark.dataSource.register(GrowingFiles)
    reader = spark.readStream.format(FORMAT).option("path", path).option("progress", progress)
    if continuation:
        reader = reader.option("continuation", continuation)
    if max_bytes is not None:
        reader = reader.option("maxBytesPerBatch", str(max_bytes))
    return reader.load()
