"""Files by name: reached from executors and from the driver through ``pyarrow.fs``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs

# Endings of compressed text that Spark reads, and the codec that checks it here.
CODECS = {"gz": "gzip", "bz2": "bz2", "zst": "zstd"}
UNCHECKED = ("deflate", "lz4", "snappy")
COMPRESSED = rf"\.({'|'.join([*CODECS, *UNCHECKED])})$"
_CHUNK = 1 << 22
_WRITE_BYTES = 1 << 16
_LIST_THREADS = 16
_LIST_ROWS = 10_000


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path as Spark names it, and the path inside."""
    scheme, _, rest = path.rpartition(":") if re.match(r"file:", path) else ("", "", path)
    if scheme or "://" not in path:
        return pafs.LocalFileSystem(), "/" + rest.lstrip("/")
    return pafs.FileSystem.from_uri(quote(path, safe=":/@"))


def fault_of(path: str) -> str | None:
    """Why a compressed file cannot be read to its end; null if it can."""
    ending = path.rsplit(".", 1)[-1]
    if ending in UNCHECKED:
        return f"files ending in .{ending} cannot be checked"
    try:
        store, inside = file_system(path)
        with store.open_input_stream(inside, compression=CODECS[ending]) as stream:
            while stream.read(_CHUNK):
                pass
    except (OSError, pa.ArrowException, EOFError) as problem:
        return (str(problem).splitlines() or [type(problem).__name__])[0][:300]
    return None


def find_faults(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, path`` of compressed files to ``key, fault``; each is read once, in pieces."""
    for batch in batches:
        faults = [fault_of(path) for path in batch.column("path").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(faults, pa.string())], names=["key", "fault"])


LISTED_SCHEMA = "name string, size bigint"


def _listed(found: Iterator[pafs.FileInfo], above: int) -> Iterator[pa.RecordBatch]:
    """Names, without the first ``above`` characters, and sizes; folders have a null size."""
    names, sizes = [], []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64())], names=["name", "size"])

    for info in found:
        names.append(info.path[above:])
        sizes.append(info.size if info.type == pafs.FileType.File else None)
        if len(names) == _LIST_ROWS:
            yield batch()
            names, sizes = [], []
    yield batch()


def folder_lister(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` of one row: what lies directly below ``root``, by its name there."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = file_system(root)
        inside = inside.rstrip("/")
        for batch in batches:
            for _ in range(batch.num_rows):
                yield from _listed(store.get_file_info(pafs.FileSelector(inside, allow_not_found=True)), len(inside) + 1)

    return read


def tree_lister(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` of what ``folder_lister`` gives: that, and all at any depth, by names below ``root``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = file_system(root)
        inside = inside.rstrip("/")

        def below(name: str) -> list[pafs.FileInfo]:
            return store.get_file_info(pafs.FileSelector(f"{inside}/{name}", allow_not_found=True, recursive=True))

        with ThreadPoolExecutor(_LIST_THREADS) as pool:
            for batch in batches:
                yield batch
                folders = batch.filter(batch.column("size").is_null()).column("name").to_pylist()
                for first in range(0, len(folders), _LIST_ROWS):
                    found = pool.map(below, folders[first : first + _LIST_ROWS])
                    yield from _listed((info for some in found for info in some), len(inside) + 1)

    return read


def gone(root: str, names: list[str]) -> set[str]:
    """Those of the files below ``root`` that are no longer there."""
    store, inside = file_system(root)
    found = store.get_file_info([f"{inside.rstrip('/')}/{name}" for name in names])
    return {name for name, info in zip(names, found) if info.type == pafs.FileType.NotFound}


def file_writer(root: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow``: ``folder, line``, in order of folders, to one text file in each folder below ``root``.

    Gives the number of files. A file is written beside and moved, so a task that runs again replaces its own.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inside = file_system(root)
        rows = (row for batch in batches for row in zip(batch.column("folder").to_pylist(), batch.column("line").to_pylist()))
        count = 0
        for folder, lines in groupby(rows, key=lambda row: row[0]):
            place = f"{inside.rstrip('/')}/{folder}"
            store.create_dir(place, recursive=True)
            with store.open_output_stream(f"{place}/.new", buffer_size=_WRITE_BYTES) as out:
                for _, line in lines:
                    out.write((line or "").encode() + b"\n")
            store.move(f"{place}/.new", f"{place}/part-00000.txt")
            count += 1
        yield pa.RecordBatch.from_arrays([pa.array([count], pa.int64())], names=["files"])

    return write
