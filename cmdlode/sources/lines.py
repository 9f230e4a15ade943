"""Text files as numbered lines, read in parallel."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark import cloudpickle
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cmdlode.session import stored, work_folder
from cmdlode.sources import files as file_tools
from cmdlode.sources.files import COMPRESSED, LISTED_SCHEMA, file_system, find_faults, folder_lister, gone, tree_lister
from cmdlode.store import inner_path, qualified

cloudpickle.register_pickle_by_value(file_tools)  # executors need not have the package

STATUS_SCHEMA = "path string, n_lines bigint, error string"
_ROWS_SCHEMA = "path string, _name string, _block bigint, _id bigint, line string"
_FILES_SCHEMA = "path string, name string, error string"
_GROUP_FILES = 20_000  # that the driver lists at a time, about 2 kB each
_TASK_FILES = 256
_TASK_BYTES = 64 << 20
_FLAT = {"recursiveFileLookup": "true"}  # no columns from names of folders


def scope_of(path: Column) -> Column:
    """Scope from a ``scope=...`` folder in the path; empty without one."""
    raw = F.regexp_extract(path, r"/scope=([^/]*)/", 1)
    return F.url_decode(F.regexp_replace(raw, r"\+", "%2B"))


# Names that listing a folder shows, even where a wildcard follows.
_SHOWN = re.compile(r"[^*?\[\]{}\\._][^\[\]{}\\]*")


def _rooted(spark: SparkSession, path: str | list[str]) -> tuple[str, str, str] | None:
    """The folder before the first wildcard of a glob, and what the names of its files match, whole and below it.

    Only for globs of folders: the driver would look into one after the other, while Spark lists what is
    below one folder side by side. Not for those that might match hidden names, which listing skips.
    """
    segments = path.split("/") if isinstance(path, str) else []
    fixed = next((i for i, s in enumerate(segments) if re.search(r"[*?\[{\\]", s)), len(segments))
    if fixed >= len(segments) - 1 or not all(_SHOWN.fullmatch(s) for s in segments[fixed:]):
        return None
    root = "/".join(segments[:fixed])
    if not root.rpartition(":")[2].strip("/"):
        return None
    parts = [re.sub(r"[*?]", lambda m: r"\E[^/]*\Q" if m[0] == "*" else r"\E[^/]\Q", s) for s in segments[fixed:]]
    below = "/".join(parts)
    return root, rf"^(?:[^/:]+:(?://[^/]*)?)?\Q{inner_path(spark, root)}/{below}\E\z", rf"^\Q{below}\E\z"


def _plain(path: Column) -> Column:
    """A path as ``_metadata`` has it, without its escapes."""
    return F.url_decode(F.regexp_replace(path, r"\+", "%2B"))


def _load(spark: SparkSession, path: str | list[str], format: str, listed: dict | None = None, **options: str) -> DataFrame:
    """The files at a path or glob. ``listed`` keeps what lies below a folder for globs that share it."""
    below = _rooted(spark, path)
    if below is None or listed is None:
        return spark.read.format(format).options(**options).load(path)
    key = (below[0], format, *sorted(options.items()))
    if key not in listed:
        listed[key] = spark.read.format(format).options(recursiveFileLookup="true", **options).load(below[0])
    return listed[key].where(_plain(F.col("_metadata.file_path")).rlike(below[1]))


def _files(spark: SparkSession, path: str | list[str], listed: dict | None = None, **options: str) -> DataFrame:
    """``(path, name, size)`` of the files at a path or glob: ``path`` as Spark's readers name it, ``name`` plain."""
    found = _load(spark, path, "binaryFile", listed, **options)  # names only, no content
    return found.select(F.col("_metadata.file_path").alias("path"), F.col("path").alias("name"), F.col("length").alias("size"))


def _rows(
    spark: SparkSession, path: str | list[str], without: list[str] | None = None, listed: dict | None = None, **options: str
) -> DataFrame:
    """Lines with their split and a number that grows in it; files ``without`` are not even opened."""
    raw = _load(spark, path, "text", listed, lineSep="\n", **options)
    if without:
        raw = raw.where(~F.col("_metadata.file_path").isin(without))
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("_name"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
        F.col("value").alias("line"),
    )


def _splits(rows: DataFrame) -> DataFrame:
    """First number and size of every split; reads every file to its end, or fails."""
    counted = rows.groupBy("path", "_name", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    return stored(counted, "splits")


_MARK_BYTES = 3  # of a byte order mark, which the reader takes away


def _broken(spark: SparkSession, path: str | list[str], files: DataFrame, **options: str) -> DataFrame:
    """``(path, name, error)`` of the files that cannot be read whole.

    Plain files are read again, skipping what fails: those that give less than their size are
    broken. Compressed ones are read to their end by the executors.
    """
    packed = F.col("name").rlike(COMPRESSED)
    read = _rows(spark, path, ignoreCorruptFiles="true", ignoreMissingFiles="true", **options)
    given = read.groupBy("path").agg(F.sum(F.octet_length("line") + 1).alias("given"))
    plain = files.where(~packed).join(given, "path", "left").withColumn("given", F.coalesce("given", F.lit(0)))
    short = plain.where((F.col("given") + _MARK_BYTES < F.col("size")) | ((F.col("given") == 0) & (F.col("size") > 0)))
    told = F.format_string("read %d of %d bytes", "given", "size").alias("error")
    asked = files.where(packed).select(F.struct("path", "name").alias("key"), F.col("name").alias("path"))
    faults = asked.mapInArrow(find_faults, "key struct<path: string, name: string>, fault string").where("fault is not null")
    found = short.select("path", "name", told).unionByName(faults.select("key.path", "key.name", F.col("fault").alias("error")))
    return stored(found, "broken")


def _below(spark: SparkSession, root: str, listed: dict) -> DataFrame | None:
    """``(name, size)`` of all that lies below a folder, listed by tasks and stored; ``size`` is null for folders.

    Null if tasks cannot open its store, or see nothing there.
    """
    if (root, "names") not in listed:
        place = listed[root, "place"] = qualified(spark, root)
        listed[root, "names"] = None
        try:
            file_system(place)
            top = spark.range(1, numPartitions=1).mapInArrow(folder_lister(place), LISTED_SCHEMA)
            found = stored(top.repartition("name").mapInArrow(tree_lister(place), LISTED_SCHEMA), "names")
        except (PySparkException, Py4JJavaError, pa.ArrowException, OSError, ValueError):
            return None
        if not found.isEmpty():
            listed[root, "names"] = found
    return listed[root, "names"]


def _groups(names: DataFrame) -> Iterator[list[Row]]:
    """Names and sizes of files in groups that the driver can list."""
    first = names.limit(_GROUP_FILES + 1).collect()
    if len(first) <= _GROUP_FILES:
        yield first
        return
    parts = -(-5 * names.count() // (4 * _GROUP_FILES))  # hashes do not make them equally large
    for part in range(parts):
        yield names.where(F.pmod(F.xxhash64("name"), F.lit(parts)) == part).collect()


def _listing(spark: SparkSession, root: str, place: str, names: list[str]) -> tuple[list[str], DataFrame, list[str]]:
    """Files below a folder: paths as Spark's readers take them, ``_files`` of them, and names of those that have gone."""
    lost: set[str] = set()
    while True:
        paths = [re.sub(r"([*?\[\]{}\\])", r"\\\1", f"{root}/{name}") for name in names if name not in lost]
        try:
            return paths, _files(spark, paths, **_FLAT), sorted(lost)
        except AnalysisException:
            more = gone(place, names) - lost
            if not more:
                raise
            lost |= more


def _stored_lines(spark: SparkSession, path: str | list[str], listed: dict) -> tuple[DataFrame, DataFrame, bool] | None:
    """``_rows`` and ``(path, name, error)`` of the files of a glob of folders, and if they are many; stored.

    Group by group, so that the driver never holds the names of all files at once. Null for other
    paths and for stores that only Spark's readers can open.
    """
    rooted = _rooted(spark, path)
    below = _below(spark, rooted[0], listed) if rooted else None
    if below is None:
        return None
    matching = below.where(F.col("name").rlike(rooted[2]))
    if matching.isEmpty():
        raise AnalysisException(f"Path does not exist: {path}.", "PATH_NOT_FOUND", {"path": path})  # as Spark's readers do
    place = listed[rooted[0], "place"]
    rows_at, files_at, n_groups = work_folder(spark, "lines"), work_folder(spark, "files"), 0
    for found in _groups(matching.where("size > 0")):
        _store_group(spark, rooted[0], place, found, rows_at, files_at)
        gc.collect()  # frames stay alive in cycles, and with them the driver's listing of their files
        n_groups += 1
    return spark.read.schema(_ROWS_SCHEMA).parquet(rows_at), spark.read.schema(_FILES_SCHEMA).parquet(files_at), n_groups > 1


def _store_group(spark: SparkSession, root: str, place: str, found: list[Row], rows_at: str, files_at: str) -> None:
    least = spark.sparkContext.defaultParallelism
    tasks = max(least, -(-len(found) // _TASK_FILES), -(-sum(row["size"] for row in found) // _TASK_BYTES))
    paths, files, lost = _listing(spark, root, place, [row["name"] for row in found])
    status = files.select("path", "name", F.lit(None).cast("string").alias("error"))
    try:
        _append(_rows(spark, paths, **_FLAT).coalesce(tasks), rows_at)
    except (PySparkException, Py4JJavaError):
        broken = _broken(spark, paths, files, **_FLAT)
        without = [row["path"] for row in broken.select("path").collect()]
        if not without:  # not a file's fault
            raise
        _append(_rows(spark, paths, without, **_FLAT).coalesce(tasks), rows_at)
        status = files.join(broken.select("path", "error"), "path", "left").select("path", "name", "error")
    _append(status.coalesce(least), files_at)
    if lost:
        names = [f"{place}/{name}" for name in lost]
        _append(spark.createDataFrame([(name, name, "gone before it was read") for name in names], _FILES_SCHEMA), files_at)


def _append(df: DataFrame, place: str) -> None:
    df.write.mode("append").parquet(place)


def read_lines(
    spark: SparkSession, path: str | list[str], together: bool = False, listed: dict | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(scope, path, line_no, line)`` with line numbers from 0, and ``(path, n_lines, error)``.

    A file that cannot be read to its end is reported with its error and left out
    whole. Finding that out takes no pass of its own: the first one reads every file, and
    only if that fails does one more pass on the executors find the
    broken ones, whatever their number. A file that breaks later fails the job. Empty files have no row.

    Files of a glob of folders may be many: tasks list them, and groups of them are read once into a
    stored table, so the driver holds the names of one group. Those of any other path the driver lists
    at once; they are read twice, the first time to count the lines of their splits.

    Numbers restart per file, or run on through all files of a scope in name order when
    ``together`` is set. Files are split over tasks: within a split the row number grows
    in file order, and the table of splits gives each its place. Lines end at a line
    feed; one carriage return before it is dropped. ``listed`` is a dict for calls that may share listings.
    """
    lines, status, _ = counted_lines(spark, path, together, listed)
    return lines, status


def counted_lines(
    spark: SparkSession, path: str | list[str], together: bool = False, listed: dict | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``read_lines``, and ``(path, n)``: lines of each file that has any, as the first pass counted them."""
    listed = {} if listed is None else listed
    kept = _stored_lines(spark, path, listed)
    if kept is not None:
        rows, status, many = kept
        splits = _splits(rows)
    else:
        rows, status, splits = _counted(spark, path, listed)
        many = False
    read = splits.groupBy("path").agg(F.sum("_n").alias("n_lines"))
    status = status.join(_sorted(read, many), "path", "left").select(
        F.col("name").alias("path"), F.coalesce("n_lines", F.lit(0)).cast("bigint").alias("n_lines"), "error"
    )
    return _numbered(rows, splits, together, many), status, read.withColumnRenamed("n_lines", "n")


def _counted(spark: SparkSession, path: str | list[str], listed: dict) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``_rows``, ``(path, name, error)`` of the files, and their splits, of a path that the driver lists."""
    if _rooted(spark, path) is not None and _files(spark, path, listed).isEmpty():
        spark.read.text(path)  # fails as for any location that does not exist
    files, rows = _files(spark, path, listed), _rows(spark, path, listed=listed)
    error = F.lit(None).cast("string").alias("error")
    try:
        splits, status = _splits(rows), files.select("path", "name", error)
    except (PySparkException, Py4JJavaError):
        broken = _broken(spark, path, files)
        names = [row["path"] for row in broken.select("path").collect()]
        if not names:  # not a file's fault
            raise
        rows = _rows(spark, path, names, listed)
        splits = _splits(rows)
        status = files.join(broken.select("path", "error"), "path", "left").select("path", "name", "error")
    return rows, status, splits


def _sorted(files: DataFrame, many: bool) -> DataFrame:
    """A table of very many files or splits is not to be broadcast: stored, names take a fraction of their size."""
    return files.hint("merge") if many else files


def _numbered(rows: DataFrame, splits: DataFrame, together: bool, many: bool = False) -> DataFrame:
    splits = splits.withColumn("scope", scope_of(F.col("path")))
    run = ["scope"] if together else ["path"]
    before = (
        Window.partitionBy(*run)
        .orderBy("_name", "path", "_block")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    places = splits.select(
        "scope",
        "path",
        "_block",
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    return rows.join(_sorted(places, many), ["path", "_block"]).select(
        "scope",
        "path",
        (F.col("_id") + F.col("_shift")).alias("line_no"),
        F.regexp_replace("line", r"\r\z", "").alias("line"),
    )


def numbered_lines(spark: SparkSession, path: str | list[str], together: bool = False) -> DataFrame:
    """The lines of ``read_lines``; broken files are left out."""
    return read_lines(spark, path, together)[0]
