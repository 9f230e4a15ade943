"""Directory paths as project identities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlode.functions.text import trim_ws


def _push(done: Column, part: Column) -> Column:
    """Add one path segment to the segments so far, resolving ``..``."""
    up = part == ".."
    stuck = (F.size(done) == 0) | (F.element_at(done, -1) == "..")
    return (
        F.when(part.isin("", "."), done)
        .when(up & ~stuck, F.slice(done, 1, F.size(done) - 1))
        .otherwise(F.array_append(done, part))
    )


def clean_path(p: Column) -> Column:
    """Shortest equivalent slash path: no empty, ``.`` or resolvable ``..`` parts."""
    absolute = p.startswith("/")
    empty = F.array().cast("array<string>")
    # ".." cannot climb above the root of an absolute path.
    parts = F.filter(
        F.aggregate(F.split(p, "/"), empty, lambda done, part: _push(done, part)),
        lambda part: ~(absolute & (part == "..")),
    )
    joined = F.array_join(parts, "/")
    resolved = F.when(absolute, F.concat(F.lit("/"), joined)).when(joined == "", ".").otherwise(joined)
    odd = p.rlike(r"//|(?:^|/)\.{1,2}(?:/|\z)|./\z")
    return F.when(odd, resolved).otherwise(p)


def normalize_path(p: Column) -> Column:
    """Compare form: slashes, drive mounts as drives, no final slash, lower case."""
    slashed = F.replace(trim_ws(p), F.lit("\\"), F.lit("/"))
    drive = F.regexp_replace(slashed, r"^/mnt/([a-z])(?=/|\z)", "$1:")
    return F.lower(F.regexp_replace(drive, r"/\z", ""))


def ancestors(p: Column, limit: int | None = None) -> Column:
    """The enclosing paths of a normalised path, itself first; the nearest ``limit`` if set."""
    parts = F.split(p, "/")
    size = F.size(parts)
    return F.transform(
        F.sequence(size, F.lit(1) if limit is None else F.greatest(size - (limit - 1), F.lit(1)), F.lit(-1)),
        lambda n: F.array_join(F.slice(parts, 1, n), "/"),
    )


def leaf_label(root: Column) -> Column:
    """Last segment of a path; empty for a file-system or drive root."""
    slashed = F.regexp_replace(F.replace(root, F.lit("\\"), F.lit("/")), r"/+\z", "")
    base = F.regexp_replace(slashed, r"(?s)^.*/", "")
    return F.when((base == ".") | base.endswith(":"), "").otherwise(base)
