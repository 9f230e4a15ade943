"""Directories to projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cmdlode.functions.paths import ancestors, clean_path, leaf_label, normalize_path
from cmdlode.params import DEFAULTS, Params


def resolve_roots(
    dirs: DataFrame, roots: DataFrame | None, params: Params = DEFAULTS
) -> DataFrame:
    """``dirs(scope, dir)`` to ``(scope, dir, project_root, project_key, label)``.

    The project is the nearest enclosing directory listed in
    ``roots(scope, root)``, or the directory itself. Each distinct directory is
    expanded once, and ancestors meet roots in an equi-join.
    """
    known = dirs.select("scope", "dir").where(F.col("dir") != "").distinct()
    known = known.withColumn("_own", normalize_path(clean_path(F.col("dir"))))
    if roots is None:
        found = known.withColumn("_root", F.lit(None).cast("string"))
    else:
        marked = _keyed_roots(roots)
        climbed = known.select(
            "scope", "dir", F.posexplode(ancestors(F.col("_own"), params.max_ancestors)).alias("_up", "_at")
        )
        nearest = (
            climbed.join(marked, ["scope", "_at"])
            .groupBy("scope", "dir")
            .agg(F.min(F.struct("_up", "root")).alias("_nearest"))
            .select("scope", "dir", F.col("_nearest.root").alias("_root"))
        )
        found = known.join(nearest, ["scope", "dir"], "left")
    root = F.coalesce(F.col("_root"), clean_path(F.col("dir")))
    return found.select(
        "scope",
        "dir",
        root.alias("project_root"),
        F.coalesce(normalize_path(F.col("_root")), F.col("_own")).alias("project_key"),
        leaf_label(root).alias("label"),
    )


def _keyed_roots(roots: DataFrame) -> DataFrame:
    """``(scope, _at, root)``: one root per normalised path."""
    return roots.groupBy("scope", normalize_path(F.col("root")).alias("_at")).agg(
        F.min("root").alias("root")
    )


def _with_root_by_map(df: DataFrame, keyed: DataFrame, cwd: str, params: Params) -> DataFrame:
    """Add ``_root``, the nearest listed root, by one join with a map of each scope's roots.

    For streams, which cannot expand a row and bring it together again: the row's
    ancestors are looked up in one expression, the nearest one first.
    """
    entries = F.array_sort(F.collect_list(F.struct("_at", "root")))  # bounded by the caller
    maps = keyed.groupBy("scope").agg(F.map_from_entries(entries).alias("_roots"))
    own = F.when(F.col(cwd) != "", normalize_path(clean_path(F.col(cwd))))
    placed = df.join(maps, "scope", "left").withColumn("_up", ancestors(own, params.max_ancestors))
    listed = F.filter("_up", lambda at: F.map_contains_key(F.col("_roots"), at))
    return placed.withColumn("_root", F.try_element_at("_roots", F.get(listed, F.lit(0)))).drop("_roots", "_up")


def _with_root(df: DataFrame, roots: DataFrame, cwd: str, params: Params) -> DataFrame:
    """By map where every scope has few roots, else by depth."""
    keyed = _keyed_roots(roots)
    many = keyed.groupBy("scope").agg(F.count("*").alias("n")).where(F.col("n") > params.max_scope_roots)
    return _with_root_by_map(df, keyed, cwd, params) if many.isEmpty() else _with_root_by_depth(df, roots, cwd, params)


def _with_root_by_depth(df: DataFrame, roots: DataFrame, cwd: str, params: Params) -> DataFrame:
    """Add ``_root``, the nearest listed root, by one equi-join per depth of roots.

    For streams, which cannot expand a row and bring it together again. There is
    one join for each depth at which roots are listed, in practice a handful.
    """
    keyed = _keyed_roots(roots)
    depth = F.size(F.split("_at", "/"))
    depths = sorted(row[0] for row in keyed.select(depth).distinct().collect())
    parts = F.split(normalize_path(clean_path(F.col(cwd))), "/")
    df = df.withColumn("_parts", F.when(F.col(cwd) != "", parts))
    size, root = F.size("_parts"), F.lit(None).cast("string")
    for number in depths:
        reachable = size >= number
        if params.max_ancestors is not None:
            reachable = reachable & (size - number < params.max_ancestors)
        at = F.when(reachable, F.array_join(F.slice("_parts", 1, number), "/"))
        listed = keyed.where(depth == number).withColumnRenamed("root", f"_root{number}")
        df = df.withColumn("_at", at).join(listed, ["scope", "_at"], "left").drop("_at")
        root = F.coalesce(F.col(f"_root{number}"), root)
    return df.withColumn("_root", root).drop("_parts", *[f"_root{n}" for n in depths])


def with_project(
    df: DataFrame, roots: DataFrame | None = None, cwd: str = "cwd", params: Params = DEFAULTS
) -> DataFrame:
    """Add ``project_key`` and ``label``; the key is null for an empty directory."""
    cwd_col = F.col(cwd)
    if roots is None:
        own = clean_path(cwd_col)
        return df.withColumn("project_key", F.when(cwd_col != "", normalize_path(own))).withColumn(
            "label", F.when(cwd_col != "", leaf_label(own)).otherwise("")
        )
    if df.isStreaming:
        placed = _with_root(df, roots, cwd, params)
        root = F.coalesce(F.col("_root"), clean_path(cwd_col))
        return (
            placed.withColumn("project_key", F.when(cwd_col != "", normalize_path(root)))
            .withColumn("label", F.when(cwd_col != "", leaf_label(root)).otherwise(""))
            .drop("_root")
        )
    resolved = resolve_roots(df.select("scope", cwd_col.alias("dir")), roots, params)
    resolved = resolved.select("scope", F.col("dir").alias(cwd), "project_key", "label")
    return df.join(resolved, ["scope", cwd], "left").withColumn("label", F.coalesce("label", F.lit("")))


def same_project(a: Column, b: Column) -> Column:
    """Two project keys name the same project; an empty side never does."""
    return F.coalesce(a == b, F.lit(False))


def project_fights(hard_won: DataFrame, roots: DataFrame | None, key: Column) -> DataFrame:
    """Hard-won commands, already cut per tool, whose project key is ``key``."""
    return with_project(hard_won, roots).where(same_project(F.col("project_key"), key))
