"""Sub-trees, paths, children and hard links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.folders import shared_folder


def parent_of(entries: DataFrame, of: DataFrame) -> DataFrame:
    """The parents of some entries, one row for each."""
    return entries.join(of.select(F.col("parent_id").alias("id")).distinct(), "id", "left_semi")


def root(entries: DataFrame) -> DataFrame:
    """The entry without a parent."""
    return entries.where((F.col("parent_id") == 0) | F.col("parent_id").isNull())


def children(entries: DataFrame) -> DataFrame:
    """(id, n_children) of every directory that has children."""
    return entries.where(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))


def branch(entries: DataFrame, root_id) -> DataFrame:
    """The entry and everything below it, level by level.

    Only directories are walked, so a level joins the next directories and not
    all entries; the files come with one join at the end. Levels are written to
    the checkpoint folder. The walk ends with an empty level, at any depth; an
    entry that is met again, as in a cycle, isn't walked again.
    """
    directories = keep(entries.where(F.col("type") == 0o040000).select("id", "parent_id"))
    seen = level = entries.where(F.col("id") == root_id).select("id")
    depth = 0
    while True:
        level = keep(directories.join(level.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").select("id").join(seen, "id", "left_anti"))
        if level.isEmpty():
            break
        depth += 1
        seen = _grown(seen.unionAll(level), depth)
    below = entries.join(seen.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").where(F.col("id") != root_id).select(*entries.columns)
    return entries.where(F.col("id") == root_id).unionByName(below)


#: Levels after which what was seen is written as one table, so that the plan doesn't grow with the depth.
LEVELS_KEPT = 16


def _grown(df: DataFrame, depth: int) -> DataFrame:
    return keep(df) if depth % LEVELS_KEPT == 0 else df


def keep(df: DataFrame) -> DataFrame:
    """Write to the shared checkpoint folder and cut the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def branch_by_path(entries: DataFrame, path: str) -> DataFrame:
    """The same, by the path prefix, where paths are kept: a scan without joins."""
    if path == "/":
        return entries
    return entries.where((F.col("path") == path) | F.col("path").startswith(path.rstrip("/") + "/"))


def derive_paths(entries: DataFrame) -> DataFrame:
    """(id, parent_id, name, path) of every link that is reachable from the root, from parents down.

    The directories' paths are found level by level; files take their parent's
    path in one join. The walk ends with an empty level, at any depth; a
    directory below itself, as in a cycle, isn't walked again.
    """
    directories = keep(entries.where(F.col("type") == 0o040000).select("id", "parent_id", "name"))
    top = entries.where(F.col("name") == "").select("id", "parent_id", "name", F.lit("/").alias("path"))
    level = keep(top.withColumn("_ids", F.array("id")))
    done = level.drop("_ids")
    depth = 0
    while True:
        up = level.select(F.col("id").alias("parent_id"), F.col("path").alias("_up"), "_ids")
        level = directories.join(up, "parent_id").where(~F.coalesce(F.array_contains("_ids", F.col("id")), F.lit(False)))
        level = keep(level.select("id", "parent_id", "name", _join("_up").alias("path"), F.concat(F.col("_ids"), F.array("id")).alias("_ids")))
        if level.isEmpty():
            break
        depth += 1
        done = _grown(done.unionAll(level.drop("_ids")), depth)
    up = done.select(F.col("id").alias("parent_id"), F.col("path").alias("_up"))
    files = entries.where(F.coalesce(F.col("type") != 0o040000, F.lit(True))).select("id", "parent_id", "name").join(up, "parent_id")
    return done.unionByName(files.select("id", "parent_id", "name", _join("_up").alias("path")))


def _join(up: str):
    return F.concat(F.when(F.col(up) == "/", "").otherwise(F.col(up)), F.lit("/"), F.col("name"))


def repair_paths(entries: DataFrame) -> DataFrame:
    """Entries with paths that agree with their parents, and `repaired` where that changed something.

    A directory that has moved leaves wrong paths below it that look complete, so
    all paths are compared with the derived ones; what agrees isn't changed.
    """
    right = derive_paths(entries).select("id", "parent_id", "name", F.col("path").alias("_right"))
    out = entries.join(right, ["id", "parent_id", "name"], "left")
    return out.withColumn("repaired", F.col("_right").isNotNull() & ~F.col("path").eqNullSafe(F.col("_right"))).withColumn("path", F.coalesce("_right", "path")).drop("_right")


def with_links(inodes: DataFrame, links: DataFrame) -> DataFrame:
    """One row for each name of an inode; inodes without a name are left out."""
    return inodes.join(links, "id")


def linkless(inodes: DataFrame, links: DataFrame) -> DataFrame:
    """Inodes without any name: what a store's garbage collection removes."""
    return inodes.join(links.select("id"), "id", "left_anti")
