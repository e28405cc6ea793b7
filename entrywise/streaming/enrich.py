"""Completing events from a snapshot of the live file system.

A snapshot has one row for each id: statx columns, `symlink`, `xattrs` (a map of
JSON texts) and `paths`, a map from `<parent_id>/<name>` to the path of that
link; columns that it lacks count as null. An event whose id is gone is skipped,
or raises if asked to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import FIELDS, STATX, STATX_FIELDS, complete, statx_of

#: Attributes that `lustre` stands for.
LUSTRE = [
    "fid", "hsm_state", "hsm_archive_id", "project_id", "magic", "gen", "flags", "mirror_count", "mirror_state", "comp_count", "mdt_count", "mdt_index", "mdt_hash", "mdt_hash_flags", "child_mdt_idx",
    "stripe_count", "stripe_size", "pattern", "comp_flags", "ost", "extension_size", "begin", "end", "pool",
]


def snapshot_of(entries: DataFrame) -> DataFrame:
    """A snapshot from an entry view with one row for each link."""
    have = set(entries.columns)
    first = lambda c: F.first(c, ignorenulls=True).alias(c)
    columns = [first(c) for c in (*STATX, "symlink", "xattrs") if c in have]
    link = F.struct(F.concat_ws("/", F.col("parent_id").cast("string"), "name"), F.col("path"))
    paths = [F.map_from_entries(F.array_distinct(F.collect_list(link))).alias("paths")] if "path" in have else []
    return entries.groupBy("id").agg(*columns, *paths)


def _wants(name: str) -> Column:
    return F.array_contains("fill", name)


def fill(events: DataFrame, snapshot: DataFrame, skip: bool = True) -> DataFrame:
    """Events without open markers: statx fields, symlinks, attributes and paths come from the snapshot.

    Each attribute to be filled becomes an XATTR event, a set or, where the entry
    doesn't have it, an unset; a LINK whose path is open is followed by an XATTR
    event of that link. Only events with markers take part in the join.
    """
    events = complete(events)
    open_ = F.coalesce(F.size("fill") > 0, F.lit(False))
    have = set(snapshot.columns)
    null = lambda t: F.lit(None).cast(t)
    live = snapshot.select(
        F.col("id"), F.lit(True).alias("_found"), statx_of(snapshot).alias("_statx"), (F.col("symlink") if "symlink" in have else null("string")).alias("_symlink"),
        (F.col("xattrs") if "xattrs" in have else null("map<string,string>")).alias("_xattrs"), (F.col("paths") if "paths" in have else null("map<string,string>")).alias("_paths"),
    )
    todo = events.where(open_).join(live, "id", "inner" if skip else "left")
    if not skip:
        gone = F.raise_error(F.concat(F.lit("no such entry: "), F.col("id").cast("string")))
        todo = todo.where(F.when(F.col("_found").isNull(), gone.cast("boolean")).otherwise(F.lit(True)))
    asked = {c: name for name, columns in STATX_FIELDS.items() for c in columns}
    statx = F.struct(*[F.when(_wants(f"statx.{asked[c]}"), F.coalesce(f"_statx.{c}", f"statx.{c}")).otherwise(F.col(f"statx.{c}")).alias(c) for c in STATX])
    own = todo.where("type <> 'XATTR' OR key IS NOT NULL").withColumns({"statx": F.when(F.col("type") == "UPSERT", statx).otherwise(F.col("statx")), "symlink": F.when(_wants("symlink"), F.col("_symlink")).otherwise(F.col("symlink"))})
    # The keys to fill: the named ones, and those that an extension stands for.
    named = F.transform(F.filter("fill", lambda n: n.startswith("xattrs.")), lambda n: F.substring(n, F.lit(8), F.length(n)))
    keys = F.array_distinct(F.concat(named, F.when(_wants("lustre"), F.array(*map(F.lit, LUSTRE))).otherwise(F.array().cast("array<string>"))))
    value = F.try_element_at("_xattrs", F.col("_key"))
    filled = todo.where("type = 'XATTR'").withColumn("_key", F.explode(keys)).where(~F.col("_key").eqNullSafe(F.col("key")))
    filled = filled.withColumns({"key": F.col("_key"), "value": value, "op": F.when(value.isNotNull(), "set").otherwise("unset"), "stamp": null("long"), "final": null("boolean")})
    # An extension only tells what it knows: what it lacks stays as it was.
    filled = filled.where(F.col("value").isNotNull() | F.array_contains("fill", F.concat(F.lit("xattrs."), F.col("key"))))
    path = F.try_element_at("_paths", F.concat_ws("/", F.col("parent_id").cast("string"), "name"))
    paths = todo.where((F.col("type") == "LINK") & _wants("path")).withColumns({"type": F.lit("XATTR"), "ns": F.lit(True), "key": F.lit("path"), "op": F.lit("set"), "value": F.to_json(F.array(path))}).where(path.isNotNull())
    paths = paths.withColumn("value", F.expr("substring(value, 2, length(value) - 2)"))
    done = [complete(part).withColumn("fill", null("array<string>")) for part in (own, filled, paths)]
    out = events.where(~open_)
    for part in done:
        out = out.unionAll(part.select(*FIELDS))
    return out


def reject_open(events: DataFrame) -> DataFrame:
    """The events; reading one that still has something to be filled raises."""
    raw = F.raise_error(F.concat(F.lit("event is not complete: "), F.col("type"), F.lit(" "), F.col("id").cast("string")))
    return events.where(F.when(F.coalesce(F.size("fill") > 0, F.lit(False)), raw.cast("boolean")).otherwise(F.lit(True)))
