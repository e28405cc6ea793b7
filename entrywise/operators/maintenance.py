"""Garbage collection, undelete, retention, enrichment, mirror facts and run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import UsageError
from ..plans.ast import Always, Node
from ..plans.compile import compile_filter
from ..streaming.events import complete, statx_of

INT64_MAX = (1 << 63) - 1


def dead_links(mirror: DataFrame, live: DataFrame, before: int | None = None, node: Node = Always(), check: DataFrame | None = None) -> DataFrame:
    """UNLINK events for mirror links that aren't live; `live` has id and path.

    With several links an inode can be alive under other names, so those are
    compared by id and path, others by id alone. `check` has the ids that a check
    of the caller's found alive; they stay. Nothing is written: a caller may list
    the events instead of applying them.
    """
    rows = mirror.where(compile_filter(node))
    if before is not None:
        rows = rows.where(F.col("sync_time") < before)
    alone = rows.where(F.coalesce("nlink", F.lit(1)) <= 1).join(live.select("id"), "id", "left_anti")
    shared = rows.where(F.coalesce("nlink", F.lit(1)) > 1).join(live.select("id", "path"), ["id", "path"], "left_anti")
    dead = alone.unionByName(shared)
    if check is not None:
        dead = dead.join(check.select("id"), "id", "left_anti")
    return dead.select(F.lit("UNLINK").alias("type"), "id", "parent_id", "name", "path")


def undeletable(mirror: DataFrame, target: str) -> DataFrame:
    """Removed but archived entries whose path begins with a match of the pattern `target`."""
    return mirror.where(F.col("rm_time").isNotNull() & F.col("path").rlike(f"(?s)^(?:{target})")).select("id", "path", "rm_time")


def restore_events(mirror: DataFrame, path: str, new_id) -> DataFrame:
    """What restoring the entry at a path sends to the mirror: the new inode and link, and DELETE of the old id."""
    old = mirror.where((F.col("path") == path) & F.col("rm_time").isNotNull())
    symlink = F.col("symlink") if "symlink" in mirror.columns else F.lit(None).cast("string")
    row = lambda seq, kind, ident, **more: complete(old.select(F.lit(seq).alias("seq"), F.lit(kind).alias("type"), ident.alias("id"), *[c.alias(k) for k, c in more.items()]))
    up = row(0, "UPSERT", F.lit(new_id), statx=statx_of(mirror), symlink=symlink)
    return up.unionAll(row(1, "LINK", F.lit(new_id), parent_id=F.col("parent_id"), name=F.col("name"))).unionAll(row(2, "DELETE", F.col("id")))


def expiry(attribute, mtime):
    """Expiration date of a retention attribute: `inf`, `+N` seconds after mtime (saturating), or a date; None where malformed."""
    plus = F.try_add(mtime, F.expr(f"try_cast(substring({attribute}, 2) as bigint)"))
    relative = F.when(plus.isNull() & F.col(attribute).rlike(r"^\+\d+$"), F.lit(INT64_MAX)).otherwise(plus)
    return F.when(F.col(attribute) == "inf", F.lit(INT64_MAX)).when(F.col(attribute).startswith("+"), relative).otherwise(F.expr(f"try_cast({attribute} as bigint)"))


def enrich_retention(entries: DataFrame, attribute: str = "retention") -> DataFrame:
    """expiration_date from the user's attribute; the later of it and an existing date stays."""
    new = expiry(attribute, F.col("mtime_sec"))
    return entries.withColumn("expiration_date", F.greatest("expiration_date", new) if "expiration_date" in entries.columns else new)


def enrich_sparseness(entries: DataFrame) -> DataFrame:
    """Percentage of the size that is allocated, of regular files; 100 for empty ones."""
    share = F.when(F.col("size") == 0, F.lit(100)).otherwise(F.floor(F.lit(512.0) * F.col("blocks") / F.col("size") * 100))
    return entries.withColumn("sparseness", F.when(F.col("type") == 0o100000, share.cast("long")))


def enrich_children(entries: DataFrame, counts: DataFrame) -> DataFrame:
    """nb_children of directories from (id, n_children); 0 where there are none."""
    out = entries.drop("nb_children").join(counts, "id", "left")
    return out.withColumn("nb_children", F.when(F.col("type") == 0o040000, F.coalesce("n_children", F.lit(0)).cast("long"))).drop("n_children")


def expired_directories(entries: DataFrame, now: int, delay: int = 0, attribute: str = "retention") -> DataFrame:
    """(id, path, delay) of directories that expire within `delay` seconds and whose attribute is relative to their use."""
    relative = F.expr(f"try_cast(substring({attribute}, 2) AS bigint)")
    rows = entries.where(F.col("type") == 0o040000).where(F.col("expiration_date") <= now + delay).where(F.col(attribute).startswith("+") & relative.isNotNull())
    return rows.select("id", "path", relative.alias("delay"))


def retention_updates(entries: DataFrame, expired: DataFrame, now: int) -> DataFrame:
    """For each expired directory (id, path, delay): the date its contents postpone it to, and whether it still is expired.

    The new date is the delay after the latest access or change of a regular
    file below it. Files are aggregated by directory first; then each directory,
    not each file, is sent once for each level above it.
    """
    files = entries.where(F.col("type") == 0o100000).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.greatest("atime_sec", "mtime_sec").alias("used"))
    folders = files.groupBy("folder").agg(F.max("used").alias("used"))
    parts = F.split("folder", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.when(i == 1, F.lit("/")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    latest = folders.select(F.explode(F.when(F.col("folder") == "", F.array(F.lit("/"))).otherwise(above)).alias("path"), "used").groupBy("path").agg(F.max("used").alias("used"))
    out = expired.select("id", "path", "delay").join(latest, "path", "left").withColumn("new_expiration", F.col("used") + F.col("delay"))
    return out.select("id", "path", "new_expiration", F.coalesce(F.col("new_expiration") <= now, F.lit(True)).alias("still_expired"))


#: What info() tells.
INFO_FIELDS = ["average_size", "backend_source", "command_backend", "count", "fsevents_source", "last_sync", "mountpoint", "size"]


def info(entries: DataFrame, log: DataFrame, facts: DataFrame, stored_size: int | None = None) -> DataFrame:
    """One row of INFO_FIELDS: counts, the start of the newest sync, the stored facts, and the bytes that the store takes (else the sum of sizes)."""
    counts = entries.agg(F.count(F.lit(1)).alias("count"), F.avg("size").alias("average_size"), F.coalesce(F.sum("size"), F.lit(0)).alias("_sum"))
    counts = counts.withColumn("size", F.lit(stored_size).cast("long") if stored_size is not None else F.col("_sum")).drop("_sum")
    last = log.where("command = 'sync'").agg(F.max_by("started", "log_id")).first()[0]
    told = ["backend_source", "command_backend", "fsevents_source", "mountpoint"]
    stored = {r["name"]: r["value"] for r in facts.where(F.col("name").isin(told)).dropDuplicates(["name"]).collect()}  # four rows at most
    return counts.withColumns({"last_sync": F.lit(last).cast("long"), **{c: F.lit(stored.get(c)).cast("string") for c in told}}).select(*INFO_FIELDS)


FACTS = "name string, value string"


def upsert_info(facts: DataFrame, new: DataFrame) -> DataFrame:
    """Stored facts (name, value as JSON text) after a run.

    backend_source is a set that grows; the members of fsevents_source are
    replaced one by one; other facts are replaced as a whole.
    """
    both = facts.withColumn("at", F.lit(0)).unionByName(new.withColumn("at", F.lit(1)))
    items = F.transform(F.flatten(F.array_sort(F.collect_list(F.struct("at", F.from_json("value", "array<string>").alias("v")))).getField("v")), lambda x: x)
    members = F.aggregate(F.array_sort(F.collect_list(F.struct("at", F.map_entries(F.from_json("value", "map<string,string>")).alias("m")))), F.array().cast("array<struct<key:string,value:string>>"), lambda acc, x: F.concat(F.filter(acc, lambda a: ~F.exists(x["m"], lambda b: b["key"] == a["key"])), x["m"]))
    merged = both.groupBy("name").agg(F.max_by("value", "at").alias("last"), F.to_json(F.array_distinct(items)).alias("items"), F.to_json(F.map_from_entries(F.array_sort(members))).alias("members"))
    return merged.select("name", F.when(F.col("name") == "backend_source", F.col("items")).when(F.col("name") == "fsevents_source", F.col("members")).otherwise(F.col("last")).alias("value"))


def log_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("command").agg(F.count(F.lit(1)).alias("n"))


def log_rows(log: DataFrame, n: int, last: bool = True) -> DataFrame:
    """The first or last runs."""
    return log.orderBy(F.desc("log_id") if last else F.asc("log_id")).limit(n)


def unowned(entries: DataFrame, known: DataFrame, column: str = "uid") -> DataFrame:
    """Entries whose owner is in no row of `known`, for owner tables too large for a list."""
    return entries.join(known.select(column).distinct(), column, "left_anti").select(*entries.columns)


def recheck(selected: DataFrame, fresh: DataFrame, node: Node) -> DataFrame:
    """The selected entries that still satisfy the predicate in a fresh snapshot."""
    return fresh.where(compile_filter(node)).join(selected.select("id"), "id", "left_semi")


def with_owner_names(entries: DataFrame, users: DataFrame, groups: DataFrame) -> DataFrame:
    """user_name and group_name from (name, uid) and (name, gid) tables; null for unknown owners."""
    u = users.select("uid", F.col("name").alias("user_name"))
    g = groups.select("gid", F.col("name").alias("group_name"))
    return entries.join(u, "uid", "left").join(g, "gid", "left")


#: What each command writes into the log.
LOG_FIELDS = {
    "sync": {"source", "destination", "command_line", "entries", "skipped", "started", "ended"}, "fsevents": {"source", "destination", "command_line", "records", "events", "last_index", "started", "ended"},
    "gc": {"mirror", "command_line", "removed", "started", "ended"}, "find": {"stores", "command_line", "matches", "started", "ended"}, "report": {"store", "command_line", "rows", "started", "ended"},
}


def append_log(log: DataFrame, command: str, started: int, fields: dict[str, str]) -> DataFrame:
    """The log with one more run; its number follows the largest."""
    if command not in LOG_FIELDS or not set(fields) <= LOG_FIELDS[command]:
        raise UsageError(f"no log of {command} with {sorted(fields)}")
    last = log.agg(F.coalesce(F.max("log_id"), F.lit(0)).alias("n"))
    pairs = [x for k, v in fields.items() for x in (F.lit(k), F.lit(str(v)))]
    row = last.select((F.col("n") + 1).alias("log_id"), F.lit(command).alias("command"), F.lit(started).cast("long").alias("started"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("fields"))
    return log.unionByName(row, allowMissingColumns=True)
