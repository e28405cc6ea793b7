"""Selecting entries: filter, sort, skip, limit, project, act."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import formatting
from ..functions.patterns import UsageError
from .ast import Node
from .compile import compile_filter, resolve, with_fields
from .parser import Action, Query, parse
from .predicates import Context
from .schema import ATTRIBUTE_TYPES, promote


def select(entries: DataFrame, node: Node) -> DataFrame:
    """The entries that satisfy a predicate; none if it refers to an entry that doesn't exist."""
    known = resolve(node, entries)
    if known is None:
        return entries.where(F.lit(False))
    rows = with_fields(entries, known).where(compile_filter(known))
    return rows.select(*entries.columns) if len(rows.columns) > len(entries.columns) else rows


def filter_one(entries: DataFrame, node: Node) -> DataFrame:
    """The first entry that satisfies a predicate, in no particular order."""
    return select(entries, node).limit(1)


def entry_at(entries: DataFrame, path: str) -> DataFrame:
    """The entry at an absolute path, resolved name by name from the root: entries need no paths.

    Each step is a lookup by parent and name; the longest chain has one for each
    part of the path.
    """
    found = entries.where(F.col("parent_id") == 0)
    for name in [p for p in path.split("/") if p]:
        parent = found.select("id").limit(1).collect()
        if not parent:
            return entries.where(F.lit(False))
        found = entries.where((F.col("parent_id") == parent[0]["id"]) & (F.col("name") == name))
    return found.limit(1)


def checked(entries: DataFrame, fresh: DataFrame, node: Node) -> DataFrame:
    """The selected entries that still satisfy the predicate in a fresh snapshot, with its values."""
    again = select(fresh, node)
    return again.join(select(entries, node).select("id"), "id", "left_semi").select(*fresh.columns)


def arrange(df: DataFrame, query: Query) -> DataFrame:
    """Sort, then skip, then limit; missing values come first in ascending order."""
    if query.sort:
        df = df.orderBy(*[F.col(c).asc_nulls_first() if up else F.col(c).desc_nulls_last() for c, up in query.sort])
    if query.one:
        df = df.where(F.col("parent_id").isNull() | (F.col("parent_id") == 0))
    if query.skip:
        df = df.offset(query.skip)
    return df.limit(query.limit) if query.limit else df


def find(entries: DataFrame, args: list[str] | Query, ctx: Context | None = None, action: int = 0, start: str = "/") -> DataFrame:
    """The rows that the action acts on; -count gives one row, -print and -printf a column `line`."""
    query = args if isinstance(args, Query) else parse(args, ctx)
    act = query.actions[action]
    if act.name == "-quit":
        return arrange(select(entries, act.filter), query).limit(1)
    return output(arrange(select(entries, act.filter), query), act, start)


def output(rows: DataFrame, act: Action, start: str = "/") -> DataFrame:
    if act.name == "-count":
        return rows.agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.col("n").cast("string"), F.lit(" matching entries")).alias("line"), "n")
    if act.name in ("-printf", "-fprintf"):
        known = promote(rows, {f"xattrs.{c}": None for c in ATTRIBUTE_TYPES})
        return known.withColumn("line", formatting.printf(act.args[-1], start)).select(*rows.columns, "line")
    if act.name in ("-ls", "-fls"):
        return rows.withColumn("line", formatting.ls_line())
    return rows


def find_all(stores: list[DataFrame], args: list[str], ctx: Context | None = None) -> DataFrame:
    """The results of several stores, one after the other."""
    out = find(stores[0], args, ctx)
    for s in stores[1:]:
        out = out.unionByName(find(s, args, ctx), allowMissingColumns=True)
    return out


def run(entries: DataFrame, args: list[str], ctx: Context | None = None, execute: Callable[[list[str]], None] | None = None, fresh: DataFrame | None = None) -> Iterator[str]:
    """Lines that the actions print, in order of the actions; rows come to the driver one partition at a time.

    -exec, -checked-exec and -delete hand their command to `execute`;
    -checked-exec only for entries that still match in `fresh`, a snapshot of the
    live file system.
    """
    query = parse(args, ctx)
    for act in query.actions:
        rows = arrange(select(entries, act.filter), query)
        if act.name == "-count":
            yield output(rows, act).first()["line"]
        elif act.name in ("-exec", "-checked-exec", "-delete"):
            if execute is None:
                raise UsageError(f"{act.name} needs an executor of commands")
            if act.name == "-checked-exec":
                if fresh is None:
                    raise UsageError("-checked-exec needs a snapshot of the live file system")
                rows = arrange(checked(entries, fresh, act.filter), query)
            for r in rows.select("path").toLocalIterator():
                execute([a.replace("{}", r["path"]) for a in act.args] if act.args else ["rm", r["path"]])
        elif act.name == "-quit":
            return
        else:
            done = output(rows, act)
            done = done if "line" in done.columns else done.withColumn("line", F.col("path"))
            end = "\0" if act.name.endswith("0") else "" if "printf" in act.name else "\n"
            lines = (r["line"] + end for r in done.select("line").toLocalIterator())
            if act.name.startswith("-f"):
                with open(act.args[0], "w", encoding="utf-8") as f:
                    f.writelines(lines)
            else:
                yield from lines


def dry_run(entries: DataFrame, args: list[str], ctx: Context | None = None) -> str:
    """The plan of a command line, which isn't run."""
    return find(entries, args, ctx)._jdf.queryExecution().toString()
