"""Policies: conditions, rules, triggers, quotas and actions."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.patterns import UsageError
from ..plans import predicates as P
from ..plans.ast import Cmp, In, Node, Not
from ..plans.compile import compile_filter
from ..plans.parser import SORT_COLUMNS

#: Minutes of time units.
MINUTES = {
    "m": 1, "minute": 1, "minutes": 1, "h": 60, "hour": 60, "hours": 60, "d": 1440, "day": 1440, "days": 1440, "w": 10_080, "week": 10_080, "weeks": 10_080,
    "mo": 43_200, "month": 43_200, "months": 43_200, "y": 525_600, "year": 525_600, "years": 525_600,
}
#: Quantities.
QUANTITIES = {"": 1, "k": 10**3, "M": 10**6, "B": 10**9, "T": 10**12}
#: Units of sizes and the suffixes of -size.
STORAGE = {"B": "c", "c": "c", "KB": "k", "k": "k", "MB": "M", "M": "M", "GB": "G", "G": "G", "TB": "T", "T": "T", "PB": "P", "P": "P", "EB": "E", "E": "E"}
#: Names of file types.
KINDS = {"file": "f", "dir": "d", "symlink": "l", "block": "b", "char": "c", "fifo": "p", "socket": "s"}
#: Forms of dates.
DATES = ["%Y-%m-%d", "%Y-%m-%dT%H:%M:%S", "%d/%m/%Y", "%d-%m-%Y", "%Y/%m/%d", "%Y.%m.%d", "%d.%m.%Y"]


def parse_time(text: str) -> tuple[int, str]:
    """(N, 'min') below a day, else (whole days, 'day')."""
    m = re.fullmatch(r"(\d+)\s?([a-zA-Z]+)", text)
    minutes = m and MINUTES.get(m[2].lower())
    if not minutes:
        raise UsageError(f"invalid time: {text!r}")
    total = int(m[1]) * minutes
    return (total, "min") if total < 1440 else (total // 1440, "day")


def parse_quantity(text) -> int:
    m = re.fullmatch(r"(\d+)([kMBT]?)", str(text))
    if not m:
        raise UsageError(f"invalid quantity: {text!r}")
    return int(m[1]) * QUANTITIES[m[2]]


def parse_bytes(text) -> int:
    m = re.fullmatch(r"(\d+)([a-zA-Z]*)", str(text))
    if not m or (m[2] and m[2] not in STORAGE):
        raise UsageError(f"invalid size: {text!r}")
    return int(m[1]) * P.size_unit("1" + STORAGE[m[2] or "c"])[1]


def parse_date(text: str) -> int | None:
    for form in DATES:
        try:
            return int(datetime.strptime(text, form).replace(tzinfo=timezone.utc).timestamp())
        except ValueError:
            pass
    return None


def in_units(op: str, name: str, n: int, unit: int) -> Node:
    """A comparison with n units, where a value counts as the units that it begins."""
    if op == "=":
        return Cmp(">", name, max(n - 1, 0) * unit) & Cmp("<", name, n * unit + 1 if n else unit + 1)
    return {">": lambda: Cmp(">", name, n * unit), ">=": lambda: Cmp(">", name, max(n - 1, 0) * unit), "<": lambda: Cmp("<=", name, max(n - 1, 0) * unit), "<=": lambda: Cmp("<=", name, n * unit)}[op]()


def at_age(op: str, name: str, now: int, n: int, unit: int) -> Node:
    """A comparison of an age in whole units with n."""
    then = now - n * unit
    if op == "=":
        return Cmp(">", name, then - unit) & Cmp("<", name, then)
    return {">": lambda: Cmp("<", name, then), ">=": lambda: Cmp("<", name, now - max(n - 1, 0) * unit), "<": lambda: Cmp(">", name, then), "<=": lambda: Cmp(">", name, then - unit)}[op]()


@dataclass(frozen=True)
class Condition:
    """A predicate tree that depends on the context of the run."""

    build: Callable[[P.Context], Node]

    def __and__(self, other: "Condition") -> "Condition":
        return Condition(lambda ctx: self.build(ctx) & other.build(ctx))

    def __or__(self, other: "Condition") -> "Condition":
        return Condition(lambda ctx: self.build(ctx) | other.build(ctx))

    def __invert__(self) -> "Condition":
        return Condition(lambda ctx: Not(self.build(ctx)))


class Key:
    """An attribute; comparing it gives a Condition."""

    def __init__(self, name: str):
        self.name = name

    __hash__ = object.__hash__

    def __eq__(self, value):  # type: ignore[override]
        return self._make("=", value)

    def __ne__(self, value):  # type: ignore[override]
        return ~self._make("=", value)

    def __lt__(self, value):
        return self._make("<", value)

    def __le__(self, value):
        return self._make("<=", value)

    def __gt__(self, value):
        return self._make(">", value)

    def __ge__(self, value):
        return self._make(">=", value)

    def _make(self, op: str, value) -> Condition:
        name = self.name
        if name in _TEXT:
            if op != "=":
                raise UsageError(f"{name} can only be equal or not")
            return Condition(lambda ctx: P.PREDICATES[_TEXT[name]][1](ctx, value))
        if name == "Type":
            letter = KINDS.get(str(value).lower(), str(value).lower())
            return Condition(lambda ctx: P.file_type(ctx, letter))
        if name in _NUMBER:
            n = parse_quantity(value)
            return Condition(lambda ctx: Cmp(op, _NUMBER[name], n))
        if name == "DirCount":
            count = parse_quantity(value)
            return Condition(lambda ctx: Cmp(op, "xattrs.nb_children", count))
        if name == "Size":
            m = re.fullmatch(r"(\d+)([a-zA-Z]*)", str(value))
            if not m or (m[2] or "c") not in STORAGE:
                raise UsageError(f"invalid size: {value!r}")
            number, unit = int(m[1]), P.size_unit("1" + STORAGE[m[2] or "c"])[1]
            return Condition(lambda ctx: in_units(op, "statx.size", number, unit))
        if name in _TIME:
            date = parse_date(str(value))
            if date is not None:
                return Condition(lambda ctx: Cmp(op, f"statx.{_TIME[name]}", date))
            n, unit = parse_time(str(value))
            seconds = 86_400 if unit == "day" else 60
            return Condition(lambda ctx: at_age(op, f"statx.{_TIME[name]}", ctx.now, n, seconds))
        raise UsageError(f"no condition on {name}")


_TEXT = {"Path": "-path", "Name": "-name", "IName": "-iname", "User": "-user", "Group": "-group"}
_NUMBER = {"UID": "statx.uid", "GID": "statx.gid"}
_TIME = {"LastAccess": "atime", "LastModification": "mtime", "LastChange": "ctime", "CreationDate": "btime"}
Path, Name, IName, User, Group, Type, UID, GID, DirCount, Size, LastAccess, LastModification, LastChange, CreationDate, Pool = map(Key, ["Path", "Name", "IName", "User", "Group", "Type", "UID", "GID", "DirCount", "Size", "LastAccess", "LastModification", "LastChange", "CreationDate", "Pool"])


class FileClass(Condition):
    """A named condition."""

    def __init__(self, name: str, target: Condition):
        object.__setattr__(self, "build", target.build)
        object.__setattr__(self, "name", name)


@dataclass(frozen=True)
class Rule:
    name: str
    condition: Condition
    action: object = None
    max_count: int | None = None


@dataclass(frozen=True)
class Policy:
    """target selects; the first rule that matches gives the action, else the policy's own; a trigger decides whether it runs."""

    name: str
    target: Condition
    action: object
    trigger: "Trigger | None" = None
    rules: tuple[Rule, ...] = ()
    sort: tuple[tuple[str, bool], ...] = ()
    max_count: int | None = None
    stop: "Trigger | None" = None


@dataclass(frozen=True)
class Trigger:
    """A test of the store, combined with & and |.

    `watch` gives the test for the entries that an action removes, one after the
    other: it knows the store's state and is asked with each removed entry. By
    default the store itself is tested again.
    """

    test: Callable[[DataFrame, P.Context], bool]
    label: str = ""
    watch_with: Callable[[DataFrame, P.Context], Callable[[object], bool]] | None = None

    def watch(self, e: DataFrame, c: P.Context) -> Callable[[object], bool]:
        return self.watch_with(e, c) if self.watch_with else lambda removed: self.test(e, c)

    def _with(self, other: "Trigger", word: str, join: Callable) -> "Trigger":
        def watch(e: DataFrame, c: P.Context) -> Callable[[object], bool]:
            mine, theirs = self.watch(e, c), other.watch(e, c)

            def told(removed) -> bool:  # both have to hear of it
                a, b = mine(removed), theirs(removed)
                return join((a, b))

            return told

        return Trigger(lambda e, c: join(t.test(e, c) for t in (self, other)), f"({self.label} {word} {other.label})", watch)

    def __and__(self, other: "Trigger") -> "Trigger":
        return self._with(other, "and", all)

    def __or__(self, other: "Trigger") -> "Trigger":
        return self._with(other, "or", any)


Always_ = Trigger(lambda e, c: True, "always")


def periodic(text: str) -> Trigger:
    """Runs every time it is asked: there is no daemon that would wait."""
    parse_time(text)
    return Trigger(lambda e, c: True, f"every {text}")


def scheduled(when: str) -> Trigger:
    at = parse_date(when)
    if at is None:
        raise UsageError(f"invalid date: {when!r}")
    return Trigger(lambda e, c: c.now >= at, f"at {when}")


_COMPARE = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b}


def capacity(provider: Callable[[], float], op: str, percent: float) -> Trigger:
    """A share of used space or inodes, from an injected provider."""
    return Trigger(lambda e, c: _COMPARE[op](provider(), percent), f"used {op} {percent} %")


def statistic(entries: DataFrame, node: Node, what: str) -> int:
    """COUNT or SUM(size) over the selected entries; 0 if there are none."""
    agg = F.count(F.lit(1)) if what == "count" else F.coalesce(F.sum("size"), F.lit(0))
    return int(entries.where(compile_filter(node)).agg(agg).first()[0])


def mirror_trigger(owner: str, names: list, what: str, op: str, threshold) -> Trigger:
    """owner: User or Group; what: FileCount, InodeCount or DiskUsage, against a threshold."""
    if owner not in ("User", "Group") or what not in ("FileCount", "InodeCount", "DiskUsage"):
        raise UsageError(f"no trigger on {owner} {what}")
    limit = parse_bytes(threshold) if what == "DiskUsage" else parse_quantity(threshold)
    column = "uid" if owner == "User" else "gid"

    def ids(ctx: P.Context) -> tuple[int, ...]:
        table = ctx.users if owner == "User" else ctx.groups
        return tuple(n if isinstance(n, int) else table[n] for n in names)

    def count(e: DataFrame, c: P.Context) -> int:
        test: Node = In(f"statx.{column}", ids(c))
        return statistic(e, test & P.file_type(c, "f") if what == "FileCount" else test, "sum" if what == "DiskUsage" else "count")

    def watch(e: DataFrame, c: P.Context) -> Callable[[object], bool]:
        # Counted once; what is removed is taken off.
        left, mine = [count(e, c)], set(ids(c))

        def told(removed) -> bool:
            if removed is not None and removed[column] in mine and (what != "FileCount" or removed["type"] == P.TYPES["f"]):
                left[0] -= (removed["size"] or 0) if what == "DiskUsage" else 1
            return _COMPARE[op](left[0], limit)

        return told

    return Trigger(lambda e, c: _COMPARE[op](count(e, c), limit), f"{what}({owner}) {op} {threshold}", watch)


def plan(policy: Policy, entries: DataFrame, ctx: P.Context, fresh: DataFrame | None = None) -> DataFrame:
    """The entries to act on with `rule` (null: the policy's own action), in scan order, within the quotas.

    Entries that no longer match in `fresh` are left out. Quotas rank the
    entries of a rule in the policy's order. The largest quota limits the ranking
    itself, so no more than that many rows of a rule leave a task.
    """
    rows = entries.where(compile_filter(policy.target.build(ctx)))
    if fresh is not None:
        rows = fresh.where(compile_filter(policy.target.build(ctx))).join(rows.select("id"), "id", "left_semi")
    rule = F.lit(None).cast("string")
    for r in reversed(policy.rules):
        rule = F.when(compile_filter(r.condition.build(ctx)), F.lit(r.name)).otherwise(rule)
    rows = rows.withColumn("rule", rule)
    order = [F.col(SORT_COLUMNS.get(c, c)).asc_nulls_first() if up else F.col(SORT_COLUMNS.get(c, c)).desc_nulls_last() for c, up in policy.sort] or [F.asc("id")]
    quotas = {r.name: r.max_count for r in policy.rules} | {None: policy.max_count}
    limits = {name: q for name, q in quotas.items() if q is not None}
    if limits:
        mine = lambda name: F.col("rule").isNull() if name is None else F.col("rule") == name
        quota = F.lit(None).cast("long")
        for name, q in limits.items():
            quota = F.when(mine(name), F.lit(q)).otherwise(quota)
        w = Window.partitionBy("rule").orderBy(*order, F.asc("id"))
        held = rows.withColumn("_quota", quota)
        ranked = held.where("_quota IS NOT NULL").withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= max(limits.values())).where("_rank <= _quota")
        free = [name for name in quotas if name not in limits]
        rows = ranked.drop("_rank", "_quota")
        if free:
            rows = rows.unionAll(held.where("_quota IS NULL").drop("_quota"))
    return rows.orderBy(*order) if policy.sort else rows


@dataclass
class Outcome:
    ran: bool
    done: int = 0
    errors: int = 0
    stopped: bool = False
    by_rule: dict = field(default_factory=dict)


#: Actions after which an entry no longer counts.
REMOVING = ("delete", "purge")


def run(policy: Policy, entries: DataFrame, ctx: P.Context, act: Callable[[object, object], None] | None = None, manual: bool = False, fresh: DataFrame | None = None, removing: tuple = REMOVING) -> Outcome:
    """Evaluate the trigger, then act on each planned entry; rows come to the driver a partition at a time.

    The stop threshold is asked after each action. It counts the store once and
    takes off what the actions in `removing` remove; a callable removes if it returns True.
    """
    if policy.trigger is not None and not manual and not policy.trigger.test(entries, ctx):
        return Outcome(False)
    out = Outcome(True)
    actions = {r.name: r.action if r.action is not None else policy.action for r in policy.rules} | {None: policy.action}
    stops = policy.stop.watch(entries, ctx) if policy.stop is not None else None
    for row in plan(policy, entries, ctx, fresh).toLocalIterator():
        action, removed = actions[row["rule"]], False
        try:
            result = action(row) if callable(action) else act(action, row) if act else None
            removed = result is True or (not callable(action) and action in removing)
            out.done += 1
            out.by_rule[row["rule"]] = out.by_rule.get(row["rule"], 0) + 1
        except Exception:  # one entry's failure doesn't end the run
            out.errors += 1
        if stops is not None and stops(row if removed else None):
            out.stopped = True
            break
    return out
