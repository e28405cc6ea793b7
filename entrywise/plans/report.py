"""Grouped reports: filter, bucket, group, accumulate, sort."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import TYPE_NAMES, UsageError
from .ast import Always, Node
from .compile import compile_filter, resolve, with_fields
from .schema import field, promote

ACCUMULATORS = ["avg", "count", "max", "min", "sum"]


@dataclass(frozen=True)
class Key:
    """A grouping field, with bucket boundaries or none."""

    field: str
    bounds: tuple[int, ...] = ()

    @property
    def name(self) -> str:
        return "id_" + re.sub(r"\W", "_", self.field)


@dataclass(frozen=True)
class Output:
    accumulator: str
    field: str | None

    @property
    def name(self) -> str:
        return f"result_{self.accumulator}" + (f"_{re.sub(r'[^0-9A-Za-z]', '_', self.field)}" if self.field else "")


def parse_output(text: str) -> list[Output]:
    """`acc(field),...`"""
    out = []
    for part in text.split(","):
        m = re.fullmatch(r"\s*(\w+)\((.*)\)\s*", part)
        if not m:
            raise UsageError(f"missing ) in {part!r}" if "(" in part and ")" not in part else f"expected accumulator(field): {part!r}")
        name, arg = m[1], m[2].strip()
        if name not in ACCUMULATORS:
            raise UsageError(f"unknown accumulator: {name!r}")
        if name == "count":
            if arg:
                raise UsageError("count() takes no field")
            out.append(Output(name, None))
            continue
        if not arg:
            raise UsageError(f"{name}() needs a field")
        field(arg)
        out.append(Output(name, arg))
    return out


def parse_group_by(text: str | None) -> list[Key]:
    """`field1,field2[b0;b1;...]`"""
    out = []
    for part in re.findall(r"[^,\[]+(?:\[[^\]]*\]?)?", text or ""):
        m = re.fullmatch(r"\s*([^\[\]]+?)\s*(?:\[([^\]]*)\])?\s*", part)
        if not m:
            raise UsageError(f"invalid group: {part!r}")
        field(m[1])
        bounds: tuple[int, ...] = ()
        if m[2] is not None:
            try:
                bounds = tuple(int(b) for b in m[2].split(";"))
            except ValueError:
                raise UsageError(f"invalid boundaries: {part!r}") from None
            if list(bounds) != sorted(set(bounds)):
                raise UsageError(f"boundaries must increase: {part!r}")
        out.append(Key(m[1], bounds))
    return out


def bucket(value: Column, bounds: tuple[int, ...]) -> Column:
    """struct<lo, hi>: the first range whose upper bound isn't below the value, else [last; +inf]."""
    rest = F.struct(F.lit(bounds[-1]).cast("long").alias("lo"), F.lit("+inf").alias("hi"))
    for low, high in reversed(list(zip(bounds, bounds[1:]))):
        rest = F.when(value <= high, F.struct(F.lit(low).cast("long").alias("lo"), F.lit(str(high)).alias("hi"))).otherwise(rest)
    return rest


def _accumulate(o: Output) -> Column:
    if o.accumulator == "count":
        return F.count(F.lit(1))
    col = F.col(f"`{field(o.field).column}`")
    if o.accumulator == "sum":
        return F.coalesce(F.sum(col), F.lit(0))
    return {"avg": F.avg, "max": F.max, "min": F.min}[o.accumulator](col)


def report(entries: DataFrame, group_by: str | None, output: str, node: Node = Always(), descending: bool = False, ordered: bool = True) -> DataFrame:
    """One row a group: the keys (buckets as <key>_lo and <key>_hi) and the results.

    Entries that lack a key are left out. Without keys, an empty input gives no row.
    """
    keys, outs = parse_group_by(group_by), parse_output(output)
    known = resolve(node, entries)
    if known is None:
        raise UsageError("the predicate refers to an entry that doesn't exist")
    rows = with_fields(entries, known).where(compile_filter(known))
    rows = promote(rows, {k.field: "bigint" if k.bounds else None for k in keys} | {o.field: "bigint" for o in outs if o.field})
    results = [_accumulate(o).alias(o.name) for o in outs]
    if not keys:
        return rows.agg(F.count(F.lit(1)).alias("_n"), *results).where("_n > 0").drop("_n")
    names = []
    for k in keys:
        col = F.col(f"`{field(k.field).column}`")
        rows = rows.where(col.isNotNull())
        if k.bounds:
            b = bucket(col, k.bounds)
            rows = rows.withColumns({f"{k.name}_lo": b["lo"], f"{k.name}_hi": b["hi"]})
            names += [f"{k.name}_lo", f"{k.name}_hi"]
        else:
            rows = rows.withColumn(k.name, col)
            names.append(k.name)
    out = rows.groupBy(*names).agg(*results)
    return out.orderBy(*[F.desc(n) if descending else F.asc(n) for n in names]) if ordered else out


def _shown(key: Key, row) -> str:
    if key.bounds:
        return f"[{row[key.name + '_lo']}; {row[key.name + '_hi']}]"
    value = row[key.name]
    return TYPE_NAMES.get(value, str(value)) if key.field == "statx.type" else str(value)


def csv_lines(entries: DataFrame, group_by: str | None, output: str, node: Node = Always(), descending: bool = False) -> list[str]:
    """`k1,k2: v1,v2` for each group; the groups come to the driver one partition at a time."""
    keys, outs = parse_group_by(group_by), parse_output(output)
    lines = []
    for row in report(entries, group_by, output, node, descending).toLocalIterator():
        values = ",".join(str(row[o.name]) for o in outs)
        lines.append(f"{','.join(_shown(k, row) for k in keys)}: {values}" if keys else values)
    return lines


def pretty(entries: DataFrame, group_by: str | None, output: str, node: Node = Always(), descending: bool = False) -> str:
    """A table with a column for each key and result."""
    keys, outs = parse_group_by(group_by), parse_output(output)
    head = [k.field for k in keys] + [f"{o.accumulator}({o.field or ''})" for o in outs]
    body = [[_shown(k, r) for k in keys] + [str(r[o.name]) for o in outs] for r in report(entries, group_by, output, node, descending).collect()]
    wide = [max(len(x[i]) for x in [head, *body]) for i in range(len(head))]
    rule = "-" * (sum(wide) + 3 * len(wide) + 1)
    line = lambda x: "| " + " | ".join(c.rjust(w) for c, w in zip(x, wide)) + " |"
    return "\n".join([rule, line(head), rule, *map(line, body), rule])
