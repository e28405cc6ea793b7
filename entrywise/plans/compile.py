"""Predicate trees to Columns.

A missing value satisfies no comparison. Negation is pushed to the leaves, and
there it is not plain NOT: the negation of `=`, of a regular expression, of IN
and of an element match holds for a missing value; the negation of `<` is `>=`,
which doesn't. A comparison with an array holds if it holds for some element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.patterns import UsageError
from .ast import Always, And, Bits, Cmp, Elem, Exists, Get, In, Node, Not, Or, Regex
from .schema import field, promote

_DUAL = {"<": ">=", "<=": ">", ">": "<=", ">=": "<"}
_BIT_DUAL = {"any_set": "all_clear", "all_set": "any_clear", "any_clear": "all_set", "all_clear": "any_set"}


def _compare(op: str, a: Column, b) -> Column:
    b = b if isinstance(b, Column) else F.lit(b)
    return {"=": lambda: a == b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def _bits(op: str, a: Column, mask: int) -> Column:
    a, m = a.cast("long"), F.lit(mask).cast("long")
    return {"any_set": lambda: a.bitwiseAND(m) != 0, "all_set": lambda: a.bitwiseAND(m) == m, "any_clear": lambda: a.bitwiseAND(m) != m, "all_clear": lambda: a.bitwiseAND(m) == 0}[op]()


def _regex(node: Regex, a: Column) -> Column:
    return a.rlike(("(?is)" if node.insensitive else "(?s)") + node.pattern)


def _element(part: tuple, x: Column) -> Column:
    op, member, value = part
    at = x[member] if member else x
    return _bits(op, at, value) if op in _BIT_DUAL else _compare(op, at, value)


def compile_filter(node: Node, negate: bool = False) -> Column:
    """A boolean Column to filter by: null counts as false.

    Leaves stay plain comparisons of columns, so that they reach the scan; no
    NOT is ever put above something that can be null.
    """
    if isinstance(node, Always):
        return F.lit(not negate)
    if isinstance(node, Not):
        return compile_filter(node.part, not negate)
    if isinstance(node, (And, Or)):
        parts = [compile_filter(p, negate) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node, And) != negate else out | p
        return out
    if isinstance(node, Get):
        raise UsageError("a reference to another entry must be resolved first")
    f = field(node.field)
    col = F.col(f"`{f.column}`")
    some: Callable = (lambda test: F.exists(col, test)) if f.array else (lambda test: test(col))
    if isinstance(node, Exists):
        return col.isNotNull() if node.present != negate else col.isNull()
    if isinstance(node, Cmp) and node.op != "=":
        op = _DUAL[node.op] if negate else node.op
        return some(lambda x: _compare(op, x, node.value))
    if isinstance(node, Bits):
        op = _BIT_DUAL[node.op] if negate else node.op
        return some(lambda x: _bits(op, x, node.mask))
    if isinstance(node, Cmp):
        test = some(lambda x: _compare("=", x, node.value))
    elif isinstance(node, Regex):
        test = some(lambda x: _regex(node, x))
    elif isinstance(node, In):
        test = some(lambda x: x.isin(*node.values)) if node.values else F.lit(False)
    elif isinstance(node, Elem):

        def all_parts(x: Column) -> Column:
            out = _element(node.parts[0], x)
            for p in node.parts[1:]:
                out = out & _element(p, x)
            return out

        test = F.exists(col, all_parts)
    else:
        raise TypeError(f"not a predicate: {node!r}")
    if not negate:
        return test
    # What a missing value doesn't satisfy, its negation does; an array may also hold missing elements.
    return ~F.coalesce(test, F.lit(False)) if f.array else col.isNull() | ~test


def holds(node: Node) -> Column:
    """The same as a value that is never null."""
    return F.coalesce(compile_filter(node), F.lit(False))


def resolve(node: Node, entries: DataFrame) -> Node | None:
    """The tree with the mtimes of the entries it refers to; None if one of them doesn't exist."""
    if isinstance(node, Get):
        row = entries.where(F.col("path") == node.path).select("mtime_sec").limit(1).collect()
        return Cmp(node.op, node.field, row[0][0]) if row and row[0][0] is not None else None
    if isinstance(node, (And, Or)):
        parts = [resolve(p, entries) for p in node.parts]
        return None if any(p is None for p in parts) else type(node)(tuple(parts))
    if isinstance(node, Not):
        part = resolve(node.part, entries)
        return None if part is None else Not(part)
    return node


def fields_of(node: Node) -> dict[str, str | None]:
    """The fields a tree refers to, with the SQL types of what they are compared with."""
    if isinstance(node, (And, Or)):
        return {k: v for p in node.parts for k, v in fields_of(p).items()}
    if isinstance(node, Not):
        return fields_of(node.part)
    if isinstance(node, (Always, Get)):
        return {}
    value = node.value if isinstance(node, Cmp) else (node.values or (None,))[0] if isinstance(node, In) else 0 if isinstance(node, Bits) else None
    kind = next((t for c, t in ((bool, "boolean"), (int, "bigint"), (float, "double"), (bytes, "binary")) if isinstance(value, c)), None)
    return {node.field: kind}


def with_fields(entries: DataFrame, node: Node) -> DataFrame:
    """The entries with the attributes of maps that a tree refers to as columns."""
    return promote(entries, fields_of(node))
