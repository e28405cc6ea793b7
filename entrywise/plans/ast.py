"""Immutable predicate trees."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


class Node:
    """A predicate over an entry."""

    def __and__(self, other: "Node") -> "Node":
        return And((self, other))

    def __or__(self, other: "Node") -> "Node":
        return Or((self, other))

    def __invert__(self) -> "Node":
        return Not(self)


@dataclass(frozen=True)
class Always(Node):
    """Matches every entry."""


@dataclass(frozen=True)
class Cmp(Node):
    """field op value, op one of = < <= > >=."""

    op: str
    field: str
    value: Any


@dataclass(frozen=True)
class In(Node):
    field: str
    values: tuple


@dataclass(frozen=True)
class Regex(Node):
    field: str
    pattern: str
    insensitive: bool = False


@dataclass(frozen=True)
class Exists(Node):
    field: str
    present: bool = True


@dataclass(frozen=True)
class Bits(Node):
    """Mask test, op one of any_set all_set any_clear all_clear."""

    op: str
    field: str
    mask: int


@dataclass(frozen=True)
class Elem(Node):
    """Some element of an array satisfies all parts: (op, member or None, value)."""

    field: str
    parts: tuple


@dataclass(frozen=True)
class Get(Node):
    """field op mtime of the entry at path; resolved before compiling."""

    op: str
    field: str
    path: str


@dataclass(frozen=True)
class And(Node):
    parts: tuple


@dataclass(frozen=True)
class Or(Node):
    parts: tuple


@dataclass(frozen=True)
class Not(Node):
    part: Node


def walk(node: Node):
    """The node and everything below it."""
    yield node
    if isinstance(node, (And, Or)):
        for p in node.parts:
            yield from walk(p)
    elif isinstance(node, Not):
        yield from walk(node.part)


def fields(node: Node) -> set[str]:
    return {n.field for n in walk(node) if hasattr(n, "field")}
