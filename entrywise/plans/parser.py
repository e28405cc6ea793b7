"""The find expression language: options, predicates, operators and actions.

Grammar: `( ) ! -not -a -and -o -or`, with an implicit AND. An action on the
right of an OR sees NOT(left) AND right, so no entry is acted on twice.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions.patterns import UsageError
from .ast import Always, And, Node, Not, Or
from .predicates import PREDICATES, UNSUPPORTED, Context

#: token: number of arguments
ACTIONS = {"-print": 0, "-print0": 0, "-printf": 1, "-ls": 0, "-count": 0, "-delete": 0, "-quit": 0, "-exec": -1, "-checked-exec": -1, "-fprint": 1, "-fprint0": 1, "-fls": 1, "-fprintf": 2}
REFUSED = ["-execdir", "-ok", "-okdir", "-prune"]
#: Names that -sort and -rsort accept, and their columns.
SORT_COLUMNS = {
    "atime": "atime_sec", "blocks": "blocks", "btime": "btime_sec", "ctime": "ctime_sec", "gid": "gid", "ino": "ino", "mode": "mode", "mtime": "mtime_sec",
    "name": "name", "nlink": "nlink", "size": "size", "type": "type", "uid": "uid", "expiration-date": "expiration_date",
}


@dataclass(frozen=True)
class Action:
    name: str
    args: tuple[str, ...]
    filter: Node


@dataclass
class Query:
    """A parsed command line."""

    filter: Node = Always()
    actions: list[Action] = field(default_factory=list)
    sort: list[tuple[str, bool]] = field(default_factory=list)
    limit: int | None = None
    skip: int = 0
    one: bool = False


class Parser:
    def __init__(self, args: list[str], ctx: Context):
        self.args, self.at, self.ctx, self.query = args, 0, ctx, Query()

    def parse(self) -> Query:
        node, _ = self._either(Always(), False)
        if self.at < len(self.args):
            raise UsageError(f"unexpected {self.args[self.at]!r}")
        self.query.filter = node
        if not self.query.actions:
            self.query.actions.append(Action("-print", (), node))
        return self.query

    def _peek(self) -> str | None:
        return self.args[self.at] if self.at < len(self.args) else None

    def _take(self, n: int, token: str) -> tuple[str, ...]:
        got = tuple(self.args[self.at : self.at + n])
        if len(got) < n:
            raise UsageError(f"missing argument to {token}")
        self.at += n
        return got

    def _either(self, seen: Node, inside: bool) -> tuple[Node, bool]:
        """OR-list; `seen` is what already holds when its actions run."""
        node, any_ = self._all(seen)
        while self._peek() in ("-o", "-or"):
            if not any_:
                raise UsageError(f"{self._peek()} needs an expression before it")
            self.at += 1
            right, ok = self._all(_both(seen, Not(node)))
            if not ok:
                raise UsageError("-o needs an expression after it")
            node = Or((*node.parts, right)) if isinstance(node, Or) else Or((node, right))
        return node, any_

    def _all(self, seen: Node) -> tuple[Node, bool]:
        node: Node = Always()
        any_ = False
        while True:
            token = self._peek()
            if token is None or token in ("-o", "-or", ")"):
                return node, any_
            if token in ("-a", "-and"):
                if not any_:
                    raise UsageError(f"{token} needs an expression before it")
                self.at += 1
                if self._peek() in (None, "-a", "-and", "-o", "-or", ")"):
                    raise UsageError(f"{token} needs an expression after it")
                continue
            part = self._one(_both(seen, node))
            any_ = True
            if part is not None:
                node = _both(node, part)

    def _one(self, seen: Node) -> Node | None:
        token = self._take(1, "")[0]
        if token in ("!", "-not"):
            if self._peek() is None:
                raise UsageError(f"{token} needs an expression after it")
            part = self._one(seen)
            if part is None:
                raise UsageError(f"{token} can't negate an action or an option")
            return Not(part)
        if token == "(":
            if self._peek() == ")":
                raise UsageError("empty parentheses")
            node, _ = self._either(seen, True)
            if self._peek() != ")":
                raise UsageError("missing )")
            self.at += 1
            return node
        if token in PREDICATES:
            n, build = PREDICATES[token]
            return build(self.ctx, *self._take(n, token))
        if token in ("-sort", "-rsort"):
            (name,) = self._take(1, token)
            if name not in SORT_COLUMNS:
                raise UsageError(f"can't sort by {name!r}")
            self.query.sort.append((SORT_COLUMNS[name], token == "-sort"))
            return None
        if token in ("-limit", "-skip"):
            (n,) = self._take(1, token)
            if token == "-limit" and self.query.limit is not None:
                raise UsageError("-limit can be given once")
            if not n.isdigit():
                raise UsageError(f"invalid {token}: {n!r}")
            if token == "-limit":
                self.query.limit = int(n)
            else:
                self.query.skip = int(n)
            return None
        if token in ACTIONS:
            n = ACTIONS[token]
            if n < 0:
                end = self.args.index(";", self.at) if ";" in self.args[self.at :] else -1
                if end < 0:
                    raise UsageError(f"missing ; after {token}")
                given = self._take(end - self.at, token)
                self.at += 1
            else:
                given = self._take(n, token)
            self.query.actions.append(Action(token, given, seen))
            return None
        if token in REFUSED:
            raise UsageError(f"{token} is not supported")
        if token in UNSUPPORTED:
            raise UsageError(f"{token} is not implemented")
        raise UsageError(f"unknown predicate: {token!r}" if token.startswith("-") else f"{token!r} after the expression began")


def _both(a: Node, b: Node) -> Node:
    if isinstance(a, Always):
        return b
    if isinstance(b, Always):
        return a
    return And((*(a.parts if isinstance(a, And) else (a,)), *(b.parts if isinstance(b, And) else (b,))))


def parse(args: list[str], ctx: Context | None = None) -> Query:
    return Parser(list(args), ctx or Context()).parse()


def expand_aliases(args: list[str], aliases: dict[str, list[str]]) -> list[str]:
    """Replace `--alias NAME` by its arguments, again and again; a loop is an error."""

    def expand(rest: list[str], above: tuple[str, ...]) -> list[str]:
        out, i = [], 0
        while i < len(rest):
            if rest[i] != "--alias":
                out.append(rest[i])
                i += 1
                continue
            if i + 1 == len(rest):
                raise UsageError("missing name after --alias")
            for name in rest[i + 1].split(","):
                if name in above:
                    raise UsageError(f"alias loop: {' -> '.join((*above, name))}")
                if name not in aliases:
                    raise UsageError(f"no such alias: {name!r}")
                out += expand(list(aliases[name]), (*above, name))
            i += 2
        return out

    return expand(list(args), ())
