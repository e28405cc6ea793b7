"""Leaf predicates of the find language, by token.

Each builder takes the context (now, user and group tables) and its arguments
and returns a predicate tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field as dc_field

from ..functions.patterns import TYPES, UsageError, glob_regex, parse_fid, parse_mode, sign, size_unit, whole
from .ast import Always, And, Bits, Cmp, Elem, Exists, Get, In, Node, Not, Or, Regex

INT64_MAX = (1 << 63) - 1
#: Flags of archived files, and of layout components.
HSM_STATES = {"exists": 0x1, "dirty": 0x2, "released": 0x4, "archived": 0x8, "norelease": 0x10, "noarchive": 0x20, "lost": 0x40}
COMP_FLAGS = {"stale": 0x1, "prefrd": 0x2, "prefwr": 0x4, "offline": 0x8, "init": 0x10, "nosync": 0x20, "extension": 0x40, "parity": 0x80, "compress": 0x100, "partial": 0x200, "nocompr": 0x400, "neg": 0x80000000}
HASH_TYPES = {"all_char": 1, "fnv_1a_64": 2, "crush": 3, "crush2": 4}
MIRROR_STATES = {"ro": 1, "wp": 2, "sp": 3}
LAYOUT_PATTERNS = {"raid0": 1, "mdt": 0x100, "overstriped": 0x200, "compress": 0x400, "default": None}


@dataclass
class Context:
    """What predicates need from outside: one clock for the whole query, names of users and groups, the root's default layout."""

    now: int = 0
    users: dict[str, int] = dc_field(default_factory=dict)
    groups: dict[str, int] = dc_field(default_factory=dict)
    memberships: dict[int, tuple[int, ...]] = dc_field(default_factory=dict)
    defaults: dict[str, int] = dc_field(default_factory=dict)
    acls: bool = False


def number(name: str) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        s, rest = sign(arg)
        return Cmp({"+": ">", "-": "<", "": "="}[s], name, whole(rest))

    return build


def age(name: str, unit: int) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        s, rest = sign(arg)
        then = ctx.now - whole(rest) * unit
        if s == "-":
            return Cmp(">", name, then)
        if s == "+":
            return Cmp("<", name, then)
        return And((Cmp(">", name, then - unit), Cmp("<", name, then)))

    return build


def size_test(name: str) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        s, rest = sign(arg)
        n, unit = size_unit(rest)
        if s == "+":
            return Cmp(">", name, n * unit)
        if s == "-":
            return Cmp("<=", name, max(n - 1, 0) * unit)
        return And((Cmp(">", name, max(n - 1, 0) * unit), Cmp("<", name, n * unit + 1 if n else unit + 1)))

    return build


def glob(name: str, insensitive: bool = False) -> Callable:
    return lambda ctx, arg: Regex(name, glob_regex(arg), insensitive)


def regex(name: str, insensitive: bool = False) -> Callable:
    return lambda ctx, arg: Regex(name, arg, insensitive)


def file_type(ctx: Context, arg: str) -> Node:
    if arg not in TYPES:
        raise UsageError(f"unknown file type: {arg!r}")
    return Cmp("=", "statx.type", TYPES[arg])


def link_name(insensitive: bool) -> Callable:
    return lambda ctx, arg: And((Cmp("=", "statx.type", TYPES["l"]), Regex("symlink", glob_regex(arg), insensitive)))


def owner(name: str, table: str) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        known = getattr(ctx, table)
        if arg not in known:
            raise UsageError(f"no such {table[:-1]}: {arg!r}")
        return Cmp("=", name, known[arg])

    return build


def unowned(name: str, table: str) -> Callable:
    def build(ctx: Context) -> Node:
        return Not(In(name, tuple(sorted(set(getattr(ctx, table).values())))))

    return build


def newer(name: str) -> Callable:
    return lambda ctx, arg: Get(">", name, arg)


def perm(ctx: Context, arg: str) -> Node:
    if arg[:1] == "/":
        mask = parse_mode(arg[1:])
        return Bits("any_set", "statx.mode", mask) if mask else Bits("all_set", "statx.mode", 0)
    if arg[:1] == "-":
        return Bits("all_set", "statx.mode", parse_mode(arg[1:]))
    return Cmp("=", "statx.mode", parse_mode(arg))


def _user(ctx: Context, arg: str) -> tuple[int, tuple[int, ...]]:
    m = re.fullmatch(r"(\d+):(\d+(?:,\d+)*)", arg)
    if m:
        return int(m[1]), tuple(map(int, m[2].split(",")))
    if arg not in ctx.users:
        raise UsageError(f"no such user: {arg!r}")
    uid = ctx.users[arg]
    return uid, ctx.memberships.get(uid, ())


def access(bit: int) -> Callable:
    """bit: 4 read, 2 write, 1 execute."""

    def build(ctx: Context, arg: str) -> Node:
        uid, gids = _user(ctx, arg)
        owns, other, group = (Bits("any_set", "statx.mode", bit << k) for k in (6, 0, 3))
        is_owner = Cmp("=", "statx.uid", uid)
        in_group = In("statx.gid", gids)
        if not ctx.acls:
            # Without ACLs only the primary group counts, the first of a user's groups.
            return Or((And((owns, is_owner)), other, *(And((group, Cmp("=", "statx.gid", g))) for g in gids[:1])))
        named_user = Elem("xattrs.acl_users", (("=", "id", uid),))
        user_can = Elem("xattrs.acl_users", (("=", "id", uid), ("all_set", "p", bit)))
        named_group = Or(tuple(Elem("xattrs.acl_groups", (("=", "id", g),)) for g in gids)) if gids else Not(Always())
        group_can = Or(tuple(Elem("xattrs.acl_groups", (("=", "id", g), ("all_set", "p", bit))) for g in gids)) if gids else Not(Always())
        owner_group_can = And((in_group, Or((Bits("all_set", "xattrs.acl_group", bit), And((Exists("xattrs.acl_group", False), group))))))
        return Or((
            And((is_owner, owns)),
            And((~is_owner, user_can, group)),
            And((~is_owner, ~named_user, Or((owner_group_can, group_can)), group)),
            And((~is_owner, ~named_user, ~Or((in_group, named_group)), other)),
        ))

    return build


def empty(ctx: Context) -> Node:
    return Or((And((Cmp("=", "statx.size", 0), Cmp("=", "statx.type", TYPES["f"]))), And((Cmp("=", "statx.type", TYPES["d"]), Cmp("=", "xattrs.nb_children", 0)))))


def layout_size(name: str, default: str, parse: Callable) -> Callable:
    """A layout property, or the file system's default for directories without a layout of their own."""

    def build(ctx: Context, arg: str) -> Node:
        bare = And((Cmp("=", "statx.type", TYPES["d"]), Exists(f"xattrs.{name}", False)))
        if arg == "default":
            return bare
        test = parse(f"xattrs.{name}")(ctx, arg)
        value = ctx.defaults.get(default)
        if value is None:
            return test
        fits = evaluate(test, value)
        return Or((test, bare)) if fits else And((test, Not(bare)))

    return build


def evaluate(node: Node, value: int) -> bool:
    """Whether a single number satisfies comparisons of one field."""
    if isinstance(node, And):
        return all(evaluate(p, value) for p in node.parts)
    return {"=": value == node.value, "<": value < node.value, ">": value > node.value, "<=": value <= node.value, ">=": value >= node.value}[node.op]


def comp_bound(name: str, is_end: bool) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        if "," in arg:
            low, high = (a * u for a, u in map(size_unit, arg.split(",", 1)))
            return Elem(name, ((">", None, low), ("<", None, high)))
        s, rest = sign(arg)
        n, unit = size_unit(rest)
        if s == "-":
            return Elem(name, ((">", None, 0), ("<=", None, n * unit))) if is_end else Elem(name, (("<=", None, n * unit),))
        return Elem(name, ((">" if s == "+" else "=", None, n * unit),))

    return build


def flag_test(name: str, table: dict[str, int]) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        mask = 0
        for word in arg.split(","):
            if word not in table:
                raise UsageError(f"unknown flag: {word!r}")
            mask |= table[word]
        return Bits("any_set", name, mask)

    return build


def hsm_state(ctx: Context, arg: str) -> Node:
    if arg == "none":
        return And((Cmp("=", "statx.type", TYPES["f"]), Exists("xattrs.hsm_state", False)))
    return flag_test("xattrs.hsm_state", HSM_STATES)(ctx, arg)


def choice(name: str, table: dict[str, int]) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        if arg not in table:
            raise UsageError(f"unknown value: {arg!r}")
        return Cmp("=", name, table[arg])

    return build


def exact(name: str) -> Callable:
    return lambda ctx, arg: Cmp("=", name, whole(arg))


def equal_text(name: str) -> Callable:
    return lambda ctx, arg: Cmp("=", name, arg)


def acl_entry(name: str) -> Callable:
    def build(ctx: Context, arg: str) -> Node:
        m = re.fullmatch(r"(\d+)(?::([rwx-]*|[0-7]))?", arg)
        if not m:
            raise UsageError(f"invalid ACL entry: {arg!r}")
        parts = [("=", "id", int(m[1]))]
        if m[2]:
            bits = int(m[2]) if m[2].isdigit() else sum({"r": 4, "w": 2, "x": 1}[c] for c in set(m[2]) - {"-"})
            parts.append(("all_set", "p", bits))
        return Elem(name, tuple(parts))

    return build


def selinux_context(ctx: Context, arg: str) -> Node:
    parts = arg.split(":", 3)
    if len(parts) < 3:
        raise UsageError(f"invalid security context: {arg!r}")
    return And(tuple(Cmp("=", f"xattrs.selinux_{k}", v) for k, v in zip(("user", "role", "type", "range"), parts)))


def parse_level(text: str) -> tuple[int, list[tuple[int, int]]]:
    """Sensitivity and category intervals of `sN[:cA,cB.cC]`."""
    m = re.fullmatch(r"s(\d+)(?::(c\d+(?:\.c\d+)?(?:,c\d+(?:\.c\d+)?)*))?", text)
    if not m:
        raise UsageError(f"invalid level: {text!r}")
    cats = []
    for part in (m[2] or "").split(",") if m[2] else []:
        ends = [int(c[1:]) for c in part.split(".")]
        if ends[0] > ends[-1]:
            raise UsageError(f"invalid category range: {part!r}")
        cats.append((ends[0], ends[-1]))
    return int(m[1]), cats


def covers(low: int, high: int) -> Node:
    return Elem("xattrs.high_cat", (("<=", "f", low), (">=", "l", high)))


def dominates(ctx: Context, arg: str) -> Node:
    sens, cats = parse_level(arg)
    return And((Cmp(">=", "xattrs.high_sens", sens), *(covers(a, b) for a, b in cats)))


def has_category(ctx: Context, arg: str) -> Node:
    m = re.fullmatch(r"c?(\d+)", arg)
    if not m:
        raise UsageError(f"invalid category: {arg!r}")
    return covers(int(m[1]), int(m[1]))


_EXPIRY = "xattrs.trusted.expiration_date"


def expired(ctx: Context) -> Node:
    return Cmp("<=", _EXPIRY, ctx.now)


def expired_at(ctx: Context, arg: str) -> Node:
    if arg == "inf":
        return Cmp("=", _EXPIRY, INT64_MAX)
    s, rest = sign(arg)
    return And((Cmp({"+": ">", "-": "<", "": "<="}[s], _EXPIRY, whole(rest)), Cmp("<", _EXPIRY, INT64_MAX)))


#: token: (number of arguments, builder)
PREDICATES: dict[str, tuple[int, Callable]] = {
    **{f"-{t[0]}min": (1, age(f"statx.{t}", 60)) for t in ("atime", "btime", "ctime", "mtime")},
    **{f"-{t}": (1, age(f"statx.{t}", 86_400)) for t in ("atime", "btime", "ctime", "mtime")},
    "-blocks": (1, number("statx.blocks")), "-gid": (1, number("statx.gid")), "-inum": (1, number("statx.ino")), "-links": (1, number("statx.nlink")), "-uid": (1, number("statx.uid")),
    "-size": (1, size_test("statx.size")),
    "-name": (1, glob("name")), "-iname": (1, glob("name", True)), "-path": (1, glob("ns-xattrs.path")), "-ipath": (1, glob("ns-xattrs.path", True)),
    "-regex": (1, regex("ns-xattrs.path")), "-iregex": (1, regex("ns-xattrs.path", True)),
    "-lname": (1, link_name(False)), "-ilname": (1, link_name(True)),
    "-type": (1, file_type), "-user": (1, owner("statx.uid", "users")), "-group": (1, owner("statx.gid", "groups")),
    "-nouser": (0, unowned("statx.uid", "users")), "-nogroup": (0, unowned("statx.gid", "groups")),
    "-newer": (1, newer("statx.mtime")), "-anewer": (1, newer("statx.atime")), "-cnewer": (1, newer("statx.ctime")),
    "-perm": (1, perm), "-readable": (1, access(4)), "-writable": (1, access(2)), "-executable": (1, access(1)),
    "-empty": (0, empty), "-xattr": (1, lambda ctx, arg: Exists(f"xattrs.{arg}")), "-dircount": (1, number("xattrs.nb_children")),
    "-comp-count": (1, number("xattrs.comp_count")), "-mdt-count": (1, number("xattrs.mdt_count")), "-mirror-count": (1, number("xattrs.mirror_count")),
    "-comp-start": (1, comp_bound("xattrs.begin", False)), "-comp-end": (1, comp_bound("xattrs.end", True)), "-comp-flags": (1, flag_test("xattrs.comp_flags", COMP_FLAGS)),
    "-extension-size": (1, size_test("xattrs.extension_size")), "-composite": (0, lambda ctx: Exists("xattrs.mirror_count")),
    "-fid": (1, lambda ctx, arg: Cmp("=", "xattrs.fid", parse_fid(arg))), "-hash-type": (1, choice("xattrs.mdt_hash", HASH_TYPES)), "-hsm-state": (1, hsm_state),
    "-layout-pattern": (1, layout_size("pattern", "pattern", lambda f: choice(f, LAYOUT_PATTERNS))), "-stripe-count": (1, layout_size("stripe_count", "stripe_count", number)),
    "-stripe-size": (1, layout_size("stripe_size", "stripe_size", size_test)), "-mdt-index": (1, exact("xattrs.mdt_index")), "-project-id": (1, exact("xattrs.project_id")),
    "-mirror-state": (1, choice("xattrs.mirror_state", MIRROR_STATES)), "-ost": (1, lambda ctx, arg: In("xattrs.ost", (whole(arg),))),
    "-pool": (1, glob("xattrs.pool")), "-ipool": (1, glob("xattrs.pool", True)),
    "-acl-user": (1, acl_entry("xattrs.acl_users")), "-acl-group": (1, acl_entry("xattrs.acl_groups")), "-acl-default-user": (1, acl_entry("xattrs.acl_default_users")), "-acl-default-group": (1, acl_entry("xattrs.acl_default_groups")),
    "-selinux-context": (1, selinux_context), "-selinux-user": (1, equal_text("xattrs.selinux_user")), "-selinux-role": (1, equal_text("xattrs.selinux_role")), "-selinux-type": (1, equal_text("xattrs.selinux_type")), "-selinux-range": (1, equal_text("xattrs.selinux_range")),
    "-selinux-range-dominates": (1, dominates), "-selinux-has-cat": (1, has_category),
    "-expired": (0, expired), "-expired-at": (1, expired_at), "-sparse": (0, lambda ctx: Cmp("<", "xattrs.sparseness", 100)),
    "-bucket": (1, regex("xattrs.bucket")),
}
#: Known to other find programs, not to this one.
UNSUPPORTED = ["-true", "-false", "-fstype", "-xtype", "-iwholename", "-wholename", "-used", "-context"]
