"""Directives of -printf and rows of -ls as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import TYPES, UsageError

ESCAPES = {"a": "\a", "b": "\b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "0": "\0", "\\": "\\"}


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def depth() -> Column:
    p = F.col("path")
    return F.when(p == "/", 0).otherwise(F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))))


def type_letter() -> Column:
    out = F.lit("U")
    for letter, bits in TYPES.items():
        out = F.when(F.col("type") == bits, F.lit("-" if letter == "f" else letter)).otherwise(out)
    return out


def find_letter() -> Column:
    return F.when(F.col("type") == TYPES["f"], F.lit("f")).otherwise(type_letter())


def symbolic_mode() -> Column:
    """drwxr-xr-x with set-id and sticky letters."""
    mode = F.col("mode")
    parts = [type_letter()]
    for k, (special, letter) in zip((6, 3, 0), ((0o4000, "s"), (0o2000, "s"), (0o1000, "t"))):
        has = lambda b, k=k: mode.bitwiseAND(b << k) != 0
        special_set = mode.bitwiseAND(special) != 0
        parts += [F.when(has(4), "r").otherwise("-"), F.when(has(2), "w").otherwise("-"), F.when(special_set & has(1), letter).when(special_set, letter.upper()).when(has(1), "x").otherwise("-")]
    return F.concat(*parts)


def octal_mode() -> Column:
    return F.lower(F.conv(F.col("mode").bitwiseAND(0o777).cast("string"), 10, 8))


def dirname() -> Column:
    return F.regexp_replace(F.col("path"), r"^(.*)/[^/]*$", "$1")


def below_start(start: str = "/") -> Column:
    """The path without the start point."""
    return F.ltrim(F.substring(F.col("path"), len(start.rstrip("/")) + 1, 1 << 30), F.lit("/"))


def time_text(name: str) -> Column:
    return clock(F.col(f"{name}_sec"))


def clock(seconds: Column) -> Column:
    """`Thu Nov  1 00:00:00 2001`, the day padded with a space."""
    at = F.timestamp_seconds(seconds)
    return F.concat(F.date_format(at, "EEE MMM "), F.lpad(F.date_format(at, "d"), 2, " "), F.date_format(at, " HH:mm:ss yyyy"))


def device() -> Column:
    return F.shiftleft(F.col("dev_major"), 8).bitwiseOR(F.col("dev_minor"))


def acl_text(array: str) -> Column:
    def entry(x: Column) -> Column:
        flags = [F.when(x["p"].bitwiseAND(b) != 0, c).otherwise("-") for b, c in ((4, "r"), (2, "w"), (1, "x"))]
        return F.concat(x["id"].cast("string"), F.lit(":"), *flags)

    return F.array_join(F.transform(F.col(array), entry), ",")


def flag_names(col: Column, table: dict[str, int]) -> Column:
    """Names of the bits that are set, joined by |; other bits read unknown."""
    known = 0
    for bit in table.values():
        known |= bit
    rest = F.when(col.bitwiseAND(~known) != 0, F.lit("unknown"))
    return F.when(col.isNull(), F.lit("None")).otherwise(F.concat_ws("|", *[F.when(col.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in table.items()], rest))


def names_of(col: Column, table: dict[str, int]) -> Column:
    """The name of a value."""
    out = F.when(col.isNull(), F.lit("None"))
    for name, value in table.items():
        if value is not None:
            out = out.when(col == value, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def fid_text(col: Column) -> Column:
    """[0xSEQ:0xOID:0xVER] of 16 little-endian bytes."""
    digits = F.lower(F.hex(col))

    def part(start: int, size: int) -> Column:
        text = F.concat(*[F.substring(digits, 2 * (start + size - 1 - k) + 1, 2) for k in range(size)])
        bare = F.ltrim(text, F.lit("0"))
        return F.concat(F.lit("0x"), F.when(bare == "", F.lit("0")).otherwise(bare))

    return F.concat(F.lit("["), part(0, 8), F.lit(":"), part(8, 4), F.lit(":"), part(12, 4), F.lit("]"))


def each(array: str, show) -> Column:
    """[a, b] of shown elements."""
    return F.concat(F.lit("["), F.array_join(F.transform(F.col(array), show), ", "), F.lit("]"))


def target_count() -> Column:
    """Storage targets of a file, or metadata targets of a directory."""
    ost = F.col("ost")
    used = F.size(F.filter(ost, lambda x: x != -1))
    return F.when(F.col("type") == TYPES["d"], F.col("mdt_count")).otherwise(F.when(F.size(ost) > 0, used).cast("long"))


def listed(array: str) -> Column:
    return F.concat(F.lit("["), F.array_join(F.transform(F.col(array), lambda x: x.cast("string")), ", "), F.lit("]"))


def _xattr(name: str) -> Column:
    return _text(F.col(name))


#: directive: Column, made when used so that only its columns are read.
DIRECTIVES = {
    "a": lambda: time_text("atime"), "A": lambda: F.col("atime_sec"), "b": lambda: F.col("blocks"), "c": lambda: time_text("ctime"), "d": depth, "D": device, "f": lambda: F.col("name"),
    "g": lambda: F.coalesce(F.col("group_name"), F.col("gid").cast("string")), "G": lambda: F.col("gid"), "h": dirname, "H": lambda: F.col("uri"), "i": lambda: F.col("ino"), "I": lambda: F.base64(F.col("id").cast("string").cast("binary")),
    "l": lambda: F.col("symlink"), "m": octal_mode, "M": symbolic_mode, "n": lambda: F.col("nlink"), "p": lambda: F.col("path"), "P": below_start,
    "s": lambda: F.col("size"), "t": lambda: time_text("mtime"), "T": lambda: F.col("mtime_sec"), "u": lambda: F.coalesce(F.col("user_name"), F.col("uid").cast("string")), "U": lambda: F.col("uid"), "y": find_letter,
    "RLb": lambda: listed("begin"), "RLc": lambda: each("comp_flags", lambda x: F.when(x == 0, F.lit("0")).otherwise(flag_names(x, _table("COMP_FLAGS")))), "RLC": target_count, "RLd": lambda: F.when(F.col("mdt_hash_flags") != 0, flag_names(F.col("mdt_hash_flags"), HASH_FLAGS)),
    "RLD": lambda: names_of(F.col("mdt_hash"), _table("HASH_TYPES")), "RLe": lambda: listed("extension_size"), "RLE": lambda: listed("end"), "RLf": lambda: fid_text(F.col("fid")), "RLF": lambda: fid_text(F.col("parent_fid")), "RLg": lambda: _xattr("flags"),
    "RLh": lambda: _xattr("hsm_archive_id"), "RLH": lambda: F.when(F.col("hsm_state") != 0, flag_names(F.col("hsm_state"), _table("HSM_STATES"))), "RLi": lambda: _xattr("mdt_index"), "RLm": lambda: F.when(F.col("mirror_state") != 0, names_of(F.col("mirror_state"), _table("MIRROR_STATES"))),
    "RLM": lambda: _xattr("mirror_count"), "RLn": lambda: _xattr("gen"), "RLN": lambda: _xattr("magic"), "RLo": lambda: listed("ost"), "RLp": lambda: _xattr("project_id"), "RLP": lambda: listed("pool"), "RLs": lambda: listed("stripe_size"), "RLS": lambda: listed("stripe_count"),
    "RLt": lambda: each("pattern", lambda x: F.when(x == 0, F.lit("raid0")).otherwise(flag_names(x, LAYOUTS))), "RLT": lambda: _xattr("comp_count"), "RLX": lambda: listed("child_mdt_idx"),
    "RAa": lambda: acl_text("acl_users"), "RAd": lambda: acl_text("acl_default_users"),
    "RZc": lambda: F.concat_ws(":", "selinux_user", "selinux_role", "selinux_type", "selinux_range"), "RZu": lambda: _xattr("selinux_user"), "RZr": lambda: _xattr("selinux_role"), "RZt": lambda: _xattr("selinux_type"), "RZR": lambda: _xattr("selinux_range"),
    "RRe": lambda: _xattr("expires"), "RRE": lambda: F.when(F.col("expiration_date") == (1 << 63) - 1, "Inf").otherwise(clock(F.col("expiration_date"))),
    "RSS": lambda: _xattr("sparseness"), "R3b": lambda: _xattr("bucket"), "R3p": lambda: F.col("path"), "R3s": lambda: F.col("size"), "R3t": lambda: time_text("mtime"), "R3T": lambda: F.col("mtime_sec"),
}


#: Flags of directory hashes and of layouts.
HASH_FLAGS = {"fixed": 0x00080000, "merge": 0x04000000, "split": 0x08000000, "lost_lmv": 0x10000000, "bad_type": 0x20000000, "migration": 0x80000000}
LAYOUTS = {"raid0": 0x1, "mdt": 0x100, "overstriped": 0x200, "released": 0x80000000}


def _table(name: str) -> dict[str, int]:
    from ..plans import predicates

    return getattr(predicates, name)


def pieces(template: str) -> list[tuple[bool, str]]:
    """(is a directive, text) for each piece of a template."""
    out, i = [], 0
    while i < len(template):
        c = template[i]
        if c == "\\":
            if i + 1 == len(template) or template[i + 1] not in ESCAPES:
                raise UsageError(f"unknown escape in {template!r}")
            out.append((False, ESCAPES[template[i + 1]]))
            i += 2
        elif c == "%":
            if template[i + 1 : i + 2] == "%":
                out.append((False, "%"))
                i += 2
                continue
            n = 3 if template[i + 1 : i + 2] == "R" else 1
            name = template[i + 1 : i + 1 + n]
            if name not in DIRECTIVES:
                raise UsageError(f"unknown directive: %{name}")
            out.append((True, name))
            i += 1 + n
        else:
            out.append((False, c))
            i += 1
    return out


def printf(template: str, start: str = "/") -> Column:
    """A template as a string Column; missing values read None. `start`: where the search began."""
    parts, text = [], ""
    for directive, value in pieces(template):
        if not directive:
            text += value
            continue
        if text:
            parts.append(F.lit(text))
            text = ""
        parts.append(_text(below_start(start) if value == "P" else DIRECTIVES[value]()))
    if text or not parts:
        parts.append(F.lit(text))
    return F.concat(*parts)


def ls_line() -> Column:
    """inode, blocks in KiB, mode, links, owner, group, size, date and path."""
    target = F.when(F.col("symlink").isNotNull(), F.concat(F.lit(" -> "), F.col("symlink"))).otherwise("")
    return F.concat(
        F.format_string("%9d %6d %s %3d %-8s %-8s %8d ", F.coalesce("ino", F.lit(0)), F.floor(F.coalesce("blocks", F.lit(0)) / 2), symbolic_mode(), F.coalesce("nlink", F.lit(0)), F.col("uid").cast("string"), F.col("gid").cast("string"), F.coalesce("size", F.lit(0))),
        F.date_format(F.timestamp_seconds("mtime_sec"), "MMM dd yyyy HH:mm"), F.lit(" "), F.col("path"), target,
    )
