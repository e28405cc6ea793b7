"""Fields of an entry and the columns that hold them.

An entry view has fixed statx columns and a column for each extended attribute
that predicates use. Time stamps are seconds and nanoseconds, never collapsed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.patterns import UsageError

STATX = ["type", "mode", "nlink", "uid", "gid", "blksize", "ino", "size", "blocks", "mnt_id"]
TIMES = ["atime", "btime", "ctime", "mtime"]
DEVICES = ["dev_major", "dev_minor", "rdev_major", "rdev_minor"]
ATTRIBUTES = ["compressed", "immutable", "append", "nodump", "encrypted", "automount", "mount-root", "verity", "dax"]

#: Extended attributes that are arrays: comparisons hold if they hold for some element.
ARRAYS = {"ost", "begin", "end", "pool", "comp_flags", "stripe_count", "stripe_size", "pattern", "extension_size", "child_mdt_idx", "acl_users", "acl_groups", "acl_default_users", "acl_default_groups", "low_cat", "high_cat"}

ENTRIES = T.StructType(
    [T.StructField("id", T.BinaryType(), False), T.StructField("type", T.IntegerType()), T.StructField("mode", T.IntegerType())]
    + [T.StructField(c, T.LongType()) for c in STATX[2:]]
    + [f for t in TIMES for f in (T.StructField(f"{t}_sec", T.LongType()), T.StructField(f"{t}_nsec", T.IntegerType()))]
    + [T.StructField(c, T.LongType()) for c in DEVICES]
    + [T.StructField("symlink", T.StringType()), T.StructField("xattrs", T.MapType(T.StringType(), T.StringType()))]
)
LINKS = T.StructType(
    [T.StructField("id", T.BinaryType(), False), T.StructField("parent_id", T.BinaryType()), T.StructField("name", T.StringType()), T.StructField("path", T.StringType()), T.StructField("sync_time", T.LongType()), T.StructField("rm_time", T.LongType())]
)


#: Types of attributes, where they aren't plain texts; those of maps are read as these.
ATTRIBUTE_TYPES = (
    dict.fromkeys(["expiration_date", "hsm_state", "hsm_archive_id", "project_id", "magic", "gen", "flags", "mirror_count", "mirror_state", "comp_count", "mdt_count", "mdt_index", "mdt_hash", "mdt_hash_flags", "nb_children", "sparseness", "acl_group", "high_sens", "rm_time", "sync_time"], "bigint")
    | dict.fromkeys(["ost", "begin", "end", "comp_flags", "stripe_count", "stripe_size", "pattern", "extension_size", "child_mdt_idx"], "array<bigint>")
    | dict.fromkeys(["acl_users", "acl_groups", "acl_default_users", "acl_default_groups"], "array<struct<id:bigint,p:bigint>>")
    | dict.fromkeys(["low_cat", "high_cat"], "array<struct<f:bigint,l:bigint>>")
    | {"pool": "array<string>", "fid": "binary", "parent_fid": "binary"}
    | dict.fromkeys(["path", "bucket", "user_tag", "expires", "selinux_user", "selinux_role", "selinux_type", "selinux_range"], "string")
)


@dataclass(frozen=True)
class Field:
    """A field name and its column; `array` columns compare element by element. Attributes may also be `key` of a map."""

    name: str
    column: str
    array: bool = False
    scope: str | None = None
    key: str | None = None


def field(name: str) -> Field:
    """The field of `id`, `name`, `parent-id`, `symlink`, `statx[.x]`, `ns-xattrs[.k]` or `xattrs[.k]`."""
    if name in ("id", "name", "symlink"):
        return Field(name, name)
    if name == "parent-id":
        return Field(name, "parent_id")
    head, _, key = name.partition(".")
    if head == "statx" and key:
        base, _, part = key.partition(".")
        if base in STATX:
            return Field(name, base)
        if base in TIMES and part in ("", "sec", "nsec"):
            return Field(name, f"{base}_{part or 'sec'}")
        if key.replace(".", "_") in DEVICES:
            return Field(name, key.replace(".", "_"))
        if base == "attributes" and part in ATTRIBUTES:
            return Field(name, "attr_" + part.replace("-", "_"))
    elif head in ("ns-xattrs", "xattrs") and key:
        column = key.split(".")[-1] if key.startswith("trusted.") else key.replace(".", "_")
        return Field(name, column, column in ARRAYS, head.replace("-", "_"), key)
    raise UsageError(f"unknown field: {name!r}")


def promote(entries: DataFrame, wanted: dict[str, str | None]) -> DataFrame:
    """The entries with a column for each wanted attribute (name: type) that they only have in a map of JSON texts.

    A text that doesn't fit the type counts as missing. What isn't wanted is never
    decoded; plain columns stay as they are, so comparisons with them reach the scan.
    """
    have = set(entries.columns)
    made = {}
    for name, kind in wanted.items():
        f = field(name)
        if f.scope is None or f.column in have or f.scope not in have:
            continue
        keys = [f.key, f.column] if f.key != f.column else [f.key]
        text = F.coalesce(*[F.try_element_at(F.col(f.scope), F.lit(k)) for k in keys])
        made[f.column] = decoded(text, ATTRIBUTE_TYPES.get(f.column) or kind or "string")
    return entries.withColumns(made) if made else entries


def decoded(text: Column, kind: str) -> Column:
    """The value of a JSON text; null where it doesn't fit."""
    if kind.startswith("array"):
        return F.from_json(text, kind)
    plain = F.when(text.startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")).otherwise(text)
    if kind == "string":
        return plain
    if kind == "binary":
        return F.try_to_binary(plain, F.lit("hex"))
    return plain.try_cast(kind)
