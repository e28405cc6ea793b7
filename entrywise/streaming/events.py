"""The table form of file-system events.

One row is one event; `seq` orders the events of an id. `statx` holds the
fields that an UPSERT sets. An XATTR row sets, unsets or increments one key;
`ns` says that the key belongs to the link (id, parent_id, name) and not to the
inode. Values are JSON texts, so every type of value keeps its type. `stamp`
and `final` belong to counters that a newer count replaces. `fill` names what
an event doesn't say itself and what has to be taken from the live file system:
`statx.<field>`, `symlink`, `xattrs.<key>`, `lustre`, `path`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TIMES = ["atime", "btime", "ctime", "mtime"]
ATTRIBUTES = ["compressed", "immutable", "append", "nodump", "encrypted", "automount", "mount_root", "verity", "dax"]
#: statx columns and their types
STATX: dict[str, str] = (
    {"type": "int", "mode": "int"}
    | dict.fromkeys(["nlink", "uid", "gid", "blksize", "ino", "size", "blocks", "mnt_id"], "long")
    | {f"{t}_{part}": kind for t in TIMES for part, kind in (("sec", "long"), ("nsec", "int"))}
    | dict.fromkeys(["dev_major", "dev_minor", "rdev_major", "rdev_minor"], "long")
    | {f"attr_{a}": "boolean" for a in ATTRIBUTES}
)
STATX_TYPE = "struct<" + ",".join(f"{c}:{t}" for c, t in STATX.items()) + ">"
FIELDS: dict[str, str] = {
    "seq": "long", "type": "string", "id": "long", "parent_id": "long", "name": "string", "statx": STATX_TYPE, "symlink": "string", "rm_time": "long",
    "ns": "boolean", "key": "string", "op": "string", "value": "string", "stamp": "long", "final": "boolean", "fill": "array<string>",
}
_PLAIN = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "boolean": T.BooleanType(), "array<string>": T.ArrayType(T.StringType()), STATX_TYPE: T.StructType([T.StructField(c, T.LongType() if t == "long" else T.IntegerType() if t == "int" else T.BooleanType()) for c, t in STATX.items()])}
SCHEMA = T.StructType([T.StructField(c, _PLAIN[t]) for c, t in FIELDS.items()])
#: Names of statx fields as events are filled by them, and their columns.
STATX_FIELDS: dict[str, list[str]] = {c: [c] for c in STATX if "_" not in c or c == "mnt_id"} | {t: [f"{t}_sec", f"{t}_nsec"] for t in TIMES} | {"dev": ["dev_major", "dev_minor"], "rdev": ["rdev_major", "rdev_minor"], "attributes": [f"attr_{a}" for a in ATTRIBUTES]}


def statx_of(df: DataFrame, only: frozenset[str] | None = None) -> Column:
    """The statx struct from the columns that a table has; what it lacks is null."""
    have = set(df.columns)
    return F.struct(*[(F.col(c) if c in have and (only is None or c in only) else F.lit(None)).cast(t).alias(c) for c, t in STATX.items()])


def complete(df: DataFrame) -> DataFrame:
    """All event columns, null where a table of events lacks them, in the order of FIELDS."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items()])
