"""File-system change-log records to events: a stateless explode.

A record says what happened and to whom, not what the entry looks like now; its
events name what has to be filled from the live file system. Records: idx,
rec_type, target, parent, name, source_parent, source_name, overwritten, source,
flags, time_sec, uid, gid, xattr, mdt_index, fid. A record type that isn't
listed here gives no events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .events import FIELDS, STATX, STATX_FIELDS, STATX_TYPE

LAST, ARCHIVED = 1, 2
#: statx fields that record types leave to be filled.
ALL = [*STATX_FIELDS]
ATIME, CTIME = ["atime"], ["ctime"]
DATA = ["size", "blocks", "type"]
#: An update of SATTR is also one of what CLOSE and MTIME update, and so on down to ATIME.
UPDATES = {"SATTR": ALL, "CLOSE": ["mtime", *DATA, *CTIME, *ATIME], "MTIME": ["mtime", *DATA, *CTIME, *ATIME], "CTIME": [*CTIME, *ATIME], "ATIME": ATIME, "TRUNC": [*CTIME, "mtime", *DATA], "LYOUT": CTIME, "FLRW": [*CTIME, "mtime", *DATA], "RESYNC": [*CTIME, *DATA], "HSM": DATA}
PARENT = ["type", "atime", "ctime", "mtime"]
#: Attributes whose values an HSM record leaves to be filled.
HSM = ["trusted.lov", "trusted.hsm"]
_EVENT = "struct<" + ",".join(f"{c}:{t}" for c, t in FIELDS.items() if c != "seq") + ">"
COLUMNS = {"idx": "long", "rec_type": "string", "target": "long", "parent": "long", "name": "string", "source_parent": "long", "source_name": "string", "overwritten": "long", "source": "long", "flags": "int", "time_sec": "long", "uid": "long", "gid": "long", "xattr": "string", "mdt_index": "long", "fid": "string"}


def _event(kind: str, ident: Column, fill: list[str] | Column | None = None, statx: dict[str, Column] | None = None, **values) -> Column:
    own = {"type": F.lit(kind), "id": ident, **values}
    if statx is not None:
        own["statx"] = F.struct(*[(statx[c] if c in statx else F.lit(None)).cast(t).alias(c) for c, t in STATX.items()])
    if fill is not None:
        own["fill"] = fill if isinstance(fill, Column) else F.array(*map(F.lit, fill))
    return F.struct(*[(own[c] if c in own else F.lit(None)).cast(t).alias(c) for c, t in FIELDS.items() if c != "seq"])


def _update(ident: Column, fields: list[str], statx: dict[str, Column] | None = None) -> Column:
    return _event("UPSERT", ident, [f"statx.{f}" for f in fields], statx)


def _set(ident: Column, key: str, value: Column, fill: list[str] | None = None) -> Column:
    return _event("XATTR", ident, fill, key=F.lit(key), op=F.lit("set"), value=value)


def expand(records: DataFrame) -> DataFrame:
    """The events of change-log records; seq is 8 * idx plus the position in the record's events."""
    have = set(records.columns)
    c = lambda name: (F.col(name) if name in have else F.lit(None)).cast(COLUMNS[name])
    kind, target, parent, name = c("rec_type"), c("target"), c("parent"), c("name")
    owner = {"uid": c("uid"), "gid": c("gid")}
    link = _event("LINK", target, ["path"], parent_id=parent, name=name)
    made = _update(target, [f for f in ALL if f not in owner], owner)
    touch = lambda who: _update(who, PARENT)
    count = lambda who, by: _event("XATTR", who, key=F.lit("nb_children"), op=F.lit("inc"), value=F.lit(str(by)))
    quoted = F.when(c("fid").isNotNull(), F.concat(F.lit('"'), c("fid"), F.lit('"')))
    fid = lambda fill=None: _set(target, "fid", quoted, fill)
    mdt = _set(target, "mdt_index", c("mdt_index").cast("string"))
    lustre = _event("XATTR", target, ["lustre"])
    last, archived = c("flags").bitwiseAND(LAST) != 0, c("flags").bitwiseAND(ARCHIVED) != 0

    def removal(who: Column) -> Column:
        partly = _event("PARTIAL_UNLINK", who, rm_time=c("time_sec"))
        return F.when(last & archived, partly).when(last, _event("DELETE", who)).otherwise(_event("UNLINK", who, parent_id=parent, name=name))

    parents = [touch(parent), count(parent, 1)]
    over = c("overwritten").isNotNull()
    source = [_event("UNLINK", target, parent_id=c("source_parent"), name=c("source_name")), touch(c("source_parent")), count(c("source_parent"), -1)]
    lists = {
        "CREAT": [link, fid(["lustre"]), made, *parents],
        "SLINK": [link, fid(["lustre"]), mdt, made, *parents, _event("UPSERT", target, ["symlink"])],
        "HLINK": [link, made, *parents],
        "MKNOD": [link, fid(), mdt, made, *parents],
        "XATTR": [_update(target, CTIME), _event("XATTR", target, F.array(F.concat(F.lit("xattrs."), c("xattr")))), lustre],
        "UNLNK": [removal(target), touch(parent), count(parent, -1)],
        "RENME": [F.when(over, removal(c("overwritten"))), link, made, touch(parent), F.when(~over, count(parent, 1)), *source],
        "MIGRT": [link, made, touch(parent), _event("DELETE", c("source")), touch(c("source_parent")), lustre],
    }
    lists |= {"MKDIR": lists["CREAT"], "RMDIR": lists["UNLNK"]}
    lists |= {k: [_update(target, fields), lustre] for k, fields in UPDATES.items()}
    lists["HSM"] += [_event("XATTR", target, [f"xattrs.{k}"]) for k in HSM]
    events = F.array().cast(f"array<{_EVENT}>")
    for k, items in lists.items():
        events = F.when(kind == k, F.array(*items)).otherwise(events)
    rows = records.select(F.col("idx"), F.posexplode(F.filter(events, lambda e: e.isNotNull())).alias("at", "e"))
    return rows.select((F.col("idx") * 8 + F.col("at")).cast("long").alias("seq"), "e.*")


def dump(records: DataFrame, path: str) -> None:
    """Append the raw records to a folder of JSON lines."""
    records.write.mode("append").json(path)
