"""An entry view over the driver's TPC-H-like tables, stated once for two SQL dialects.

/r<k> (region) / n<k> (nation) / c<k> (customer) / o<k>[.ext] (order): a tree of
depth four. Extended attributes are functions of the key, some of them missing
for some entries. The same expressions make the Spark view and the DuckDB view
that queries are checked with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.events import complete, statx_of

NOW = 1_000_000_000
INT64_MAX = (1 << 63) - 1
ROOT, REGION, NATION, CUSTOMER, ORDER = 1, 1_000_000_000, 2_000_000_000, 3_000_000_000, 4_000_000_000
FILE, DIRECTORY, LINK = 0o100000, 0o040000, 0o120000


@dataclass(frozen=True)
class Dialect:
    """What differs between the two engines."""

    duck: bool

    def epoch(self, ts: str) -> str:
        return f"cast(floor(epoch({ts})) as bigint)" if self.duck else f"floor(timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts}) / 1000000)"

    def array(self, *items: str) -> str:
        return f"[{', '.join(items)}]" if self.duck else f"array({', '.join(items)})"

    def struct(self, **members: str) -> str:
        if self.duck:
            return "{" + ", ".join(f"'{k}': {v}" for k, v in members.items()) + "}"
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in members.items()) + ")"

    def binary(self, number: str) -> str:
        """16 bytes: a number in hexadecimal, padded with zeroes."""
        text = f"lpad(to_hex({number}), 32, '0')" if self.duck else f"lpad(hex({number}), 32, '0')"
        return f"from_hex({text})" if self.duck else f"unhex({text})"


def big(x: str) -> str:
    return f"cast({x} as bigint)"


def _xattrs(d: Dialect, k: str, mtime: str) -> dict[str, str]:
    """Attributes of files by key."""
    b = lambda e: big(e)
    return {
        "user_tag": f"CASE WHEN {k} % 4 = 1 THEN concat('t', cast({k} % 7 as string)) END",
        "expiration_date": f"CASE WHEN {k} % 3 = 0 THEN NULL WHEN {k} % 9 = 1 THEN cast({INT64_MAX} as bigint) ELSE {b(f'{mtime} + ({k} % 1000) * 86400')} END",
        "fid": d.binary(b(k)),
        "hsm_state": f"CASE WHEN {k} % 6 = 0 THEN NULL ELSE {b(f'({k} * 5) & 31')} END",
        "hsm_archive_id": f"CASE WHEN {k} % 6 = 0 THEN NULL ELSE {b(f'{k} % 3')} END",
        "project_id": b(f"{k} % 13"),
        "mdt_index": b(f"{k} % 4"),
        "mdt_hash": b(f"{k} % 4 + 1"),
        "mdt_count": b(f"{k} % 3 + 1"),
        "mirror_count": f"CASE WHEN {k} % 5 = 0 THEN {b(f'1 + {k} % 3')} END",
        "mirror_state": f"CASE WHEN {k} % 5 = 0 THEN {b(f'1 + {k} % 3')} END",
        "comp_count": f"CASE WHEN {k} % 10 = 9 THEN NULL ELSE {b(f'1 + {k} % 4')} END",
        "begin": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b('0'), b(f'({k} % 8) * 1048576'))} END",
        "end": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b(f'({k} % 8) * 1048576'), b(f'({k} % 8 + 4) * 1048576'))} END",
        "comp_flags": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b(f'{k} & 31'), b(f'({k} * 3) & 31'))} END",
        "stripe_count": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b(f'1 + {k} % 2'), b(f'1 + {k} % 5'))} END",
        "stripe_size": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b('1048576'), b(f'(1 + {k} % 4) * 1048576'))} END",
        "pattern": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b(f'CASE WHEN {k} % 6 = 0 THEN 256 ELSE 1 END'))} END",
        "extension_size": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b(f'({k} % 3) * 65536'))} END",
        "ost": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(b(f'{k} % 8'), b(f'({k} + 3) % 8'))} END",
        "pool": f"CASE WHEN {k} % 10 <> 9 THEN {d.array(f"concat('ssd', cast({k} % 3 as string))", f"concat('HDD', cast({k} % 2 as string))")} END",
        "acl_users": f"CASE WHEN {k} % 4 = 0 THEN {d.array(d.struct(id=b(f'1000 + {k} % 9'), p=b(f'{k} & 7')), d.struct(id=b(f'1020 + {k} % 5'), p=b(f'({k} * 3) & 7')))} END",
        "acl_groups": f"CASE WHEN {k} % 4 = 0 THEN {d.array(d.struct(id=b(f'{k} % 12'), p=b(f'({k} * 5) & 7')))} END",
        "acl_default_users": f"CASE WHEN {k} % 8 = 0 THEN {d.array(d.struct(id=b(f'1000 + {k} % 3'), p=b('5')))} END",
        "acl_default_groups": f"CASE WHEN {k} % 8 = 0 THEN {d.array(d.struct(id=b(f'{k} % 6'), p=b('6')))} END",
        "acl_group": f"CASE WHEN {k} % 4 = 0 THEN {b(f'({k} * 7) & 7')} END",
        "selinux_user": f"CASE WHEN {k} % 7 <> 0 THEN concat('u', cast({k} % 3 as string)) END",
        "selinux_role": f"CASE WHEN {k} % 7 <> 0 THEN concat('r', cast({k} % 2 as string)) END",
        "selinux_type": f"CASE WHEN {k} % 7 <> 0 THEN concat('ty', cast({k} % 5 as string)) END",
        "selinux_range": f"CASE WHEN {k} % 7 <> 0 THEN concat('s', cast({k} % 4 as string)) END",
        "high_sens": f"CASE WHEN {k} % 7 <> 0 THEN {b(f'{k} % 4')} END",
        "high_cat": f"CASE WHEN {k} % 7 <> 0 THEN {d.array(d.struct(f=b(f'{k} % 10'), l=b(f'{k} % 10 + 3')), d.struct(f=b('20'), l=b(f'20 + {k} % 6')))} END",
        "bucket": f"concat('bucket-', cast({k} % 6 as string))",
        "rm_time": f"CASE WHEN {k} % 40 = 3 THEN {b(f'{mtime} + 5')} END",
    }


def _order(d: Dialect) -> dict[str, str]:
    k, mtime = "o_orderkey", d.epoch("o_orderdate")
    size = f"CASE WHEN {k} % 20 = 0 THEN cast(({k} % 100) / 20 as bigint) * 512 ELSE cast(round(o_totalprice * 100) as bigint) END"
    kind = f"CASE WHEN {k} % 50 = 7 THEN {LINK} ELSE {FILE} END"
    ext = f"CASE {k} % 4 WHEN 0 THEN '.dat' WHEN 1 THEN '.TXT' WHEN 2 THEN '.log' ELSE '' END"
    blocks = f"cast(({size} - ({size}) % 512) / 512 as bigint)"
    return {
        "id": big(f"{ORDER} + {k}"), "parent_id": big(f"{CUSTOMER} + o_custkey"), "name": f"concat('o', cast({k} as string), {ext})",
        "type": kind, "mode": f"cast(({k} * 73) & 511 as int)", "nlink": big(f"1 + {k} % 3"), "uid": big("1000 + o_custkey % 50"), "gid": big(f"{k} % 10"), "ino": big(k),
        "size": size, "blocks": blocks, "atime_sec": f"CASE WHEN {k} % 11 = 0 THEN NULL ELSE {big(f'{mtime} + ({k} % 100) * 3600')} END",
        "btime_sec": big(f"{mtime} - 86400 * ({k} % 30)"), "ctime_sec": big(f"{mtime} + ({k} % 7) * 60"), "mtime_sec": big(mtime), "mtime_nsec": f"cast({k} % 1000 as int)",
        "symlink": f"CASE WHEN {k} % 50 = 7 THEN concat('/target/', cast({k} % 9 as string), '.dat') END",
        "dev_major": big("8"), "dev_minor": big(f"{k} % 4"), "sync_time": big(f"900000000 + {k} % 1000"), "nb_children": big("NULL"),
        "sparseness": f"CASE WHEN {size} = 0 THEN cast(100 as bigint) ELSE cast(floor(512.0 * ({blocks}) / ({size}) * 100) as bigint) END",
        **_xattrs(d, k, mtime),
    }


def _directory(d: Dialect, k: str, offset: int, parent: str, name: str, uid: str) -> dict[str, str]:
    """A directory row: what it lacks is null with the type of the order's column."""
    mtime = f"800000000 + {k} * 1000"
    out = {c: f"CASE WHEN {k} < 0 THEN {e} END" for c, e in _xattrs(d, k, mtime).items()}
    out.update({
        "id": big(f"{offset} + {k}"), "parent_id": parent, "name": name, "type": str(DIRECTORY), "mode": "493", "nlink": big("2"), "uid": uid, "gid": big("0"), "ino": big(f"{offset} + {k}"),
        "size": big("4096"), "blocks": big("8"), "atime_sec": big(mtime), "btime_sec": big(mtime), "ctime_sec": big(mtime), "mtime_sec": big(mtime), "mtime_nsec": "0", "symlink": f"CASE WHEN {k} < 0 THEN '' END",
        "dev_major": big("8"), "dev_minor": big("0"), "sync_time": big(f"900000000 + {k} % 1000"), "nb_children": big(f"{k} % 3"), "sparseness": big("NULL"),
        "project_id": big(f"{k} % 13"), "mdt_index": big(f"{k} % 4"),
    })
    return out


def _branches(d: Dialect) -> list[tuple[str, dict[str, str]]]:
    """(FROM clause, columns) of each kind of entry; every kind has the same columns and a path."""
    o = _order(d)
    customer = "c_custkey"
    rows = [
        ("orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey", {**o, "path": f"concat('/r', cast(n_regionkey as string), '/n', cast(n_nationkey as string), '/c', cast(c_custkey as string), '/', {o['name']})"}),
        ("customer JOIN nation ON c_nationkey = n_nationkey", {**_directory(d, customer, CUSTOMER, big(f"{NATION} + c_nationkey"), "concat('c', cast(c_custkey as string))", big("1000 + c_custkey % 50")), "path": "concat('/r', cast(n_regionkey as string), '/n', cast(n_nationkey as string), '/c', cast(c_custkey as string))"}),
        ("nation", {**_directory(d, "n_nationkey", NATION, big(f"{REGION} + n_regionkey"), "concat('n', cast(n_nationkey as string))", big("0")), "path": "concat('/r', cast(n_regionkey as string), '/n', cast(n_nationkey as string))"}),
        ("region", {**_directory(d, "r_regionkey", REGION, big(str(ROOT)), "concat('r', cast(r_regionkey as string))", big("0")), "path": "concat('/r', cast(r_regionkey as string))"}),
        ("(SELECT 0 AS z FROM region LIMIT 1) one", {**_directory(d, "z", ROOT, big("0"), "''", big("0")), "path": "'/'"}),
    ]
    names = [*rows[0][1]]
    return [(table, {c: columns[c] for c in names}) for table, columns in rows]


def duck_view(columns: list[str] | None = None) -> str:
    """SQL of the view for DuckDB."""
    parts = []
    for table, exprs in _branches(Dialect(True)):
        parts.append("SELECT " + ", ".join(f'{e} AS "{c}"' for c, e in exprs.items() if columns is None or c in columns) + f" FROM {table}")
    return " UNION ALL ".join(parts)


def columns() -> list[str]:
    return [*_branches(Dialect(False))[0][1]]


def entries(spark: SparkSession, sf_dir: str, path: bool = True) -> DataFrame:
    """The entry view. Without `path` the orders need no join with their customers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    nation = read("nation")
    orders, customers = read("orders"), read("customer")
    small = F.broadcast(nation)  # 25 rows
    tables = [
        orders.join(customers.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(small, F.col("c_nationkey") == F.col("n_nationkey")) if path else orders,
        customers.join(small, F.col("c_nationkey") == F.col("n_nationkey")) if path else customers,
        nation,
        read("region"),
        spark.range(1).select(F.col("id").alias("z")),
    ]
    out = None
    for table, (_, exprs) in zip(tables, _branches(Dialect(False))):
        part = table.selectExpr(*[f"{e} AS `{c}`" for c, e in exprs.items() if path or c != "path"])
        out = part if out is None else out.unionByName(part)
    return out


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extra hard links: an order is also linked from each supplier of its lines."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_suppkey").distinct()
    return lines.selectExpr(f"{big(f'{ORDER} + l_orderkey')} AS id", f"{big(f'{NATION} + l_suppkey % 25')} AS parent_id", "concat('s', cast(l_suppkey as string), '-o', cast(l_orderkey as string)) AS name")


DUCK_LINKS = f"SELECT DISTINCT {big(f'{ORDER} + l_orderkey')} AS id, {big(f'{NATION} + l_suppkey % 25')} AS parent_id, concat('s', cast(l_suppkey as string), '-o', cast(l_orderkey as string)) AS name FROM lineitem"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change log from the events table: one event for each row, on 1 entry for each user."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet")
    flat = raw.selectExpr(*[f"{e} AS `{c}`" for c, e in event_columns(Dialect(False)).items()])
    return complete(flat.withColumn("statx", statx_of(flat, EVENT_STATX)))


#: statx fields that the change log sets.
EVENT_STATX = frozenset({"size", "uid", "gid", "mode", "mtime_sec", "mtime_nsec"})


def event_columns(d: Dialect) -> dict[str, str]:
    kind = "CASE event_type WHEN 'signup' THEN 'UPSERT' WHEN 'view' THEN 'XATTR' WHEN 'click' THEN 'LINK' WHEN 'purchase' THEN 'XATTR' ELSE 'UNLINK' END"
    kind = f"CASE WHEN event_id % 97 = 0 THEN 'DELETE' WHEN event_id % 89 = 0 THEN 'PARTIAL_UNLINK' ELSE {kind} END"
    plain = "event_id % 97 <> 0 AND event_id % 89 <> 0"
    made, put = f"event_type = 'signup' AND {plain}", f"event_type IN ('view', 'purchase') AND {plain}"
    op = f"CASE WHEN {plain} THEN CASE event_type WHEN 'view' THEN 'inc' WHEN 'purchase' THEN CASE WHEN event_id % 5 = 0 THEN 'unset' ELSE 'set' END END END"
    text = "CASE WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN concat('\"v', cast(event_id % 4 as string), '\"') ELSE cast(event_id % 10 as string) END"
    return {
        "seq": big("event_id"), "type": kind, "id": big("user_id"), "parent_id": big("user_id % 7"), "name": "concat('f', cast(event_id % 5 as string))",
        "size": f"CASE WHEN {made} AND event_id % 2 = 0 THEN {big('event_id')} END", "uid": f"CASE WHEN {made} AND event_id % 3 = 0 THEN {big('event_id % 50')} END",
        "gid": f"CASE WHEN {made} AND event_id % 4 = 0 THEN {big('event_id % 9')} END", "mode": f"CASE WHEN {made} AND event_id % 5 < 2 THEN cast(event_id % 512 as int) END",
        "mtime_sec": f"CASE WHEN {made} THEN {d.epoch('ts')} END", "mtime_nsec": f"CASE WHEN {made} THEN cast(event_id % 1000 as int) END",
        "symlink": f"CASE WHEN {made} AND event_id % 6 = 0 THEN concat('/to/', cast(event_id % 8 as string)) END", "rm_time": f"CASE WHEN event_id % 89 = 0 THEN {big('event_id + 7')} END",
        "ns": f"coalesce({put} AND event_id % 3 = 0, false)", "key": f"CASE WHEN {put} THEN CASE WHEN event_id % 2 = 0 THEN 'hits' ELSE 'score' END END", "op": op, "value": f"CASE WHEN {put} THEN {text} END",
    }
