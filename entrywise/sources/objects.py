"""Object listings and file lists as entries.

An object store's listing is a table (bucket, key, size, mtime_sec, metadata); a
file list is a table of the fields that such lists hold. Both take the queries
of the entry view; a file list takes the predicates on its fields only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.patterns import UsageError
from ..plans.ast import Always, Node
from ..plans.compile import fields_of
from ..plans.find import select

FILE = 0o100000
#: Columns of a file list.
LIST_COLUMNS = {"path": "string", "name": "string", "type": "int", "mode": "int", "uid": "long", "gid": "long", "size": "long"} | {f"{t}_{p}": k for t in ("atime", "ctime", "mtime") for p, k in (("sec", "long"), ("nsec", "int"))}
#: Fields that predicates on a file list may use.
LIST_FIELDS = {"name", "ns-xattrs.path", "statx.type", "statx.size"} | {f"statx.{t}{p}" for t in ("atime", "ctime", "mtime") for p in ("", ".sec", ".nsec")}


def objects(listing: DataFrame) -> DataFrame:
    """Entries of objects: the id is a hash of bucket and key, the path is the key, user metadata are attributes."""
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>")) if "metadata" in listing.columns else F.create_map().cast("map<string,string>")
    texts = F.map_from_entries(F.transform(F.map_entries(metadata), lambda e: F.struct(F.concat(F.lit("user_metadata."), e["key"]), F.regexp_replace(F.to_json(F.array(e["value"])), r"^\[|\]$", ""))))
    return listing.select(
        F.sha2(F.concat_ws("/", "bucket", "key"), 256).alias("id"), F.col("key").alias("name"), F.col("key").alias("path"), "bucket", F.lit(FILE).alias("type"),
        F.col("size").cast("long").alias("size"), F.col("mtime_sec").cast("long").alias("mtime_sec"), texts.alias("xattrs"),
    )


def write_list(entries: DataFrame, path: str, node: Node = Always()) -> None:
    """Write the selected entries as a file list."""
    have = set(entries.columns)
    select(entries, node).select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in LIST_COLUMNS.items()]).write.mode("overwrite").parquet(path)


def read_list(spark: SparkSession, path: str, node: Node = Always()) -> DataFrame:
    """A file list, filtered while it is read; a predicate on a field that lists don't hold is refused."""
    other = sorted(set(fields_of(node)) - LIST_FIELDS)
    if other:
        raise UsageError(f"a file list has no {', '.join(other)}")
    rows = spark.read.schema(", ".join(f"{c} {t}" for c, t in LIST_COLUMNS.items())).parquet(path)
    return select(rows, node)
