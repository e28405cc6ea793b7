"""Keeping a mirror current with Structured Streaming.

A store holds its tables in buckets by a hash of the id. A micro-batch reads and
rewrites the buckets of its ids only; a manifest, written last, says which
version of which bucket is current. A batch that is run again after a failure
starts from the same manifest and replaces what the failed run left, so the
result is the same. Buckets that no recent manifest names are removed.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .enrich import fill, reject_open
from .events import SCHEMA, complete
from .fold import Mirror, apply, fold

TABLES = ("inodes", "links", "xattrs")
#: The format of a store's folders; a store of another format is refused.
FORMAT = 1
BUCKETS = 64


class Store:
    """Bucketed snapshots of a mirror in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        known = self.versions()
        made = self.manifest(known[-1]) if known else {"format": FORMAT, "buckets": buckets}
        if made["format"] != FORMAT:
            raise ValueError(f"{path} has format {made['format']}, not {FORMAT}")
        self.buckets: int = made["buckets"]

    def versions(self) -> list[int]:
        """Complete snapshots, oldest first."""
        at = self._path(f"{self.path}/done")
        if not self._fs.exists(at):
            return []
        names = [str(s.getPath().getName()) for s in self._fs.listStatus(at)]
        return sorted(int(n) for n in names if re.fullmatch(r"\d+", n))

    def manifest(self, version: int) -> dict:
        """format, buckets, last sequence number, and for each table the version of each bucket that has rows."""
        source = self._fs.open(self._path(f"{self.path}/done/{version}"))
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        finally:
            source.close()

    def acknowledged(self) -> int | None:
        """The largest seq of the events that complete snapshots hold: what a reader of the log may let go."""
        known = self.versions()
        return self.manifest(known[-1])["seq"] if known else None

    def bucket(self, ident: str = "id") -> Column:
        return F.pmod(F.xxhash64(ident), F.lit(self.buckets)).cast("int")

    def read(self, version: int | None = None, only: list[int] | None = None) -> Mirror | None:
        """A snapshot, or some of its buckets."""
        known = self.versions()
        if not known:
            return None
        at = self.manifest(known[-1] if version is None else version)
        empty = fold(self.spark.createDataFrame([], SCHEMA))
        out = []
        for t in TABLES:
            paths = [f"{self.path}/data/{v}/{t}/bucket={k}" for k, v in at["tables"][t].items() if only is None or int(k) in only]
            schema = getattr(empty, t).schema
            out.append(self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema))
        return Mirror(*out)

    def write(self, mirror: Mirror, version: int, touched: list[int], before: dict | None, seq: int | None) -> None:
        """Write the touched buckets as part of a new version."""
        tables = {}
        for t in TABLES:
            folder = f"{self.path}/data/{version}/{t}"
            rows = getattr(mirror, t).withColumn("bucket", self.bucket())
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
            names = [str(s.getPath().getName()) for s in self._fs.listStatus(self._path(folder))]
            made = {m[1]: version for n in names if (m := re.fullmatch(r"bucket=(\d+)", n))}
            kept = {k: v for k, v in (before or {}).get("tables", {}).get(t, {}).items() if int(k) not in touched}
            tables[t] = kept | made
        last = [s for s in (seq, (before or {}).get("seq")) if s is not None]
        text = json.dumps({"format": FORMAT, "buckets": self.buckets, "seq": max(last) if last else None, "tables": tables})
        sink = self._fs.create(self._path(f"{self.path}/done/{version}"), True)
        sink.write(bytearray(text.encode()))
        sink.close()

    def drop_before(self, version: int, keep: int = 2) -> None:
        """Remove old manifests and the buckets that none of those kept names."""
        known = [v for v in self.versions() if v < version]
        old, kept = known[:-keep], [*known[-keep:], version]
        if not old:
            return
        used = {(t, k, v) for m in map(self.manifest, kept) for t in TABLES for k, v in m["tables"][t].items()}
        for gone in old:
            held = {(t, k, v) for t in TABLES for k, v in self.manifest(gone)["tables"][t].items()}
            for t, k, v in held - used:
                self._fs.delete(self._path(f"{self.path}/data/{v}/{t}/bucket={k}"), True)
            self._fs.delete(self._path(f"{self.path}/done/{gone}"), False)


def apply_batch(store: Store, batch: DataFrame, batch_id: int, snapshot: DataFrame | None = None, dedup: bool = True) -> None:
    """Fold one micro-batch; its number makes it idempotent.

    With a snapshot of the live file system, events are completed first; with
    `dedup` the open ones of an id are merged before that and those of ids that
    the batch deletes are left out, so that fewer are looked up. Events that are
    still open are refused.
    """
    version = batch_id + 1
    known = store.versions()
    if version in known:
        return
    earlier = [v for v in known if v < version]
    before = store.manifest(earlier[-1]) if earlier else None
    batch = complete(batch).persist()
    events = batch
    try:
        touched, seq = batch.agg(F.collect_set(store.bucket()), F.max("seq")).first()  # at most as many numbers as buckets
        if not touched:
            return
        if snapshot is not None:
            events = fill(_merged(batch) if dedup else batch, snapshot)
        events = reject_open(events).persist()  # the folds read it several times
        old = store.read(earlier[-1], touched) if earlier else None
        store.write(fold(events) if old is None else apply(old, events), version, touched, before, seq)
    finally:
        events.unpersist()
        batch.unpersist()
    store.drop_before(version)


def _merged(batch: DataFrame) -> DataFrame:
    """The batch without the open events of ids that it deletes later, and with one event for the updates of an id that only name what to fill."""
    gone = batch.where("type = 'DELETE'").groupBy("id").agg(F.max("seq").alias("_gone"))
    left = batch.join(gone, "id", "left").where("_gone IS NULL OR seq >= _gone")
    bare = F.expr("coalesce(type = 'UPSERT' AND size(fill) > 0 AND statx IS NULL AND symlink IS NULL, false)")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("fill")))).alias("fill")
    merged = left.where(bare).groupBy("type", "id").agg(names, F.max("seq").alias("seq"))
    return complete(left.where(~bare)).unionAll(complete(merged))


def start(events: DataFrame, store_path: str, checkpoint: str, available_now: bool = True, snapshot: DataFrame | None = None, after: int | None = None, dedup: bool = True, buckets: int = BUCKETS):
    """Run a stream of events into a store; returns the streaming query. `after`: only events with a larger seq."""
    store = Store(events.sparkSession, store_path, buckets)
    chosen = events if after is None else events.where(F.col("seq") > after)
    writer = chosen.writeStream.foreachBatch(lambda batch, n: apply_batch(store, batch, n, snapshot, dedup)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_events(spark: SparkSession, path: str, schema=SCHEMA, files_per_batch: int = 16, kind: str = "parquet") -> DataFrame:
    """A stream of event files (parquet, or JSON lines)."""
    return spark.readStream.format(kind).schema(schema).option("maxFilesPerTrigger", files_per_batch).load(path)


def write_events(events: DataFrame, path: str, checkpoint: str | None = None, kind: str = "json"):
    """Events to files: a stream gives a streaming query, a table is appended."""
    if events.isStreaming:
        return events.writeStream.format(kind).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
    return events.write.mode("append").format(kind).save(path)


def first_events(events: DataFrame, most: int, after: int | None = None) -> DataFrame:
    """At most so many events, from the one after a seq."""
    chosen = events if after is None else events.where(F.col("seq") > after)
    return chosen.orderBy("seq").limit(most)
