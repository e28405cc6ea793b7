"""Folding a change log into a mirror.

Events of one id are applied in order of `seq`, whatever the batches. A DELETE
starts the id anew; links are present if their last event is LINK; statx fields
and the symlink take their last value; an extended attribute is its last set (or
unset) plus the increments after it, from 0 where there is none.

A PARTIAL_UNLINK takes the id's links away and leaves one row without parent and
name that carries the removal time and the attributes that the links had. Attributes
of a link end with it and start anew with the next LINK. Of counts with a stamp the
one with the newest stays; of equal stamps the first that is final, or the last.

Folds are keyed partial aggregates, but for attributes of links. What a mirror
already holds is turned into events that precede all others, so applying a log in
any split gives the same tables; `parts` keeps what the values of links don't show.
Only an unset with a stamp, where nothing is left under its key, ends with its batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .events import FIELDS, STATX, complete, statx_of

BEFORE = -1
#: Links of a mirror come before the parts of their attributes.
FIRST = -(1 << 62)
PARTS = "array<struct<seq:bigint,parent_id:bigint,name:string,op:string,value:string,stamp:bigint,final:boolean>>"


@dataclass
class Mirror:
    """inodes(id, statx columns, symlink), links(id, parent_id, name, rm_time), xattrs(id, ns, parent_id, name, key, value, stamp, final, parts)."""

    inodes: DataFrame
    links: DataFrame
    xattrs: DataFrame


def live(events: DataFrame) -> DataFrame:
    """The events after the last DELETE of their id."""
    gone = events.where("type = 'DELETE'").groupBy("id").agg(F.max("seq").alias("_gone"))
    return events.join(gone, "id", "left").where("type <> 'DELETE' AND (_gone IS NULL OR seq > _gone)").drop("_gone")


def _last(value: Column) -> Column:
    return F.max_by(value, F.when(value.isNotNull(), F.col("seq")))


def fold_inodes(events: DataFrame) -> DataFrame:
    """id, the last known statx fields and the symlink of every id that an UPSERT or LINK made."""
    rows = live(events).where("type IN ('UPSERT', 'LINK')")
    return rows.groupBy("id").agg(*[_last(F.col(f"statx.{c}")).alias(c) for c in STATX], _last(F.col("symlink")).alias("symlink"))


def _cuts(rows: DataFrame) -> DataFrame:
    """The last PARTIAL_UNLINK of each id."""
    return rows.where("type = 'PARTIAL_UNLINK'").groupBy("id").agg(F.max("seq").alias("_cut"), F.max_by("rm_time", "seq").alias("_rm"))


def fold_links(events: DataFrame) -> DataFrame:
    """The links whose last event is LINK, and a row without parent and name for ids that are partly unlinked."""
    rows = live(events)
    cuts = _cuts(rows)
    last = rows.where("type IN ('LINK', 'UNLINK')").groupBy("id", "parent_id", "name").agg(F.max_by("type", "seq").alias("_type"), F.max("seq").alias("_seq"))
    there = last.join(cuts, "id", "left").where("_type = 'LINK' AND (_cut IS NULL OR _seq > _cut)")
    removed = cuts.select("id", F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("name"), F.col("_rm").alias("rm_time"))
    return there.select("id", "parent_id", "name", F.lit(None).cast("long").alias("rm_time")).unionByName(removed)


_KEY = ["id", "ns", "parent_id", "name", "key"]


def _same(a: str, b: str) -> Column:
    out = F.lit(True)
    for c in _KEY:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def _of_links(rows: DataFrame) -> DataFrame:
    """Attribute events with the keys they end at.

    An attribute of a link counts if the last thing that happened to the link
    before it is a LINK. If the next thing is a PARTIAL_UNLINK of the id, it moves
    to the row without parent and name; if it is a LINK or an UNLINK, it has ended.
    What has no id or no seq is neither of a link nor before or after anything.
    """
    xattrs = F.expr("type = 'XATTR' AND key IS NOT NULL")
    columns = ["seq", "id", F.coalesce("ns", F.lit(False)).alias("ns"), "parent_id", "name", "key", "op", "value", "stamp", "final", "type"]
    of_links = rows.where("type IN ('LINK', 'UNLINK') AND seq IS NOT NULL").select(*columns)
    cuts = rows.where("type = 'PARTIAL_UNLINK' AND seq IS NOT NULL").select("id", F.col("seq").alias("_cut"))
    met = of_links.select("id", "parent_id", "name").distinct().join(cuts, "id").select("id", "parent_id", "name", F.col("_cut").alias("seq"), F.lit("CUT").alias("type"))
    all_ = rows.where(xattrs).select(*columns).where("NOT ns OR id IS NOT NULL AND seq IS NOT NULL")
    inside = all_.where("ns AND parent_id IS NOT NULL").unionAll(of_links).unionByName(met, allowMissingColumns=True)
    w = Window.partitionBy("id", "parent_id", "name").orderBy("seq", F.col("type") == "XATTR")
    mark = F.when(F.col("type") != "XATTR", F.col("type"))
    before = F.last(mark, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(mark, ignorenulls=True).over(Window.partitionBy("id", "parent_id", "name").orderBy(F.desc("seq"), F.col("type") != "XATTR").rowsBetween(Window.unboundedPreceding, -1))
    kept = inside.withColumns({"_before": before, "_after": after}).where("type = 'XATTR' AND _before = 'LINK' AND (_after IS NULL OR _after = 'CUT')")
    moves = F.col("_after").isNotNull()
    kept = kept.withColumns({"parent_id": F.when(~moves, F.col("parent_id")), "name": F.when(~moves, F.col("name"))}).drop("_before", "_after")
    return all_.where("NOT ns OR parent_id IS NULL").withColumns({"parent_id": F.lit(None).cast("long"), "name": F.lit(None).cast("string")}).unionByName(kept)


def _order() -> Column:
    """The fixed operation that holds is the one with the largest of these."""
    final = F.coalesce("final", F.lit(False))
    return F.struct(F.coalesce("stamp", F.lit(-(1 << 63))).alias("stamp"), final.alias("final"), F.when(final, -F.col("seq")).otherwise(F.col("seq")).alias("seq"))


def fold_xattrs(events: DataFrame) -> DataFrame:
    """(id, ns, parent_id, name, key, value, stamp, final, parts) of every attribute that is set."""
    rows = _of_links(live(events))
    return _of_inodes(rows.where("NOT ns")).unionByName(_with_parts(rows.where("ns")))


def _of_inodes(rows: DataFrame) -> DataFrame:
    """What the attributes of inodes have come to."""
    fixes = F.col("op").isin("set", "unset")
    # The last fixed operation of each key; the increments that count are those after it. Sums are partial before the shuffle.
    fixed = rows.where(fixes).groupBy(*_KEY).agg(F.max_by(F.struct((F.col("op") == "set").alias("is_set"), "value", "stamp", "final", "seq"), _order()).alias("_base"))
    more = rows.alias("i").join(fixed.alias("f"), _same("i", "f"), "left")
    counts = (F.col("i.op") == "inc") & (F.col("_base").isNull() | (F.col("i.seq") > F.col("_base.seq")))
    anchor = fixes & (F.col("i.seq") == F.col("_base.seq"))
    kept = more.where(counts | anchor).groupBy(*[F.col(f"i.{c}").alias(c) for c in _KEY]).agg(F.sum(F.when(counts, F.expr("try_cast(i.value AS bigint)"))).alias("_more"), F.max(F.when(anchor & F.col("_base.is_set"), F.struct("_base.value", "_base.stamp", "_base.final"))).alias("_held"))
    return kept.where("_held IS NOT NULL OR _more IS NOT NULL").select(*_KEY, _total().alias("value"), "_held.stamp", "_held.final", F.lit(None).cast(PARTS).alias("parts"))


def _total() -> Column:
    """The text that is held plus the increments after it."""
    total = (F.coalesce(F.expr("try_cast(_held.value AS bigint)"), F.lit(0)) + F.col("_more")).cast("string")
    return F.when(F.col("_more").isNull(), F.col("_held.value")).otherwise(total)


def _with_parts(rows: DataFrame) -> DataFrame:
    """What the attributes of links have come to, and the parts that they are made of.

    A PARTIAL_UNLINK puts attributes of several links under one key, in the order
    of their events, and an UNLINK before it takes some of them out. So the parts
    keep, for each link, the fixed operation that holds and the sums of increments
    between those of all links of the id, numbered back from -1. An unset matters
    if a set or an increment comes before it; if its own link shows nothing, the
    first row of the id and the key carries it. An attribute that is one plain set,
    alone under its id and key, has no parts.
    """
    group, own = ["id", "key"], Window.partitionBy(*_KEY)
    fixes = F.col("op").isin("set", "unset")
    rows = rows.repartition(*group)  # all that follows keeps this partitioning
    rows = rows.withColumns({"_rank": F.when(fixes, _order()), "_n": F.expr("CASE WHEN op = 'inc' THEN try_cast(value AS bigint) END")})
    rows = rows.withColumns({"_top": F.max("_rank").over(own), "_at": F.max_by("seq", "_rank").over(own)})
    rows = rows.withColumn("_fixed", fixes & (F.col("seq") == F.col("_at")))
    earlier = Window.partitionBy(*group).orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    ends = F.count(F.when(F.col("_fixed"), 1)).over(Window.partitionBy(*group)) - F.count(F.when(F.col("_fixed"), 1)).over(earlier)
    # An increment may count if a fixed operation that the link's own doesn't outrank comes before it, or if there is none.
    rows = rows.withColumns({"_pos": -2 * ends - F.when(F.col("_fixed"), 0).otherwise(1), "_before": F.max(F.when(F.col("_fixed"), F.col("_rank"))).over(earlier)})
    rows = rows.where("_fixed OR _n IS NOT NULL AND (_top IS NULL OR _before >= _top)")
    counts = F.expr("NOT _fixed AND (_at IS NULL OR seq > _at)")
    parts = rows.groupBy(*_KEY, "_pos").agg(F.sum("_n").alias("_n"), F.max(counts).alias("_counts"), F.max(F.when(F.col("_fixed"), F.struct("op", "value", "stamp", "final"))).alias("_base"))
    all_ = Window.partitionBy(*group)
    parts = parts.withColumn("_from", F.min(F.when(F.expr("_base IS NULL OR _base.op = 'set'"), F.col("_pos"))).over(all_))
    parts = parts.where("_base IS NULL OR _base.op = 'set' OR _pos > _from OR _base.stamp IS NOT NULL OR _base.final")
    part = F.struct(
        F.col("_pos").alias("seq"), "parent_id", "name", F.coalesce("_base.op", F.lit("inc")).alias("op"), F.when(F.col("_base").isNull(), F.col("_n").cast("string")).otherwise(F.col("_base.value")).alias("value"),
        F.col("_base.stamp").alias("stamp"), F.col("_base.final").alias("final"),
    )
    held = F.max(F.when(F.col("_base.op") == "set", F.struct("_base.value", "_base.stamp", "_base.final")))
    links = parts.groupBy(*_KEY).agg(held.alias("_held"), F.sum(F.when(F.col("_counts"), F.col("_n"))).alias("_more"), F.collect_list(part).alias("parts"))
    links = links.withColumn("_seen", F.expr("_held IS NOT NULL OR _more IS NOT NULL"))
    links = links.withColumns({"_by": F.min(F.when(F.col("_seen"), F.struct("parent_id", "name"))).over(all_), "_links": F.count(F.lit(1)).over(all_)})
    links = links.withColumn("_alone", F.expr("_links = 1 AND size(parts) = 1 AND parts[0].op = 'set'"))
    mine = F.when(F.col("_seen"), F.struct("parent_id", "name")).otherwise(F.col("_by"))
    seen = F.max(F.when(F.col("_seen"), F.struct(_total().alias("value"), F.col("_held.stamp").alias("stamp"), F.col("_held.final").alias("final"))))
    out = links.where("_by IS NOT NULL").groupBy("id", "ns", mine["parent_id"].alias("parent_id"), mine["name"].alias("name"), "key").agg(seen.alias("_row"), F.array_sort(F.flatten(F.collect_list(F.when(~F.col("_alone"), F.col("parts"))))).alias("parts"))
    return out.select(*_KEY, "_row.value", "_row.stamp", "_row.final", F.when(F.size("parts") > 0, F.col("parts")).cast(PARTS).alias("parts"))


def as_events(mirror: Mirror) -> DataFrame:
    """The events that make a mirror, all before any other."""
    seq = F.lit(BEFORE).cast("long").alias("seq")
    a = complete(mirror.inodes.select(seq, F.lit("UPSERT").alias("type"), "id", statx_of(mirror.inodes).alias("statx"), "symlink"))
    gone = F.col("parent_id").isNull() & F.col("name").isNull()  # its removal came before the links that the id has now
    b = complete(mirror.links.select((F.lit(FIRST) - gone.cast("long")).alias("seq"), F.when(gone, "PARTIAL_UNLINK").otherwise("LINK").alias("type"), "id", "parent_id", "name", "rm_time"))
    xattrs = mirror.xattrs if "parts" in mirror.xattrs.columns else mirror.xattrs.withColumn("parts", F.lit(None).cast(PARTS))
    whole = F.array(F.struct(seq, "parent_id", "name", F.lit("set").alias("op"), "value", "stamp", "final")).cast(PARTS)
    c = complete(xattrs.select(F.lit("XATTR").alias("type"), "id", "ns", "key", F.inline(F.coalesce("parts", whole))))
    return a.unionAll(b).unionAll(c)


def fold(events: DataFrame) -> Mirror:
    events = complete(events)
    return Mirror(fold_inodes(events), fold_links(events), fold_xattrs(events))


def apply(mirror: Mirror, events: DataFrame) -> Mirror:
    """The mirror after the events.

    The plan reads the mirror several times, so it should be stored tables and
    not the plan of another fold.
    """
    return fold(as_events(mirror).unionAll(complete(events)))


def compact(events: DataFrame) -> DataFrame:
    """A change log with the same effect on an empty mirror: one event for each thing that is left, with all that is still to be filled."""
    events = complete(events)
    m = fold(events)
    left = live(events).where("size(fill) > 0")
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("fill")))).alias("fill")
    last = F.max("seq").alias("seq")
    # What an UPSERT, an XATTR or the last LINK of a name leaves open stays open.
    of_id = left.where("type IN ('UPSERT', 'XATTR')").groupBy("type", "id").agg(names, last)
    there = m.links.where("rm_time IS NULL").select("id", "parent_id", "name")
    of_links = left.where("type = 'LINK'").groupBy("type", "id", "parent_id", "name").agg(names, last).join(there, ["id", "parent_id", "name"], "left_semi")
    return as_events(m).unionAll(complete(of_id)).unionAll(complete(of_links))
