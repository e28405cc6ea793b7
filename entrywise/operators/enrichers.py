"""Attributes from raw extended attributes, in Spark functions.

Raw values are binary columns in the layouts that the kernel and the file system
document; numbers are little-endian. A value that is missing, too short or of
another kind gives nulls.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tags of ACL entries, and magic numbers of layouts.
ACL_TAGS = {"owner": 0x01, "user": 0x02, "group": 0x04, "groups": 0x08, "mask": 0x10, "other": 0x20}
ACL_VERSION = 2
LOV_V1, LOV_V3, LOV_COMPOSITE = 0x0BD10BD0, 0x0BD30BD0, 0x0BD60BD0


def number(raw: Column, at: Column | int, size: int) -> Column:
    """`size` bytes (up to 7, or 8 below 2^63) from a position, as a number."""
    at = at if isinstance(at, Column) else F.lit(at)
    piece = F.hex(F.substring(raw, at + 1, F.lit(size)))
    turned = F.concat(*[F.substring(piece, 2 * (size - k) - 1, 2) for k in range(size)])
    return F.when(F.octet_length(raw) >= at + size, F.conv(turned, 16, 10).cast("bigint"))


def acl(raw: Column) -> Column:
    """struct<owner, group, mask, other, users, groups> of a POSIX ACL: a version, then entries of tag, permissions and id."""
    count = F.floor((F.octet_length(raw) - 4) / 8).cast("int")
    at = lambda i: F.lit(4) + i * 8
    each = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.struct(number(raw, at(i), 2).alias("tag"), number(raw, at(i) + 2, 2).alias("p"), number(raw, at(i) + 4, 4).alias("id")))
    entries = F.when((number(raw, 0, 4) == ACL_VERSION) & (count > 0), each)
    one = lambda tag: F.get(F.filter(entries, lambda e: e["tag"] == ACL_TAGS[tag]), F.lit(0))["p"]
    some = lambda tag: F.transform(F.filter(entries, lambda e: e["tag"] == ACL_TAGS[tag]), lambda e: F.struct(e["id"].alias("id"), e["p"].alias("p")))
    return F.struct(one("owner").alias("owner"), one("group").alias("group"), one("mask").alias("mask"), one("other").alias("other"), some("user").alias("users"), some("groups").alias("groups"))


def enrich_acl(entries: DataFrame, access: str = "posix_acl_access", default: str = "posix_acl_default") -> DataFrame:
    """acl_users, acl_groups and acl_group, and the same of the default ACL, from raw ACLs."""
    a, d = acl(F.col(access)), acl(F.col(default))
    return entries.withColumns({"acl_users": a["users"], "acl_groups": a["groups"], "acl_group": a["group"], "acl_mask": a["mask"], "acl_default_users": d["users"], "acl_default_groups": d["groups"]})


def _categories(text: Column) -> Column:
    """`c0.c5,c7` as intervals, in order."""
    edges = lambda p: F.transform(F.split(p, "[.]"), lambda c: F.regexp_extract(c, "^c([0-9]+)$", 1).try_cast("bigint"))
    spans = F.transform(F.split(text, ","), lambda p: F.struct(F.get(edges(p), F.lit(0)).alias("f"), F.element_at(edges(p), -1).alias("l")))
    return F.when(text == "", F.array().cast("array<struct<f:bigint,l:bigint>>")).otherwise(spans)


def enrich_selinux(entries: DataFrame, context: str = "selinux") -> DataFrame:
    """User, role, type, range, sensitivity and categories from a context `user:role:type:low[-high]`; a level is `s2:c0.c5,c7`."""
    text = F.regexp_replace(F.col(context), "\\x00$", "")
    ok = text.rlike("^[^:]+:[^:]+:[^:]+(:.+)?$")
    part = lambda k: F.when(ok, F.nullif(F.regexp_extract(text, "^([^:]+):([^:]+):([^:]+):?(.*)$", k), F.lit("")))
    low = F.substring_index(part(4), "-", 1)
    high = F.regexp_extract(part(4), "^[^-]*-?(.*)$", 1)
    high = F.when(high == "", low).otherwise(high)
    sensitivity = F.regexp_extract(high, "^s([0-9]+)", 1).try_cast("bigint")
    categories = lambda level: _categories(F.regexp_extract(level, "^s[0-9]+:?(.*)$", 1))
    return entries.withColumns({"selinux_user": part(1), "selinux_role": part(2), "selinux_type": part(3), "selinux_range": part(4), "high_sens": sensitivity, "low_cat": categories(low), "high_cat": categories(high)})


def enrich_hsm(entries: DataFrame, raw: str = "trusted_hsm") -> DataFrame:
    """hsm_state and hsm_archive_id: a compatibility number, flags, and the archive's number."""
    c = F.col(raw)
    return entries.withColumns({"hsm_state": number(c, 4, 4), "hsm_archive_id": number(c, 8, 7)})


def enrich_fid(entries: DataFrame, raw: str = "trusted_lma") -> DataFrame:
    """fid: 16 bytes after two numbers."""
    return entries.withColumn("fid", F.when(F.octet_length(raw) >= 24, F.substring(F.col(raw), 9, 16)))


def _plain_layout(raw: Column, at: Column) -> Column:
    """One component: magic, pattern, object id, stripe size and count, generation, a pool if it is the third form, then the objects."""
    magic, count = number(raw, at, 4), number(raw, at + 28, 2)
    third = magic == LOV_V3
    objects = at + F.when(third, 48).otherwise(32)
    pool = F.regexp_replace(F.decode(F.substring(raw, at + 33, F.lit(16)), "UTF-8"), "\\x00.*$", "")
    ost = F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)).cast("int") - 1), lambda i: number(raw, objects + i * 24 + 20, 4))).otherwise(F.array().cast("array<bigint>"))
    known = magic.isin(LOV_V1, LOV_V3)
    return F.when(known, F.struct(number(raw, at + 4, 4).alias("pattern"), number(raw, at + 24, 4).alias("stripe_size"), count.alias("stripe_count"), number(raw, at + 30, 2).alias("gen"), F.when(third, pool).otherwise(F.lit("")).alias("pool"), ost.alias("ost")))


def enrich_layout(entries: DataFrame, raw: str = "trusted_lov") -> DataFrame:
    """Stripes, pools, targets and extents of a layout; a composite one has a header of 32 bytes and one of 48 for each component."""
    c = F.col(raw)
    magic = number(c, 0, 4)
    composite = magic == LOV_COMPOSITE
    n = F.when(composite, number(c, 14, 2)).otherwise(F.lit(1)).cast("int")
    head = lambda i: F.lit(32) + i * 48
    start = lambda i: F.when(composite, number(c, head(i) + 24, 4)).otherwise(F.lit(0)).cast("int")
    # The components are a column of their own, so that they are decoded once.
    held = "_components"
    while held in entries.columns:
        held += "_"
    entries = entries.withColumn(held, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: _plain_layout(c, start(i))), lambda p: p.isNotNull()))
    parts = F.col(held)
    each = lambda name: F.when(F.size(parts) > 0, F.transform(parts, lambda p: p[name]))
    of_heads = lambda offset, size: F.when(composite & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: number(c, head(i) + offset, size)))
    end = F.transform(of_heads(16, 8), lambda e: F.coalesce(e, F.lit((1 << 63) - 1)))
    return entries.withColumns({
        "magic": magic, "gen": F.when(composite, number(c, 8, 4)).otherwise(F.get(parts, F.lit(0))["gen"]), "comp_count": F.when(composite, n.cast("bigint")), "mirror_count": F.when(composite, number(c, 16, 2) + 1),
        "comp_flags": of_heads(4, 4), "begin": of_heads(8, 8), "end": end,
        "pattern": each("pattern"), "stripe_size": each("stripe_size"), "stripe_count": each("stripe_count"), "pool": each("pool"), "ost": F.when(F.size(parts) > 0, F.flatten(F.transform(parts, lambda p: p["ost"]))),
    }).drop(held)
