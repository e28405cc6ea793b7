"""Document fingerprints: bottom-k sketches of shingle hashes, in Spark functions only.

A fingerprint holds the k smallest distinct hashes of a text's five-word
shingles, in order. Fingerprints of parts merge into the fingerprint of the
whole; two of them give estimates of resemblance, containment and of the number
of distinct shingles, all exact while a set has fewer than k shingles.

Defined results: a null or wordless text has an empty fingerprint; a text with
fewer words than a shingle is one shingle; two empty fingerprints resemble each
other fully, an empty and another not at all; equal texts have equal
fingerprints. In `with_edited` a row with a null key has no next document, so
what its edited text loses isn't replaced; rows with equal keys are ordered by
text and follow one another. `merge_all` gives every group a fingerprint, an
empty one where all its texts are null or wordless. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import unused

SIZE = 128
SHINGLE = 5
#: Ranges of consecutive keys, in which the next document is found; their table of firsts is broadcast.
MOST_RANGES = 65_536
RANGE_ROWS = 64
#: Rows that one task compares with their next rows, about.
TASK_ROWS = 20_000
#: Parts that rows without a key are dealt into.
KEYLESS = 4_096
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Hashes of all k-word windows of a text, as array<bigint>."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), _SPACE), lambda w: w != "")

    def windows(h: Column) -> Column:
        n = F.size(h)
        whole = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
        return F.when(n >= k, whole).when(n > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), windows)


def bottom_k(hashes: Column, size: int = SIZE) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, size)


def fingerprint(text: Column, size: int = SIZE, k: int = SHINGLE) -> Column:
    """The sketch of a text: at most `size` hashes in ascending order."""
    return bottom_k(shingle_hashes(text, k), size)


def merge(a: Column, b: Column, size: int = SIZE) -> Column:
    """The sketch of the union of two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, size)


def merge_all(df: DataFrame, by: list[str], sketch: str = "sketch", size: int = SIZE) -> DataFrame:
    """One sketch for each group: rank hashes, not rows, so a hot group is pre-reduced on the map side.

    Groups are first reduced within salts, then over them; each step keeps `size` hashes.
    """
    one, salt, some = (unused(df, c) for c in ("_hash", "_salt", "_some"))
    h = df.select(*by, F.explode_outer(sketch).alias(one), F.pmod(F.hash(sketch), F.lit(64)).alias(salt)).distinct()
    parts = h.groupBy(*by, salt).agg(F.slice(F.sort_array(F.collect_set(one)), 1, size).alias(some))
    return parts.groupBy(*by).agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list(some)))), 1, size).alias(sketch))


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated Jaccard similarity of two sketches."""
    return let(merge(a, b, size), lambda u: F.when(F.size(u) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(u, F.array_intersect(a, b))) / F.size(u)))


def distinct_shingles(a: Column, size: int = SIZE) -> Column:
    """Estimated number of distinct shingles; exact below `size`."""
    top = F.get(a, F.lit(size - 1)).cast("double") + F.lit(2.0**63)
    return F.when(F.size(a) < size, F.size(a).cast("double")).otherwise(F.lit((size - 1) * 2.0**64) / top)


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of a's shingles that b has."""
    union = distinct_shingles(merge(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, size) * union / distinct_shingles(a, size)))


def as_text(a: Column) -> Column:
    """A sketch as hexadecimal text, 16 digits a hash."""
    return F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def from_text(text: Column) -> Column:
    """The sketch that as_text() wrote."""
    at = F.transform(F.sequence(F.lit(0), (F.length(text) / 16).cast("int") - 1), lambda i: F.substring(text, i * 16 + 1, F.lit(16)))
    high = lambda x: F.conv(F.substring(x, 1, 8), 16, 10).cast("bigint")
    low = lambda x: F.conv(F.substring(x, 9, 8), 16, 10).cast("bigint")
    return F.when(F.length(text) == 0, F.array().cast("array<bigint>")).otherwise(F.transform(at, lambda x: F.shiftleft(high(x), 32).bitwiseOR(low(x))))


def _range_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds at or below the key, by binary search in a constant array."""
    table = F.lit(bounds) if bounds else F.array().cast("array<bigint>")
    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        up = F.get(table, middle) <= key
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & up, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~up, middle).otherwise(acc["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda acc: acc["low"])


def with_next(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Each row with next_<column> of the row with the next larger key; the last row gets the first's.

    Keys are cut into ranges at quantiles, so outliers and gaps make no range
    large. A range's first row is also sent to the range before it, so one
    exchange by range, of any number of rows, and a window inside each range are
    enough. Rows with a null key have no next row.
    """
    keyed = df.where(F.col(key).isNotNull())
    n = keyed.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    cuts = [k / ranges for k in range(1, ranges)]
    accuracy = min(6 * ranges + 100, 400_000)
    bounds = sorted(set(keyed.agg(F.percentile_approx(key, F.lit(cuts), F.lit(accuracy))).first()[0] or [])) if cuts else []
    at_, first_, before_, guest_, to_ = (unused(df, c) for c in ("_at", "_first", "_before", "_guest", "_to"))
    at = F.when(F.col(key).isNotNull(), _range_of(F.col(key), bounds)).otherwise(-1 - F.pmod(F.xxhash64(*columns), F.lit(KEYLESS)).cast("int"))
    rows = df.withColumn(at_, at)
    firsts = rows.where(F.col(key).isNotNull()).groupBy(at_).agg(F.min(key).alias(first_))  # at most MOST_RANGES rows
    w = Window.orderBy(at_)
    firsts = firsts.select(first_, F.lag(at_).over(w).alias(before_), F.max(at_).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_last"))
    firsts = firsts.select(first_, F.coalesce(before_, "_last").alias(before_), F.when(F.col(before_).isNull(), 2).otherwise(1).alias(guest_))
    rows = rows.join(F.broadcast(firsts), F.col(key) == F.col(first_), "left")
    home = F.struct(F.col(at_).alias("at"), F.lit(0).alias("guest"))
    away = F.struct(F.col(before_).alias("at"), F.col(guest_).alias("guest"))
    rows = rows.withColumn(to_, F.explode(F.when(F.col(first_).isNull(), F.array(home)).otherwise(F.array(home, away))))
    tasks = n // TASK_ROWS
    if tasks > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        rows = rows.repartition(tasks, F.col(f"{to_}.at"))
    w = Window.partitionBy(f"{to_}.at").orderBy(f"{to_}.guest", key, *columns[:1])
    rows = rows.withColumns({f"next_{c}": F.when(F.col(key).isNotNull(), F.lead(c).over(w)) for c in columns})
    return rows.where(f"{to_}.guest = 0").drop(at_, first_, before_, guest_, to_)


def with_edited(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, k: int = SHINGLE) -> DataFrame:
    """Sketches of each text, of its edited text and of the next text, with the edited text."""
    rows = df.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = with_next(rows.withColumn("sketch", fingerprint(F.col("text"), size, k)), "doc_id", "text", "sketch")
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = rows.select("doc_id", n.cast("long").alias("n_chars"), "sketch", F.coalesce("next_sketch", F.array().cast("array<bigint>")).alias("next_sketch"), edited.alias("edited"))
    return out.withColumn("edited_sketch", fingerprint(F.col("edited"), size, k))


def fingerprint_report(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_shingles, contained_edited."""
    rows = with_edited(df, key, text, size, k)
    a, b = F.col("sketch"), F.col("edited_sketch")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), as_text(a).alias("fingerprint"), as_text(b).alias("edited_fingerprint"),
        resemblance(a, b, size).alias("near_edited"), resemblance(a, F.col("next_sketch"), size).alias("near_next"),
        distinct_shingles(a, size).alias("n_shingles"), containment(b, a, size).alias("contained_edited"),
    )
