"""Near-duplicate groups: fast similarity sketches, banding, exact verification.

The sketch has T coordinates. In round i every shingle goes to one coordinate
by a hash and leaves its hash value there; a coordinate keeps the smallest value
of the first round that reaches it. After T such rounds, round T + j sends all
shingles to coordinate j, so every coordinate is filled, and a text of n
shingles needs about T log(T) / n rounds. A value carries its round in its high
bits, so a coordinate simply keeps its smallest value, many rounds are done at
once for short texts, and rounds after the last needed one change nothing.
Coordinates agree with the
probability of the Jaccard similarity and concentrate like those of T
independent permutations.

Bands of ROWS coordinates make bucket keys. With 32 bands of 4 a pair at
similarity 0.8 shares no bucket with probability 5e-8. Links are confirmed on
the full shingle sets. No bucket is expanded into all its pairs: texts with
equal sets are one class; each class is first compared with the smallest class
of its buckets; components are found; only classes that share a bucket and are
still in different components are compared further, first with the ends of the
bucket and then with each other, and of those only pairs whose sizes and
digests allow the similarity. A digest holds two bits of each of 1,024
coordinates; at similarity 0.8 more than 216 differing coordinates would be 5.5
standard deviations off. A pair is compared in the first bucket it shares.

Defined results: a null or wordless text has no shingles and is alone; a text
with fewer words than a shingle is one shingle; rows with a null key are alone
and kept; rows with the same key are one document; extra columns are ignored
by `near_duplicates` and kept by `drop_near_duplicates`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, ship, unused
from .components import components
from .textops import LOWER, RollingHash, SpanHash, blocks, mix, words

T = 128
ROWS = 4
SHINGLE = 5
PERCENT = 80
#: Coordinates of the digest, and standard deviations by which two digests may differ more than expected.
DIGEST = 1024
DEVIATIONS = 5.5
#: Bits of the filter that lets texts without candidates pass by: eight for each candidate, within these bounds.
FILTER_BITS = (1 << 20, 1 << 30)
#: Pairs of one text that are compared in one task, about.
PAIRS_TOGETHER = 4096
#: Hash evaluations done at once in a sketch.
_AT_ONCE = 1 << 17
_ROUND_BITS = 12

_U = np.uint64
_EMPTY = np.iinfo(np.uint64).max


def shingle_sets(block, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, joined, and their offsets."""
    w = words(block)
    roll = RollingHash(SpanHash(LOWER[block.data])(w.start, w.end))
    h = roll.windows(k)
    first = np.searchsorted(w.doc, np.arange(block.n + 1))
    parts, sizes = [], np.zeros(block.n + 1, np.int64)
    for d in range(block.n):
        a, b = first[d], first[d + 1]
        if b - a >= k:
            s = np.sort(h[a : b - k + 1])
            s = s[np.concatenate(([True], s[1:] != s[:-1]))]
        elif b > a:
            s = roll.spans(np.array([a]), np.array([b]))
        else:
            continue
        parts.append(s)
        sizes[d + 1] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, _U)), np.cumsum(sizes)


def sketch(values: np.ndarray, offs: np.ndarray, t: int = T) -> np.ndarray:
    """The sketch of each set: an array (sets, t); rows of empty sets are all-ones."""
    n = len(offs) - 1
    out = np.full(n * t, _EMPTY, dtype=_U)
    live = np.repeat(np.arange(n), np.diff(offs)) * t
    x = values
    keys = mix(np.arange(1, 2 * t + 1, dtype=_U))
    shift = _U(64 - (t.bit_length() - 1))
    i = 0
    while len(x) and i < 2 * t:
        # Rounds up to t deal by hash, those after it by their number; a batch doesn't mix them.
        rounds = np.arange(i, min(t if i < t else 2 * t, i + max(1, _AT_ONCE // len(x))))
        h = mix(x[None, :] ^ keys[rounds][:, None])
        place = (h >> shift).astype(np.int64) if i < t else (rounds - t)[:, None]
        value = (h << _U(_ROUND_BITS)) >> _U(_ROUND_BITS)
        value |= rounds.astype(_U)[:, None] << _U(64 - _ROUND_BITS)
        np.minimum.at(out, (live[None, :] + place).ravel(), value.ravel())
        i = int(rounds[-1]) + 1
        open_ = np.flatnonzero(np.concatenate(([True], live[1:] != live[:-1])))
        gaps = (out.reshape(n, t)[live[open_] // t] == _EMPTY).any(axis=1)
        keep = np.repeat(gaps, np.diff(np.append(open_, len(live))))
        live, x = live[keep], x[keep]
    return out.reshape(n, t)


def sketch_column(text: Column, k: int, t: int = T, rows: int = ROWS) -> Column:
    """struct<n, s1, s2, bands, digest> of a text."""
    names = ["n", "s1", "s2", "bands", "digest"]
    bands = t // rows
    width = {"bands": bands, "digest": DIGEST // 32}

    @F.arrow_udf("n long, s1 long, s2 long, bands array<long>, digest array<long>")
    def make(batch: pa.Array) -> pa.Array:
        got = {c: [np.zeros((0, width[c]) if c in width else 0, np.int64)] for c in names}
        for b in blocks(batch, most=256):
            v, offs = shingle_sets(b, k)
            n = np.diff(offs)
            sums = np.zeros((2, len(v) + 1), _U)
            np.cumsum(mix(v), out=sums[0, 1:])
            np.cumsum(mix(v ^ _U(0x5851F42D4C957F2D)), out=sums[1, 1:])
            got["n"].append(n)
            for j, c in enumerate(("s1", "s2")):
                got[c].append((sums[j][offs[1:]] - sums[j][offs[:-1]]).view(np.int64))
            s = mix(sketch(v, offs, t))
            w = s.reshape(b.n, bands, rows)
            key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=_U)), (b.n, bands)).copy()
            for j in range(rows):
                key = mix(key * _U(0x9E3779B97F4A7C15) + w[:, :, j])
            got["bands"].append(key.view(np.int64))
            d = mix(sketch(v, offs, DIGEST)).reshape(b.n, DIGEST // 64, 64)
            at = np.arange(64, dtype=_U)
            bits = [np.bitwise_or.reduce(((d >> _U(k)) & _U(1)) << at, axis=2) for k in (0, 1)]
            got["digest"].append(np.concatenate(bits, axis=1).view(np.int64))
        flat = {c: np.concatenate(p) for c, p in got.items()}
        m = len(flat["n"])
        cols = [pa.ListArray.from_arrays(pa.array(np.arange(m + 1, dtype=np.int32) * width[c]), pa.array(flat[c].reshape(-1))) if c in width else pa.array(flat[c], pa.int64()) for c in names]
        return pa.StructArray.from_arrays(cols, names)

    return make(text)


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap with the hashes of the ids; what reaches the driver is at most the bitmap."""
    at = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1  # the bitmap functions count from 1
    rows = ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).toLocalIterator()
    out = np.zeros(bits // 8 + 4096, np.uint8)
    for r in rows:
        k = (r["k"] - 1) * 4096
        out[k : k + len(r["bits"])] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def shingle_table(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, shingles) of the documents with these ids and of few others; docs has columns id and text."""
    spark = docs.sparkSession
    least, most = FILTER_BITS
    size = min(most, max(least, 1 << (8 * ids.count()).bit_length()))
    bits = spark.sparkContext.broadcast(_bitmap(ids, size))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = bits.value
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((have[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            if batch.num_rows == 0:
                continue
            for b in blocks(batch.column(1)):
                v, offs = shingle_sets(b, k)
                yield pa.RecordBatch.from_arrays([batch.column(0)[b.lo : b.hi], pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(v.view(np.int64)))], ["id", "shingles"])

    rows = docs.where("id IS NOT NULL").select("id", "text", F.pmod(F.xxhash64("id"), F.lit(size)).alias("at"))
    return materialize(rows.mapInArrow(sets, "id long, shingles array<long>"))


def _with_sets(left: DataFrame, pairs: DataFrame, sets: DataFrame, mine: str, other: str, name: str, salts: int) -> DataFrame:
    """`left`, rows of pairs, with the sets of column `mine`. A set goes once to each salt of its partners, so a text with very many partners is spread."""
    salt = F.pmod(F.xxhash64(other), F.lit(salts)).alias("salt")
    places = pairs.select(mine, salt).distinct()
    dealt = places.join(sets.select(F.col("id").alias(mine), F.col("shingles").alias(name)), mine)
    return left.select("*", salt).join(dealt, [mine, "salt"]).drop("salt")


def verify(sets: DataFrame, pairs: DataFrame, percent: int = PERCENT, narrow: bool = False) -> DataFrame:
    """The pairs (a, b) of keys whose full shingle sets have the similarity.

    narrow: sets go by half their hash bits, with one per cent of slack for hashes that
    fall together: that loses no pair but may leave some too many.
    """
    if narrow:
        sets = sets.select("id", F.array_distinct(F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int"))).alias("shingles"))
    pairs = pairs.select("a", "b")
    salts = pairs.count() // PAIRS_TOGETHER + 16
    both = _with_sets(_with_sets(pairs, pairs, sets, "a", "b", "sa", salts), pairs, sets, "b", "a", "sb", salts)
    common = F.size(F.array_intersect("sa", "sb"))
    return both.where(F.lit(100) * common >= F.lit(percent - narrow) * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _near(percent: int) -> Column:
    """Whether sizes and digests of x and y allow the similarity."""
    words_ = DIGEST // 64
    half = lambda j: F.get("x.digest", F.lit(j)).bitwiseXOR(F.get("y.digest", F.lit(j)))
    off = sum((F.bit_count(half(j).bitwiseOR(half(words_ + j))) for j in range(words_)), F.lit(0))
    p = 0.75 * (100 - percent) / 100  # two bits of different values agree once in four times
    most = int(DIGEST * p + DEVIATIONS * (DIGEST * p * (1 - p)) ** 0.5)
    return (F.lit(100) * F.least("x.n", "y.n") >= F.lit(percent) * F.greatest("x.n", "y.n")) & (off <= most)


def _first_shared() -> Column:
    """Whether x and y share no bucket of an earlier band."""
    earlier = F.exists(F.sequence(F.lit(0), F.col("x.band") - 1), lambda j: F.get("x.bands", j) == F.get("y.bands", j))
    return (F.col("x.band") == 0) | ~earlier


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """key, n_shingles, component_id and kept for every row."""
    ship(df.sparkSession)
    docs = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    rows = materialize(docs.select("id", sketch_column(F.col("text"), shingle).alias("v")).select("id", "v.*"))
    full = rows.where("n > 0 AND id IS NOT NULL")
    classes = materialize(full.groupBy("n", "s1", "s2").agg(F.min("id").alias("rep")))
    members = full.select("id", "n", "s1", "s2").join(classes, ["n", "s1", "s2"]).where("id <> rep").select("id", "rep")
    reps = full.join(classes.select("n", "s1", "s2", F.col("rep").alias("id")), ["id", "n", "s1", "s2"], "left_semi").dropDuplicates(["id"])
    buckets = reps.select(F.col("id").alias("rep"), F.posexplode("bands").alias("band", "bucket"))
    ends = materialize(buckets.groupBy("bucket").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high"))
    shared = materialize(buckets.join(ends, "bucket"))
    marks = reps.select("id", "n", "digest")

    def plausible(pairs: DataFrame) -> DataFrame:
        x, y = (marks.select(*[F.col(c).alias("a" if c == "id" and s == "x" else "b" if c == "id" else c) for c in marks.columns]).alias(s) for s in "xy")
        return pairs.join(x, "a").join(y, "b").where(_near(percent)).select("a", "b")

    # Every class with the smallest class it may be linked with.
    stars = plausible(shared.where("rep <> low").select(F.col("low").alias("a"), F.col("rep").alias("b")).distinct())
    stars = materialize(stars)
    first = materialize(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
    sets = shingle_table(docs, shared.select(F.col("rep").alias("id")).distinct(), shingle)
    edges = materialize(verify(sets, first, percent))
    found = materialize(components(edges))

    # What else shares a bucket and is in another component: ends of buckets, then all.
    def apart(pairs: DataFrame) -> DataFrame:
        ca, cb = (found.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
        return pairs.join(ca, "a", "left").join(cb, "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)").select("a", "b")

    more = shared.where("rep <> high").select(F.col("rep").alias("a"), F.col("high").alias("b")).distinct()
    more = apart(stars.join(first, ["a", "b"], "left_anti").unionAll(plausible(more)).distinct())
    more = materialize(more)
    tried = first
    if not more.isEmpty():
        edges = materialize(edges.unionAll(verify(sets, more, percent)))
        found = materialize(components(edges))
        tried = first.unionAll(more)

    named = shared.select("bucket", "band", "rep").join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = named.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q")).where("p < q").select("bucket")
    open_ = materialize(named.join(materialize(mixed), "bucket", "left_semi").join(reps.select(F.col("id").alias("rep"), "n", "digest", "bands"), "rep"))
    x, y = open_.alias("x"), open_.alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.rep") < F.col("y.rep")) & (F.col("x.component") != F.col("y.component")) & _near(percent) & _first_shared())
    rest = rest.select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).join(tried, ["a", "b"], "left_anti")
    rest = materialize(rest)
    if not rest.isEmpty():
        likely = materialize(verify(sets, rest, percent, narrow=True))
        edges = materialize(edges.unionAll(verify(sets, likely, percent)))
        found = components(edges)

    # Classes carry their component to their members.
    groups = materialize(found.select("node", "component"))
    by_member = members.join(groups.withColumnRenamed("node", "rep"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    by_rep = groups.where("node <> component").select(F.col("node").alias("id"), "component")
    moved = by_member.unionAll(by_rep).groupBy("id").agg(F.min("component").alias("component"))
    out = rows.select("id", "n").join(moved, "id", "left")
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.coalesce(F.col("component").isNull() | (F.col("component") == F.col("id")), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row of each group, the one with the smallest key; columns as they are."""
    found = near_duplicates(df, key, text, shingle, percent)
    gone = unused(df, "_gone")
    return df.join(found.where("NOT kept").select(F.col(key).alias(gone)).distinct(), F.col(f"`{key}`").cast("long") == F.col(gone), "left_anti")
