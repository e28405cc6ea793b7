"""Importance resampling towards a target: hashed n-gram models and Gumbel top-k.

Two bag-of-hashed-n-grams models are fitted, one on all texts and one on the
target rows. A text's log weight is the sum over its n-grams of the log ratio
of the models. Adding Gumbel noise and keeping the k largest keys draws k texts
without replacement in proportion to their weights; the noise comes from a hash
of the row's key, so the draw is the same on every run and every cluster.

`temper` is off by default. With it the key uses the mean log ratio of a text
times `temper`, as if every text had that many n-grams; rows are then no longer
drawn in proportion to the ratio of the models.

Defined results: a null or blank text has no n-grams, a null log weight and is
never kept; rows equal to the k-th key are all kept (repeated rows tie); with no
target rows every weight is zero and the draw is uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, materialize, ship, unused
from .textops import LOWER, Block, RollingHash, SpanHash, blocks, words

BUCKETS = 10_000
NGRAMS = (1, 2)
#: At most so many labelled rows make the target model; they are chosen by hash.
TARGET_ROWS = 20_000
_SCALE = float(1 << 20)


def features(block: Block, ngrams: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and bucket of every n-gram of a block."""
    w = words(block)
    roll = RollingHash(SpanHash(LOWER[block.data])(w.start, w.end))
    docs, bins = [], []
    for n in ngrams:
        h = roll.windows(n)
        whole = np.flatnonzero(w.doc[: len(h)] == w.doc[n - 1 :]) if len(h) else np.zeros(0, np.int64)
        docs.append(w.doc[whole])
        bins.append(((h[whole] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(docs), np.concatenate(bins)


def count_models(df: DataFrame, key: str, text: str, target_keys: np.ndarray, ngrams: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """n-grams by bucket of all texts, and of the rows whose key is in target_keys.

    Each task sends one count a bucket; what reaches the driver has `buckets` rows.
    """
    ship(df.sparkSession)
    targets = np.unique(np.asarray(target_keys, dtype=np.int64))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, aim = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            keys = batch.column(0)
            mine = np.isin(keys.fill_null(0).to_numpy(), targets) & keys.is_valid().to_numpy(zero_copy_only=False)
            for b in blocks(batch.column(1)):
                doc, bins = features(b, ngrams, buckets)
                raw += np.bincount(bins, minlength=buckets)
                aim += np.bincount(bins[mine[b.lo : b.hi][doc]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(aim[used])], ["bucket", "raw", "aim"])

    rows = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(count, "bucket long, raw long, aim long")
    raw, aim = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("aim").alias("aim")).collect():
        raw[r["bucket"]], aim[r["bucket"]] = r["raw"], r["aim"]
    return raw, aim


def log_ratio(raw: np.ndarray, aim: np.ndarray) -> np.ndarray:
    """Log of the target's over all texts' smoothed bucket probabilities."""
    if aim.sum() == 0:
        return np.zeros(len(raw))
    # The prior of the target model is the raw model, so an unseen bucket is neutral.
    prior = (raw + 1.0) / (raw + 1.0).sum()
    strength = float(len(raw))
    return np.log((aim + strength * prior) / (aim.sum() + strength)) - np.log(prior)


def weight_column(text: Column, ratio: np.ndarray, ngrams: tuple[int, ...] = NGRAMS) -> Column:
    """struct<n_ngrams, log_weight> of a text."""
    buckets = len(ratio)

    @F.arrow_udf("n_ngrams long, log_weight double")
    def weigh(batch: pa.Array) -> pa.Array:
        n, total = [np.zeros(0, np.int64)], [np.zeros(0)]
        for b in blocks(batch):
            doc, bins = features(b, ngrams, buckets)
            n.append(np.bincount(doc, minlength=b.n))
            total.append(np.bincount(doc, weights=ratio[bins], minlength=b.n))
        count, weight = np.concatenate(n), np.concatenate(total)
        return pa.StructArray.from_arrays([pa.array(count, pa.int64()), pa.array(weight, mask=count == 0)], ["n_ngrams", "log_weight"])

    return weigh(text)


def kth_largest(df: DataFrame, value: str, k: int) -> int | None:
    """The k-th largest of a long column; None if there are fewer values. Exact.

    Narrows the range by counting at most 65,536 equal bins of it at a time.
    """
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if k <= 0 or n < k:
        return None
    while high > low:
        width = (int(high) - int(low)) // 65_536 + 1
        inside = df.where(F.col(value).between(low, high))
        bins = inside.groupBy(F.floor((F.col(value) - low) / F.lit(width)).alias("bin")).count().collect()
        for r in sorted(bins, key=lambda r: -r["bin"]):
            if r["count"] >= k:
                low, high = low + r["bin"] * width, min(high, low + (r["bin"] + 1) * width - 1)
                break
            k -= r["count"]
        if width == 1:
            high = low
    return int(low)


def resample(df: DataFrame, target_keys: np.ndarray, keep: float, key: str = "doc_id", text: str = "text", temper: float | None = None, seed: int = 29, ngrams: tuple[int, ...] = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """key, n_ngrams, log_weight, gumbel_key and kept for every row; the share `keep` of the rows is kept."""
    raw, aim = count_models(df, key, text, target_keys, ngrams, buckets)
    held = unused(df, "_dsir")
    scored = df.select(F.col(f"`{key}`").alias(key), weight_column(F.col(f"`{text}`"), log_ratio(raw, aim), ngrams).alias(held))
    noise = -F.log(-F.log((hash_unit(f"{seed}", F.col(f"`{key}`").cast("string")) + F.lit(2.0**-53))))
    n, w = F.col(held)["n_ngrams"], F.col(held)["log_weight"]
    exponent = w if temper is None else w / n * temper
    scored = scored.select(key, n.alias("n_ngrams"), w.alias("log_weight"), (exponent + noise).alias("gumbel_key"))
    rank = unused(scored, "_rank")
    scored = materialize(scored.withColumn(rank, F.round(F.col("gumbel_key") * _SCALE).cast("long")))
    k = int(round(keep * scored.count()))
    cut = kth_largest(scored, rank, k)
    keeps = F.lit(False) if k <= 0 else F.col(rank).isNotNull() if cut is None else F.col(rank) >= cut
    return scored.withColumn("kept", F.coalesce(keeps, F.lit(False))).drop(rank)


def target_sample(labels: DataFrame, key: str = "doc_id", good: str = "quality = 1", rows: int = TARGET_ROWS) -> tuple[np.ndarray, float]:
    """Keys of a bounded sample of the good rows, chosen by hash, and the share of good rows."""
    n, of = labels.agg(F.count_if(F.expr(good)), F.count(F.lit(1))).first()
    if n == 0:
        return np.zeros(0, np.int64), 0.0 if of else 1.0
    # A hash below a threshold leaves about 1.5 times the rows wanted, so that no task sends more than its part of them.
    unit = F.pmod(F.xxhash64(key), F.lit(1 << 30))
    near = labels.where(good).where(f"{key} IS NOT NULL").select(key, unit.alias("h")).where(F.col("h") < F.lit(int(min(1.0, 1.5 * rows / n + 0.001) * (1 << 30))))
    picked = near.orderBy("h", key).limit(rows).toPandas()[key]
    return picked.to_numpy(np.int64), n / of
