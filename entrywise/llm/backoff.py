"""Stupid-backoff language-model scores of a corpus under its own n-gram counts.

Texts are dealt out in chunks of a few megabytes. Each chunk explodes its texts
into n-grams of all orders and lists the distinct ones with their counts, by
64-bit hash, cut by the hash into parts. The parts are the count tables: grouped
by part, the lists are added up and every list gets its totals. Grouped again
by chunk, the totals are joined to the chunk's n-grams and the scores of each
text are summed.

A frequent n-gram is one entry of a chunk's list however often it occurs, so no
part is hot, and what travels grows with the corpus and not with the frequency
of a word. Lists are sorted and stored as differences; a row for each n-gram
would take more disk than the corpus allows (README).

    S(w | u v) = c(u v w) / c(u v)        if c(u v w) >= min_count
               = alpha * S(w | v)         else, and so on down to
    S(w)       = c(w) / N

Words are lower-cased in A-Z. Defined results: a null or wordless text has
n_words 0 and null scores; repeated rows are counted and scored each; extra
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship
from .textops import LOWER, Block, RollingHash, SpanHash, blocks, words

CHUNK_BYTES = 4 << 20
#: Bytes of text for each part of the count tables, the fewest parts, and bytes of text for each task that scores.
PART_BYTES = 4 << 20
FEWEST_PARTS = 64
TASK_BYTES = 32 << 20
ALPHA = 0.4
#: Bits of a listed hash that are stored as they are; the others are stored as differences.
_LOW_BITS = 40
_U = np.uint64
_zip = zstandard.ZstdCompressor(level=1).compress
_unzip = zstandard.ZstdDecompressor().decompress


def seal(zipped: np.ndarray, plain: bytes) -> bytes:
    """Compressed numbers (their first bytes, then their second bytes, ...), then plain bytes."""
    body = _zip(np.ascontiguousarray(zipped.view(np.uint8).reshape(len(zipped), -1).T).tobytes())
    return len(body).to_bytes(4, "little") + body + plain


def unseal(sealed: bytes, kind: str) -> tuple[np.ndarray, bytes]:
    end = 4 + int.from_bytes(sealed[:4], "little")
    planes = np.frombuffer(_unzip(sealed[4:end]), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind), sealed[end:]


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys."""
    high = keys >> _U(_LOW_BITS)
    step = np.diff(high, prepend=_U(0)).astype("<u4")
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, : _LOW_BITS // 8]
    return seal(step, np.ascontiguousarray(low).tobytes())


def unpack_keys(sealed: bytes) -> np.ndarray:
    step, plain = unseal(sealed, "<u4")
    out = np.zeros((len(step), 8), np.uint8)
    out[:, : _LOW_BITS // 8] = np.frombuffer(plain, np.uint8).reshape(len(step), -1)
    return out.reshape(-1).view("<u8") | np.cumsum(step, dtype=_U) << _U(_LOW_BITS)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts, of which most are small."""
    return seal(np.minimum(counts, 255).astype("u1"), counts[counts >= 255].astype("<i8").tobytes())


def unpack_counts(sealed: bytes) -> np.ndarray:
    small, plain = unseal(sealed, "u1")
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(plain, "<i8")
    return out


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of consecutive texts: keys, offsets and bytes, compressed."""
    task = TaskContext.get()
    chunk = (task.partitionId() if task else 0) << 32
    zip_ = zstandard.ZstdCompressor(level=9).compress
    keys, sizes, data, held = [], [], [], 0

    def made() -> pa.RecordBatch:
        nulls = np.concatenate([k.is_null().to_numpy(zero_copy_only=False) for k in keys])
        ids = np.concatenate([k.fill_null(0).to_numpy() for k in keys])
        head = ids.astype("<i8").tobytes() + nulls.astype("u1").tobytes() + np.concatenate(sizes).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([chunk]), pa.array([len(ids)]), pa.array([zip_(head)], pa.binary()), pa.array([zip_(np.concatenate(data).tobytes())], pa.binary())], ["chunk", "n_texts", "head", "body"])

    for batch in batches:
        for b in blocks(batch.column(1), CHUNK_BYTES):
            if keys and held + len(b.data) > CHUNK_BYTES:
                yield made()
                chunk += 1
                keys, sizes, data, held = [], [], [], 0
            keys.append(batch.column(0)[b.lo : b.hi])
            sizes.append(np.diff(b.offs))
            data.append(b.data)
            held += len(b.data)
    if keys:
        yield made()


def unpack(n: int, head: bytes, body: bytes) -> tuple[np.ndarray, np.ndarray, Block]:
    h = _unzip(head)
    ids, nulls, sizes = np.frombuffer(h, "<i8", n), np.frombuffer(h, "u1", n, 8 * n), np.frombuffer(h, "<i8", n, 9 * n)
    offs = np.concatenate(([0], np.cumsum(sizes)))
    return ids, nulls.astype(bool), Block(0, n, np.frombuffer(_unzip(body), np.uint8) if offs[-1] else np.zeros(0, np.uint8), offs)


def ngram_keys(block: Block, order: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The text of each word; for each order the key of the n-gram that starts at each word, 0 where it would leave the text."""
    w = words(block)
    roll = RollingHash(SpanHash(LOWER[block.data])(w.start, w.end))
    out = []
    for n in range(1, order + 1):
        keys = np.zeros(len(w.doc), _U)
        h = roll.windows(n)
        whole = w.doc[: len(h)] == w.doc[n - 1 :] if len(h) else np.zeros(0, bool)
        keys[: len(h)] = np.where(whole, np.maximum(h, _U(1)), _U(0))
        out.append(keys)
    return w.doc, out


def _lists(keys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate(keys)
    return np.unique(flat[flat > 0], return_counts=True)


def score_texts(doc: np.ndarray, counts: list[np.ndarray], n_texts: int, total: int, alpha: float, min_count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, backed-off words and summed log score of each text; counts as ngram_keys gives keys."""
    m = len(doc)
    order = len(counts)
    place = np.arange(m) - np.searchsorted(doc, doc) if m else np.zeros(0, np.int64)
    log = np.zeros(m)
    done = np.zeros(m, bool)
    steps = np.zeros(m, np.int64)
    for n in range(order, 0, -1):
        can = ~done & (place >= n - 1)
        i = np.flatnonzero(can)
        c = counts[n - 1][i - (n - 1)]
        hit = c >= min_count if n > 1 else np.ones(len(i), bool)
        j = i[hit]
        below = counts[n - 2][j - (n - 1)] if n > 1 else np.full(len(j), total)
        log[j] = np.log(c[hit] / below) + steps[j] * np.log(alpha)
        done[j] = True
        steps[i[~hit]] += 1
    tally = lambda w=None: np.bincount(doc, weights=w, minlength=n_texts)
    return tally().astype(np.int64), tally((steps > 0).astype(float)).astype(np.int64), tally(log).astype(float)  # bincount of nothing is whole numbers


def corpus_size(df: DataFrame, text: str) -> tuple[int, int]:
    """Bytes and words of all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = n = 0
        for batch in batches:
            for b in blocks(batch.column(0)):
                size += len(b.data)
                n += len(words(b).start)
        yield pa.RecordBatch.from_arrays([pa.array([size]), pa.array([n])], ["size", "n"])

    rows = df.select(F.col(f"`{text}`").alias("t")).mapInArrow(count, "size long, n long")
    return tuple(x or 0 for x in rows.agg(F.sum("size"), F.sum("n")).first())


def backoff_scores(df: DataFrame, key: str = "doc_id", text: str = "text", order: int = 3, alpha: float = ALPHA, min_count: int = 2) -> DataFrame:
    """key, n_words, n_backoff, log_score (sum of natural logs) and mean_log for every row."""
    spark = df.sparkSession
    ship(spark)
    size, total_words = corpus_size(df, text)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(FEWEST_PARTS, -(-size // PART_BYTES) - 1).bit_length()
    packed = df.select(F.col(f"`{key}`").cast("long").alias("k"), F.col(f"`{text}`").alias("t")).mapInArrow(pack, "chunk long, n_texts long, head binary, body binary")
    # One exchange, of which both the lists and the scores read.
    chunks = packed.repartition(max(least, size // TASK_BYTES), "chunk")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, n, head, body in zip(*(batch.column(i) for i in range(4))):
                keys, counts = _lists(ngram_keys(unpack(n.as_py(), head.as_py(), body.as_py())[2], order)[1])
                if len(keys) == 0:
                    continue
                part = (keys >> _U(64 - bits)).astype(np.int64)
                cuts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True])))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]]), pa.array([chunk.as_py()] * len(spans), pa.int64()), pa.array([pack_keys(keys[a:b]) for a, b in spans], pa.binary()), pa.array([pack_counts(counts[a:b]) for a, b in spans], pa.binary())], ["part", "chunk", "keys", "counts"])

    def add_up(lists: pa.Table) -> pa.Table:
        keys = [unpack_keys(k.as_py()) for k in lists["keys"]]
        own = np.concatenate([unpack_counts(c.as_py()) for c in lists["counts"]])
        _, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(at, weights=own).astype(np.int64)[at]
        ends = np.cumsum([len(k) for k in keys])
        totals = [pack_counts(total[e - len(k) : e]) for k, e in zip(keys, ends)]
        return pa.table({"chunk": lists["chunk"], "part": lists["part"], "totals": pa.array(totals, pa.binary())})

    asked = chunks.mapInArrow(ask, "part long, chunk long, keys binary, counts binary")
    asked = asked.repartition(max(least, 1 << bits), "part")
    totals = asked.groupBy("part").applyInArrow(add_up, "chunk long, part long, totals binary")

    def score(own: pa.Table, found: pa.Table) -> pa.Table:
        n = own["n_texts"][0].as_py()
        ids, nulls, block = unpack(n, own["head"][0].as_py(), own["body"][0].as_py())
        doc, keys = ngram_keys(block, order)
        known = _lists(keys)[0]
        answers = [unpack_counts(t.as_py()) for t in found.sort_by("part")["totals"]]
        total = np.concatenate([np.zeros(0, np.int64), *answers])
        if len(total) != len(known):
            raise RuntimeError("the counts don't fit the texts: the table gave other rows when it was read again")
        counts = []
        for k in keys:
            at = np.searchsorted(known, k)
            counts.append(np.where(k > 0, total[np.minimum(at, max(0, len(known) - 1))] if len(known) else 0, 0))
        n_words, backed, log = score_texts(doc, counts, n, total_words, alpha, min_count)
        none = n_words == 0
        return pa.table({"k": pa.array(ids, pa.int64(), mask=nulls), "n_words": n_words, "n_backoff": backed, "log_score": pa.array(log, mask=none), "mean_log": pa.array(log / np.maximum(n_words, 1), mask=none)})

    out = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInArrow(score, "k long, n_words long, n_backoff long, log_score double, mean_log double")
    return out.withColumnRenamed("k", key)
