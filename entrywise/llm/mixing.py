"""Mixing sources to target weights by Poisson replication.

A source's rate is its target share of the output divided by its share of the
input. Each row gets a Poisson number of copies with that mean, by inverting
the distribution at a uniform number from a hash of its key, so the mixture is
the same on every run. The copies are dealt to partitions and ordered there by
another hash: a global shuffle. A mean above PIECE_RATE is the sum of as many
Poisson numbers of smaller means, each from a hash of its own, so any rate will
do; the pieces of such rows are dealt out before they become copies.

Defined results: a null source is a source of its own; a source without a
target weight gets none of the output; rows with equal keys get equal numbers
of copies; a row without a key draws by a hash of all its columns, so such rows
neither share one number nor land in one partition; extra columns are kept, but
one that has the name given as `copy` is replaced; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hash_unit, unused

#: Sources up to this number are broadcast with their distributions; more are joined by a shuffle.
BROADCAST_SOURCES = 2_000
#: The largest mean number of copies that is drawn at once.
PIECE_RATE = 500.0
#: With a larger mean the numbers of copies are longs.
LARGEST_INT = 2e9


def counted(df: DataFrame, source: str, most: int) -> tuple[DataFrame, bool]:
    """(source, n) for each source, and whether they are few; the counts of few sources are kept, so the rows are counted once."""
    counts = df.groupBy(F.col(f"`{source}`").alias("source")).agg(F.count(F.lit(1)).alias("n"))
    first = counts.limit(most + 1).collect()
    if len(first) > most:
        return counts, False
    return df.sparkSession.createDataFrame(first, counts.schema), True


def rates(counts: DataFrame, weights: dict[str | None, float] | None, ratio: float = 1.0) -> DataFrame:
    """(source, rate) for each counted source; no weights: all sources alike. ratio: output rows for an input row."""
    if weights is None:
        weighed = counts.withColumn("w", F.lit(1.0))
    else:
        w = F.lit(0.0)
        for name, value in weights.items():
            w = F.when(F.col("source").isNull() if name is None else F.col("source") == name, F.lit(float(value))).otherwise(w)
        weighed = counts.withColumn("w", w)
    rows, weight = weighed.agg(F.sum("n"), F.sum("w")).first()
    return weighed.select("source", F.coalesce(F.try_divide(F.col("w") * F.lit((rows or 0) * ratio), F.col("n") * F.lit(weight or 0.0)), F.lit(0.0)).alias("rate"))


def poisson_steps(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... until it can't be told from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("steps"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * rate / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.array_append(acc["steps"], acc["c"] + p).alias("steps"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["steps"])


def mix_sources(df: DataFrame, weights: dict[str | None, float] | None = None, source: str = "source", key: str = "doc_id", ratio: float = 1.0, seed: int = 41, copy: str | None = None, broadcast: int = BROADCAST_SOURCES) -> DataFrame:
    """Copies of the rows, shuffled; `copy` names a column for the number of the copy, from 1."""
    counts, few = counted(df, source, broadcast)
    rate = rates(counts, weights, ratio)
    top = rate.agg(F.max("rate")).first()[0] or 0.0
    name, steps, pieces, n, run, order = (unused(df, x) for x in ("_src", "_steps", "_pieces", "_copies", "_run", "_order"))
    number = copy or unused(df, "_copy")
    df = df.drop(number)
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / F.lit(PIECE_RATE)).cast("int"))
    table = rate.select(F.col("source").alias(name), poisson_steps(F.col("rate") / parts).alias(steps), parts.alias(pieces))
    plain = [f"`{c}`" for c, t in df.dtypes if "map" not in t]
    text = F.coalesce(F.col(f"`{key}`").cast("string"), F.xxhash64(F.lit("no key"), *plain).cast("string"))

    def copies(drawn: Column) -> Column:
        return F.size(F.filter(F.col(steps), lambda c: c <= drawn))

    rows = df.join(F.broadcast(table) if few else table, F.col(f"`{source}`").eqNullSafe(F.col(name)))
    once = rows.where(F.col(pieces) == 1) if top > PIECE_RATE else rows
    once = once.withColumn(n, copies(hash_unit(f"{seed}", text))).drop(name, steps, pieces).where(F.col(n) > 0)
    out = once.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(n)))).drop(n)
    if top > PIECE_RATE:
        # One row can have more copies than a task should write: they are dealt out as runs of numbers first.
        whole = "long" if top > LARGEST_INT else "int"
        each = F.lit(int(PIECE_RATE)).cast("long")
        drawn = F.aggregate(F.sequence(F.lit(1), F.col(pieces)), F.lit(0).cast("long"), lambda acc, k: acc + copies(hash_unit(F.concat(F.lit(f"{seed}/"), k.cast("string")), text)))
        often = rows.where(F.col(pieces) > 1).withColumn(n, drawn).drop(name, steps, pieces).where(F.col(n) > 0)
        often = often.withColumn(run, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n), each))).repartition(text, F.col(run))
        numbers = F.sequence(F.col(run), F.least(F.col(n), F.col(run) + each - 1))
        often = often.withColumn(number, F.explode(numbers.cast(f"array<{whole}>"))).drop(n, run)
        out = out.unionByName(often)
    out = out.withColumn(order, F.xxhash64(F.lit(seed), text, F.col(number)))
    out = out.repartition(order).sortWithinPartitions(order).drop(order)
    return out if copy else out.drop(number)
