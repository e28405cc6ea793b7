"""Quality rules from repetition: how many characters lie inside repeated n-grams and lines.

Every text is read once. Rolling hashes of the word sequence give the hash of
each n-word window at constant cost for any n; a window is repeated if its hash
occurs twice in the same text. Coverage counts the characters of the words that
lie in at least one repeated window, and of those in repeated lines.

Defined results: a null or blank text has no words, zero counts and fails the
base rule; repeated rows are judged independently; extra columns are kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, unused
from .textops import Block, RollingHash, SpanHash, blocks, mix, repeated, words

#: Window lengths, and the largest share of a text's word characters that may lie in repeated windows.
NGRAM_LIMITS = {5: 0.35, 6: 0.34, 7: 0.33, 8: 0.32, 9: 0.31, 10: 0.30}
#: The largest share of word characters that may lie in lines equal to an earlier line.
LINE_LIMIT = 0.30
#: The largest share of characters that may be symbols.
SYMBOL_LIMIT = 0.10

_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars"]


def _per_text(block: Block, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[block.offs[1:]] - total[block.offs[:-1]]


def measure(block: Block, ngrams: tuple[int, ...]) -> dict[str, np.ndarray]:
    """The counts of FIELDS and dup_chars_<n> for each text of a block."""
    n = block.n
    w = words(block)
    count = lambda mask_or_docs, weights=None: np.bincount(mask_or_docs, weights=weights, minlength=n).astype(np.int64)
    out = {"n_words": count(w.doc), "n_symbols": _per_text(block, _SYMBOL[block.data])}
    points = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
    chars = points[w.end] - points[w.start]
    out["word_chars"] = count(w.doc, chars)
    span = SpanHash(block.data)
    salt = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25))

    # Lines: a repeated line counts from its second occurrence on.
    size = len(block.data)
    starts = np.unique(np.concatenate((block.offs[:-1], np.flatnonzero(block.data == 10) + 1)))
    starts = starts[starts < size]
    ends = np.append(starts[1:], size)
    if len(starts):
        ends = ends - (block.data[ends - 1] == 10)
    a, b = np.searchsorted(w.start, starts), np.searchsorted(w.start, ends)
    full = b > a
    starts, ends, a, b = starts[full], ends[full], a[full], b[full]
    line_doc = np.searchsorted(block.offs, starts, "right") - 1
    keys = span(starts, ends) ^ salt[line_doc]
    dup_line = np.zeros(len(keys), bool)
    twice = np.flatnonzero(repeated(keys))
    if len(twice):
        _, first = np.unique(keys[twice], return_index=True)
        dup_line[twice] = True
        dup_line[twice[first]] = False
    out["n_dup_lines"] = count(line_doc[dup_line])
    so_far = np.zeros(len(chars) + 1, np.int64)
    np.cumsum(chars, out=so_far[1:])
    out["dup_line_chars"] = count(line_doc[dup_line], (so_far[b] - so_far[a])[dup_line])

    # Windows of n words.
    roll = RollingHash(span(w.start, w.end))
    for k in (3, *ngrams):
        keys = roll.windows(k)
        m = len(keys)
        cover = np.zeros(len(w.doc) + 1, np.int64)
        if m:
            whole = np.flatnonzero(w.doc[:m] == w.doc[k - 1 :])
            hit = whole[repeated(keys[whole] ^ salt[w.doc[whole]])]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + k, -1)
        covered = np.cumsum(cover)[:-1] > 0
        if k == 3:
            out["n_repeat_words"] = count(w.doc[covered])
        if k in ngrams:
            out[f"dup_chars_{k}"] = count(w.doc[covered], chars[covered])
    return out


def repetition_column(text: Column, ngrams: tuple[int, ...] = tuple(NGRAM_LIMITS)) -> Column:
    """A struct of the counts for a text column."""
    names = [*FIELDS, *(f"dup_chars_{k}" for k in ngrams)]

    @F.arrow_udf(", ".join(f"{c} long" for c in names))
    def counts(batch: pa.Array) -> pa.Array:
        parts = [measure(b, ngrams) for b in blocks(batch)]
        cols = [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64) for c in names]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], names)

    return counts(text)


def _verdict(counts: Column, limits: dict[int, float], min_words: int, line_limit: float, symbol_limit: float) -> tuple[Column, Column]:
    """Whether the base rule fails, and whether the text is kept."""
    base = (counts["n_words"] < min_words) | (F.lit(100) * counts["n_repeat_words"] > F.lit(50) * counts["n_words"])
    chars = counts["word_chars"].cast("double")
    over = (counts["dup_line_chars"] > chars * line_limit) | (counts["n_symbols"] > chars * symbol_limit)
    for k, limit in limits.items():
        over = over | (counts[f"dup_chars_{k}"] > chars * limit)
    return base, ~base & ~over


def add_repetition_rules(df: DataFrame, text: str = "text", min_words: int = 50, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> DataFrame:
    """Append the counts, base_failed and kept (columns of these names are replaced).

    A text is kept if it has min_words words, at most half of them in repeated
    three-word windows, and its repeated n-grams, repeated lines and symbols
    stay within their shares of its word characters.
    """
    ship(df.sparkSession)
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    held = unused(df, "_rep")
    out = df.withColumn(held, repetition_column(F.col(f"`{text}`"), tuple(limits)))
    base, kept = _verdict(F.col(held), limits, min_words, line_limit, symbol_limit)
    names = [*FIELDS, *(f"dup_chars_{k}" for k in limits)]
    return out.withColumns({**{x: F.col(held)[x] for x in names}, "base_failed": base, "kept": kept}).drop(held)


def keep_unrepetitive(df: DataFrame, text: str = "text", min_words: int = 50, limits: dict[int, float] | None = None, line_limit: float = LINE_LIMIT, symbol_limit: float = SYMBOL_LIMIT) -> DataFrame:
    """The rows that the rules keep, with their own columns only."""
    ship(df.sparkSession)
    limits = dict(NGRAM_LIMITS if limits is None else limits)
    held = unused(df, "_rep")
    out = df.withColumn(held, repetition_column(F.col(f"`{text}`"), tuple(limits)))
    return out.filter(_verdict(F.col(held), limits, min_words, line_limit, symbol_limit)[1]).drop(held)
