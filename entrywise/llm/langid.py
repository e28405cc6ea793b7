"""Language identification by compression with per-language zstandard dictionaries.

Learning: a bounded sample of labelled texts for each language is joined into a
raw-content dictionary. Predicting: the whole text, lower-cased and without ASCII signs, is cut into
pieces of a few kilobytes, so that the dictionary and not the text's own
repetition decides; each piece is compressed with every dictionary and the
language with the smallest total wins. If the runner-up is nearly as small, the
prediction is marked as not accepted.

Defined results: a null text, and one without letters, is `und` with score 0
and not accepted; with no labelled text at all every text is `und`; ties go to
the language with the most labelled rows; extra columns are kept, but one that
is called lang_pred, score or accepted is replaced. Every worker holds all
dictionaries, so more than MOST_LANGUAGES labels are refused with an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ship, unused

#: Labelled texts sampled for each language, bytes taken of each, bytes of a dictionary.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 2048
DICT_BYTES = 96 << 10
#: Languages that one classifier takes.
MOST_LANGUAGES = 1_000
#: Bytes of text compressed at a time.
PIECE_BYTES = 2048
#: Compressor settings: short matches count, and the search is a few steps deep.
SETTINGS = {"strategy": zstandard.STRATEGY_GREEDY, "min_match": 4, "window_log": 19, "hash_log": 16, "chain_log": 16, "search_log": 4, "target_length": 16}
#: The least relative margin between the two smallest sizes.
MIN_MARGIN = 0.005
#: The margin at which the score reaches one half.
HALF_MARGIN = 0.05

_LETTER = regex.compile(r"\p{L}")
#: ASCII characters other than letters say little about a language: they become spaces.
_PLAIN = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_compressors: dict[tuple, list] = {}


def normal(text: str) -> bytes:
    """Lower case, ASCII letters and other characters only, single spaces."""
    return b" ".join(text.lower().encode("utf-8", "surrogatepass").translate(_PLAIN).split())


def learn_dictionaries(df: DataFrame, text: str = "text", lang: str = "lang", texts: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS, size: int = DICT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary for each language of the labelled rows.

    The sample has the `texts` different texts of a language with the smallest
    hashes, so it is the same whatever the partitioning and the number of
    copies, and its size doesn't grow with the input. Of each text, `chars`
    characters from a hashed position are looked at, and each gets an equal part
    of the dictionary; what short texts leave goes to the others.
    """
    rows = df.select(F.col(f"`{lang}`").alias("lang"), F.col(f"`{text}`").alias("text")).where("lang IS NOT NULL AND length(text) > 0")
    rows = rows.withColumn("h", F.xxhash64(F.lit(17), "text"))
    # The number of different texts only says how many hashes to look at: three times as many as are wanted.
    found = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("h").alias("different")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages in column {lang!r}")
    counts = {r["lang"]: r["n"] for r in found}
    if not counts:
        return {}
    unit = F.pmod(F.col("h"), F.lit(1 << 30)).cast("double") / float(1 << 30)
    share, room = F.lit(0.0), F.lit(chars)
    for r in found:
        # A position is left with twice the bytes of a text's part after it, as signs and spaces go.
        room = F.when(F.col("lang") == r["lang"], F.lit(min(chars, 2 * size // max(1, min(texts, r["different"]))))).otherwise(room)
        share = F.when(F.col("lang") == r["lang"], F.lit(min(1.0, 3.0 * texts / max(1, r["different"])))).otherwise(share)
    start = F.pmod(F.xxhash64(F.lit(19), "text"), F.greatest(F.lit(1), F.length("text") - room + 1)).cast("int") + 1
    sample = (
        rows.where(unit < share).select("lang", "h", (unit / share).alias("at"), F.substring("text", start, F.lit(chars)).alias("text")).distinct()
        .orderBy("at", "lang", "h", "text").limit(4 * texts * len(counts)).collect()
    )
    out: dict[str, list[bytes]] = {}
    for r in sample:
        mine = out.setdefault(r["lang"], [])
        if len(mine) < texts:
            mine.append(normal(r["text"]))
    return {name: b" ".join(_equal_parts(out[name], size - len(out[name]) + 1))[:size] for name in sorted(out, key=lambda x: (-counts[x], x))}


def _equal_parts(parts: list[bytes], size: int) -> list[bytes]:
    """The parts, cut at one length so that together they have `size` bytes at most."""
    left, each = size, 0
    lengths = sorted(map(len, parts))
    for k, n in enumerate(lengths):
        each = max(0, left) // (len(lengths) - k)
        if n > each:
            return [p[:each] for p in parts]
        left -= n
    return parts


def _sizers(dictionaries: tuple[tuple[str, bytes], ...]) -> list:
    key = tuple((n, len(d), hash(d)) for n, d in dictionaries)
    if key not in _compressors:
        made = []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            params = zstandard.ZstdCompressionParameters(**SETTINGS, write_checksum=False, write_content_size=False, write_dict_id=False)
            d.precompute_compress(compression_params=params)
            made.append(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress)
        _compressors.clear()
        _compressors[key] = made
    return _compressors[key]


def classify(text: str | None, sizers: list, names: list[str], piece: int = PIECE_BYTES) -> tuple[str, float]:
    """The language with the smallest encoding and the relative margin to the runner-up."""
    if text is None or not names or not _LETTER.search(text):
        return "und", 0.0
    data = normal(text)
    pieces = [data] if len(data) <= piece else [data[i : i + piece] for i in range(0, len(data), piece)]
    totals = [sum(len(size(p)) for p in pieces) for size in sizers]
    best = min(range(len(totals)), key=totals.__getitem__)
    if len(totals) == 1:
        return names[0], 1.0
    second = min(t for k, t in enumerate(totals) if k != best)
    return names[best], 1.0 - totals[best] / second


def language_column(text: Column, dictionaries: dict[str, bytes]) -> Column:
    """struct<lang: string, margin: double> of a text column."""
    fixed = tuple(dictionaries.items())
    names = [n for n, _ in fixed]

    @F.arrow_udf("lang string, margin double")
    def predict(batch: pa.Array) -> pa.Array:
        sizers = _sizers(fixed)
        langs, margins = [], np.zeros(len(batch))
        for i, t in enumerate(batch):
            name, margins[i] = classify(t.as_py(), sizers, names)
            langs.append(name)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(margins)], ["lang", "margin"])

    return predict(text)


def identify_languages(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Append lang_pred, score (0 to 1, one half at HALF_MARGIN) and accepted."""
    ship(df.sparkSession)
    held = unused(df, "_lang")
    out = df.withColumn(held, language_column(F.col(f"`{text}`"), dictionaries))
    margin = F.col(held)["margin"]
    return out.withColumns({
        "lang_pred": F.col(held)["lang"],
        "score": margin / (margin + HALF_MARGIN),
        "accepted": (F.col(held)["lang"] != "und") & (margin >= min_margin),
    }).drop(held)


def keep_identified(df: DataFrame, dictionaries: dict[str, bytes], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows whose language is accepted, with their own columns only."""
    ship(df.sparkSession)
    held = unused(df, "_lang")
    out = df.withColumn(held, language_column(F.col(f"`{text}`"), dictionaries))
    return out.filter((F.col(held)["lang"] != "und") & (F.col(held)["margin"] >= min_margin)).drop(held)
