"""Licence scans with ordered signature rules, in Spark functions only.

Texts are normalized to lower-case words. Every match of a rule has one of the
rule's keywords; the keywords that a text has, found in one pass over its
words, choose the rules that are searched, mostly none. That only saves work. The
detections of all rules are word intervals; one that lies inside another of the
same or higher priority is suppressed. Everything happens inside the row: there
is no shuffle, and a text's detections never leave it.

Defined results: a null text is an empty text; it and texts without detections
have empty labels, null positions and score 0; of equal intervals with equal
priorities the alphabetically first label stays; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fingerprint import let
from .license_rules import Rule, rules

#: phrase of consecutive words and its label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Confidence by priority of the best detection.
CONFIDENCE = {1: 0.4, 2: 0.7, 3: 0.9, 4: 1.0}
_NOT_WORD = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_INTERVAL = "array<struct<first:int,last:int,priority:int,label:string>>"


def normalize(text: Column) -> Column:
    """Words with one space before and after each; case is kept."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), _NOT_WORD, " ")), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def intervals(text: Column, pattern: Column, priority: Column, label: Column) -> Column:
    """Word intervals [first, last) of all matches of a pattern in normalized text."""

    def places(found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_INTERVAL).alias("out"))

        def walk(gaps: Column) -> Column:
            def add(acc: Column, i: Column) -> Column:
                first = acc["at"] + F.get(gaps, i)
                last = first + _spaces(F.get(found, i)) + 1
                row = F.struct(first.alias("first"), last.alias("last"), priority.alias("priority"), label.alias("label"))
                return F.struct(last.alias("at"), F.array_append(acc["out"], row).alias("out"))

            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), start, add, lambda acc: acc["out"])

        return F.when(F.size(found) > 0, let(F.transform(pieces, lambda p: _spaces(p) - 1), walk)).otherwise(F.array().cast(_INTERVAL))

    return let(F.regexp_extract_all(text, pattern, F.lit(0)), places)


def _table(some: list[Rule]) -> Column:
    bounded = "(?<= )(?:{})(?= )"
    return F.array(*[F.struct(F.lit(r.label).alias("label"), F.lit(r.priority).alias("priority"), F.lit(bounded.format(r.pattern)).alias("pattern")) for r in some])


def keyword_index(some: list[Rule]) -> dict[str, list[int]]:
    """The rules of each keyword."""
    out: dict[str, list[int]] = {}
    for i, r in enumerate(some):
        for w in r.keywords:
            out.setdefault(w, []).append(i)
    return dict(sorted(out.items()))


def detect(text: Column, some: list[Rule], present: Column) -> Column:
    """All intervals of the rules in normalized lower-case text that has the keywords, with overlaps."""
    index = keyword_index(some)
    table = F.create_map(*[x for w, at in index.items() for x in (F.lit(w), F.array(*map(F.lit, at)))])
    chosen = F.array_distinct(F.flatten(F.transform(present, lambda w: F.coalesce(F.element_at(table, w), F.array().cast("array<int>")))))
    search = lambda r: intervals(text, r["pattern"], r["priority"], r["label"])
    return F.flatten(F.transform(chosen, lambda i: search(F.get(_table(some), i))))


def suppress(found: Column, levels: int = 4) -> Column:
    """struct<labels, best, n>: what is left after dropping intervals inside others of the same or higher priority.

    In order of start, then longest, then highest priority, an interval lies
    inside an earlier one exactly if one of them ends as late; the latest end
    is kept for each priority.
    """
    order = F.sort_array(F.transform(found, lambda d: F.struct(d["first"], (-d["last"]).alias("back"), (-d["priority"]).alias("below"), d["label"])))
    none = F.struct(F.transform(F.sequence(F.lit(1), F.lit(levels)), lambda _: F.lit(0)).alias("ends"), F.array().cast("array<string>").alias("labels"), F.lit(0).alias("best"), F.lit(0).alias("n"))

    def step(acc: Column, d: Column) -> Column:
        last, priority = -d["back"], -d["below"]
        covered = F.array_max(F.slice(acc["ends"], priority, levels)) >= last
        ends = F.transform(acc["ends"], lambda e, i: F.when(i == priority - 1, F.greatest(e, last)).otherwise(e))
        kept = F.struct(ends.alias("ends"), F.array_union(acc["labels"], F.array(d["label"])).alias("labels"), F.greatest(acc["best"], priority).alias("best"), (acc["n"] + 1).alias("n"))
        return F.when(covered, acc).otherwise(kept)

    return F.aggregate(order, none, step)


def scan_column(text: Column, some: list[Rule] | None = None) -> Column:
    """struct<n_words, n_base, first_word, last_word, base_labels, labels, score, n_found> of a text."""
    some = rules() if some is None else some
    base_rules = [Rule(label, 1, phrase) for phrase, label in PHRASES.items()]
    none = F.array().cast(_INTERVAL)

    def scan(norm: Column) -> Column:
        keywords = F.array(*map(F.lit, keyword_index(base_rules + some)))

        def search(low: Column) -> Column:
            found = lambda present: F.struct(detect(low, base_rules, present).alias("base"), suppress(detect(low, some, present)).alias("own"))
            return let(F.array_intersect(F.split(low, " "), keywords), lambda present: F.when(F.size(present) > 0, found(present)))

        both = let(F.translate(norm, _UPPER, _LOWER), search)

        def report(x: Column) -> Column:
            base = F.coalesce(x["base"], none)
            names = F.array_sort(F.array_distinct(F.transform(base, lambda d: d["label"])))
            own = F.coalesce(x["own"]["labels"], F.array().cast("array<string>"))
            score = F.lit(0.0)
            for priority, value in CONFIDENCE.items():
                score = F.when(x["own"]["best"] == priority, F.lit(value)).otherwise(score)
            firsts = F.transform(base, lambda d: d["first"])
            return F.struct(
                F.greatest(F.lit(0), F.when(F.length(norm) > 2, _spaces(norm) - 1).otherwise(F.lit(0))).cast("long").alias("n_words"),
                F.size(base).cast("long").alias("n_base"), F.array_min(firsts).cast("long").alias("first_word"), F.array_max(firsts).cast("long").alias("last_word"),
                F.array_join(names, ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(names, own)), ",").alias("labels"),
                F.greatest(score, F.when(F.size(base) > 0, F.lit(CONFIDENCE[2])).otherwise(F.lit(0.0))).alias("score"), F.coalesce(x["own"]["n"], F.lit(0)).cast("long").alias("n_found"),
            )

        return let(both, report)

    return let(normalize(text), scan)


def scan_licenses(df: DataFrame, key: str = "doc_id", text: str = "text", some: list[Rule] | None = None) -> DataFrame:
    """key and the fields of scan_column() for every row."""
    return df.select(F.col(f"`{key}`").alias(key), scan_column(F.col(f"`{text}`"), some).alias("s")).select(key, "s.*")
