"""The corpus operators against brute force, and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import oracle
from entrywise.llm import backoff, bpe, components, fingerprint, importance, langid, licenses, maglev, mixing, neardup, registry, repetition
from entrywise.llm.license_rules import rules
from entrywise.llm.textops import Block, RollingHash, SpanHash, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30_000))
#: doc_id, text, lang, source, and columns whose names the operators use themselves
AWKWARD = [
    (1, None, None, None, "x", 1), (2, "", "en", "a", "x", 2), (3, " \n\t ", "en", "a", None, 3), (4, "one", "en", "a", "x", 4), (5, "one", None, "b", "x", 4),
    (None, "no key at all here", "en", "b", "x", 5), (6, LONG, "en", "b", "x", 6), (7, "Été ÀÉ 日本 ¡hola! 🙂 mit LICENSE", "fr", "b", "x", 7), (7, "Été ÀÉ 日本 ¡hola! 🙂 mit LICENSE", "fr", "b", "x", 7), (8, "12 34 ## $$", "en", "c", "x", 8),
]
AWKWARD = [(*row, 0, 1, 0.5, 2) for row in AWKWARD]
SCHEMA = "doc_id long, text string, lang string, source string, kept string, slot int, q int, _at int, score double, copy int"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(AWKWARD, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", ["op2_repetition", "op3_neardup", "op4_shards", "op6_mixing", "op7_backoff"])
def test_queries_against_sql(spark, sf, name):
    assert oracle.compare(spark, sf, registry.queries()[name], registry.oracle_sql()[name]) is None


def test_every_operator_takes_awkward_and_empty_tables(spark, odd):
    dictionaries = {"en": b"the of and to one two", "fr": b"le la et un deux"}
    runs = {
        "importance": lambda d: importance.resample(d, np.array([4, 5]), 0.5), "rules": repetition.add_repetition_rules, "keep": repetition.keep_unrepetitive, "neardup": neardup.near_duplicates, "drop": neardup.drop_near_duplicates,
        "shards": lambda d: maglev.assign_shards(d, ["a", "b", "c"], size=13), "lang": lambda d: langid.identify_languages(d, dictionaries), "none": lambda d: langid.identify_languages(d, {}), "mix": mixing.mix_sources, "lm": backoff.backoff_scores,
        "prints": fingerprint.fingerprint_report, "licenses": licenses.scan_licenses, "bpe": lambda d: bpe.token_digests(d, registry.tokenizer_path()), "ids": lambda d: bpe.add_tokens(d, registry.tokenizer_path()),
    }
    empty = odd.limit(0)
    full = {"importance", "rules", "neardup", "shards", "lang", "none", "lm", "prints", "licenses", "bpe", "ids"}
    for name, run in runs.items():
        got = run(odd).collect()
        if name in full:
            assert len(got) == len(AWKWARD), name
        assert run(empty).count() == 0, name
    kept = repetition.keep_unrepetitive(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [6]
    assert neardup.drop_near_duplicates(odd).columns == odd.columns
    assert mixing.mix_sources(odd).columns == odd.columns


def test_a_text_longer_than_blocks_and_chunks(spark):
    n = 600_000
    long = " ".join(f"w{k % 977}x{k}" for k in range(n))
    assert len(long) > max(backoff.CHUNK_BYTES, 4 << 20)
    df = spark.createDataFrame([(1, long), (2, long), (3, "a b c d e f")], "doc_id long, text string")
    by = lambda d: {r["doc_id"]: r for r in d.collect()}
    rules_, lm, near = by(repetition.add_repetition_rules(df)), by(backoff.backoff_scores(df)), by(neardup.near_duplicates(df))
    assert rules_[1]["n_words"] == lm[1]["n_words"] == n and rules_[1]["n_repeat_words"] == 0 and not rules_[1]["base_failed"]
    assert near[1]["n_shingles"] == n - 4 and near[2]["component_id"] == 1 and near[3]["component_id"] == 3
    assert lm[1]["n_backoff"] == 0 and lm[3]["n_backoff"] == 5  # every n-gram of the long text occurs twice
    weights = by(importance.resample(df, np.array([1]), 0.4))
    assert weights[1]["n_ngrams"] == 2 * n - 1 and sum(r["kept"] for r in weights.values()) == 1


def test_words_and_hashes():
    parts = ["a b", "", "  ", "é b a b", "x"]
    data = np.frombuffer("".join(parts).encode(), np.uint8)
    offs = np.cumsum([0, *(len(p.encode()) for p in parts)])
    w = words(Block(0, 5, data, offs))
    assert [bytes(data[a:b]).decode() for a, b in zip(w.start, w.end)] == ["a", "b", "é", "b", "a", "b", "x"]
    assert list(w.doc) == [0, 0, 3, 3, 3, 3, 4]
    h = SpanHash(data)(w.start, w.end)
    assert h[0] == h[4] and h[1] == h[3] == h[5] and len(set(h.tolist())) == 4
    r = RollingHash(h).windows(2)
    assert r[0] == r[4] and len(set(r.tolist())) == 5


def coverage(text, k):
    w = WORD.findall(text)
    seen = Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    cover = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
    return sum(len(w[j]) for j in cover)


def test_repetition_by_brute_force(spark):
    rnd = random.Random(3)
    made = ["".join(rnd.choice(["a ", "b ", "cé ", "a\n", "a b c a b c ", "#", "x y\n"]) for _ in range(rnd.randrange(60))) for _ in range(80)]
    got = repetition.add_repetition_rules(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string")).collect()
    for r in got:
        t = made[r["doc_id"]]
        lines, seen, dup = t.split("\n"), set(), []
        for line in lines:
            if WORD.search(line):
                dup += [line] if line in seen else []
                seen.add(line)
        assert r["n_dup_lines"] == len(dup) and r["dup_line_chars"] == sum(len(x) for line in dup for x in WORD.findall(line))
        for k in repetition.NGRAM_LIMITS:
            assert r[f"dup_chars_{k}"] == coverage(t, k)


def test_quality_keeps_good_documents(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    r = repetition.add_repetition_rules(docs).join(labels, "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share"))
    share = {x["quality"]: x["share"] for x in r.collect()}
    assert share[1] > 0.97 and share.get(0, 0) < 0.4


def test_importance_prefers_the_target(spark, sf, docs):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    keys, share = importance.target_sample(labels)
    got = importance.resample(docs, keys, share)
    assert importance.resample(docs, keys, share).exceptAll(got).count() == 0
    by = {x["quality"]: x["s"] for x in got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert by[1] > 0.9 and by[0] < 0.4
    assert abs(got.where("kept").count() - round(share * got.count())) <= 2


def test_importance_without_good_rows(spark, docs):
    keys, share = importance.target_sample(spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, quality int"))
    got = importance.resample(docs, keys, share)
    assert got.count() == docs.count() and got.where("kept").count() == 0


def test_importance_models_by_brute_force(spark):
    rows = [(1, "a b a"), (2, "b c"), (3, None)]
    raw, aim = importance.count_models(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", np.array([2]))
    assert raw.sum() == (3 + 2) + (2 + 1) and aim.sum() == 3 and (aim <= raw).all()
    ratio = importance.log_ratio(raw, aim)
    assert ratio[aim > 0].min() > ratio[(raw > 0) & (aim == 0)].max()


def test_importance_draw_by_brute_force(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdefgH") for _ in range(rnd.randrange(25))) if i % 9 else None, "q") for i in range(120)]
    keys, buckets = list(range(0, 120, 4)), importance.BUCKETS
    df = spark.createDataFrame(rows, "doc_id long, text string, q string").repartition(5)

    def grams(t):
        data = np.frombuffer((t or "").translate(LOWER).encode(), np.uint8)
        w = words(Block(0, 1, data, np.array([0, len(data)])))
        roll = RollingHash(SpanHash(data)(w.start, w.end))
        return [int(h >> np.uint64(32)) % buckets for n in (1, 2) for h in roll.windows(n)]

    raw, aim = Counter(), Counter()
    for i, t, _ in rows:
        raw.update(grams(t))
        aim.update(grams(t) if i in keys else [])
    size, target = sum(raw.values()) + buckets, sum(aim.values()) + buckets
    ratio = lambda b: math.log((aim[b] + buckets * (raw[b] + 1) / size) / target) - math.log((raw[b] + 1) / size)
    got = {r["doc_id"]: r for r in importance.resample(df, np.array(keys), 0.25).collect()}
    want = {}
    for i, t, _ in rows:
        g = grams(t)
        unit = int(hashlib.md5(f"29:{i}".encode()).hexdigest()[:13], 16) / (1 << 52) + 2.0**-53
        assert got[i]["n_ngrams"] == len(g)
        if g:
            want[i] = sum(map(ratio, g)) - math.log(-math.log(unit))
            assert abs(got[i]["log_weight"] - sum(map(ratio, g))) < 1e-9 and abs(got[i]["gumbel_key"] - want[i]) < 1e-9
        else:
            assert got[i]["log_weight"] is None and got[i]["gumbel_key"] is None
    assert {i for i in got if got[i]["kept"]} == set(sorted(want, key=want.get, reverse=True)[:30])


def test_importance_keeps_all_ties_at_the_cut(spark):
    df = spark.createDataFrame([(7, "a b c d")] * 5 + [(8, "x")] * 5, "doc_id long, text string")
    kept = Counter(r["doc_id"] for r in importance.resample(df, np.array([7]), 0.3).where("kept").collect())
    assert kept == {7: 5}


@pytest.mark.parametrize("k", [1, 3, 10, 400])
def test_kth_largest(spark, k):
    rnd = random.Random(k)
    values = [rnd.choice([rnd.randrange(-(10**12), 10**12), 7]) for _ in range(400)]
    assert importance.kth_largest(spark.createDataFrame([(v,) for v in values], "q long"), "q", k) == sorted(values, reverse=True)[k - 1]


def exact_groups(table, k, percent):
    sets = {}
    for i, t in table.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    top = {i: i for i in table}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(table)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    top[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}, {i: len(s) for i, s in sets.items()}


def test_near_duplicates_by_brute_force(spark):
    rnd = random.Random(11)
    base = [[f"v{rnd.randrange(500)}" for _ in range(rnd.choice([3, 8, 40, 120]))] for _ in range(12)]
    table = {}
    for i in range(160):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(5)):
            w[rnd.randrange(len(w))] = f"u{rnd.randrange(9)}"
        table[i * 3] = " ".join(w) if i % 40 else None
    df = spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(5)
    for k, percent in ((4, 80), (5, 80)):
        want, sizes = exact_groups(table, k, percent)
        got = {r["doc_id"]: r for r in neardup.near_duplicates(df, shingle=k, percent=percent).collect()}
        assert {i: r["component_id"] for i, r in got.items()} == want
        assert {i: r["n_shingles"] for i, r in got.items()} == sizes
        assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())
        if k == 5:
            assert sorted(r["doc_id"] for r in neardup.drop_near_duplicates(df, percent=percent).collect()) == sorted(set(want.values()))


def test_sketch_is_full_and_concentrated():
    rnd = np.random.default_rng(1)
    for n in (1, 5, 60, 2000):
        common = rnd.integers(0, 2**63, n).astype(np.uint64)
        a, b = np.concatenate((common, rnd.integers(0, 2**63, n // 4).astype(np.uint64))), common
        offs = np.array([0, len(a), len(a) + len(b)])
        s = neardup.sketch(np.concatenate((a, b)), offs)
        assert (s != neardup._EMPTY).all()
        assert abs((s[0] == s[1]).mean() - n / len(a)) < 0.2
    assert (neardup.sketch(np.zeros(0, np.uint64), np.array([0, 0])) == neardup._EMPTY).all()


def test_components(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(45)] + [(k, k + 1) for k in range(100, 140)]
    top = {v: v for e in edges for v in e}
    for _ in range(80):
        for a, b in edges:
            top[a] = top[b] = min(top[a], top[b])
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {v for a, b in edges if a != b for v in (a, b)}
    assert got == {v: top[v] for v in linked}
    odd_ends = spark.createDataFrame([(1, None), (None, 2), (3, 3), (None, None)], "a long, b long")
    assert components.components(odd_ends).count() == 0 and components.components(odd_ends.limit(0)).count() == 0


def test_lookup_table_is_balanced_and_moves_little():
    names = [f"s{k}" for k in range(16)]
    table = maglev.lookup_table(names, 4099)
    counts = Counter(table)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    fewer = maglev.lookup_table(names[:-1], 4099)
    moved = sum(a != b for a, b in zip(table, fewer) if a != 15)
    assert moved < 0.15 * 4099
    for bad in ((names, 4098), ([], 13), (["a", "a"], 13), (names, 13)):
        with pytest.raises(ValueError):
            maglev.lookup_table(*bad)


def test_shards_on_disk(spark, docs, tmp_path):
    maglev.write_shards(docs, str(tmp_path / "s"), ["a", "b", "c"], size=101)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and set(back.columns) == {*docs.columns, "shard"}
    keyless = docs.withColumn("doc_id", F.lit(None).cast("long"))
    dealt = maglev.deal_shards(keyless, ["a", "b", "c"], size=101)
    assert dealt.select("shard").distinct().count() == 1 and dealt.select("text").exceptAll(docs.select("text")).count() == 0
    assert dealt.where("slot IS NULL OR shard IS NULL").count() == 0 and set(dealt.columns) == {*docs.columns, "slot", "shard"}
    assert maglev.deal_shards(docs.limit(0), ["a"], size=13).count() == 0


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    learned = langid.learn_dictionaries(docs.where(~registry.held_out()))
    assert set(learned) == {"en", "fr", "de", "es"} and all(len(d) <= langid.DICT_BYTES for d in learned.values())
    held = langid.identify_languages(docs.where(registry.held_out()), learned).select("doc_id", "lang", "lang_pred", "score").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2 and 0 <= r["score"] <= 1 for r in held)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)


def test_dictionaries_of_copies_and_long_texts(spark):
    copied = spark.range(120_000, numPartitions=4).select(F.lit("xx").alias("lang"), F.concat(F.lit("mostly copies "), F.expr("substring('abc', cast(id % 3 as int) + 1, 1)")).alias("text"))
    word = lambda k: "".join(chr(97 + k // 26**j % 26) for j in range(3))
    long = [("yy", f"q{word(k)}z " * 350) for k in range(400)] + [("zz", "p" * 2048 + " " + f"q{word(k)}z " * 350) for k in range(400)]
    learned = langid.learn_dictionaries(copied.unionByName(spark.createDataFrame(long, "lang string, text string")))
    assert set(learned) == {"xx", "yy", "zz"} and all(f"mostly copies {c}".encode() in learned["xx"] for c in "abc")
    assert len(set(re.findall(b"q[a-z]{3}z", learned["yy"]))) == 400 and 0.95 * langid.DICT_BYTES < len(learned["yy"]) <= langid.DICT_BYTES
    assert len(set(re.findall(b"q[a-z]{3}z", learned["zz"]))) > 100
    again = langid.learn_dictionaries(copied.unionByName(spark.createDataFrame(long * 2, "lang string, text string").repartition(7)))
    assert again == learned


def test_language_of_texts_without_letters(spark, odd):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(odd, {"en": b"the one"}).collect()}
    assert got[1] == got[2] == got[3] == got[8] == "und" and got[4] == "en"
    signs = spark.createDataFrame(list(enumerate(["²", "½ ³", "Ⅷ", "①", "_", "٣", "ª", "日", "é"])), "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(signs, {"en": b"the one"}).collect()} == {**dict.fromkeys(range(6), "und"), 6: "en", 7: "en", 8: "en"}


def test_languages_against_a_plain_loop(spark, docs):
    import zstandard

    learned = langid.learn_dictionaries(docs)
    params = zstandard.ZstdCompressionParameters(**langid.SETTINGS, write_checksum=False, write_content_size=False, write_dict_id=False)
    tie = {"b": b"one two three", "a": b"one two three"}
    for dictionaries in (learned, tie):
        found = langid.identify_languages(docs, dictionaries).select("text", "lang_pred", "score", "accepted").collect()
        for r in found[:120]:
            plain = " ".join(re.sub("[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]", " ", (r["text"] or "").lower()).split()).encode() if any(c.isalpha() for c in r["text"] or "") else None
            if plain is None:
                assert (r["lang_pred"], r["score"], r["accepted"]) == ("und", 0, False)
                continue
            total = {n: sum(len(zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)).compress(plain[i : i + 2048])) for i in range(0, max(1, len(plain)), 2048)) for n, d in dictionaries.items()}
            best = min(total, key=total.get)
            margin = 1 - total[best] / min(v for n, v in total.items() if n != best)
            assert r["lang_pred"] == best and abs(r["score"] - margin / (margin + langid.HALF_MARGIN)) < 1e-12 and r["accepted"] == (margin >= langid.MIN_MARGIN)


def test_mixing_meets_the_weights(spark):
    rows = [(i, "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = Counter(r["source"] for r in mixing.mix_sources(df, {"hot": 1, "cold": 2, None: 1}).collect())
    assert abs(got["hot"] - 1500) < 150 and abs(got["cold"] - 3000) < 250 and abs(got[None] - 1500) < 150
    assert mixing.mix_sources(df, {"hot": 1.0}).where("source = 'cold'").count() == 0
    out = mixing.mix_sources(df, copy="n").collect()
    per = defaultdict(list)
    for r in out:
        per[r["doc_id"]].append(r["n"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) for v in per.values())
    ids = [r["doc_id"] for r in out]
    assert ids != sorted(ids)


def test_mixing_at_any_rate(spark):
    def unit(text):
        return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) / (1 << 52)

    def poisson(rate, u):
        p = total = math.exp(-rate)
        k = 0
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        return k

    rows = [(7, None, "x"), (8, None, "y")] + [(i, f"s{i % 19}", "z") for i in range(100, 28_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(3)
    n = Counter(r[1] for r in rows)
    rate = {name: len(rows) / (len(n) * k) for name, k in n.items()}
    assert rate[None] > 690
    want = {}
    for i, name, _ in rows:
        parts = max(1, math.ceil(rate[name] / 500))
        want[i] = poisson(rate[name], unit(f"41:{i}")) if parts == 1 else sum(poisson(rate[name] / parts, unit(f"41/{k}:{i}")) for k in range(1, parts + 1))
    per = defaultdict(list)
    for r in mixing.mix_sources(df, copy="n").collect():
        per[r["doc_id"]].append(r["n"])
        assert r["source"] == (None if r["doc_id"] < 100 else f"s{r['doc_id'] % 19}")
    assert {i: sorted(v) for i, v in per.items()} == {i: list(range(1, k + 1)) for i, k in want.items() if k}
    assert abs(len(per[7]) - rate[None]) < 6 * rate[None] ** 0.5
    for ratio in (3_000.0, 100_000.0):
        few = mixing.mix_sources(spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "b")], "doc_id long, source string"), ratio=ratio, copy="n")
        got = {r["doc_id"]: r for r in few.groupBy("doc_id").agg(F.count("n").alias("k"), F.countDistinct("n").alias("d"), F.min("n").alias("low"), F.max("n").alias("high")).collect()}
        for i in (1, 2, 3, 4):
            mean = 2 * ratio / (1 if i == 1 else 3)
            assert got[i]["k"] == got[i]["d"] == got[i]["high"] and got[i]["low"] == 1 and abs(got[i]["k"] - mean) < 6 * mean**0.5


def test_mixing_of_rows_without_key_and_of_many_sources(spark):
    df = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), (F.col("id") % 3).cast("string").alias("source"), F.col("id").cast("string").alias("text"), F.lit(9).alias("n"))
    out = mixing.mix_sources(df, {"0": 1, "1": 1}, copy="n")
    per = Counter(r["text"] for r in out.collect())
    assert {1, 2, 3} <= set(per.values()) and abs(sum(per.values()) - 6000) < 400 and out.columns == ["doc_id", "source", "text", "n"]
    keyed = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("source"))
    few, many = (Counter(r["doc_id"] for r in mixing.mix_sources(keyed, {"hot": 1, "3": 1}, broadcast=b).collect()) for b in (10_000, 5))
    assert few == many and few[3] > 1000


def test_poisson_steps(spark):
    for rate in (0.0, 0.3, 4.0, 90.0):
        got = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("c")).first()["c"]
        want, p = 0.0, math.exp(-rate)
        for k, c in enumerate(got):
            want += p
            assert abs(c - want) < 1e-9
            p *= rate / (k + 1)
        assert abs(got[-1] - 1) < 1e-9


def test_backoff_trigram_by_brute_force(spark):
    rnd = random.Random(4)
    table = {i: " ".join(rnd.choice("abcdeF") for _ in range(rnd.randrange(30))) for i in range(60)}
    seqs = {i: t.translate(LOWER).split() for i, t in table.items()}
    counts = [Counter(tuple(w[j : j + n]) for w in seqs.values() for j in range(len(w) - n + 1)) for n in (1, 2, 3)]
    total = sum(counts[0].values())

    def score(gram):
        if len(gram) == 1:
            return counts[0][gram] / total
        if counts[len(gram) - 1][gram] >= 2:
            return counts[len(gram) - 1][gram] / counts[len(gram) - 2][gram[:-1]]
        return 0.4 * score(gram[1:])

    got = backoff.backoff_scores(spark.createDataFrame(list(table.items()), "doc_id long, text string").repartition(7), order=3).collect()
    assert len(got) == len(table)
    for r in got:
        w = seqs[r["doc_id"]]
        want = sum(math.log(score(tuple(w[max(0, j - 2) : j + 1]))) for j in range(len(w)))
        assert r["n_words"] == len(w) and (abs(r["log_score"] - want) < 1e-9 if w else r["log_score"] is None)


def jaccard(a, b, k=5):
    def s(t):
        w = WORD.findall(t)
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    a, b = s(a), s(b)
    return (len(a & b) / len(a | b) if a | b else 1.0), len(a)


def test_fingerprints_by_brute_force(spark, docs, texts):
    got = {r["doc_id"]: r for r in fingerprint.fingerprint_report(docs.repartition(3)).collect()}
    ids = sorted(texts)
    errors = []
    for i, nxt in zip(ids, ids[1:] + ids[:1]):
        t, u, r = texts[i], texts[nxt], got[i]
        half = len(t) // 2
        edited = t[: len(t) - half] + u[:half]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        for other, near in ((edited, r["near_edited"]), (u, r["near_next"])):
            want, n = jaccard(t, other)
            errors.append(abs(near - want))
            assert abs(near - want) < 0.2
        assert (abs(r["n_shingles"] - n) <= 0.4 * n) and (n >= fingerprint.SIZE or r["n_shingles"] == n)
    assert sum(errors) / len(errors) < 0.03
    same = defaultdict(set)
    for i in ids:
        same[texts[i]].add(got[i]["fingerprint"])
    assert all(len(v) == 1 for v in same.values())


@pytest.mark.parametrize("ids", [[5], [1, 2], [10**12, 3, -7, 4, 5], list(range(0, 4000, 13))])
def test_next_document(spark, ids):
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, "doc_id", "text").collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1])}


def test_next_document_with_outliers_and_null_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4999, F.col("id")).otherwise(F.lit(10**12)).alias("doc_id"), F.col("id").cast("string").alias("text"))
    df = df.unionByName(spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("n"), "id").alias("text")))
    out = fingerprint.with_next(df.withColumn("_at", F.lit(1)), "doc_id", "text")
    got = {r["text"]: r["next_text"] for r in out.collect()}
    assert got == {**{str(k): str((k + 1) % 5000) for k in range(5000)}, **{f"n{k}": None for k in range(3000)}} and out.columns == ["doc_id", "text", "_at", "next_text"]
    bounds = [3, 3 + 64, 10**12]
    at = spark.createDataFrame([(k,) for k in (-5, 2, 3, 66, 67, 10**12, 10**13)], "k long").select(fingerprint._range_of(F.col("k"), bounds).alias("r"))
    assert [r["r"] for r in at.collect()] == [0, 0, 1, 1, 2, 3, 3]
    twice = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "doc_id long, text string")
    assert {r["text"]: r["next_text"] for r in fingerprint.with_next(twice, "doc_id", "text").collect()} == {"a": "b", "b": "c", "c": "a"}


def test_merge_keeps_empty_groups_and_containment_counts(spark):
    long, part = " ".join(f"a{k}" for k in range(900)), " ".join(f"a{k}" for k in range(450))
    df = spark.createDataFrame([(1, "x y"), (2, None), (3, "  "), (None, "z"), (4, long), (4, None)], "_salt int, text string").withColumn("sketch", fingerprint.fingerprint(F.col("text")))
    got = {r["_salt"]: r["sketch"] for r in fingerprint.merge_all(df, ["_salt"]).collect()}
    assert set(got) == {1, 2, 3, 4, None} and got[2] == got[3] == [] and len(got[1]) == len(got[None]) == 1 and len(got[4]) == fingerprint.SIZE
    a, b = (fingerprint.fingerprint(F.lit(t)) for t in (long, part))
    r = spark.range(1).select(fingerprint.containment(b, a).alias("in_"), fingerprint.containment(a, b).alias("half"), fingerprint.distinct_shingles(a).alias("n")).first()
    assert r["in_"] > 0.75 and abs(r["half"] - 0.5) < 0.15 and abs(r["n"] - 896) < 250


def test_sketches_merge(spark):
    a, b = " ".join(f"a{k}" for k in range(300)), " ".join(f"a{k}" for k in range(150, 500))
    df = spark.createDataFrame([(1, a), (1, b)], "g int, text string").select("g", fingerprint.fingerprint(F.col("text")).alias("sketch"), "text")
    rows = [r["sketch"] for r in df.collect()]
    both = spark.range(1).select(fingerprint.merge(F.array(*map(F.lit, rows[0])), F.array(*map(F.lit, rows[1]))).alias("m")).first()["m"]
    assert fingerprint.merge_all(df, ["g"]).first()["sketch"] == both
    text = df.select(fingerprint.as_text(F.col("sketch")).alias("t"), "sketch")
    assert text.where(fingerprint.from_text(F.col("t")) == F.col("sketch")).count() == 2


def test_licenses_by_brute_force(docs, texts):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    extra = {10**9: "Mit license, MIT-License and the Apache  license; GNU General Public License v3", 10**9 + 1: "nothing", 10**9 + 2: "KMIT LICENSE mit lıcense"}
    df = docs.select("doc_id", "text").unionAll(docs.sparkSession.createDataFrame(list(extra.items()), "doc_id long, text string"))
    got = {r["doc_id"]: r for r in licenses.scan_licenses(df).collect()}
    some = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in rules()]
    for i, t in {**texts, **extra}.items():
        w, r = token.findall(t.translate(LOWER)), got[i]
        places = [(j, label) for phrase, label in licenses.PHRASES.items() for p in [phrase.split()] for j in range(len(w)) if w[j : j + len(p)] == p]
        assert (r["n_words"], r["n_base"]) == (len(w), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        base = {label for _, label in places}
        assert r["base_labels"] == ",".join(sorted(base))
        text = f" {' '.join(w)} "
        found = [(text[: m.start()].count(" ") - 1, text[: m.end()].count(" "), rule.priority, rule.label) for rule, p in some for m in p.finditer(text)]
        left = set()
        for a, b, p, label in found:
            inside = [(x, y, q, z) for x, y, q, z in found if x <= a and b <= y and q >= p and ((x, y) != (a, b) or q > p or z < label)]
            if not inside:
                left.add(label)
        assert r["labels"] == ",".join(sorted(base | left)), t[:200]
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(base | left)


def test_rules_are_many_and_keywords_are_whole_words():
    assert len(rules()) > 400 and all(re.compile(r.pattern) for r in rules())
    for r in rules():
        assert r.keywords and all(re.fullmatch("[0-9a-z]+", w) for w in r.keywords), r
        for t in sample_texts(r.pattern):
            assert set(t.split()) & set(r.keywords), (r, t)
    from entrywise.llm.license_rules import wordings

    assert wordings("a(?: b+| c)? [xy]z{0,2}\\S") == {f"a{b} {x}{z}*" for b in ("", " b", " c") for x in "xy" for z in ("", "z")}


def sample_texts(pattern):
    """Matches of a pattern: with each way of every branch, with and without what may be missing."""
    from re import _parser

    def walk(items):
        made = [""]
        for op, value in items:
            op = str(op)
            if op == "LITERAL":
                ways = [chr(value)]
            elif op == "SUBPATTERN":
                ways = walk(value[3])
            elif op == "BRANCH":
                ways = [w for way in value[1] for w in walk(way)]
            elif op == "IN":
                ways = ["1"] if str(value[0][0]) == "CATEGORY" else [chr(value[0][1])]
            else:
                once = walk(value[2])
                ways = [w * value[0] for w in once] if value[0] else ["", once[0]]
            made = [(made[k % len(made)] + ways[k % len(ways)]) for k in range(max(len(made), len(ways)))]
        return made

    return sorted(set(walk(_parser.parse(pattern))))


def test_every_license_rule_is_searched(spark):
    some = [(r, re.compile(f"(?<= )(?:{r.pattern})(?= )")) for r in rules()]
    said = ["Library released under the GPL v2.", "Text under CC BY 4.0", "MPL 2.0", "BSD 3-clause", "The software is provided as is", "https://www.mozilla.org/MPL/2.0/", "http://www.wtfpl.net", "oss.oracle.com/licenses/upl", "0BSD", "EUPL v1.2", "php.net/license"]
    for r, p in some:
        made = sample_texts(r.pattern)
        assert made and all(p.search(f" {t} ") for t in made), r
        said += [f"Qq {t} qq." for t in made]
    got = {r["doc_id"]: r for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(said)), "doc_id long, text string").repartition(4)).collect()}
    for i, t in enumerate(said):
        text = f" {' '.join(re.findall('[0-9a-z]+', t.lower()))} "
        found = [(m.start(), m.end(), r.priority, r.label) for r, p in some for m in p.finditer(text)]
        left = {z for a, b, q, z in found if not any(x <= a and b <= y and o >= q and ((x, y) != (a, b) or o > q or v < z) for x, y, o, v in found)}
        assert found and set(got[i]["labels"].split(",")) == left | set(filter(None, got[i]["base_labels"].split(","))), t
        assert got[i]["score"] > 0 and got[i]["n_found"] > 0, t


def test_bpe_tables_stay_bounded_and_files_are_checked(monkeypatch):
    import json

    table = bpe.Recent(8)
    for k in range(100):
        table.put(k, bytes([k]))
        assert table.get(0) == b"\0" and len(table.new) + len(table.old) <= 8
    assert table.get(99) == b"c" and table.get(50) is None
    spec = json.load(open(registry.tokenizer_path()))
    bpe.check_supported(spec)
    changes = [{"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, {"pre_tokenizer": None}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}, {"model": {**spec["model"], "unk_token": "?"}}]
    for change in changes:
        with pytest.raises(ValueError):
            bpe.check_supported({**spec, **change})


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = registry.tokenizer_path()
    lib = Tokenizer.from_file(path)
    rnd = random.Random(6)
    parts = ["a", "b", " ", "  ", "\n", "\t\n", " ", "\x1c", "\x85", "é", "ß", "’", "'s", "'RE", "1", "²", "日本", "🙂", "aaaa", "<|endoftext|>", "<|endo", "_", "...", "the", " THE", "\x00"]
    made = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(40)))) for i in range(800)] + [(900, None), (901, "a" * 5000), (902, LONG)]
    df = spark.createDataFrame(made, "doc_id long, text string").unionAll(docs.select(F.col("doc_id") + 1000, "text"))
    got = {r["doc_id"]: r for r in bpe.token_digests(df, path).collect()}
    for r in df.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[r["doc_id"]]["n_tokens"], got[r["doc_id"]]["ids_sha256"], got[r["doc_id"]]["decoded_sha256"]) == want, r["text"][:80]
    ids = bpe.add_tokens(df.where("text IS NOT NULL"), path)
    assert ids.where(bpe.decode_column(F.col("token_ids"), path) != F.col("text")).count() == 0
