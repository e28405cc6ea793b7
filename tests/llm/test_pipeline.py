"""The five stages on a small table, each held against brute force on its own input, and run() against their chain."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import zstandard
from pyspark.sql import functions as F
from test_llm_ops import LOWER, WORD, coverage, exact_groups

import corpus_pipeline as P
from entrywise.llm import langid, registry, repetition

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(text):
    """The quality rules, written out."""
    w = WORD.findall(text or "")
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    if len(w) < 50 or 100 * len(repeated) > 50 * len(w):
        return False
    chars, lines, twice = sum(map(len, w)), set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            twice += sum(map(len, WORD.findall(line))) if line in lines else 0
            lines.add(line)
    few = all(coverage(text, n) <= chars * limit for n, limit in repetition.NGRAM_LIMITS.items())
    return few and twice <= chars * repetition.LINE_LIMIT and sum(text.count(c) for c in "#*$%&|<>") <= chars * repetition.SYMBOL_LIMIT


def identified(text, dictionaries):
    """Smallest encoding with margin, by compressors made anew."""
    if not any(c.isalpha() for c in text):
        return False
    plain = " ".join(re.sub("[\\x00-\\x40\\x5b-\\x60\\x7b-\\x7f]", " ", text.lower()).split()).encode()
    params = zstandard.ZstdCompressionParameters(**langid.SETTINGS, write_checksum=False, write_content_size=False, write_dict_id=False)
    sizes = []
    for content in dictionaries.values():
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        sizes.append(sum(len(zstandard.ZstdCompressor(compression_params=params, dict_data=d).compress(plain[i : i + 2048])) for i in range(0, max(1, len(plain)), 2048)))
    first, second = sorted(sizes)[:2]
    return 1 - first / second >= langid.MIN_MARGIN


def copies(ids_sources):
    """Poisson numbers of copies from MD5, by the sources' shares."""
    n = Counter(s for _, s in ids_sources)
    out = {}
    for i, s in ids_sources:
        rate = len(ids_sources) / (len(n) * n[s])
        u = int(hashlib.md5(f"41:{i}".encode()).hexdigest()[:13], 16) / (1 << 52)
        p = total = math.exp(-rate)
        k = 0
        while total <= u:
            k += 1
            p *= rate / k
            total += p
        out[i] = k
    return {i: k for i, k in out.items() if k}


def test_every_stage_by_brute_force(spark, sf):
    from tokenizers import Tokenizer

    docs, rows = spark.read.parquet(f"{sf}/documents.parquet"), {}
    inputs = {}
    for name, stage in P.STAGES:
        inputs[name] = docs
        docs = stage(spark, docs, sf).cache()
        rows[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == COLUMNS
    given = {name: {r["doc_id"]: r for r in df.collect()} for name, df in inputs.items()}
    ids = {name: Counter(r["doc_id"] for r in rs) for name, rs in rows.items()}
    assert ids["quality rules"] == Counter(i for i, r in given["quality rules"].items() if good(r["text"]))
    learned = langid.learn_dictionaries(inputs["language id"])
    assert ids["language id"] == Counter(i for i, r in given["language id"].items() if identified(r["text"], learned))
    groups, _ = exact_groups({i: r["text"] for i, r in given["near dedup"].items()}, 5, 80)
    assert ids["near dedup"] == Counter(set(groups.values())) and len(ids["near dedup"]) < len(given["near dedup"])
    assert ids["mixing"] == copies([(i, r["source"]) for i, r in given["mixing"].items()])
    lib = Tokenizer.from_file(registry.tokenizer_path())
    for r in rows["bpe"]:
        own = lib.encode(given["bpe"][r["doc_id"]]["text"], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(own), hashlib.sha256(np.array(own, "<u4").tobytes()).hexdigest())
    assert ids["bpe"] == ids["mixing"]
    for name in ("quality rules", "language id", "near dedup", "mixing"):  # rows pass as they are
        assert all(tuple(r) == tuple(given[name][r["doc_id"]]) for r in rows[name])
    assert Counter(tuple(r) for r in P.run(spark, sf).collect()) == Counter(tuple(r) for r in rows["bpe"])


def test_empty_null_and_repeated_rows(spark, sf, tmp_path):
    assert P.ORACLE_SQL is None and LOWER
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    (tmp_path / "empty").mkdir()
    docs.limit(0).write.parquet(str(tmp_path / "empty" / "documents.parquet"))
    assert P.run(spark, str(tmp_path / "empty")).count() == 0
    assert langid.learn_dictionaries(docs.limit(0)) == {}
    some = docs.where("length(text) BETWEEN 400 AND 2000").limit(40)
    keyless = some.withColumn("doc_id", F.lit(None).cast("long"))
    (tmp_path / "odd").mkdir()
    some.unionByName(some).unionByName(keyless).unionByName(some.withColumn("text", F.lit(" "))).unionByName(some.selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")).write.parquet(str(tmp_path / "odd" / "documents.parquet"))
    got = P.run(spark, str(tmp_path / "odd")).collect()
    assert {r["doc_id"] for r in got} <= {None, *(r["doc_id"] for r in some.collect())}
