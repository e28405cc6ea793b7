"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .maglev import TABLE_SIZE, lookup_table
from .repetition import LINE_LIMIT, NGRAM_LIMITS, SYMBOL_LIMIT

_WORD = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def repetition() -> str:
    lengths = (3, *NGRAM_LIMITS)
    grams = " UNION ALL ".join(f"SELECT doc_id, {n} AS k, i, list_aggregate(ws[i:i + {n - 1}], 'string_agg', ' ') AS g FROM t, unnest(range(1, len(ws) - {n - 2})) AS r(i)" for n in lengths)
    fields = ", ".join(f"coalesce(max(c.chars) FILTER (c.k = {n}), 0)::BIGINT AS dup_chars_{n}" for n in NGRAM_LIMITS)
    over = " OR ".join(f"dup_chars_{n} > word_chars::DOUBLE * {limit}" for n, limit in NGRAM_LIMITS.items())
    names = ", ".join(f"dup_chars_{n}" for n in NGRAM_LIMITS)
    return f"""
    WITH t AS (SELECT doc_id, text, coalesce(regexp_extract_all(text, '{_WORD}'), []) AS ws FROM documents),
    grams AS ({grams}),
    twice AS (SELECT doc_id, k, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, g) AS n FROM grams) WHERE n > 1),
    covered AS (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM twice),
    cover AS (SELECT c.doc_id, c.k, count(*) AS words, sum(length(t.ws[c.i])) AS chars FROM covered c JOIN t USING (doc_id) GROUP BY ALL),
    lines AS (SELECT doc_id, line, count(*) - 1 AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '{_WORD}') GROUP BY ALL),
    dup AS (SELECT doc_id, sum(n)::BIGINT AS n_dup_lines, sum(n * length(list_aggregate(regexp_extract_all(line, '{_WORD}'), 'string_agg', '')))::BIGINT AS dup_line_chars FROM lines GROUP BY 1),
    facts AS (
      SELECT t.doc_id, len(any_value(t.ws)) AS n_words, coalesce(length(list_aggregate(any_value(t.ws), 'string_agg', '')), 0)::BIGINT AS word_chars,
        coalesce(length(any_value(t.text)) - length(regexp_replace(any_value(t.text), '[#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols,
        coalesce(any_value(d.n_dup_lines), 0)::BIGINT AS n_dup_lines, coalesce(max(c.words) FILTER (c.k = 3), 0)::BIGINT AS n_repeat_words, coalesce(any_value(d.dup_line_chars), 0)::BIGINT AS dup_line_chars, {fields}
      FROM t LEFT JOIN cover c USING (doc_id) LEFT JOIN dup d ON d.doc_id = t.doc_id GROUP BY t.doc_id),
    base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM facts)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, {names}, base_failed,
      NOT base_failed AND NOT (dup_line_chars > word_chars::DOUBLE * {LINE_LIMIT} OR n_symbols > word_chars::DOUBLE * {SYMBOL_LIMIT} OR {over}) AS kept
    FROM base"""


def neardup(shingle: int = 4, percent: int = 80) -> str:
    return f"""
    WITH RECURSIVE t AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS ws FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, hash(list_aggregate(ws[i:i + {shingle - 1}], 'string_agg', ' ')) AS g FROM t, unnest(range(1, greatest(2, len(ws) - {shingle - 2}))) AS r(i) WHERE len(ws) > 0),
    n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    shared AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
    link AS MATERIALIZED (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
    both_ways AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
    reach(doc_id, top) AS (SELECT doc_id, doc_id FROM t UNION SELECT e.b, r.top FROM reach r JOIN both_ways e ON e.a = r.doc_id AND r.top < e.b)
    SELECT t.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.top) AS component_id, t.doc_id = min(r.top) AS kept
    FROM t JOIN reach r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY t.doc_id"""


def shards(names: list[str], size: int = TABLE_SIZE) -> str:
    table = ",".join(str(k) for k in lookup_table(names, size))
    listed = ", ".join(f"'{x}'" for x in names)
    return f"""
    WITH lut AS (SELECT unnest(string_split('{table}', ','))::INT AS k, unnest(range({size}))::INT AS slot),
    d AS (SELECT *, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {size})::INT AS slot FROM documents)
    SELECT d.*, ([{listed}])[k + 1] AS shard FROM d JOIN lut USING (slot)"""


def mixing(seed: int = 41) -> str:
    return f"""
    WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
    r AS (SELECT source, (sum(n) OVER ())::DOUBLE / (count(*) OVER () * n) AS rate FROM c),
    p AS (SELECT source, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p FROM r, range(0, 60) AS x(k)),
    cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM p),
    u AS (SELECT *, ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
    drawn AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM u.source AND cdf.c <= u.u) AS copies FROM u)
    SELECT doc_id, text, lang, source, n_chars, unnest(range(1, copies + 1))::INT AS copy FROM drawn WHERE copies > 0"""


def backoff(alpha: float = 0.4, min_count: int = 2) -> str:
    return f"""
    WITH t AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}'), []) AS ws FROM documents),
    w AS (SELECT doc_id, ws[i] AS w, CASE WHEN i > 1 THEN ws[i - 1] END AS v, CASE WHEN i > 2 THEN ws[i - 2] END AS u FROM t, unnest(range(1, len(ws) + 1)) AS r(i)),
    c1 AS (SELECT w, count(*) AS n FROM w GROUP BY 1), c2 AS (SELECT v, w, count(*) AS n FROM w WHERE v IS NOT NULL GROUP BY ALL), c3 AS (SELECT u, v, w, count(*) AS n FROM w WHERE u IS NOT NULL GROUP BY ALL), total AS (SELECT count(*) AS n FROM w),
    f AS (SELECT w.doc_id, w.v, w.u, c3.n AS uvw, cuv.n AS uv, c2.n AS vw, cv.n AS n_v, cw.n AS n_w, total.n AS n
      FROM w JOIN c1 cw ON cw.w = w.w LEFT JOIN c1 cv ON cv.w = w.v LEFT JOIN c2 ON c2.v = w.v AND c2.w = w.w LEFT JOIN c2 cuv ON cuv.v = w.u AND cuv.w = w.v LEFT JOIN c3 ON c3.u = w.u AND c3.v = w.v AND c3.w = w.w, total),
    s AS (SELECT doc_id, CASE WHEN (u IS NOT NULL AND uvw < {min_count}) OR (v IS NOT NULL AND u IS NULL AND vw < {min_count}) THEN 1 ELSE 0 END AS backed,
        CASE WHEN uvw >= {min_count} THEN ln(uvw / uv) ELSE CASE WHEN u IS NULL THEN 0 ELSE ln({alpha}) END + CASE WHEN v IS NULL THEN ln(n_w / n) WHEN vw >= {min_count} THEN ln(vw / n_v) ELSE ln(n_w / n) + ln({alpha}) END END AS lp FROM f)
    SELECT t.doc_id, count(lp) AS n_words, coalesce(sum(backed), 0)::BIGINT AS n_backoff, round(sum(lp), 4) AS log_score, round(sum(lp) / count(lp), 6) AS mean_log
    FROM t LEFT JOIN s USING (doc_id) GROUP BY t.doc_id"""


def oracles(shard_names: list[str]) -> dict[str, str]:
    return {"op2_repetition": repetition(), "op3_neardup": neardup(), "op4_shards": shards(shard_names), "op6_mixing": mixing(), "op7_backoff": backoff()}
