"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from dietlens.llm import quality


def _stop_list() -> str:
    return ", ".join(f"'{w}'" for w in sorted({w for group in quality.STOP_WORDS.values() for w in group}))


def _verdict(rule: quality.Rule) -> str:
    bounds = [f"1000 * {rule.measure} >= {rule.low} * {rule.per}"] if rule.low is not None else []
    bounds += [f"1000 * {rule.measure} <= {rule.high} * {rule.per}"] if rule.high is not None else []
    return "(" + " AND ".join(bounds) + ")"


QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\x0B\\f\\r]')) AS ls FROM d),
p AS (SELECT r, i, list_slice(ws, i, i + 2) AS g FROM w, range(1, len(ws) - 1) t(i)),
c AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1),
k AS (SELECT r, count(DISTINCT i + j) AS n FROM c, range(0, 3) t(j) GROUP BY r),
m AS (SELECT w.doc_id, len(ws) AS n_words, length(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(k.n, 0) AS n_repeat_words, len(ls) AS n_lines,
             length(regexp_replace(text, '[^!?]', '', 'g')) AS n_marks,
             len(list_filter(ws, lambda x: lower(x) IN ({_stop_list()}))) AS n_stop_words
      FROM w LEFT JOIN k USING (r)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
             concat_ws(',', {', '.join(f"CASE WHEN NOT {_verdict(r)} THEN '{r.name}' END" for r in quality.RULES)}) AS failed_rules FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND failed_rules = '' AS kept, failed_rules FROM b
"""

DEDUP = """
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n,
                  sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER o = 1 AS kept, text_sha256
FROM d WINDOW o AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST)
"""

WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest,
                  row_number() OVER () AS r FROM pages),
g AS (SELECT *, first_value(page_id) OVER o AS first_id, row_number() OVER o > 1 AND payload_bytes >= 100 AS again
      FROM p WINDOW o AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST, r))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first_id END AS refers_to FROM g
"""

_TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MINHASH = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r,
    list_filter(string_split_regex({_LOWER}, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT DISTINCT r, array_to_string(list_slice(ws, i, i + 2), ' ') AS g
      FROM d, range(1, greatest(len(ws) - 1, 2)) t(i) WHERE len(ws) > 0),
n AS (SELECT r, count(*) AS n FROM g GROUP BY r),
common AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM g AS a JOIN g AS b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
half AS (SELECT a, b FROM common JOIN n AS x ON a = x.r JOIN n AS y ON b = y.r WHERE 100 * k >= 85 * (x.n + y.n - k)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT r, r FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reach JOIN d ON reach.b = d.r GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept
FROM d JOIN least USING (r) LEFT JOIN n USING (r)
"""

SEARCH = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOWER}, '{_TERMS}') AS ts FROM documents),
i AS (SELECT item_id, row_number() OVER () AS q, unnest(regexp_extract_all({_LOWER}, '{_TERMS}')) AS t FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(ts))::BIGINT AS n_terms FROM d WHERE len(ts) > 0),
m AS (SELECT r, 25 + (75 * len(ts) * n_docs) // n_terms AS m FROM d, s WHERE len(ts) > 0),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) GROUP BY r, t),
w AS (SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY t, n_docs),
scored AS (SELECT item_id, q, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
           FROM i JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) JOIN d USING (r) GROUP BY item_id, q, doc_id, r)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""

HARD_NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM v AS a JOIN v AS b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5),
n AS (SELECT p.a, p.b, s.b AS c, p.score AS ps, s.score AS ns,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON p.a = s.a AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT a AS anchor_id, b AS positive_id, rank::INTEGER AS rank, c AS negative_id, ps AS positive_score, ns AS negative_score
FROM n WHERE rank <= 3
"""

ORACLE = {
    "op5_warc": WARC, "op9_exact_dedup": DEDUP, "op8_quality_rules": QUALITY,
    "op11_minhash": MINHASH, "op12_search": SEARCH, "op13_hard_negatives": HARD_NEGATIVES,
}
