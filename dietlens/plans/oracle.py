"""DuckDB SQL for the queries of the catalogue that SQL can express.

Written from the rules, not from the Spark code: theta joins, regular expressions and recursion
where the library joins, hashes or iterates.
"""

from __future__ import annotations

from dietlens.constants import FOOD_SIMILARITY_THRESHOLD, SEVERITY_MARKERS
from dietlens.functions.text import EXTRACTION_PROMPT, LABELLING_PROMPT
from dietlens.operators import reasoning as R
from dietlens.operators.relevance import MESSAGES
from dietlens.plans import catalogue as C

SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def norm(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '{SPACE}+', ' ', 'g'))"


def any_of(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


def hits(n: str) -> str:
    tests = ", ".join(f"CASE WHEN regexp_matches({n}, '(^|{NOT_WORD}){t}($|{NOT_WORD})') THEN {q(t)} END" for t in C.LEXICON)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


def items(n: str) -> str:
    segments = f"regexp_extract_all({n}, '(?:{'|'.join(C.MARKERS)}){SPACE}+([^.;:]+)', 1)"
    parts = f"flatten(list_transform({segments}, lambda s: string_split_regex(s, ',| and | or ')))"
    return f"list_filter(list_transform({parts}, lambda p: trim(p, ' .;:')), lambda i: length(i) >= 3)"


def terms(n: str) -> str:
    return f"list_sort(list_distinct(list_concat({hits(n)}, {items(n)})))"


def low(x: str) -> str:
    generic = "[" + ", ".join(q(g) for g in C.GENERIC) + "]"
    return f"(len(list_filter({x}, lambda f: NOT list_contains({generic}, lower(f)))) = 0)"


def rule(x: str) -> str:
    cases = " ".join(f"WHEN regexp_matches({x}, {q('|'.join(ps))}) THEN {q(level)}" for level, ps in C.PATTERNS.items())
    return f"CASE {cases} ELSE 'unknown' END"


SPLIT = """split AS (
  SELECT doc_id, source, lang, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) - 1 AS text_pos
  FROM documents)"""
LINES = f"""{SPLIT}, lines AS (
  SELECT doc_id, text_pos::BIGINT AS text_pos, {strip('source')} AS drug_name, lang, {strip('line')} AS interaction_text
  FROM split WHERE {strip('line')} <> '')"""
TERMS = f"""{LINES}, normed AS (SELECT *, {norm('interaction_text')} AS n FROM lines),
found AS (SELECT *, {terms('n')} AS foods FROM normed)"""
FLAT = f"""{TERMS}, flat AS (
  SELECT doc_id, text_pos, drug_name, interaction_text, unnest(CASE WHEN len(foods) = 0 THEN [NULL] ELSE foods END) AS food FROM found)"""

PAIRS = """pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id AS row_id, b.label AS label,
         round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) AS distance
  FROM embeddings a, embeddings b),
ranked AS (
  SELECT *, greatest(0, least(1, 1 - distance)) AS similarity,
         row_number() OVER (PARTITION BY query_id ORDER BY distance, row_id) AS rank FROM pairs)"""
RANKED = f"""WITH {PAIRS}
SELECT query_id, rank, row_id, round(distance, 6) AS distance, round(similarity, 6) AS similarity FROM ranked WHERE rank <= 10"""


def voted(source: str, label: str = "label", by: str = "query_id") -> str:
    return f"""weights AS (
  SELECT {by}, {label} AS label, sum(similarity) AS w, min(rank) AS first_rank FROM {source} GROUP BY {by}, {label}),
shares AS (
  SELECT *, w / CASE WHEN sum(w) OVER (PARTITION BY {by}) > 0 THEN sum(w) OVER (PARTITION BY {by}) ELSE 1 END AS share,
         row_number() OVER (PARTITION BY {by} ORDER BY w DESC, first_rank) AS place FROM weights)"""


VOTE = f"{PAIRS}, near AS (SELECT * FROM ranked WHERE rank <= {C.K}), {voted('near')}"

PREDICTIONS = f"""{PAIRS}, sized AS (
  SELECT r.*, m.k FROM ranked r, (SELECT unnest([1, 3, 9]) AS k) m
  WHERE r.rank <= 10 AND r.row_id <> r.query_id AND r.rank <= m.k + 1),
{voted('sized', by='query_id, k')},
predictions AS (
  SELECT 'vote' || k AS model, k, e.label::BIGINT AS actual, s.label::BIGINT AS predicted
  FROM shares s JOIN embeddings e ON e.vec_id = s.query_id WHERE place = 1)"""
SCORES = f"""{PREDICTIONS},
labels_met AS (SELECT model, actual AS label FROM predictions UNION SELECT model, predicted FROM predictions),
per_class AS (
  SELECT l.model, l.label,
         count(*) FILTER (p.actual = l.label AND p.predicted = l.label) AS tp,
         count(*) FILTER (p.actual = l.label) AS support, count(*) FILTER (p.predicted = l.label) AS said
  FROM labels_met l JOIN predictions p ON p.model = l.model GROUP BY l.model, l.label),
scored AS (
  SELECT model, label, support,
         CASE WHEN said > 0 THEN tp / said ELSE 0 END AS precision,
         CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
         CASE WHEN said + support > 0 THEN 2 * tp / (said + support) ELSE 0 END AS f1
  FROM per_class),
totals AS (SELECT model, k, avg((actual = predicted)::INT) AS accuracy, count(*) AS n FROM predictions GROUP BY model, k),
summary AS (
  SELECT t.model, t.k, t.n, t.accuracy, s.macro_f1
  FROM totals t JOIN (SELECT model, avg(f1) AS macro_f1 FROM scored GROUP BY model) s USING (model))"""

SEVERITY = "['info', 'minor', 'moderate', 'severe']"

QUESTIONS = f"""questions AS (
  SELECT conv_id * 1000 + turn AS query_id, nullif(regexp_extract({norm('text')}, '{WORD}+'), 'the') AS drug_name,
         nullif(role, 'system') AS food, text AS interaction_text FROM conversations),
vocabulary AS (SELECT DISTINCT unnest(regexp_extract_all({norm('text')}, '{WORD}+')) AS drug_key FROM documents)"""

INJECTABLES = f"""{LINES}, joined AS (
  SELECT drug_name || '-' || lang AS drug, lower(string_agg(interaction_text, ' ' ORDER BY doc_id, text_pos)) AS txt
  FROM lines GROUP BY 1),
injectables AS (
  SELECT lower(drug) AS drug_key FROM joined WHERE {any_of('txt', C.IV_WORDS)} AND NOT {any_of('txt', C.ORAL_WORDS)}
  UNION SELECT unnest([{', '.join(q(c) for c in C.CURATED)}]))"""

REASONED = f"""{PAIRS}, near AS (
  SELECT query_id, row_id, rank, similarity, {SEVERITY}[label % 4 + 1] AS label FROM ranked WHERE rank <= 3),
{voted('near')},
contexts AS (
  SELECT n.query_id, string_agg(coalesce(d.text, ''), ' ' ORDER BY n.rank) AS others,
         list('* [' || n.label || '] ' || d.source || '-' || d.lang || ' with ' || d.lang || ' - ' || d.text ORDER BY n.rank) AS examples
  FROM near n JOIN documents d ON d.doc_id = n.row_id GROUP BY n.query_id),
reasoned AS (
  SELECT d.doc_id AS query_id, d.source || '-' || d.lang AS drug_name, d.lang AS food,
         coalesce(d.text, '') || ' ' || coalesce(c.others, '') AS context, coalesce(c.examples, []) AS examples,
         s.label AS final_severity, round(s.share, 6) AS confidence
  FROM documents d LEFT JOIN contexts c ON c.query_id = d.doc_id LEFT JOIN shares s ON s.query_id = d.doc_id AND s.place = 1)"""
FLAGS = ",\n".join(
    f"         {any_of('lower(context)', words)}{' OR ' + any_of('lower(food)', C.THINNING) if name == 'bleeding' else ''} AS is_{name}"
    for name, words in C.MECHANISMS.items()
)


def choose(key: str, texts: dict[str, str], default: str) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in texts.items())
    return f"CASE {key} {cases} ELSE {q(texts[default])} END"


MECHANISM = f"""{INJECTABLES}, {REASONED},
flagged AS (
  SELECT r.*, i.drug_key IS NOT NULL AS injected,
{FLAGS}
  FROM reasoned r LEFT JOIN injectables i ON i.drug_key = lower(r.drug_name)),
typed AS (
  SELECT *,
    CASE WHEN injected AND is_bleeding THEN 'injectable_bleeding' WHEN injected AND is_alcohol THEN 'injectable_alcohol'
         WHEN injected THEN 'injectable_none' WHEN is_alcohol THEN 'alcohol' WHEN is_absorption THEN 'absorption'
         WHEN is_vitamin_k THEN 'vitamin_k' WHEN is_cyp3a4 THEN 'cyp3a4' WHEN is_bleeding THEN 'bleeding' ELSE 'other' END AS text_key,
    CASE WHEN injected AND is_bleeding THEN 'bleeding' WHEN injected AND is_alcohol THEN 'alcohol'
         WHEN injected THEN 'injectable_none' WHEN is_alcohol THEN 'alcohol' WHEN is_vitamin_k THEN 'vitamin_k'
         WHEN is_cyp3a4 THEN 'cyp3a4' WHEN is_bleeding THEN 'bleeding' WHEN is_absorption THEN 'absorption' ELSE 'other' END AS type_label
  FROM flagged),
worded AS (
  SELECT *,
    {choose('text_key', {k: v[0] for k, v in R.MECHANISM_TEXT.items()}, 'other')} AS mechanism,
    {choose('text_key', {k: v[1] for k, v in R.MECHANISM_TEXT.items()}, 'other')} AS risk,
    CASE WHEN type_label = 'injectable_none' THEN {q(R.INJECTABLE_TEXT)}
         ELSE {choose('final_severity', R.SEVERITY_TEXT, 'info')} END AS severity_english,
    {choose('final_severity', R.RECOMMENDATION, 'info')} AS recommendation
  FROM typed)"""

def along(axis: list[float]) -> str:
    return f"list_dot_product(embedding::DOUBLE[], [{', '.join(repr(a) for a in axis)}]::DOUBLE[])"


PLANE = f"plane AS (SELECT vec_id AS row_id, label, {along(C.AXES[0])} AS x, {along(C.AXES[1])} AS y FROM embeddings)"
DENSITY = f"""WITH RECURSIVE {PLANE},
points AS (SELECT x, y, count(*) AS n FROM plane GROUP BY x, y),
near AS (
  SELECT a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_, b.n AS n, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d
  FROM points a, points b WHERE d <= {C.EPS * C.EPS!r}),
core AS (SELECT ax AS x, ay AS y FROM near GROUP BY ax, ay HAVING sum(n) >= {C.MIN_POINTS}),
edges AS (SELECT ax, ay, bx, by_ FROM near JOIN core a ON a.x = ax AND a.y = ay JOIN core b ON b.x = bx AND b.y = by_),
reach AS (
  SELECT x, y, x AS rx, y AS ry FROM core
  UNION SELECT e.bx, e.by_, r.rx, r.ry FROM reach r JOIN edges e ON e.ax = r.x AND e.ay = r.y),
roots AS (SELECT x, y, min(struct_pack(x := rx, y := ry)) AS root FROM reach GROUP BY x, y),
border AS (
  SELECT ax AS x, ay AS y, arg_min(root, struct_pack(d := d, x := bx, y := by_)) AS root
  FROM near JOIN roots ON roots.x = bx AND roots.y = by_
  WHERE (ax, ay) NOT IN (SELECT (x, y) FROM core) GROUP BY ax, ay),
members AS (SELECT * FROM roots UNION ALL SELECT * FROM border),
kept AS (
  SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster
  FROM members JOIN points USING (x, y) GROUP BY root HAVING sum(n) >= {C.MIN_SIZE}),
found AS (
  SELECT p.row_id, p.label, coalesce(k.cluster, -1)::BIGINT AS cluster
  FROM plane p LEFT JOIN members m USING (x, y) LEFT JOIN kept k USING (root))"""

# The corpus of the whole job, its vectors as (row, term, weight), and all queries against all rows.


def hashed(rows: str, key: str, text: str, name: str) -> str:
    """CTEs that encode `text` of `rows`; the weights come from `idf`."""
    return f"""{name}_words AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {C.TFIDF_SIZE} AS term FROM (
    SELECT {key}, unnest(regexp_extract_all(lower(coalesce({text}, '')), '[\\p{{L}}\\p{{N}}]+')) AS w FROM {rows})),
{name}_counts AS (SELECT {key}, term, count(*) AS n FROM {name}_words GROUP BY {key}, term)"""


def unit(key: str, name: str) -> str:
    return f"""{name}_idf AS (SELECT {key}, term, n * weight AS w FROM {name}_counts JOIN idf USING (term) WHERE weight <> 0),
{name}_float AS (SELECT {key}, term, (w / sqrt(sum(w * w) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w FROM {name}_idf),
{name}_unit AS (SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM {name}_float)"""


def idf(rows: str, name: str) -> str:
    return f"""idf AS (SELECT term, ln(((SELECT count(*) FROM {rows}) + 1) / (count(*) + 1)) AS weight FROM {name}_counts GROUP BY term)"""


def nearest(asked: str, asked_key: str, rows: str, key: str, a: str, b: str) -> str:
    return f"""dots AS (SELECT x.{asked_key} AS q, y.{key} AS r, sum(x.w * y.w) AS s FROM {a}_unit x JOIN {b}_unit y USING (term) GROUP BY ALL),
near AS (
  SELECT q.{asked_key} AS q, r.{key} AS r, round(1 - coalesce(s, 0), 12) AS distance,
         row_number() OVER (PARTITION BY q.{asked_key} ORDER BY round(1 - coalesce(s, 0), 12), r.{key}) AS rank
  FROM (SELECT DISTINCT {asked_key} FROM {asked}) q CROSS JOIN {rows} r LEFT JOIN dots ON dots.q = q.{asked_key} AND dots.r = r.{key})"""


JOB = f"""{FLAT}, sevens AS (
  SELECT *, CASE WHEN {rule('lower(interaction_text)')} = 'unknown' THEN 'info' ELSE {rule('lower(interaction_text)')} END AS severity,
         row_number() OVER (ORDER BY doc_id, text_pos, food) - 1 AS row_id FROM flat),
corpus AS (
  SELECT row_id, food, severity, 'Drug: ' || drug_name || '. Food: ' || coalesce({strip('food')}, 'general food') || '. Interaction: ' || interaction_text AS document
  FROM sevens),
asked AS (
  SELECT conv_id * 1000 + turn AS query_id, 'SRC' || (conv_id % 25) AS drug_name, regexp_extract({norm('text')}, '{WORD}+') AS food, text FROM conversations),
{hashed('corpus', 'row_id', 'document', 'rows')}, {idf('corpus', 'rows')}"""
ASKED = f"""texts AS (
  SELECT query_id, 'Drug: ' || drug_name || '. Food: ' || coalesce(nullif({strip('food')}, ''), 'general food') || '. Interaction: ' || coalesce(text, '') AS document FROM asked),
{hashed('texts', 'query_id', 'document', 'asks')}, {unit('query_id', 'asks')}, {unit('row_id', 'rows')},
{nearest('texts', 'query_id', 'corpus', 'row_id', 'asks', 'rows')},
retrieved AS (
  SELECT q AS query_id, rank, r AS row_id, severity AS label, distance, greatest(0, least(1, 1 - distance)) AS similarity
  FROM near JOIN corpus ON row_id = r WHERE rank <= 10)"""


ORACLE = {
    "severity_counts": f"WITH {LINES} SELECT {rule(norm('interaction_text'))} AS severity, count(*) AS n FROM lines GROUP BY 1",
    "explode_lines": f"WITH {LINES} SELECT doc_id, text_pos, drug_name, interaction_text FROM lines",
    "normalize_text": f"""SELECT conv_id, turn, {norm('text')} AS normalized,
  len(list_filter(string_split({norm('text')}, ' '), lambda w: w <> ''))::BIGINT AS n_words FROM conversations""",
    "lexicon_match": f"""WITH n AS (SELECT doc_id, {norm('text')} AS n FROM documents)
SELECT doc_id, array_to_string(list_sort({hits('n')}), '; ') AS terms FROM n""",
    "lexicon_match_join": f"""WITH lexicon AS (SELECT DISTINCT unnest(regexp_extract_all({norm('text')}, '{WORD}+')) AS term FROM benchmark),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all({norm('text')}, '{WORD}+')) AS term FROM documents)
SELECT doc_id, term FROM words JOIN lexicon USING (term)""",
    "lexicon_file": f"""WITH words AS (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark),
parts AS (SELECT lower({strip('unnest(string_split(w, chr(10)))')}) AS term FROM words)
SELECT term FROM parts WHERE term <> '' UNION SELECT unnest([{', '.join(q(t) for t in C.LEXICON)}])""",
    "extract_terms_join": f"""WITH lexicon AS (SELECT DISTINCT unnest(regexp_extract_all({norm('text')}, '{WORD}+')) AS term FROM benchmark),
normed AS (SELECT doc_id, {norm('text')} AS n FROM documents),
words AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(n, '{WORD}+')) AS term FROM normed),
known AS (SELECT doc_id, list(term) AS terms FROM words JOIN lexicon USING (term) GROUP BY doc_id)
SELECT doc_id, md5(array_to_string(list_sort(list_distinct(list_concat(coalesce(terms, []), {items('n')}))), '; ')) AS terms
FROM normed LEFT JOIN known USING (doc_id)""",
    "enumeration_extract": f"""WITH n AS (SELECT doc_id, {norm('text')} AS n FROM documents)
SELECT doc_id, array_to_string({items('n')}, '|') AS items FROM n""",
    "extract_terms": f"WITH {TERMS} SELECT doc_id, text_pos, array_to_string(foods, '; ') AS food_entities_str FROM found",
    "low_information": f"""WITH n AS (SELECT doc_id, {norm('text')} AS n FROM documents)
SELECT doc_id, {low(terms('n'))} AS low_all, {low(hits('n'))} AS low_lexicon FROM n""",
    "flatten_terms": f"WITH {FLAT} SELECT doc_id, text_pos, drug_name, food FROM flat",
    "severity_label": f"WITH {LINES} SELECT doc_id, text_pos, {rule('lower(interaction_text)')} AS rule_label FROM lines",
    "final_label": f"""WITH {LINES}, ruled AS (SELECT *, {rule('lower(interaction_text)')} AS rule_label FROM lines)
SELECT r.doc_id, r.text_pos, r.rule_label,
  CASE WHEN r.rule_label <> 'unknown' THEN r.rule_label
       WHEN l.doc_id IS NULL OR (l.quality = 0 AND l.toxic = 1) THEN 'info'
       WHEN l.toxic = 1 THEN 'severe' WHEN l.quality = 1 THEN 'moderate' ELSE 'minor' END AS severity
FROM ruled r LEFT JOIN labels l ON l.doc_id = r.doc_id""",
    "extract_with_answers": f"""WITH {TERMS}
SELECT f.doc_id, f.text_pos, array_to_string(CASE
    WHEN {low('foods')} AND l.doc_id IS NOT NULL AND NOT (l.quality = 0 AND l.toxic = 1)
    THEN list_sort(list_distinct(list_concat(foods, ['zucchini', f.doc_id::VARCHAR, l.quality::VARCHAR])))
    ELSE foods END, '; ') AS food_entities_str
FROM found f LEFT JOIN labels l ON l.doc_id = f.doc_id""",
    "unresolved_prompts": f"""WITH {LINES}
SELECT doc_id, text_pos, md5({q(LABELLING_PROMPT)} || interaction_text) AS label_prompt,
       md5({q(EXTRACTION_PROMPT)} || interaction_text) AS extract_prompt
FROM lines WHERE {rule('lower(interaction_text)')} = 'unknown'""",
    "parse_food_list": """WITH raw AS (
  SELECT event_id, 'Answer:' || chr(10) || '[" ' || event_type || ' ", ' || value::VARCHAR || ', ' || user_id::VARCHAR || ', null, [3], ' || props || '] - done' AS raw
  FROM events),
listed AS (SELECT event_id, json_extract(regexp_extract(raw, '(?s)\\[.*\\]'), '$[*]') AS elements FROM raw)
SELECT event_id, array_to_string(list_transform(
  list_filter(elements, lambda e: json_type(e) IN ('VARCHAR', 'UBIGINT', 'BIGINT', 'DOUBLE')),
  lambda e: trim(json_extract_string(e, '$'))), '|') AS foods FROM listed""",
    "embedding_text": f"""WITH {FLAT}
SELECT doc_id, text_pos, food,
       md5('Drug: ' || drug_name || '. Food: ' || coalesce({strip('food')}, 'general food') || '. Interaction: ' || interaction_text) AS embedding_text
FROM flat""",
    "head_rows": f"WITH {LINES} SELECT doc_id, text_pos, drug_name, interaction_text FROM lines ORDER BY doc_id, text_pos LIMIT 10",
    "row_key": f"WITH {LINES} SELECT doc_id, text_pos, drug_name, row_number() OVER (ORDER BY doc_id, text_pos) - 1 AS row_id FROM lines",
    "alignment": """SELECT doc_id, 'right' AS missing_in FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'left' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""",
    "id_range_check": "SELECT doc_id AS vec_id FROM labels WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "category_codes": "SELECT doc_id, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM documents",
    "vocabulary": "SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL ORDER BY 1",
    "vocabulary_counts": f"""WITH {LINES} SELECT count(*) AS num_rows, count(DISTINCT lower(drug_name)) AS num_drugs,
  count(DISTINCT doc_id) AS num_documents FROM lines""",
    "l2_normalize": """WITH s AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * label) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM s)
SELECT vec_id, CASE WHEN norm > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS sq_norm, round(CASE WHEN norm > 0 THEN v[1] / norm ELSE 0 END, 6) AS first_value FROM n""",
    "cosine_pairs": """SELECT a.vec_id AS row_id, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1""",
    "knn_exact": RANKED,
    "knn_blocked": RANKED,
    "knn_by_id": f"""WITH {PAIRS} SELECT query_id, rank, row_id, label, round(distance, 6) AS distance
FROM ranked WHERE rank <= {C.K} AND query_id IN (SELECT doc_id FROM labels)""",
    "neighbor_lists": f"""WITH {PAIRS}
SELECT query_id, string_agg(rank || ':' || row_id || ':' || label, '|' ORDER BY rank) AS neighbors FROM ranked WHERE rank <= {C.K} GROUP BY query_id""",
    "neighbor_vote": f"""WITH {VOTE}
SELECT query_id, label::BIGINT AS neighbor_pred, round(share, 6) AS neighbor_confidence FROM shares WHERE place = 1""",
    "vote_distribution": f"WITH {VOTE} SELECT query_id, label::BIGINT AS label, round(share, 6) AS share FROM shares",
    "nearest_food": """WITH typed AS (
  SELECT vec_id, list_transform(embedding, lambda x, i: CASE WHEN i % 2 = 1 THEN x ELSE 0 END)::DOUBLE[] AS v FROM embeddings WHERE vec_id % 20 = 0),
sims AS (
  SELECT a.vec_id AS query_id, format('food-{:09d}', f.vec_id) AS food_name, round(1 - list_cosine_similarity(a.v, f.embedding::DOUBLE[]), 12) AS distance
  FROM typed a, embeddings f),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, food_name) AS place FROM sims)
SELECT query_id, CASE WHEN 1 - distance >= 0.7 THEN food_name ELSE 'typed' END AS resolved_food,
       round(1 - distance, 6) AS food_similarity_score FROM best WHERE place = 1""",
    "vector_metadata": "SELECT count(*) AS num_rows, max(len(embedding))::BIGINT AS embedding_dim, 'cosine' AS metric FROM embeddings",
    "severity_combine": f"""WITH {PAIRS}, near AS (
  SELECT query_id, rank, similarity, {SEVERITY}[label % 4 + 1] AS label FROM ranked WHERE rank <= 10), {voted('near')},
both_labels AS (
  SELECT s.query_id, s.label AS neighbor_pred, s.share, ['info', 'severe', 'minor', 'odd'][e.label % 4 + 1] AS classifier_pred
  FROM shares s JOIN embeddings e ON e.vec_id = s.query_id WHERE s.place = 1),
ranks AS (
  SELECT *, greatest(coalesce(list_position({SEVERITY}, neighbor_pred), 0) - 1, 0) AS n_rank,
         greatest(coalesce(list_position({SEVERITY}, classifier_pred), 0) - 1, 0) AS c_rank FROM both_labels),
final AS (SELECT *, CASE WHEN n_rank > c_rank THEN neighbor_pred ELSE classifier_pred END AS final_severity FROM ranks)
SELECT query_id, neighbor_pred, classifier_pred, neighbor_pred = classifier_pred AS agreement, final_severity,
  CASE WHEN neighbor_pred = classifier_pred AND share >= 0.7 THEN 'high'
       WHEN neighbor_pred = classifier_pred OR share >= 0.4 THEN 'medium' ELSE 'low' END AS confidence_level,
  greatest(n_rank, c_rank)::BIGINT AS final_rank,
  CASE final_severity {' '.join(f'WHEN {q(k)} THEN {q(v)}' for k, v in SEVERITY_MARKERS.items())} ELSE '⚪ غير معروفة' END AS marker
FROM final""",
    "confusion": f"WITH {PREDICTIONS} SELECT model, actual, predicted, count(*) AS n FROM predictions GROUP BY ALL",
    "confusion_matrix": f"""WITH {PREDICTIONS}
SELECT actual, {', '.join(f'count(*) FILTER (predicted = {i}) AS p{i}' for i in range(10))}
FROM predictions WHERE model = 'vote3' GROUP BY actual""",
    "model_scores": f"WITH {SCORES} SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1 FROM summary",
    "class_report": f"""WITH {SCORES}
SELECT model, label::VARCHAR AS label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support::BIGINT AS support FROM scored
UNION ALL SELECT model, 'accuracy', round(accuracy, 6), round(accuracy, 6), round(accuracy, 6), n::BIGINT FROM summary
UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM scored GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM scored GROUP BY model""",
    "best_model": f"""WITH {SCORES} SELECT model, round(macro_f1, 6) AS macro_f1, round(accuracy, 6) AS accuracy
FROM summary ORDER BY summary.macro_f1 DESC, summary.accuracy DESC, k LIMIT 1""",
    "class_weights": """SELECT quality, count(*) AS n,
  round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight FROM labels GROUP BY quality""",
    "stratified_split": """SELECT doc_id, quality,
  row_number() OVER (PARTITION BY quality ORDER BY substr(md5(doc_id || ':42'), 1, 8), doc_id)
    <= floor(0.2 * count(*) OVER (PARTITION BY quality) + 0.5) AS is_test FROM labels""",
    "injectable_set": f"WITH {INJECTABLES} SELECT drug_key FROM injectables",
    "unknown_drugs": f"""WITH {QUESTIONS}
SELECT query_id, drug_name, coalesce(lower(drug_name) IN (SELECT drug_key FROM vocabulary), false) AS known FROM questions""",
    "relevance_check": f"""WITH {QUESTIONS}, reasons AS (
  SELECT *, CASE
    WHEN length(coalesce(drug_name, '')) < 2 OR length(coalesce(food, '')) < 2 THEN 'missing_drug_or_food'
    WHEN {any_of('lower(interaction_text)', C.OFF_TOPIC)} OR {any_of('lower(food)', C.OFF_TOPIC)} OR {any_of('lower(drug_name)', C.OFF_TOPIC)} THEN 'irrelevant_domain'
    WHEN lower(drug_name) NOT IN (SELECT drug_key FROM vocabulary) THEN 'unknown_drug'
    WHEN len(list_filter(string_split({norm('interaction_text')}, ' '), lambda w: w <> '')) < 3 THEN 'low_context'
    ELSE 'ok' END AS relevance_reason FROM questions)
SELECT query_id, relevance_reason IN ('ok', 'low_context') AS relevant, relevance_reason,
  CASE relevance_reason WHEN 'missing_drug_or_food' THEN {q(MESSAGES['missing_drug_or_food'])}
    WHEN 'irrelevant_domain' THEN {q(MESSAGES['irrelevant_domain'])}
    WHEN 'unknown_drug' THEN {q(MESSAGES['unknown_drug'])} || drug_name END AS relevance_message FROM reasons""",
    "validation": f"""WITH {QUESTIONS} SELECT query_id, CASE WHEN drug_name IS NULL THEN 'choose_drug'
  WHEN food IS NULL OR {strip('food')} = '' THEN 'enter_food' END AS error FROM questions""",
    "context_text": f"WITH {REASONED} SELECT query_id, md5(context) AS context FROM reasoned",
    "mechanism": f"WITH {MECHANISM} SELECT query_id, type_label, mechanism, risk, severity_english, recommendation FROM worded",
    "neighbor_examples": f"WITH {REASONED} SELECT query_id, md5(coalesce(array_to_string(examples[1:2], chr(10)), '')) AS examples FROM reasoned",
    "prompts": f"""WITH {MECHANISM} SELECT query_id, md5(
  'Explain this drug and food interaction to a patient in plain Modern Standard Arabic. Give no doses and send every change to a doctor or pharmacist.' || chr(10)
  || 'Drug: ' || drug_name || chr(10) || 'Food: ' || CASE WHEN food = 'en' THEN 'en (closest known food: english)' ELSE food END || chr(10)
  || 'Severity: ' || final_severity || ' - ' || severity_english || chr(10) || 'Mechanism: ' || mechanism || chr(10)
  || 'Risk: ' || risk || chr(10) || 'Advice: ' || recommendation || chr(10) || 'Similar known cases:' || chr(10)
  || array_to_string(examples, chr(10)) || chr(10)
  || 'Answer with: drug and food; severity word; meaning and risks; advice; a closing warning.') AS prompt FROM worded""",
    "explanations": f"""WITH {MECHANISM}, cores AS (
  SELECT w.query_id, final_severity, confidence, CASE WHEN l.quality = 0 THEN 'made for ' || l.doc_id || chr(10) || chr(10) || {q(R.WARNING)}
    ELSE 'الدواء: ' || drug_name || chr(10) || 'الطعام أو العشبة: ' || food || chr(10) || 'درجة الخطورة: '
      || CASE final_severity WHEN 'severe' THEN 'شديدة' WHEN 'moderate' THEN 'متوسطة' WHEN 'minor' THEN 'بسيطة' WHEN 'info' THEN 'معلوماتية فقط' ELSE 'غير معروفة' END
      || chr(10) || 'آلية التداخل: ' || mechanism || chr(10) || 'المخاطر: ' || risk || chr(10) || 'النصيحة: ' || recommendation
      || chr(10) || chr(10) || {q(R.WARNING)} END AS core
  FROM worded w LEFT JOIN labels l ON l.doc_id = w.query_id),
noted AS (
  SELECT *, concat_ws(chr(10), CASE WHEN final_severity IN ('severe', 'moderate') THEN {q(R.SERIOUS_NOTE)} END,
                      CASE WHEN confidence IS NULL OR confidence < 0.9 THEN {q(R.UNSURE_NOTE)} END) AS notes FROM cores)
SELECT query_id, CASE WHEN notes = '' THEN core ELSE core || chr(10) || chr(10) || notes END AS explanation FROM noted""",
    "cluster_sizes": "SELECT label::BIGINT AS cluster, count(*) AS n FROM embeddings GROUP BY 1 ORDER BY 1",
    "plot_bins": f"""WITH {PLANE}, codes AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM plane))
SELECT floor(x / {C.BIN})::BIGINT AS x_bin, floor(y / {C.BIN})::BIGINT AS y_bin, label::BIGINT AS label, code, count(*) AS n
FROM plane JOIN codes USING (label) GROUP BY ALL""",
    "density_clusters": f"{DENSITY} SELECT row_id, cluster FROM found",
    "clustering_summary": f"""{DENSITY},
sizes AS (
  SELECT 'label' AS name, label::VARCHAR AS id, count(*) AS size FROM found GROUP BY label
  UNION ALL SELECT 'cluster_hdbscan', cluster::VARCHAR, count(*) FROM found GROUP BY cluster)
SELECT name, id, size, {C.EPS}::DOUBLE AS eps, {C.MIN_POINTS}::BIGINT AS min_points, 'euclidean' AS metric FROM sizes""",
    "density_off": "SELECT vec_id AS row_id, (-1)::BIGINT AS cluster FROM embeddings",
    "json_round_trip": f"WITH {LINES} SELECT doc_id, text_pos, drug_name, interaction_text FROM lines",
    "csv_round_trip": "SELECT doc_id, source, nullif(lang, 'en') AS food, md5(text) AS text FROM documents",
    "raw_records": f"WITH {LINES} SELECT doc_id, text_pos, drug_name, md5(interaction_text) AS interaction_text FROM lines",
    "vector_store_round_trip": """SELECT count(*) AS num_rows, max(len(embedding))::BIGINT AS embedding_dim, 'cosine' AS metric,
  round(sum(list_sum(embedding::DOUBLE[])), 4) AS total FROM embeddings""",
    "explanations_csv": f"""WITH asked AS (
  SELECT conv_id * 1000 + turn AS query_id, 'src' || (conv_id % 25) AS drug, regexp_extract({norm('text')}, '{WORD}+') AS food, text AS t FROM conversations),
reasons AS (
  SELECT *, CASE WHEN length(food) < 2 THEN 'missing_drug_or_food'
    WHEN {any_of('lower(t)', C.OFF_TOPIC)} OR {any_of('lower(food)', C.OFF_TOPIC)} THEN 'irrelevant_domain'
    WHEN drug NOT IN (SELECT lower(source) FROM documents) THEN 'unknown_drug' ELSE 'ok' END AS relevance_reason FROM asked)
SELECT query_id, upper(drug) AS drug_name, nullif(food, '') AS food, md5(t) AS interaction_text, relevance_reason = 'ok' AS relevant, relevance_reason FROM reasons""",
    "encode_text": f"""SELECT doc_id,
  CASE WHEN len(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm,
  {C.TFIDF_SIZE}::BIGINT AS dim FROM documents""",
}
ORACLE["encode_hashed"] = f"""WITH {hashed('documents', 'doc_id', 'text', 'rows')}, {idf('documents', 'rows')}, {unit('doc_id', 'rows')}
SELECT doc_id, term, round(w, 5) AS weight FROM rows_float"""
ORACLE["encode_batches"] = """WITH c AS (SELECT doc_id, list_transform(['a', 'e', 'i', 'o', 'u'], lambda v: length(text) - length(replace(text, v, ''))) AS n FROM documents),
m AS (SELECT doc_id, n, greatest(1, sqrt(list_sum(list_transform(n, lambda x: x * x)))) AS norm FROM c)
SELECT doc_id, round(n[1] / norm, 4) AS a, round(n[2] / norm, 4) AS e, round(n[3] / norm, 4) AS i, round(n[4] / norm, 4) AS o, round(n[5] / norm, 4) AS u FROM m"""
ORACLE["retrieve"] = f"WITH {JOB}, {ASKED} SELECT query_id, rank, row_id, label AS severity, round(distance, 6) AS distance FROM retrieved"
ORACLE["zero_shot"] = f"""WITH {JOB}, {ASKED}, {voted('retrieved')}
SELECT query_id, label AS neighbor_pred, round(share, 6) AS neighbor_confidence, 10::BIGINT AS n_neighbors FROM shares WHERE place = 1"""
ORACLE["resolve_foods"] = f"""WITH {JOB},
foods AS (SELECT DISTINCT food AS food_name FROM corpus WHERE food IS NOT NULL AND {strip('food')} <> ''),
{hashed('foods', 'food_name', 'food_name', 'foods')}, {unit('food_name', 'foods')},
typed AS (SELECT DISTINCT food, {strip('food')} AS t FROM asked WHERE {strip('food')} <> ''), {hashed('typed', 'food', 't', 'typed')}, {unit('food', 'typed')},
{nearest('typed', 'food', 'foods', 'food_name', 'typed', 'foods')}
SELECT query_id, food, CASE WHEN food IS NULL THEN NULL WHEN {strip('food')} = '' THEN '' WHEN 1 - distance >= {FOOD_SIMILARITY_THRESHOLD} THEN r ELSE food END AS resolved_food,
       round(coalesce(1 - distance, 0), 6) AS food_similarity_score
FROM asked LEFT JOIN near ON q = food AND rank = 1"""
ORACLE["explanation_texts"] = ORACLE["explanations"]
ORACLE["model_summary"] = f"""SELECT c.model, s.accuracy, s.macro_f1, c.model = b.model AS best, c.actual, c.predicted, c.n
FROM ({ORACLE['confusion']}) c JOIN ({ORACLE['model_scores']}) s USING (model), ({ORACLE['best_model']}) b"""
