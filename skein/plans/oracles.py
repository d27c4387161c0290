"""SQL for DuckDB with the same rows as the queries of `catalogue`."""

from __future__ import annotations

from skein.operators.retrieve import STOP_WORDS

WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def words(col: str) -> str:
    return WORDS.format(col)


_LEXICON = "(VALUES ('thing','thing'),('things','thing'),('erth','earth'),('erea','earth'),('und','joining'),('nicht','joining'),('para','purpose'),('dans','purpose'),('the','article'),('les','article'),('las','article'),('was','being'),('are','being')) AS l(alias, term)"
_HITS = f"hits AS (SELECT DISTINCT doc_id, term FROM (SELECT doc_id, unnest(list_distinct({words('text')})) AS alias FROM documents) d JOIN {_LEXICON} USING (alias))"
_PLACE = """
triples AS (
  SELECT 0 * 1000000000000 + c_custkey AS ord, c_name AS subject, 'customer' AS st, n_name AS object, 'nation' AS ot, 'customer' AS doc FROM customer JOIN nation ON c_nationkey = n_nationkey
  UNION ALL SELECT 1000000000000 + n_nationkey, n_name, 'nation', r_name, 'region', 'nation' FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 2000000000000 + s_suppkey, s_name, 'supplier', n_name, 'nation', 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey
)"""
_ENTITIES = """
sides AS (SELECT ord, 0 AS side, lower(trim(subject)) AS name, st AS type, doc FROM triples UNION ALL SELECT ord, 1, lower(trim(object)), ot, doc FROM triples),
entities AS (SELECT name, arg_min(type, ord * 2 + side) AS type, count(*) AS mention_count, count(DISTINCT doc) AS n_docs FROM sides GROUP BY name)"""
_PART_OF = "edges AS (SELECT DISTINCT lower(trim(subject)) AS src, lower(trim(object)) AS dst FROM triples)"
_BRAND = """
uses AS (
  SELECT o_orderkey * 100 + l_linenumber AS ord, 'c' || o_custkey AS subject, p_brand AS object, o_orderdate AS ts, o_orderkey AS doc
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
),
folded AS (
  SELECT subject AS src, lower(object) AS dst, count(*) AS n, count(DISTINCT doc) AS n_docs, max(ts) AS last_reinforced, least(1.0, 0.5 + 0.1 * (count(*) - 1)) AS weight
  FROM uses GROUP BY 1, 2
),
decayed AS (
  SELECT src, dst, n - 1 AS reinforcement_count,
         weight * pow(0.5, greatest(0.0, date_diff('microsecond', last_reinforced, TIMESTAMP '2001-08-02 00:00:00') / 86400000000.0) / (1000 * pow(1 + 0.3 * (n - 1), 0.5))) AS weight
  FROM folded
)"""
_UNDIRECTED = """
edges AS (SELECT DISTINCT lower(trim(subject)) AS src, lower(trim(object)) AS dst FROM triples),
both_ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"""
_COSINE = "list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})))"
_VEC = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_COS = _COSINE.format(a="a.v", b="b.v")
_L2 = "round(sqrt(list_sum(list_transform(list_zip(q.v, d.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))), 9)"
_CANDIDATES = f"c AS (SELECT a.label AS kind, a.vec_id AS a, b.vec_id AS b, {_COS} AS similarity FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id)"


def _top(where_q: str, where_d: str = "true", k: int = 10, distance: str = _L2) -> str:
    return f"""
  SELECT * FROM (
    SELECT q.vec_id AS query_id, d.vec_id AS id, d.label, {distance} AS distance,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {distance}, d.vec_id) AS rank
    FROM e q JOIN e d ON q.vec_id <> d.vec_id WHERE {where_q} AND {where_d}
  ) WHERE rank <= {k}"""


_TF = f"""
tok AS (SELECT doc_id AS id, {words('text')} AS w FROM documents),
lens AS (SELECT count(*) AS n_docs, avg(len(w)) AS avg_len FROM tok),
tf AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(w) AS len, unnest(w) AS term FROM tok) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def _bm25(name: str, asked: str, key: str, k: int) -> str:
    """The best k documents of each key of `asked` (key, text), as (key, id, bm25, rank)."""
    return f"""
{name}_q AS (SELECT {key}, unnest(list_distinct({words('text')})) AS term FROM ({asked})),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY bm25 DESC, id) AS rank FROM (
  SELECT {key}, id, round(sum(ln(1 + (n_docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS bm25
  FROM {name}_q JOIN tf USING (term) JOIN df USING (term), lens GROUP BY 1, 2)) WHERE rank <= {k})"""


_BM25 = f"{_TF}, {_bm25('keyword', 'SELECT item_id AS query_id, text FROM benchmark', 'query_id', 10)}"
_KNOWN = "ents AS (SELECT * FROM (VALUES ('thing', 9, 0), ('things', 4, 1), ('the thing', 7, 2), ('erth', 12, 3), ('erth and', 3, 4), ('und', 6, 5), ('und nicht', 5, 6), ('nicht', 8, 7), ('para', 2, 8), ('dans les', 2, 9), ('les', 11, 10), ('was', 1, 11)) AS v(name, mention_count, first_ord))"


def _recognised(asked: str) -> str:
    return rf"""
{_KNOWN},
cand_l AS (SELECT query_id, list_concat(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w) AS l FROM (SELECT query_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS w FROM ({asked}))),
cand AS (SELECT query_id, i - 1 AS pos, l[i] AS candidate FROM cand_l, unnest(range(1, len(l) + 1)) AS r(i) WHERE length(l[i]) >= 2),
named AS (SELECT candidate, arg_min(name, first_ord - 1000 * mention_count) AS name FROM (SELECT DISTINCT candidate FROM cand) c JOIN ents ON contains(name, candidate) GROUP BY 1),
seeds AS (
  SELECT query_id, name, min(pos)::BIGINT AS pos FROM cand JOIN named USING (candidate)
  WHERE len(list_intersect(string_split(name, ' '), string_split(candidate, ' '))) / len(list_distinct(string_split(name, ' '))) >= 0.8 GROUP BY 1, 2
)"""


_TERM_GRAPH = r"""
held AS (SELECT doc_id, name AS term FROM documents, ents WHERE contains(' ' || regexp_replace(lower(text), '\s+', ' ', 'g') || ' ', ' ' || name || ' ')),
heavy AS (SELECT a.term AS src, b.term AS dst FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2 HAVING count(*) >= 2),
both_ways AS (SELECT src, dst FROM heavy UNION SELECT dst, src FROM heavy),
walk AS (SELECT name AS seed, name, 0 AS distance FROM ents UNION SELECT seed, dst, distance + 1 FROM walk JOIN both_ways ON name = src WHERE distance < 2),
near AS (SELECT seed, name, 1.0 / (1 + min(distance)) AS score FROM walk WHERE name <> seed GROUP BY 1, 2),
capped AS (SELECT seed, name AS other, score, row_number() OVER (PARTITION BY seed ORDER BY score DESC, name) AS rk FROM near)"""
_EXPANSIONS = f"""
{_recognised('SELECT item_id AS query_id, text FROM benchmark')}, {_TERM_GRAPH},
paired AS (SELECT query_id, name, other, score, pos, rk, least(name, other) || '|' || greatest(name, other) AS key FROM seeds JOIN capped ON seed = name WHERE rk <= 3),
expanded AS (SELECT * FROM (SELECT query_id, name || ' ' || other AS expansion, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos, name, rk) AS no
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY pos, name, rk) AS r FROM paired) WHERE r = 1) WHERE no <= 5)"""
_GUIDED = f"""
{_EXPANSIONS},
phases AS (SELECT query_id, 0 AS phase, no, expansion AS text FROM expanded UNION ALL SELECT query_id, 1, pos, name FROM seeds),
{_bm25('searched', 'SELECT DISTINCT text AS phrase, text FROM phases', 'phrase', 3)},
keyed AS (SELECT p.query_id, phase, no, p.text, s.rank AS hit, s.id, d.text[1:100] AS start FROM phases p JOIN searched s ON s.phrase = p.text JOIN documents d ON d.doc_id = s.id),
guided AS (SELECT * FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY phase, no, text, hit, id) AS rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, start ORDER BY phase, no, text, hit, id) AS r FROM keyed) WHERE r = 1) WHERE rank <= 20)"""
_FUSED = f"""
{_GUIDED},
{_VEC},
vector AS ({_top('q.vec_id IN (SELECT item_id FROM benchmark)')}),
parts AS (
  SELECT query_id, id, 0 AS no, 'vector' AS source, 0.5 / (60 + rank - 1) AS part FROM vector
  UNION ALL SELECT query_id, id, 1, 'graph', 0.3 / (60 + rank - 1) FROM guided
  UNION ALL SELECT query_id, id, 2, 'fulltext', 0.2 / (60 + rank - 1) FROM keyword
),
fused AS (
  SELECT query_id, id, round(sum(part), 9) AS score, count(DISTINCT source) AS n_sources,
         CASE WHEN count(DISTINCT source) > 1 THEN 'hybrid' ELSE arg_min(source, no) END AS origin
  FROM parts GROUP BY 1, 2
),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused) WHERE rank <= 10)"""
_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def _telling(text: str) -> str:
    return f"list_filter(list_distinct({words(text)}), lambda x: NOT list_contains({_STOP}, x))"


_HYBRID = f"""
{_BM25}, {_FUSED},
x AS (
  SELECT r.query_id, r.id, origin, score, i.text AS query, d.text, {_telling('i.text')} AS qw, {_telling('d.text[1:500]')} AS dw,
         CASE WHEN ts IS NULL OR {{days}} < 0 THEN 1.0 ELSE greatest(pow(0.5, {{days}} / 90.0), 0.3) END::DOUBLE AS f
  FROM ranked r JOIN documents d ON d.doc_id = r.id JOIN benchmark i ON i.item_id = r.query_id LEFT JOIN events e ON e.event_id = r.id
),
y AS (SELECT *, CASE WHEN len(qw) = 0 THEN 1.0 WHEN len(dw) = 0 THEN 0.0 ELSE len(list_intersect(qw, dw)) / len(qw) END AS relevance FROM x),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score * f, 9) DESC, id) AS rank FROM y WHERE relevance >= 0.12)"""
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda t: t <> ''))"
_OVERLAP = "CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / least(len({a}), len({b})) END"
_NEGATIONS = "['no,', 'no ', 'not ', 'wrong', 'incorrect', 'that''s not', 'thats not', 'don''t', 'dont ', 'didn''t', 'didnt ', 'isn''t', 'isnt ', 'wasn''t', 'wasnt ', 'mal,', 'mal ', 'incorrecto', 'eso no', 'esta mal', 'está mal', 'no es']"


def _outcomes(same: float, negated: float) -> str:
    return f"""
  SELECT conv_id, turn,
         CASE WHEN nxt IS NULL THEN 'neutral' WHEN (neg AND ov > {negated}) OR ov >= {same} THEN 'rejected' ELSE 'accepted' END AS outcome,
         CASE WHEN nxt IS NULL THEN 'session_close' WHEN neg AND ov > {negated} THEN 'negation' WHEN ov >= {same} THEN 'reformulation' ELSE 'new_topic' END AS reason,
         round(CASE WHEN nxt IS NOT NULL THEN ov END, 6) AS overlap
  FROM (
    SELECT *, {_OVERLAP.format(a='ta', b='tb')} AS ov,
           len(list_filter({_NEGATIONS}, lambda k: starts_with(lower(nxt[1:50]), k) OR contains(lower(nxt[1:50]), ' ' || k))) > 0 AS neg
    FROM (SELECT *, {_TOKENS.format('text')} AS ta, {_TOKENS.format('nxt')} AS tb
          FROM (SELECT *, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations WHERE role = 'user'))
  )"""


_RANKED_TURNS = """
r AS (
  SELECT *, role IN ('user', 'assistant') AS spoken,
         row_number() OVER (PARTITION BY conv_id, role IN ('user', 'assistant') ORDER BY turn DESC) AS from_end,
         first_value(role) OVER (PARTITION BY conv_id, role IN ('user', 'assistant') ORDER BY turn DESC) AS last_role,
         sum(length(text) // 4) OVER (PARTITION BY conv_id, role IN ('user', 'assistant') ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS tokens_from_end
  FROM conversations
)"""
_SNIP = "NOT spoken OR from_end <= 2 + CASE WHEN last_role = 'user' THEN 1 ELSE 0 END"
_ASKED = f"asked AS (SELECT conv_id * 1000 + turn AS query_id, text, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS tokens FROM conversations WHERE role = 'user')"


def _has(*terms: str) -> str:
    parts = [f"CAST(contains(low, '{t}') AS INT)" if " " in t else f"CAST(list_contains(tokens, '{t}') AS INT)" for t in terms]
    return f"({' + '.join(parts)}) / {len(terms)}.0"


_TASKS = {"reading": ("the", "that", "this"), "travel": ("dans", "les", "pour"), "law": ("und", "nicht", "der"), "kitchen": ("para", "los", "con una"), "garden": ("thing", "erth")}
_CLASSES = f"""
{_ASKED},
s AS (SELECT query_id, {', '.join(f'{_has(*w)} AS {t}' for t, w in _TASKS.items())} FROM asked),
classes AS (SELECT query_id, best, CASE WHEN best = 0 THEN 'general' {' '.join(f"WHEN {t} = best THEN '{t}'" for t in _TASKS)} END AS task
            FROM (SELECT *, greatest({', '.join(_TASKS)}) AS best FROM s))"""
_DAYS = "date_diff('microsecond', ts, TIMESTAMP '2024-02-01 00:00:00') / 86400000000.0"
_TFIDF = f"""
tok AS (SELECT doc_id AS id, lang AS label, {words('text')} AS w FROM documents),
term AS (SELECT id, label, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tok),
tf AS (SELECT id, label, term, count(*) AS tf FROM term GROUP BY ALL),
vocab AS (SELECT term, df FROM (SELECT term, sum(tf) AS total, count(*) AS df FROM tf GROUP BY term ORDER BY total DESC, term LIMIT 5000)),
w AS (SELECT id, label, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1) AS w FROM tf JOIN vocab USING (term)),
unit AS (SELECT id, label, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM w),
cent AS (SELECT label AS class, term, sum(weight) / any_value(m) AS cw FROM unit JOIN (SELECT lang AS label, count(*) AS m FROM documents GROUP BY 1) USING (label) GROUP BY 1, 2),
norm AS (SELECT class, sqrt(sum(cw * cw)) AS cn FROM cent GROUP BY 1),
dots AS (SELECT id, label, class, round(sum(weight * cw) / any_value(cn), 9) AS cosine FROM unit JOIN cent USING (term) JOIN norm USING (class) GROUP BY 1, 2, 3)"""
_STRATEGY = "(VALUES ('debugging',2,0.5,0.5,0.6,2,8,1536),('code_review',1,0.7,0.3,0.7,1,5,1024),('architecture',3,0.4,0.6,0.5,2,8,1536),('explanation',2,0.6,0.4,0.8,1,4,1024),('testing',2,0.6,0.4,0.7,1,5,1024),('devops',1,0.7,0.3,0.6,1,6,1024),('ml_engineering',2,0.5,0.5,0.6,2,8,1536),('general',2,0.6,0.4,0.7,1,5,768)) AS st(task, graph_depth, vector_weight, graph_weight, confidence, min_k, max_k, max_tokens)"
_ARM = "['default', 'graph_boost', 'deep_graph', 'vector_focus', 'unknown']"

SQL: dict[str, str] = {
    "lexicon_entities": f"WITH {_HITS} SELECT md5(term)[1:12] AS entity_id, term AS name, 2 * count(*) AS mention_count, count(*) AS n_docs, min(doc_id) AS first_doc FROM hits GROUP BY term",
    "cooccurrence_edges": f"WITH {_HITS} SELECT a.term AS a, b.term AS b, round(least(1.0, 0.5 + 0.1 * (count(*) - 1)), 6)::DOUBLE AS weight, count(*) - 1 AS reinforcement_count, min(a.doc_id) AS first_doc FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY 1, 2",
    "category_links": f"WITH {_HITS} SELECT term, lang AS category, count(*) AS n_docs, 0.6::DOUBLE AS confidence FROM hits JOIN documents USING (doc_id) WHERE lang IS NOT NULL GROUP BY 1, 2",
    "substring_patterns": "SELECT pattern, lang, count(*) AS n FROM documents, (VALUES ('ation'), ('heit'), ('ción'), ('ment'), ('erth')) AS p(pattern) WHERE contains(lower(text), pattern) GROUP BY 1, 2",
    "regex_class_fixes": r"""
WITH d AS (SELECT lower(text) AS low FROM documents)
SELECT strategy, error, count(*) AS n_docs, 0.6::DOUBLE AS confidence FROM d,
  (VALUES ('ending', '(tion|heit|ción)\.'), ('double', '(the the|de de|und und)')) AS e(error, ep),
  (VALUES ('comma', '[\p{L}]+, and'), ('colon', '[\p{L}]+: '), ('with', 'with [\p{L}]+')) AS s(strategy, sp)
WHERE regexp_matches(low, ep) AND regexp_matches(low, sp) GROUP BY 1, 2""",
    "regex_class_hits": r"SELECT error, count(*) AS n_docs FROM documents, (VALUES ('ending', '(tion|heit|ción)\.'), ('double', '(the the|de de|und und)')) AS e(error, ep) WHERE regexp_matches(lower(text), ep) GROUP BY 1",
    "entity_ids": "SELECT md5(lower(trim(name)))[1:12] AS entity_id, count(*) AS n, min(name) AS first_name FROM (SELECT p_name AS name FROM part UNION ALL SELECT s_name FROM supplier) GROUP BY 1",
    "graph_entities": f"WITH {_PLACE}, {_ENTITIES} SELECT md5(name)[1:12] AS entity_id, name, type, mention_count, n_docs FROM entities",
    "graph_edges": f"WITH {_BRAND} SELECT src, dst, 'USES' AS relation, round(weight, 6)::DOUBLE AS weight, n - 1 AS reinforcement_count, n_docs, last_reinforced FROM folded",
    "transitive_part_of": f"WITH {_PLACE}, {_PART_OF} SELECT DISTINCT x.src, y.dst, 'PART_OF' AS relation, 0.3::DOUBLE AS weight FROM edges x JOIN edges y ON x.dst = y.src WHERE x.src <> y.dst AND NOT EXISTS (SELECT 1 FROM edges z WHERE z.src = x.src AND z.dst = y.dst)",
    "edge_decay": f"WITH {_BRAND} SELECT src, dst, round(weight, 6) AS weight, reinforcement_count FROM decayed",
    "decay_summary": f"WITH {_BRAND} SELECT count(*) AS decayed, 0::BIGINT AS skipped, round(min(weight), 6) AS min_weight, round(max(weight), 6) AS max_weight, round(avg(reinforcement_count), 6) AS avg_reinforcement, max(reinforcement_count) AS max_reinforcement FROM decayed",
    "prune_graph": f"""
WITH {_BRAND}, weak AS (SELECT src, dst FROM decayed WHERE round(weight, 9) < 0.3), kept AS (SELECT src, dst FROM decayed WHERE round(weight, 9) >= 0.3),
names AS (SELECT name, count(*) AS m FROM (SELECT subject AS name FROM uses UNION ALL SELECT lower(object) FROM uses) GROUP BY 1)
SELECT 'edge' AS what, src AS name, dst FROM weak
UNION ALL SELECT 'entity', name, NULL FROM names WHERE m <= 5 AND name NOT IN (SELECT src FROM kept UNION SELECT dst FROM kept)""",
    "graph_stats": f"""
WITH {_PLACE}, {_ENTITIES}, {_PART_OF}
SELECT 'entity' AS what, type, count(*) AS n FROM entities GROUP BY ROLLUP (type)
UNION ALL SELECT 'edge', relation, count(*) FROM (SELECT 'PART_OF' AS relation FROM edges) GROUP BY ROLLUP (relation)""",
    "neighbours_depth2": f"""
WITH RECURSIVE {_PLACE}, {_UNDIRECTED},
walk AS (
  SELECT lower(n_name) AS seed, lower(n_name) AS name, 0 AS distance FROM nation
  UNION SELECT seed, dst, distance + 1 FROM walk JOIN both_ways ON name = src WHERE distance < 2
)
SELECT seed, name, min(distance)::BIGINT AS distance, round(1.0 / (1 + min(distance)), 6)::DOUBLE AS score FROM walk WHERE name <> seed GROUP BY 1, 2""",
    "customers_near": f"""
WITH RECURSIVE {_PLACE}, {_UNDIRECTED},
walk AS (
  SELECT lower(c_name) AS seed, lower(c_name) AS name, 0 AS distance FROM customer
  UNION SELECT seed, dst, distance + 1 FROM walk JOIN both_ways ON name = src WHERE distance < 2
)
SELECT name, distance::BIGINT AS distance, count(*) AS n_seeds FROM (SELECT seed, name, min(distance) AS distance FROM walk GROUP BY 1, 2) GROUP BY 1, 2""",
    "neighbours_of_all": f"""
WITH RECURSIVE {_PLACE}, {_UNDIRECTED},
walk AS (
  SELECT lower(s_name) AS seed, lower(s_name) AS name, 0 AS distance FROM supplier
  UNION SELECT seed, dst, distance + 1 FROM walk JOIN both_ways ON name = src WHERE distance < 2
)
SELECT seed, distance::BIGINT AS distance, count(*) AS n, min(name) AS first_name FROM (SELECT seed, name, min(distance) AS distance FROM walk WHERE name <> seed GROUP BY 1, 2) GROUP BY 1, 2""",
    "context_paths": f"""
WITH RECURSIVE {_PLACE}, {_UNDIRECTED},
pairs AS (
  SELECT lower(s_name) AS src, lower(r_name) AS dst FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey IN (n_regionkey, (n_regionkey + 1) % 5)
  UNION ALL SELECT lower(s_name), lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT lower(n_name), lower(s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
direct AS (
  SELECT p.src, p.dst, CASE WHEN bool_or(ahead) THEN p.src || ' --[PART_OF]--> ' || p.dst ELSE p.dst || ' --[PART_OF]--> ' || p.src END AS path
  FROM pairs p JOIN (SELECT src, dst, true AS ahead FROM edges UNION ALL SELECT dst, src, false FROM edges) e ON e.src = p.src AND e.dst = p.dst GROUP BY p.src, p.dst
),
rest AS (SELECT src, dst FROM pairs p WHERE NOT EXISTS (SELECT 1 FROM direct d WHERE d.src = p.src AND d.dst = p.dst)),
walk AS (
  SELECT src AS start, [src] AS nodes, src AS here FROM (SELECT DISTINCT src FROM rest)
  UNION ALL SELECT start, list_append(nodes, b.dst), b.dst FROM walk w JOIN both_ways b ON w.here = b.src WHERE len(nodes) < 4 AND NOT list_contains(nodes, b.dst)
),
hit AS (SELECT src, dst, nodes FROM rest JOIN walk ON start = src AND here = dst),
best AS (SELECT src, dst, min(len(nodes)) AS n FROM hit GROUP BY 1, 2)
SELECT src, dst, path, 2::BIGINT AS n_nodes FROM direct
UNION ALL SELECT src, dst, array_to_string(min(nodes), ' -> '), any_value(n)::BIGINT FROM hit JOIN best USING (src, dst) WHERE len(nodes) = n GROUP BY 1, 2""",
    "components": """
WITH part AS (
  SELECT lower(r_name) AS region, lower(r_name) AS name FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
  UNION SELECT lower(r_name), lower(n_name) FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION SELECT lower(r_name), lower(s_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION SELECT lower(r_name), lower(c_name) FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
)
SELECT min(name) AS component, count(*) AS n FROM part GROUP BY region""",
    "neighbour_jaccard_drift": f"""
WITH {_BRAND}, ends AS (SELECT subject AS name, object AS near, ts FROM uses UNION ALL SELECT object, subject, ts FROM uses),
o AS (SELECT name, list_sort(list_distinct(list(near))) AS was FROM ends WHERE ts < TIMESTAMP '1998-04-17' GROUP BY 1),
n AS (SELECT name, list_sort(list_distinct(list(near))) AS now FROM ends WHERE ts >= TIMESTAMP '1998-04-17' GROUP BY 1),
j AS (SELECT name, was, coalesce(now, []) AS now FROM o LEFT JOIN n USING (name)),
k AS (SELECT name, len(list_intersect(was, now)) / len(list_distinct(list_concat(was, now))) AS jaccard,
        coalesce(array_to_string(list_sort(list_filter(now, lambda x: NOT list_contains(was, x))), ','), '') AS added,
        coalesce(array_to_string(list_sort(list_filter(was, lambda x: NOT list_contains(now, x))), ','), '') AS removed FROM j)
SELECT name, round(jaccard, 6) AS jaccard, added, removed FROM k WHERE jaccard < 0.4""",
    "neighbour_drift_counts": f"""
WITH {_BRAND}, ends AS (SELECT subject AS name, object AS near, ts FROM uses UNION ALL SELECT object, subject, ts FROM uses),
p AS (SELECT name, near, bool_or(ts < TIMESTAMP '1998-04-17') AS o, bool_or(ts >= TIMESTAMP '1998-04-17') AS n FROM ends GROUP BY 1, 2),
c AS (SELECT name, count(*) FILTER (o AND n) AS kept, count(*) FILTER (NOT n) AS removed, count(*) FILTER (NOT o) AS added, min(near) FILTER (o <> n) AS first_change, count(*) FILTER (o <> n) AS n_changes FROM p GROUP BY 1)
SELECT name, kept, removed, added, round(kept / (kept + removed + added), 6) AS jaccard, first_change, n_changes FROM c WHERE kept + removed > 0 AND kept / (kept + removed + added) < 0.4""",
    "snapshot_versions": f"""
WITH {_BRAND}, ends AS (SELECT subject AS name, object AS near, ts FROM uses UNION ALL SELECT object, subject, ts FROM uses),
p AS (SELECT name, near, bool_or(ts < TIMESTAMP '1998-04-17') AS o FROM ends GROUP BY 1, 2)
SELECT name, CASE WHEN bool_or(o) AND bool_or(NOT o) THEN 2 ELSE 1 END::BIGINT AS version FROM p GROUP BY 1""",
    "graph_snapshot": f"""
WITH {_BRAND}, ends AS (SELECT subject AS name, object AS near, ts FROM uses UNION ALL SELECT object, subject, ts FROM uses),
o AS (SELECT name, list_sort(list_distinct(list(near))) AS was FROM ends WHERE ts < TIMESTAMP '1998-04-17' GROUP BY 1),
n AS (SELECT name, list_sort(list_distinct(list(near))) AS now FROM ends GROUP BY 1)
SELECT name, array_to_string(now, ',') AS neighbours, CASE WHEN was IS NOT NULL AND was <> now THEN 2 ELSE 1 END::BIGINT AS version FROM n LEFT JOIN o USING (name)""",
    "alias_candidates": f"WITH {_VEC}, {_CANDIDATES} SELECT kind::BIGINT AS kind, a, b, round(similarity, 6) AS similarity FROM c WHERE similarity >= 0.35",
    "alias_candidates_by_hash": f"WITH {_VEC}, {_CANDIDATES} SELECT kind::BIGINT AS kind, a, b, round(similarity, 6) AS similarity FROM c WHERE similarity >= 0.35",
    "alias_merge": f"""
WITH {_VEC}, {_CANDIDATES},
d AS (SELECT CASE WHEN (b * 7) % 11 > (a * 7) % 11 THEN a ELSE b END AS alias, CASE WHEN (b * 7) % 11 > (a * 7) % 11 THEN b ELSE a END AS canonical,
        round(similarity, 9) AS similarity, row_number() OVER (ORDER BY round(similarity, 9) DESC, a, b) AS no FROM c WHERE similarity >= 0.3),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY alias ORDER BY no) AS r FROM d) WHERE r = 1)
SELECT m.alias, m.canonical, round(m.similarity, 6) AS similarity, coalesce(g.no > m.no, true) AS effective FROM m LEFT JOIN m g ON g.alias = m.canonical""",
    "vector_topk": f"WITH {_VEC} SELECT query_id, id, round(distance, 6) AS distance, rank FROM ({_top('q.vec_id % 50 = 0')})",
    "vector_topk_filtered": f"""
WITH {_VEC} SELECT 'pre' AS placement, query_id, id, round(distance, 6) AS distance, rank FROM ({_top('q.vec_id % 50 = 0', 'd.label < 3')})
UNION ALL SELECT 'post', query_id, id, round(distance, 6), rank FROM ({_top('q.vec_id % 50 = 0')}) WHERE label < 3""",
    "adaptive_stop": f"""
WITH {_VEC}, h AS ({_top('q.vec_id % 50 = 0', k=8, distance='round(1 - ' + _COSINE.format(a='q.v', b='d.v') + ', 9)')}),
kept AS (SELECT *, greatest(0.0, least(1.0, 1 - distance)) AS sim FROM h WHERE greatest(0.0, least(1.0, 1 - distance)) >= 0.2),
wanted AS (SELECT doc_id AS query_id, unnest(list_distinct({words('text')})) AS entity FROM documents WHERE doc_id IN (SELECT query_id FROM h)),
counts AS (SELECT query_id, count(*) AS n_entities FROM wanted GROUP BY 1),
fresh AS (SELECT query_id, rank, count(*) AS fresh FROM (
  SELECT k.query_id, entity, min(rank) AS rank FROM kept k JOIN wanted w USING (query_id) JOIN documents d ON d.doc_id = k.id WHERE contains(lower(d.text), entity) GROUP BY 1, 2) GROUP BY 1, 2),
k AS (
  SELECT k.query_id, k.rank, CASE WHEN n_entities IS NULL THEN avg(sim) OVER u ELSE 0.6 * avg(sim) OVER u + 0.4 * sum(coalesce(fresh, 0)) OVER u / n_entities END AS conf
  FROM kept k LEFT JOIN counts USING (query_id) LEFT JOIN fresh f ON f.query_id = k.query_id AND f.rank = k.rank WINDOW u AS (PARTITION BY k.query_id ORDER BY k.rank ROWS UNBOUNDED PRECEDING)
),
s AS (SELECT query_id, min(CASE WHEN rank >= 2 AND conf >= 0.25 THEN rank END) AS stop, max(rank) AS last, count(*) AS n FROM k GROUP BY 1)
SELECT x.query_id, coalesce(stop, last, 0)::BIGINT AS stop_rank, CASE WHEN stop IS NOT NULL THEN 'threshold' WHEN last IS NOT NULL THEN 'max_k' ELSE 'no_results' END AS reason,
       coalesce(round(k.conf, 6), 0.0) AS confidence, coalesce(n, 0)::BIGINT AS n_hits
FROM (SELECT DISTINCT query_id FROM h) x LEFT JOIN s USING (query_id) LEFT JOIN k ON k.query_id = x.query_id AND k.rank = coalesce(stop, last)""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, id, round(bm25, 4) AS bm25, rank, round(1.0 / rank, 6)::DOUBLE AS score FROM keyword",
    "index_counts": f"""
WITH t AS (SELECT doc_id, unnest({words('text')}) AS w FROM documents)
SELECT (SELECT count(*) FROM documents) AS documents, count(DISTINCT w) AS terms, count(DISTINCT (doc_id, w)) AS postings, count(*) AS words FROM t""",
    "model_labels": r"""
WITH a AS (SELECT conv_id, turn, lower(trim(CASE WHEN turn % 3 = 0 THEN ' ' || string_split(text, ' ')[1] || ' ' ELSE text END)) AS a FROM conversations),
l AS (SELECT *, CASE WHEN a IN ('in', 'the', 'und', 'les', 'para') THEN a WHEN contains(a, 'in') THEN 'in' WHEN contains(a, 'the') THEN 'the' WHEN contains(a, 'und') THEN 'und'
                     WHEN contains(a, 'les') THEN 'les' WHEN contains(a, 'para') THEN 'para' ELSE 'general' END AS label FROM a)
SELECT label, count(*) AS n, min(conv_id) AS first_conv FROM l GROUP BY label""",
    "rrf_fusion": f"WITH RECURSIVE {_BM25}, {_FUSED} SELECT query_id, id, round(score, 6)::DOUBLE AS score, origin, n_sources, rank FROM ranked",
    "context_aging": f"""
SELECT event_id, round(value * f, 6) AS score, round(value, 6) AS score_raw, round(f, 3) AS age_factor
FROM (SELECT *, CASE WHEN d < 0 THEN 1.0 ELSE greatest(pow(0.5, d / 10.0), 0.3) END::DOUBLE AS f FROM (SELECT *, {_DAYS} AS d FROM events))""",
    "relevance_filter": f"""
WITH q AS (SELECT item_id AS query_id, {_telling('text')} AS w FROM benchmark),
qw AS (SELECT query_id, len(w) AS n, unnest(w) AS word FROM q),
d AS (SELECT doc_id AS id, unnest({_telling('text[1:500]')}) AS word FROM documents)
SELECT query_id, id, round(count(*) / any_value(n), 6) AS relevance FROM qw JOIN d USING (word) GROUP BY 1, 2 HAVING count(*) / any_value(n) >= 0.12""",
    "hybrid_retrieve": f"WITH RECURSIVE {_HYBRID.replace('{days}', _DAYS)} SELECT query_id, id, origin, round(score * f, 6) AS score, round(relevance, 6) AS relevance, round(f, 3) AS age_factor FROM z",
    "context_prompts": f"""
WITH RECURSIVE {_HYBRID.replace('{days}', _DAYS)},
c AS (SELECT query_id, string_agg('[doc|' || origin || '] ' || text[1:300], chr(10) || '---' || chr(10) ORDER BY rank) AS parts FROM z WHERE rank <= 3 GROUP BY 1),
p AS (SELECT item_id AS query_id, CASE WHEN parts IS NULL THEN text ELSE 'Context:' || chr(10) || parts || chr(10) || chr(10) || '---' || chr(10) || 'Question: ' || text || chr(10) || chr(10) || 'Answer from the context where it is relevant.' END AS prompt FROM benchmark LEFT JOIN c ON c.query_id = item_id)
SELECT query_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM p""",
    "recognised_entities": f"WITH {_recognised("SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'")} SELECT query_id, name, pos AS \"at\" FROM seeds",
    "graph_expansion": f"WITH RECURSIVE {_EXPANSIONS} SELECT query_id, expansion, round(score, 6)::DOUBLE AS score, no FROM expanded",
    "graph_retrieve": f"WITH RECURSIVE {_TF}, {_GUIDED} SELECT query_id, id, rank FROM guided",
    "neighbour_cap": f"WITH RECURSIVE {_KNOWN}, {_TERM_GRAPH} SELECT seed, other AS name, rk AS rank FROM capped WHERE rk <= 5",
    "entity_search": f"""
WITH {_PLACE}, sides AS (SELECT ord, lower(trim(subject)) AS name, st AS type FROM triples UNION ALL SELECT ord, lower(trim(object)), ot FROM triples)
SELECT name, count(*) AS mention_count FROM sides WHERE type = 'supplier' AND (contains(name, 'supplier0') OR contains(regexp_replace(name, '[ #]', '', 'g'), 'supplier0')) GROUP BY name ORDER BY count(*) DESC, min(ord) LIMIT 10""",
    "entity_lookup": "SELECT upper(s_name) AS query, lower(s_name) AS name FROM supplier UNION ALL SELECT regexp_replace(s_name, '[ #]', '', 'g'), lower(s_name) FROM supplier",
    "entity_relations": f"""
WITH {_PLACE}, {_PART_OF}, n AS (SELECT lower(n_name) AS name FROM nation),
r AS (SELECT name, 'out' AS direction, src, dst FROM n JOIN edges ON src = name UNION ALL SELECT name, 'in', src, dst FROM n JOIN edges ON dst = name)
SELECT name, direction, 'PART_OF' AS relation, count(*) AS n, min(src) AS first_src, max(dst) AS last_dst FROM r GROUP BY 1, 2""",
    "neighbourhood_docs": f"""
WITH {_PLACE}, {_UNDIRECTED}, n AS (SELECT lower(n_name) AS seed FROM nation),
near AS (SELECT seed, dst AS name FROM n JOIN both_ways ON src = seed UNION SELECT seed, seed FROM n),
docs AS (SELECT lower(subject) AS name, doc FROM triples UNION SELECT lower(object), doc FROM triples)
SELECT DISTINCT seed, doc FROM near JOIN docs USING (name)""",
    "entity_upserts": """
WITH e AS (SELECT event_type AS name, event_id, user_id, ts, 'u' || (user_id % 20) AS alias FROM events),
a AS (SELECT name, string_agg(alias, ',' ORDER BY first) AS aliases FROM (SELECT name, alias, min(event_id) AS first FROM e GROUP BY 1, 2) GROUP BY 1)
SELECT name, arg_min('kind' || (user_id % 3), event_id) AS type, arg_min('seen by ' || user_id, event_id) FILTER (event_id % 5 = 3) AS description, any_value(aliases) AS aliases, count(*) AS mention_count, max(ts) AS last_seen
FROM e JOIN a USING (name) GROUP BY name""",
    "alias_rewrite_edges": f"""
WITH {_PLACE}, {_PART_OF}
SELECT DISTINCT CASE WHEN starts_with(src, 'supplier#') THEN 'supplier#' || lpad((k - k % 3)::VARCHAR, 9, '0') ELSE src END AS src, dst, 'PART_OF' AS relation, 0.5::DOUBLE AS weight
FROM (SELECT *, CASE WHEN starts_with(src, 'supplier#') THEN src[10:]::BIGINT ELSE 0 END AS k FROM edges)""",
    "alias_rewrite_entities": f"""
WITH {_PLACE}, {_ENTITIES},
k AS (SELECT *, CASE WHEN starts_with(name, 'supplier#') THEN 'supplier#' || lpad((name[10:]::BIGINT - name[10:]::BIGINT % 3)::VARCHAR, 9, '0') ELSE name END AS f FROM (SELECT name, type, mention_count FROM entities)),
l AS (SELECT f, string_agg(a, ',' ORDER BY a) AS aliases FROM (SELECT f, regexp_replace(name, '[ #]', '', 'g') AS a FROM k UNION SELECT f, name FROM k WHERE name <> f) GROUP BY f)
SELECT f AS name, arg_min(type, name <> f) AS type, sum(mention_count)::BIGINT AS mention_count, any_value(aliases) AS aliases FROM k JOIN l USING (f) GROUP BY f""",
    "chunk_documents": r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
step AS (
  SELECT doc_id, 0 AS no, 0 AS start FROM d
  UNION ALL SELECT doc_id, no + 1, stop - 200 FROM (
    SELECT p.doc_id, no, total, start + CASE WHEN start + 1000 < total AND brk > 500 THEN brk + 1 ELSE 1000 END AS stop FROM (
      SELECT s.doc_id, no, start, length(text) AS total, greatest(1000 - nullif(strpos(reverse(text[start + 1 : start + 1000]), ' .'), 0) - 1, 1000 - nullif(strpos(reverse(text[start + 1 : start + 1000]), chr(10)), 0), -1) AS brk
      FROM step s JOIN d USING (doc_id)
    ) p
  ) WHERE total > 1000 AND stop - 200 < total
),
cut AS (
  SELECT doc_id, no, CASE WHEN length(text) <= 1000 THEN text WHEN start + 1000 < length(text) AND brk > 500 THEN text[start + 1 : start + brk + 1] ELSE text[start + 1 : start + 1000] END AS piece, length(text) > 1000 AS stripped
  FROM (SELECT s.doc_id, no, start, text, greatest(1000 - nullif(strpos(reverse(text[start + 1 : start + 1000]), ' .'), 0) - 1, 1000 - nullif(strpos(reverse(text[start + 1 : start + 1000]), chr(10)), 0), -1) AS brk FROM step s JOIN d USING (doc_id))
),
c AS (SELECT doc_id, no, CASE WHEN stripped THEN regexp_replace(piece, '^[\s\x{85}\x{A0}\x{1c}-\x{1f}]+|[\s\x{85}\x{A0}\x{1c}-\x{1f}]+$', '', 'g') ELSE piece END AS chunk FROM cut)
SELECT doc_id, no::BIGINT AS chunk_no, length(chunk) AS n_chars, md5(chunk) AS digest FROM c""",
    "conversation_pairs": """
SELECT conv_id, turn, instruction, output FROM (
  SELECT conv_id, turn, role, text AS output, lag(role) OVER w AS before, lag(text) OVER w AS instruction
  FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
) WHERE role = 'assistant' AND before = 'user'""",
    "pair_quality": r"""
WITH p AS (
  SELECT conv_id, turn, instruction, output, lower(instruction) AS low FROM (
    SELECT conv_id, turn, role, text AS output, lag(role) OVER w AS before, lag(text) OVER w AS instruction
    FROM conversations WHERE role IN ('user', 'assistant') AND text <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
  ) WHERE role = 'assistant' AND before = 'user'
),
s AS (
  SELECT *, round(greatest(0.0, least(1.0, 0.5 + CASE WHEN length(output) > 500 THEN 0.1 ELSE 0 END + CASE WHEN length(output) > 1000 THEN 0.1 ELSE 0 END
    + CASE WHEN contains(output, '```') THEN 0.15 ELSE 0 END
    + CASE WHEN contains(output, '- ') OR contains(output, '* ') OR contains(output, '1.') OR contains(output, '##') OR contains(output, '**') THEN 0.05 ELSE 0 END
    - CASE WHEN length(output) < 100 THEN 0.2 ELSE 0 END
    - CASE WHEN len(list_filter(regexp_split_to_array(output, '\s+'), lambda t: t <> '')) < 10 THEN 0.3 ELSE 0 END)), 6)::DOUBLE AS score FROM p
)
SELECT md5(instruction || output)[1:12] AS pair_id, conv_id, turn, score,
  CASE WHEN regexp_matches(low, 'escribe|write|create|implement|función|function|class') AND contains(output, '```') THEN 'code_generation'
       WHEN regexp_matches(low, 'fix|error|bug|arregla|corrige') THEN 'error_fix'
       WHEN regexp_matches(low, 'refactor|improve|optimize|mejora|optimiza') THEN 'refactor'
       WHEN regexp_matches(low, 'explain|what|how|why|explica|qué|cómo|por qué') THEN 'explanation'
       WHEN regexp_matches(low, 'review|check|revisa|mira') THEN 'code_review'
       WHEN regexp_matches(low, 'should|better|recommend|debería|mejor|recomienda') THEN 'decision' ELSE 'general' END AS category
FROM s WHERE length(instruction) >= 10 AND length(output) >= 20 AND score >= 0.4""",
    "outcome_inference": f"SELECT *, 'default' AS setting FROM ({_outcomes(0.5, 0.3)}) UNION ALL SELECT *, 'low' FROM ({_outcomes(0.15, 0.1)})",
    "outcome_rates": f"""
WITH o AS (SELECT *, (conv_id % 5)::VARCHAR AS topic FROM ({_outcomes(0.15, 0.1)}))
SELECT topic, reason, count(*) AS total, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'rejected') AS rejected,
       CASE WHEN count(*) FILTER (outcome <> 'neutral') > 0 THEN round(count(*) FILTER (outcome = 'accepted') / count(*) FILTER (outcome <> 'neutral'), 6) END AS rate
FROM o GROUP BY ROLLUP (topic, reason)""",
    "compaction_snip": f"WITH {_RANKED_TURNS} SELECT conv_id, turn, role FROM r WHERE {_SNIP}",
    "compaction_emergency": f"WITH {_RANKED_TURNS} SELECT conv_id, turn, role FROM r WHERE NOT spoken OR tokens_from_end <= 500",
    "compaction_plan": """
WITH t AS (SELECT conv_id, sum(CASE WHEN role IN ('user', 'assistant') THEN length(text) // 4 ELSE 0 END)::BIGINT AS tokens FROM conversations GROUP BY 1)
SELECT conv_id, tokens, CASE WHEN tokens < 300 THEN 'none' WHEN tokens < 700 THEN 'snip' WHEN tokens <= 1000 THEN 'summary' ELSE 'emergency' END AS action FROM t""",
    "compaction_summary": rf"""
WITH {_RANKED_TURNS},
gone AS (SELECT conv_id, turn, regexp_extract(text, '^\s*([^.\n]*)', 1) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM r WHERE NOT ({_SNIP})),
every AS (
  SELECT conv_id, turn, role, text FROM r WHERE {_SNIP}
  UNION ALL SELECT conv_id, min(turn), 'system', '- ' || string_agg(line, chr(10) || '- ' ORDER BY turn) FROM gone GROUP BY conv_id
)
SELECT conv_id, turn, role, length(text) AS n_chars, md5(text) AS digest FROM every""",
    "parent_chain": """
WITH RECURSIVE m AS (SELECT conv_id, turn AS id, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS parent, role, text FROM conversations),
walk AS (
  SELECT conv_id, turn AS id, turn AS node, 0 AS depth, role FROM conversations WHERE role = 'assistant'
  UNION ALL SELECT w.conv_id, w.id, m.parent, depth + 1, p.role FROM walk w JOIN m ON m.conv_id = w.conv_id AND m.id = w.node JOIN m p ON p.conv_id = m.conv_id AND p.id = m.parent WHERE depth < 20 AND (depth = 0 OR w.role <> 'user')
)
SELECT w.conv_id, w.id, max(depth)::BIGINT AS depth, count(*) AS n_nodes, md5(coalesce(string_agg(text, chr(10) || chr(10) ORDER BY depth DESC) FILTER (m.role = 'assistant'), '')) AS digest
FROM walk w JOIN m ON m.conv_id = w.conv_id AND m.id = w.node GROUP BY 1, 2""",
    "keyword_classify": f"WITH {_CLASSES} SELECT query_id, task, round(best, 6) AS score FROM classes",
    "routing_strategy": f"""
WITH {_CLASSES}, n AS (SELECT query_id, CASE task WHEN 'reading' THEN 'explanation' WHEN 'law' THEN 'code_review' WHEN 'travel' THEN 'architecture' ELSE task END AS task FROM classes)
SELECT query_id, n.task, vector_weight::DOUBLE AS vector_weight, graph_weight::DOUBLE AS graph_weight, confidence::DOUBLE AS confidence, graph_depth::BIGINT AS graph_depth, min_k::BIGINT AS min_k, max_k::BIGINT AS max_k, max_tokens::BIGINT AS max_tokens
FROM n JOIN {_STRATEGY} ON st.task = CASE WHEN n.task IN ('explanation', 'code_review', 'architecture') THEN n.task ELSE 'general' END""",
    "gate_votes": f"""
WITH {_CLASSES}, g AS (
  SELECT query_id, CASE task WHEN 'law' THEN 'debugging' ELSE task END AS task, CASE WHEN query_id % 3 = 0 THEN NULL ELSE query_id % 2 END AS n,
         query_id % 5 < 2 AS known, query_id % 7 < 3 AS topic FROM classes
),
v AS (SELECT *, coalesce((n > 0)::INT, 0) + known::INT + (task <> 'general')::INT + topic::INT AS yes, CASE WHEN n IS NULL THEN 3 ELSE 4 END AS total FROM g)
SELECT query_id, task = 'debugging' OR yes >= total - yes AS inject, CASE WHEN task = 'debugging' THEN 1.0 ELSE round(abs(2 * yes - total) / total, 3) END::DOUBLE AS confidence FROM v""",
    "context_map": r"""
SELECT rule, count(*) AS n FROM (
  SELECT CASE WHEN regexp_matches(text, '\?') THEN 'question' WHEN regexp_matches(text, '(?i)erth') THEN 'erth' WHEN regexp_matches(text, '(?i)thing(s|$)') THEN 'thing' ELSE 'none' END AS rule
  FROM conversations WHERE role = 'user'
) GROUP BY 1""",
    "tfidf_centroid": f"""
WITH {_TFIDF}
SELECT id, label, CASE WHEN cosine >= 0.05 THEN class END AS predicted, round(cosine, 6) AS cosine
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY cosine DESC, class) AS r FROM dots) WHERE r = 1""",
    "response_eval": """
WITH s AS (
  SELECT conv_id % 4 AS category, length(text) AS n, lower(text) AS low FROM conversations WHERE role = 'assistant'
),
t AS (
  SELECT category, round(greatest(0.0, 0.5 * (contains(low, 'the')::INT + contains(low, 'and')::INT + contains(low, 'erth')::INT) / 3
    + 0.3 * CASE WHEN n < 0.3 * 200 THEN 0.3 WHEN n < 0.6 * 200 THEN 0.6 ELSE least(1.0, n / (1.5 * 200)) END
    + 0.2 * CASE WHEN n < 50 THEN 0.5 WHEN n > 2000 THEN 0.7 ELSE 1.0 END - 0.2 * (contains(low, 'thing')::INT + contains(low, 'und')::INT)), 3)::DOUBLE AS score FROM s
)
SELECT category, count(*) AS n, round(avg(score), 4) AS mean_score, max(score) AS best FROM t GROUP BY 1""",
    "profile_topics": "SELECT source AS topic, count(*) AS n, round(count(*) / (SELECT count(*) FROM documents WHERE source <> 'src0'), 6) AS weight FROM documents WHERE source <> 'src0' GROUP BY 1 ORDER BY n DESC, topic LIMIT 10",
    "topic_drift_ema": """
WITH c AS (SELECT user_id, event_type AS topic, count(*) FILTER (ts < TIMESTAMP '2024-01-04') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-04') AS b FROM events GROUP BY 1, 2),
w AS (SELECT user_id, topic, coalesce(a / nullif(sum(a) OVER u, 0), 0) AS o, coalesce(b / nullif(sum(b) OVER u, 0), 0) AS n FROM c WINDOW u AS (PARTITION BY user_id)),
s AS (SELECT user_id, CASE WHEN sum(o * o) > 0 AND sum(n * n) > 0 THEN round(1 - sum(o * n) / sqrt(sum(o * o) * sum(n * n)), 9) ELSE 0.0 END AS distance FROM w GROUP BY 1),
m AS (SELECT user_id, topic, distance, distance > 0.3 AS drifted, round(CASE WHEN distance > 0.3 THEN 0.7 * n + 0.3 * o ELSE 0.3 * n + 0.7 * o END, 9) AS v FROM w JOIN s USING (user_id)),
k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY v DESC, topic) AS r FROM m) WHERE r <= 10)
SELECT user_id, topic, round(CASE WHEN sum(v) OVER (PARTITION BY user_id) > 0 THEN v / sum(v) OVER (PARTITION BY user_id) ELSE 0 END, 4) AS weight, round(distance, 6) AS distance, drifted FROM k""",
    "replay_buffer": """
WITH t AS (SELECT event_type || ':' || (user_id % 10) AS topic, user_id FROM events)
SELECT topic, count(*) AS n, (topic NOT IN (SELECT topic FROM t WHERE user_id % 2 = 0))::BIGINT AS novelty FROM t GROUP BY topic ORDER BY novelty DESC, n DESC, topic LIMIT 20""",
    "competence_map": """
WITH e AS (SELECT event_type || ':' || (user_id % 7) AS topic, user_id, ts, value FROM events),
a AS (SELECT topic, count(*) AS entries, count(DISTINCT user_id) FILTER (user_id % 7 < 5) AS edges, max(ts) FILTER (user_id % 7 > 1) AS last,
        count(*) FILTER (user_id % 7 <> 3 AND value > 50) AS g, count(*) FILTER (user_id % 7 <> 3 AND value <= 20) AS b FROM e GROUP BY 1),
k AS (SELECT topic, entries, least(ln(entries + 1) / ln(101), 1.0) AS p, CASE WHEN edges > 0 THEN least(edges / 100, 1.0) END AS d,
        CASE WHEN last IS NOT NULL THEN pow(0.5, greatest(0, date_diff('microsecond', last, TIMESTAMP '2024-02-01') / 86400000000.0) / 30) END AS r, CASE WHEN g + b >= 5 THEN g / (g + b) END AS o FROM a),
s AS (SELECT topic, entries, round(CASE
    WHEN d IS NOT NULL AND r IS NOT NULL AND o IS NOT NULL THEN 0.3 * p + 0.25 * d + 0.2 * r + 0.25 * o
    WHEN r IS NOT NULL AND o IS NOT NULL THEN 0.4 * p + 0.3 * r + 0.3 * o
    WHEN d IS NOT NULL AND o IS NOT NULL THEN 0.4 * p + 0.3 * d + 0.3 * o
    WHEN o IS NOT NULL THEN 0.6 * p + 0.4 * o
    WHEN d IS NOT NULL AND r IS NOT NULL THEN 0.5 * p + 0.3 * d + 0.2 * r
    WHEN r IS NOT NULL THEN 0.7 * p + 0.3 * r
    WHEN d IS NOT NULL THEN 0.6 * p + 0.4 * d ELSE p END, 6) AS score FROM k)
SELECT topic, entries, score, CASE WHEN score >= 0.8 THEN 'Expert' WHEN score >= 0.4 THEN 'Competent' WHEN score >= 0.1 THEN 'Novice' ELSE 'Unknown' END AS level FROM s""",
    "bandit_posterior": f"""
WITH o AS (SELECT user_id % 6 AS context, {_ARM}[event_id % 5 + 1] AS arm, event_type = 'purchase' AS won FROM events WHERE event_type IN ('purchase', 'error')),
g AS (SELECT context, arm, arm_no FROM (SELECT DISTINCT user_id % 6 AS context FROM events), (VALUES ('default', 0), ('graph_boost', 1), ('deep_graph', 2), ('vector_focus', 3)) AS a(arm, arm_no)),
p AS (SELECT g.context, g.arm, arm_no, CASE arm_no WHEN 0 THEN 2 ELSE 1 END + count(*) FILTER (won) AS alpha, 1 + count(*) FILTER (NOT won) AS beta FROM g LEFT JOIN o ON o.context = g.context AND o.arm = g.arm GROUP BY 1, 2, 3)
SELECT context, arm, alpha::BIGINT AS alpha, beta::BIGINT AS beta, round(alpha / (alpha + beta), 6) AS mean, arm_no > 0 AND row_number() OVER (PARTITION BY context ORDER BY arm_no = 0, alpha / (alpha + beta) DESC, arm_no) = 1 AS best FROM p""",
    "feedback_latest": """
WITH l AS (SELECT * FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events WHERE event_type IN ('click', 'error')) WHERE r = 1)
SELECT e.event_id, e.user_id, e.value, l.event_type AS feedback, l.event_id AS feedback_event FROM events e LEFT JOIN l USING (user_id)
WHERE e.event_type = 'purchase' AND coalesce(l.event_type <> 'error', true)""",
    "instinct_decay": """
WITH u AS (SELECT user_id, event_type, max(ts) AS last, count(*) AS activations FROM events GROUP BY 1, 2),
c AS (SELECT *, least(0.95, 0.3 + activations / 40) AS c, date_diff('microsecond', last, TIMESTAMP '2024-05-01') // 86400000000 AS idle FROM u),
d AS (SELECT *, round(CASE WHEN idle >= 30 THEN greatest(0.2, c - 0.05 * (idle // 30)) ELSE c END, 6)::DOUBLE AS d FROM c)
SELECT event_type, count(*) AS n, count(*) FILTER (d < 0.3) AS needs_review, round(avg(d), 3) AS mean_confidence, sum(activations)::BIGINT AS activations FROM d GROUP BY 1""",
    "instinct_confidence": """
SELECT user_id AS key, round(list_reduce(list_concat([0.5::DOUBLE], list(CASE WHEN value > 30 THEN 0.03 ELSE -0.05 END::DOUBLE ORDER BY ts, event_id)),
         lambda c, x: CASE WHEN x > 0 THEN least(0.95, c + x) ELSE greatest(0.2, c + x) END), 6) AS confidence, count(*) AS n
FROM events GROUP BY 1""",
    "topic_trigger": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS n FROM events) WHERE n = 3",
    "nearest_event": """
SELECT left_id, right_id, gap FROM (
  SELECT a.event_id AS left_id, b.event_id AS right_id, abs(date_diff('microsecond', a.ts, b.ts)) AS gap,
         row_number() OVER (PARTITION BY a.event_id ORDER BY abs(date_diff('microsecond', a.ts, b.ts)), b.event_id) AS r
  FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'error' AND b.event_type = 'click' AND abs(date_diff('microsecond', a.ts, b.ts)) < 3600000000::BIGINT
) WHERE r = 1""",
    "datalake_stats": """
WITH f AS (SELECT url AS path, length(html) AS length, 'pages' AS lake FROM pages UNION ALL SELECT source, length(text), 'documents' FROM documents),
c AS (
  SELECT *, CASE WHEN contains(lower(path), 'decision') THEN 'decision' WHEN contains(lower(path), 'learning') THEN 'learning'
    WHEN contains(lower(path), 'problem') OR contains(lower(path), 'solution') THEN 'problem_solution' WHEN contains(lower(path), 'session') OR contains(lower(path), 'conversation') THEN 'conversation'
    WHEN contains(lower(path), 'code-change') THEN 'code_change' WHEN contains(lower(path), 'training') THEN 'training_data' WHEN contains(lower(path), 'claude.md') THEN 'prompt_template'
    WHEN contains(lower(path), 'readme') THEN 'documentation' WHEN path ILIKE '%.py' THEN 'code_python' WHEN path ILIKE '%.ts' OR path ILIKE '%.tsx' OR path ILIKE '%.js' THEN 'code_typescript' ELSE 'other' END AS category FROM f
)
SELECT lake, category, count(*) AS files, sum(length)::BIGINT AS bytes, grouping(lake)::BIGINT AS all_lake, grouping(category)::BIGINT AS all_category FROM c GROUP BY GROUPING SETS ((), (lake), (category))""",
    "datalake_search": "SELECT url AS path, length(html) AS n_chars FROM pages WHERE contains(lower(url), 'thing') OR contains(lower(html), 'thing') ORDER BY url LIMIT 50",
    "quality_gate": r"""
SELECT reasons, reasons = '' AS accepted, count(*) AS n FROM (
  SELECT array_to_string(list_filter([CASE WHEN length(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) < 300 THEN 'reasoning<300' END,
                                      CASE WHEN length(coalesce(lang, '')) < 2 THEN 'description<2' END], lambda x: x IS NOT NULL), ',') AS reasons FROM documents
) GROUP BY 1""",
    "unprocessed_files": """
SELECT user_id::VARCHAR AS path, max(ts) AS modified FROM events GROUP BY user_id HAVING max(ts) >= TIMESTAMP '2024-01-30'""",
    "stream_outcomes": f"SELECT * FROM ({_outcomes(0.15, 0.1)}) WHERE outcome <> 'neutral'",
    "stream_sessions": "SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, max(turn) AS last_turn FROM conversations GROUP BY 1",
}
