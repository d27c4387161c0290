r"""SQL for DuckDB with the same rows as the queries of `more`."""

from __future__ import annotations

from skein.plans.oracles import _ENTITIES, _PART_OF, _PLACE, _TASKS, _has, _outcomes

_ALIASES = (("thing", "thing"), ("things", "thing"), ("earth", "earth"), ("erth", "earth"), ("erth and", "earth"), ("joining", "joining"), ("und", "joining"), ("und nicht", "joining"), ("both", "both"), ("und", "both"), ("purpose", "purpose"), ("para", "purpose"), ("dans les", "purpose"), ("article", "article"), ("the", "article"), ("las", "article"))
_FOUND_ANYWHERE = "(VALUES ('nation','nation'),('ation','nation'),('heit','heit'),('ment','ment'),('mente','ment'),('ción','ment')) AS p(alias, term)"
_ERR = (("ending", r"(tion|heit|ción)\."), ("double", "(the the|de de|und und)"))
_STR = (("comma", r"[\p{L}]+, and"), ("colon", r"[\p{L}]+: "), ("with", r"with [\p{L}]+"))


def _matching(patterns, text: str) -> str:
    """(doc, term) of each (term, pattern); one select a pattern, so that each is compiled once."""
    return " UNION ".join(f"SELECT doc, '{term}' AS term FROM src WHERE regexp_matches({text}, '{pattern}')" for term, pattern in patterns)


def _hits(rows: str) -> str:
    """tech, pat, err and strat (doc, term) of rows (doc, t)."""
    border = r"[^\p{L}\p{N}_]"
    return f"""
src AS MATERIALIZED (SELECT doc, t, lower(t) AS low FROM ({rows})),
tech AS ({_matching([(term, f"(^|{border}){alias}($|{border})") for alias, term in _ALIASES], "low")}),
pat AS (SELECT DISTINCT doc, term FROM src, {_FOUND_ANYWHERE} WHERE contains(low, alias)),
err AS ({_matching([(t, "(?i)" + x) for t, x in _ERR], "t")}),
strat AS ({_matching([(t, "(?i)" + x) for t, x in _STR], "t")})"""


def _self(table: str, kind: str, conf: float) -> str:
    return f"SELECT doc, term AS subject, '{kind}' AS subject_type, 'related_to' AS relation, term AS object, '{kind}' AS object_type, {conf} AS confidence FROM {table}"


def _fixes(conf: float) -> str:
    return f"SELECT s.doc, s.term, 'strategy', 'fixes', e.term, 'error_type', {conf} FROM strat s JOIN err e USING (doc)"


def _pairs(conf: float) -> str:
    return f"SELECT a.doc, a.term, 'technology', 'related_to', b.term, 'technology', {conf} FROM tech a JOIN tech b ON a.doc = b.doc AND a.term < b.term"


def _counted(ctes: str, *parts: str) -> str:
    return f"WITH {ctes}, triples AS ({' UNION ALL '.join(parts)}) SELECT subject, subject_type, relation, object, object_type, round(confidence, 2)::DOUBLE AS confidence, count(*) AS n, min(doc) AS first_doc FROM triples GROUP BY ALL"


_DECISION = "SELECT doc_id AS doc, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END || ' ' || CASE WHEN doc_id % 2 = 0 THEN coalesce(lang, '') ELSE '' END || ' ' || text AS t FROM documents"
_TOPIC = "CASE WHEN doc % 3 > 0 THEN lower(trim(source)) ELSE '' END"
_SUFFIX = "['.py', '.ts', '.md', '.go', '.PY', '']"
_CAPTURES = f"""
cap AS (SELECT event_id AS doc, user_id, event_type, ts, {_SUFFIX}[event_id % 6 + 1] AS suffix, 'p' || (user_id % 5) AS project, event_id % 4 = 0 AS told, event_id % 3 AS enriched FROM events)"""
_CATEGORY = "['fastapi', 'debugging-real', 'ddd', 'docker', 'general', 'ml-rag', 'postgresql', 'error_fix', 'angular', 'history'][doc_id % 10 + 1]"
_CATS = f"cats AS (SELECT {_CATEGORY} AS category, count(*) AS n FROM documents GROUP BY 1)"
_TYPED = "typed AS (SELECT CASE category WHEN 'fastapi' THEN 'backend' WHEN 'debugging-real' THEN 'debugging' WHEN 'ddd' THEN 'architecture' WHEN 'docker' THEN 'devops' WHEN 'ml-rag' THEN 'ml_engineering' WHEN 'postgresql' THEN 'backend' WHEN 'error_fix' THEN 'debugging' WHEN 'angular' THEN 'frontend' ELSE category END AS task_type, sum(n)::BIGINT AS n FROM cats WHERE category <> 'general' GROUP BY 1)"
_MATCHED = """
topics AS (SELECT unnest(['fastapi', 'click', 'view', 'p1', 'postgresql', 'bash']) AS topic),
matched AS (
  SELECT doc, topic, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS timestamp FROM cap, topics
  WHERE (doc % 2 = 0 AND topic = event_type) OR contains(project, topic) OR (lower(suffix) = '.py' AND topic = 'fastapi')
)"""
_INSTINCTS = """
inst AS (
  SELECT 'i' || user_id AS id, ['Erth', 'thing', 'und', 'para', 'zzz'][user_id % 5 + 1] AS pattern, ['workflow', 'preference', 'shortcut'][user_id % 3 + 1] AS category,
         round(least(0.95, (user_id % 10) / 10 + 0.05), 6)::DOUBLE AS confidence, user_id % 7 > 0 AS enabled, count(*) AS activations, max(ts) AS last_used
  FROM events GROUP BY user_id
),
idle AS (SELECT *, date_diff('microsecond', last_used, TIMESTAMP '2024-05-01') // 86400000000 AS days FROM inst),
worn AS (SELECT id, enabled, activations, round(CASE WHEN days >= 30 THEN greatest(0.2, confidence - 0.05 * (days // 30)) ELSE confidence END, 6)::DOUBLE AS confidence FROM idle)"""
_FOUND = """
asked AS (SELECT conv_id, turn, conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'),
found AS (SELECT query_id, conv_id, turn, id, confidence, row_number() OVER (PARTITION BY query_id ORDER BY confidence DESC, id) AS rank FROM asked JOIN inst ON enabled AND confidence >= 0.3 AND contains(lower(text), lower(pattern)))"""
_SAID = f"said AS (SELECT conv_id, turn, outcome = 'accepted' AS accepted FROM ({_outcomes(0.15, 0.1)}) WHERE outcome <> 'neutral')"
_ARMS = f"""
{_SAID},
dec AS (SELECT conv_id, turn, 't' || (conv_id % 4) AS context, ['default', 'graph_boost', 'deep_graph', 'vector_focus'][(turn + conv_id) % 4 + 1] AS arm FROM conversations WHERE role = 'user'),
won AS (SELECT context, arm, accepted FROM said JOIN dec USING (conv_id, turn)),
grid AS (SELECT context, arm, arm_no FROM (SELECT DISTINCT context FROM dec), (VALUES ('default', 0), ('graph_boost', 1), ('deep_graph', 2), ('vector_focus', 3)) AS v(arm, arm_no)),
post AS (SELECT g.context, g.arm, arm_no, CASE arm_no WHEN 0 THEN 2 ELSE 1 END + count(*) FILTER (accepted) AS alpha, 1 + count(*) FILTER (NOT accepted) AS beta FROM grid g LEFT JOIN won w ON w.context = g.context AND w.arm = g.arm GROUP BY 1, 2, 3)"""
_ASKED = "asked AS (SELECT conv_id * 1000 + turn AS query_id, lower(text) AS low, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda t: t <> '') AS tokens, list_filter(regexp_split_to_array(lower(replace(text, '-', ' ')), '\\s+'), lambda t: t <> '') AS parts FROM conversations WHERE role = 'user')"
_TOPICS = """
detected AS (SELECT query_id, arg_min(topic, no) AS topic, arg_min(level, no) AS level
  FROM asked JOIN (VALUES ('Und', 'Expert', 1), ('les', 'Competent', 2), ('the', 'Competent', 3), ('para', 'Novice', 4)) AS t(topic, level, no) ON list_contains(parts, lower(topic)) GROUP BY 1)"""
_MESSAGES = """
m AS (SELECT 'c' || conv_id AS file, conv_id, turn AS ord, role, 'u' || (turn - turn % 2) AS uuid, CASE WHEN turn % 3 = 0 THEN text ELSE text || chr(10) || 'bare' END AS text,
             CASE WHEN turn % 3 = 0 THEN '' ELSE 'hm ' || role END AS thinking, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END::BIGINT AS n_tools FROM conversations WHERE role <> 'system')"""

SQL: dict[str, str] = {
    "pair_triples": _counted(
        _hits("SELECT doc_id AS doc, source || ' ' || text AS t FROM documents"),
        _self("tech", "technology", 0.8), "SELECT doc, term, 'technology', 'related_to', lower(trim(lang)), 'category', 0.6 FROM tech JOIN documents ON doc_id = doc WHERE lang <> ''",
        _self("pat", "pattern", 0.7), _self("err", "error_type", 0.7), _fixes(0.6), _self("strat", "strategy", 0.7), _pairs(0.5),
    ),
    "thought_triples": _counted(
        _hits("SELECT doc_id AS doc, text AS t FROM documents WHERE length(text) >= 100"),
        _self("tech", "technology", 0.65), _self("pat", "pattern", 0.65), _self("strat", "strategy", 0.65), _self("err", "error_type", 0.65), _fixes(0.65), _pairs(0.65),
    ),
    "decision_triples": _counted(
        _hits(_DECISION),
        f"SELECT doc, term AS subject, 'technology' AS subject_type, 'related_to' AS relation, {_TOPIC} AS object, 'concept' AS object_type, 0.7 AS confidence FROM tech JOIN documents ON doc_id = doc WHERE doc % 3 > 0 AND source <> ''",
        f"SELECT doc, term, 'strategy', 'learned_from', CASE WHEN {_TOPIC} = '' THEN 'decision' ELSE {_TOPIC} END, 'concept', 0.7 FROM strat JOIN documents ON doc_id = doc WHERE doc % 2 = 0 AND lang <> ''",
    ),
    "learning_triples": _counted(
        _hits("SELECT doc_id AS doc, CASE WHEN doc_id % 3 > 0 THEN source ELSE '' END || ' ' || text AS t FROM documents"),
        f"SELECT doc, {_TOPIC} AS subject, 'concept' AS subject_type, 'related_to' AS relation, term AS object, 'technology' AS object_type, 0.6 AS confidence FROM tech JOIN documents ON doc_id = doc WHERE doc % 3 > 0 AND source <> ''",
    ),
    "capture_triples": _counted(
        f"""{_CAPTURES},
said AS (SELECT *, CASE enriched WHEN 0 THEN 0.7 WHEN 1 THEN 0.6 ELSE 0.4 END AS base, CASE enriched WHEN 0 THEN 0.6 WHEN 1 THEN 0.55 ELSE 0.5 END AS pair FROM cap),
ext AS (SELECT doc, project, base, pair, CASE lower(suffix) WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.go' THEN 'golang' END AS term FROM said WHERE lower(suffix) IN ('.py', '.ts', '.go')),
tech AS (SELECT doc, project, base, pair, term FROM said, (VALUES ('click', 'clicking'), ('view', 'viewing'), ('purchase', 'buying')) AS a(alias, term) WHERE event_type = alias OR (told AND alias = 'click')),
every AS (SELECT doc, project, pair, term FROM ext UNION SELECT doc, project, pair, term FROM tech)""",
        "SELECT doc, term AS subject, 'technology' AS subject_type, 'related_to' AS relation, term AS object, 'technology' AS object_type, base AS confidence FROM (SELECT * FROM ext UNION ALL SELECT * FROM tech)",
        "SELECT doc, 'mistake', 'pattern', 'related_to', 'mistake', 'pattern', base FROM said WHERE event_type = 'error'",
        "SELECT doc, 'joining', 'strategy', 'related_to', 'joining', 'strategy', base FROM said WHERE event_type = 'signup'",
        "SELECT doc, project, 'concept', 'uses', term, 'technology', pair FROM every",
        "SELECT a.doc, a.term, 'technology', 'related_to', b.term, 'technology', 0.5 FROM every a JOIN every b ON a.doc = b.doc AND a.term < b.term",
    ),
    "model_json_triples": _counted(
        "r AS (SELECT event_id AS doc, 'u' || (user_id % 9) AS u, event_type, event_id % 4 AS k FROM events)",
        "SELECT doc, u AS subject, CASE WHEN k < 2 THEN 'technology' ELSE 'concept' END AS subject_type, CASE WHEN k < 2 THEN 'uses' ELSE 'related_to' END AS relation, event_type AS object, 'concept' AS object_type, 0.6 AS confidence FROM r WHERE k < 3",
    ),
    "profile_build": f"""
WITH {_CATS}, {_TYPED},
ext AS (SELECT suffix, count(*) AS n FROM (SELECT {_SUFFIX}[event_id % 6 + 1] AS suffix FROM events) WHERE suffix <> '' GROUP BY 1),
x AS (SELECT sum(n) AS n_ext, sum(n) FILTER (suffix IN ('.py', '.ts', '.go')) AS code FROM ext),
c AS (SELECT sum(n) AS n_cat, sum(n) FILTER (category <> 'history') AS code, sum(n) FILTER (category = 'ddd') AS formal FROM cats),
t AS (SELECT string_agg(category || ':' || round(n / total * 1000)::BIGINT, ',' ORDER BY n DESC, category) AS topics FROM (SELECT *, sum(n) OVER () AS total FROM cats WHERE category NOT IN ('general', 'error_fix')))
SELECT 'software_development' AS domain, round(least(0.6 * x.code / n_ext + 0.4 * c.code / n_cat, 1.0), 6)::DOUBLE AS confidence, round(0.4 + 0.6 * formal / n_cat, 6)::DOUBLE AS formality,
       CASE arg_min(suffix, -n * 1000 + CASE suffix WHEN '.PY' THEN 0 WHEN '.go' THEN 1 WHEN '.md' THEN 2 WHEN '.py' THEN 3 ELSE 4 END) WHEN '.go' THEN 'Use Go for code examples; ' WHEN '.py' THEN 'Use Python for code examples; ' WHEN '.ts' THEN 'Use TypeScript for code examples; ' ELSE '' END
       || 'Prefer FastAPI with async/await and Pydantic; Follow DDD and hexagonal architecture; Deploy with Docker; Build AI agents and RAG pipelines' AS patterns,
       any_value(topics) AS topics, (SELECT string_agg(task_type, ',' ORDER BY n DESC, task_type) FROM typed) AS task_types, any_value(n_ext + n_cat)::BIGINT AS n
FROM ext, x, c, t GROUP BY x.code, n_ext, c.code, n_cat, formal""",
    "capture_counts": f"""
WITH {_CAPTURES}
SELECT 'project' AS what, 'P' || project[2:] AS name, count(*) AS n FROM cap GROUP BY 2 UNION ALL SELECT 'suffix', suffix, count(*) FROM cap WHERE suffix <> '' GROUP BY 2
UNION ALL SELECT 'tool', event_type, count(*) FROM cap GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM cap""",
    "tag_counts": f"""
SELECT 'category' AS what, {_CATEGORY} AS name, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'total', NULL, count(*) FROM documents
UNION ALL SELECT 'tag', tag, count(*) FROM (SELECT unnest([lang, source]) AS tag FROM documents WHERE doc_id % 3 > 0) GROUP BY 2""",
    "task_types": f"WITH {_CATS}, {_TYPED} SELECT task_type, n FROM typed ORDER BY n DESC, task_type LIMIT 10",
    "capture_topics": f"WITH {_CAPTURES}, {_MATCHED} SELECT topic, count(*) AS n, min(doc) AS first_id FROM matched GROUP BY 1",
    "topic_activity": f"""
WITH {_CAPTURES}, {_MATCHED},
dated AS (SELECT topic, strftime(ts, '%Y-%m-%d') AS timestamp FROM events JOIN topics ON topic = ['fastapi', 'bash', 'none'][event_id % 3 + 1])
SELECT topic, max(timestamp) AS last FROM (SELECT topic, timestamp FROM matched UNION ALL SELECT * FROM dated) GROUP BY 1""",
    "topic_edges": f"""
WITH {_PLACE}, {_PART_OF}, ends AS (SELECT src AS name FROM edges UNION ALL SELECT dst FROM edges),
n AS (SELECT name, count(*) AS n FROM ends GROUP BY 1), t AS (SELECT n_name AS topic FROM nation UNION ALL SELECT upper(r_name) FROM region)
SELECT topic, n AS edges FROM t JOIN n ON name = lower(topic)""",
    "competence_lookup": "",
    "instinct_matches": f"WITH {_INSTINCTS}, {_FOUND} SELECT query_id, id, round(confidence, 6) AS confidence, rank FROM found",
    "instinct_changes": f"""
WITH {_INSTINCTS},
ch AS (SELECT 'i' || (user_id % 60) AS id, event_id, event_type, event_id % 3 AS c FROM events WHERE event_type = 'error' OR event_id % 3 <> 1),
last AS (SELECT id, arg_max(event_type, event_id) AS pattern, arg_max(c, event_id) AS c FROM ch GROUP BY 1)
SELECT id, pattern, category, round(confidence, 6) AS confidence, enabled FROM inst WHERE id NOT IN (SELECT id FROM last)
UNION ALL SELECT id, pattern, ['workflow', 'unknown', 'timing'][c + 1], 0.35, true FROM last WHERE pattern <> 'error'""",
    "instinct_summary": f"""
WITH {_INSTINCTS} SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (enabled AND confidence < 0.3) AS needs_review, round(avg(confidence) FILTER (enabled), 3) AS mean_confidence, sum(activations)::BIGINT AS activations FROM worn""",
    "instinct_review": f"WITH {_INSTINCTS} SELECT id, confidence FROM worn WHERE enabled AND confidence < 0.3",
    "feedback_loop": f"""
WITH {_INSTINCTS}, {_FOUND}, {_SAID}, ev AS (SELECT id, conv_id, turn, accepted FROM found JOIN said USING (conv_id, turn))
SELECT id AS key, round(list_reduce(list_concat([0.5::DOUBLE], list(CASE WHEN accepted THEN 0.03 ELSE -0.05 END::DOUBLE ORDER BY conv_id, turn)),
         lambda c, x: CASE WHEN x > 0 THEN least(0.95, c + x) ELSE greatest(0.2, c + x) END), 6) AS confidence, count(*) AS n
FROM ev GROUP BY 1""",
    "arm_updates": f"WITH {_ARMS} SELECT context, arm, alpha::BIGINT AS alpha, beta::BIGINT AS beta FROM post",
    "best_arms": f"WITH {_ARMS} SELECT context, arg_min(arm, -1000000 * round(alpha / (alpha + beta), 9) + arm_no / 100.0) AS arm, round(max(alpha / (alpha + beta)), 6) AS mean FROM post WHERE arm_no > 0 GROUP BY 1",
    "habit_trigger": """
SELECT session, topic, conv_id, turn FROM (
  SELECT conv_id % 6 AS session, ['a', 'b'][turn % 2 + 1] AS topic, conv_id, turn, row_number() OVER (PARTITION BY conv_id % 6, turn % 2 ORDER BY conv_id, turn) AS n
  FROM conversations WHERE role = 'user' AND len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) >= 5
) WHERE n = 3 AND topic NOT IN (SELECT 'b' FROM conversations WHERE role = 'user' AND conv_id % 6 = 2 AND turn % 2 = 1)""",
    "drifted_topics": """
WITH c AS (SELECT user_id, event_type AS topic, count(*) FILTER (ts < TIMESTAMP '2024-01-04') AS a, count(*) FILTER (ts >= TIMESTAMP '2024-01-04') AS b FROM events GROUP BY 1, 2),
w AS (SELECT user_id, topic, coalesce(a / nullif(sum(a) OVER u, 0), 0) AS o, coalesce(b / nullif(sum(b) OVER u, 0), 0) AS n FROM c WINDOW u AS (PARTITION BY user_id))
SELECT user_id, string_agg(topic, ',' ORDER BY topic) AS topics FROM w WHERE round(abs(o - n), 9) > 0.1 GROUP BY 1""",
    "compaction_by_task": """
WITH t AS (SELECT conv_id, ['debugging', 'code_review', 'general', 'other'][conv_id % 4 + 1] AS task, sum(CASE WHEN role IN ('user', 'assistant') THEN length(text) * 10 // 4 ELSE 0 END)::BIGINT AS tokens FROM conversations GROUP BY 1, 2),
l AS (SELECT * FROM t JOIN (VALUES ('debugging', 4500, 6000, 7000, 8), ('code_review', 3500, 5000, 6000, 6), ('general', 2500, 4000, 5000, 4), ('other', 3500, 5000, 6000, 6)) AS v(task, s, h, e, k) USING (task))
SELECT conv_id, task, tokens, k::BIGINT AS keep_turns, CASE WHEN tokens < s THEN 'none' WHEN tokens < h THEN 'snip' WHEN tokens <= e THEN 'summary' ELSE 'emergency' END AS action FROM l""",
    "summary_inputs": r"""
WITH l AS (SELECT conv_id, turn, role || ': ' || regexp_replace(CASE WHEN turn % 2 = 1 THEN repeat(text, 20) ELSE text END, '^\s+|\s+$', '', 'g') AS line FROM conversations),
j AS (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY turn)[1:12000] AS text FROM l GROUP BY 1)
SELECT conv_id, length(text) AS n_chars, md5(text) AS digest FROM j""",
    "session_stats": "",
    "system_prompts": """
WITH e AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
t AS (SELECT user_id, list(event_type ORDER BY n DESC, event_type) AS topics, list(event_type ORDER BY event_type) AS tasks, list(event_type ORDER BY n DESC, event_type) FILTER (n >= 14) AS habits,
             list(event_type ORDER BY n DESC, event_type) FILTER (n >= 18) AS expert, list(event_type ORDER BY n DESC, event_type) FILTER (n >= 12 AND n < 18) AS competent FROM e GROUP BY 1),
p AS (SELECT *, ['debugging', 'architecture', 'explanation', 'general', 'poetry'][user_id % 5 + 1] AS task, ['software engineering', 'data science', 'unknown'][user_id % 3 + 1] AS domain,
             user_id % 3 < 2 AND user_id % 10 >= 1 AS known, user_id % 2 = 1 AS other FROM t),
f AS (SELECT *, CASE WHEN known THEN 'You are assisting a ' || domain || ' professional.' || CASE WHEN other THEN ' Respond in es.' ELSE '' END ELSE 'You are a general-purpose assistant.' END AS identity,
             'Tech focus: ' || array_to_string(topics[1:5], ', ') || '.' AS stack, array_to_string(list_transform(habits[1:5], lambda x: 'Use ' || x || '.'), ' ') AS patterns,
             'Common tasks: ' || array_to_string(tasks[1:5], ', ') || '.' AS projects FROM p),
c AS (SELECT *, concat_ws('. ', 'Expert in: ' || array_to_string(expert[1:5], ', '), 'Competent in: ' || array_to_string(competent[1:5], ', ')) AS able FROM f)
SELECT user_id, task, concat_ws(' ',
  CASE task WHEN 'debugging' THEN 'Task: debugging. Focus on root cause analysis. Be direct about the fix.' WHEN 'architecture' THEN 'Task: architecture. Explain trade-offs. Consider scalability and maintainability.'
            WHEN 'explanation' THEN 'Task: explanation. Be clear and structured. Use examples when helpful.' END,
  CASE WHEN task <> 'poetry' THEN identity WHEN known THEN 'You are assisting a ' || domain || ' professional.' ELSE 'You are a general-purpose assistant. Adapt your responses to the user''s needs.' END,
  CASE WHEN task IN ('debugging', 'architecture', 'explanation') THEN stack END,
  CASE WHEN task IN ('debugging', 'architecture') OR task = 'poetry' AND known THEN nullif(patterns, '') END,
  CASE WHEN task = 'architecture' THEN projects WHEN task = 'poetry' AND known AND other THEN 'Respond in es.' END,
  CASE WHEN able <> '' THEN able || '.' END) AS prompt FROM c""",
    "exported_pairs": """
WITH b AS (SELECT event_id, event_type, CASE WHEN event_id % 4 = 0 THEN ['negative', 'positive'][(event_id // 4) % 2 + 1] WHEN event_id % 2 = 0 THEN ['positive', 'negative', 'neutral'][user_id % 3 + 1] END AS f FROM events WHERE event_id % 3 = 0 OR value > 20),
k AS (SELECT *, 'positive' AS least FROM b WHERE f = 'positive' UNION ALL SELECT *, 'neutral' FROM b WHERE coalesce(f <> 'negative', true) UNION ALL SELECT *, 'any' FROM b)
SELECT event_type AS instruction, count(*) AS n, max(event_id) AS last_id, least FROM k GROUP BY event_type, least""",
    "enriched_captures": """
WITH m AS (
  SELECT event_id AS id, repeat(event_type, (user_id % 30)::INT) AS t1, repeat(event_type, (user_id % 40)::INT) AS t2, repeat(props, (event_id % 8)::INT) AS x, event_id % 3 > 0 AS prompted, event_id % 5 < 3 AS direct, event_id % 5 > 1 AS fuzzy FROM events
),
p AS (SELECT *, CASE WHEN direct AND length(t1) + length(x) > 0 THEN t1 WHEN fuzzy AND length(t2) + length(x) > 0 THEN t2 END AS t FROM m),
c AS (SELECT *, CASE WHEN length(t) > 100 THEN 'high' WHEN length(x) > 50 THEN 'medium' ELSE 'low' END AS enrichment_confidence FROM p WHERE t IS NOT NULL)
SELECT enrichment_confidence, count(*) AS n, sum(length(t))::BIGINT AS thinking_chars, sum(length(x))::BIGINT AS text_chars FROM c WHERE enrichment_confidence <> 'low' OR prompted GROUP BY 1""",
    "detected_topics": f"WITH {_ASKED}, {_TOPICS} SELECT query_id, topic, level FROM detected",
    "routing_decisions": f"""
WITH {_ASKED}, {_TOPICS},
s AS (SELECT query_id, {', '.join(f'{_has(*w)} AS {t}' for t, w in _TASKS.items())} FROM asked),
classes AS (SELECT query_id, best, CASE WHEN best = 0 THEN 'general' {' '.join(f"WHEN {t} = best THEN '{t}'" for t in _TASKS)} END AS task FROM (SELECT *, greatest({', '.join(_TASKS)}) AS best FROM s))
SELECT query_id, CASE WHEN query_id % 6 = 0 THEN 'law' ELSE task END AS task, CASE WHEN query_id % 6 = 0 THEN 'learned' WHEN best > 0 THEN 'keyword' ELSE 'fallback' END AS how, topic, coalesce(level, 'Unknown') AS level
FROM classes LEFT JOIN detected USING (query_id)""",
    "strategy_cascade": """
WITH q AS (SELECT conv_id * 1000 + turn AS query_id FROM conversations WHERE role = 'user'),
t AS (SELECT query_id, ['debugging', 'general', 'odd'][query_id % 3 + 1] AS task, CASE query_id % 4 WHEN 0 THEN 'sql' WHEN 1 THEN 'web' END AS topic FROM q),
b AS (SELECT *, CASE WHEN topic IS NULL THEN task ELSE task || '_' || topic END AS context FROM t),
a AS (
  SELECT *, CASE task WHEN 'debugging' THEN [2, 0.5, 0.5, 0.6, 2, 8, 1536] ELSE [2, 0.6, 0.4, 0.7, 1, 5, 768] END::DOUBLE[] AS f,
         CASE context WHEN 'debugging' THEN [2, 0, 0.2] WHEN 'debugging_sql' THEN [1, 0, 0.1] WHEN 'general_web' THEN [0, 0.1, -0.1] ELSE [0, 0, 0] END::DOUBLE[] AS d,
         context IN ('debugging', 'debugging_sql', 'general_web') AS armed FROM b
),
m AS (SELECT query_id, task, topic, context, f, armed, f[1] + d[1] AS depth, round(f[2] + d[2], 4) AS v, round(f[3] + d[3], 4) AS g FROM a)
SELECT query_id, task, topic, CASE WHEN context = 'general_web' THEN 5.0 WHEN task = 'general' THEN 1.0 ELSE depth END::DOUBLE AS graph_depth,
       CASE WHEN task = 'debugging' THEN 0.9 WHEN task = 'general' THEN 0.25 ELSE v END::DOUBLE AS vector_weight, g AS graph_weight, f[4] AS confidence, f[5] AS min_k, f[6] AS max_k, f[7] AS max_tokens,
       CASE WHEN task IN ('debugging', 'general') THEN 'override' WHEN armed THEN 'arm' ELSE 'base' END AS source FROM m""",
    "response_report": """
WITH s AS (SELECT (conv_id % 4)::VARCHAR AS category, ['easy', 'hard'][turn % 2 + 1] AS difficulty, turn, length(text) AS n, lower(text) AS low FROM conversations WHERE role = 'assistant'),
t AS (
  SELECT category, difficulty, turn, round(greatest(0.0, 0.5 * (contains(low, 'the')::INT + contains(low, 'and')::INT + contains(low, 'erth')::INT) / 3
    + 0.3 * CASE WHEN n < 0.3 * 200 THEN 0.3 WHEN n < 0.6 * 200 THEN 0.6 ELSE least(1.0, n / (1.5 * 200)) END
    + 0.2 * CASE WHEN n < 50 THEN 0.5 WHEN n > 2000 THEN 0.7 ELSE 1.0 END - 0.2 * (contains(low, 'thing')::INT + contains(low, 'und')::INT)), 3)::DOUBLE AS score FROM s
)
SELECT category, difficulty, count(*) AS n, round(avg(score), 4) AS mean_score, max(score) AS best, round(avg(turn), 2) AS mean_latency, grouping(category)::BIGINT AS all_category, grouping(difficulty)::BIGINT AS all_difficulty
FROM t GROUP BY GROUPING SETS ((), (category), (difficulty))""",
    "session_messages": f"WITH {_MESSAGES} SELECT file, ord, role, md5(text) AS text, thinking, n_tools FROM m",
    "messages_by_uuid": f"WITH {_MESSAGES} SELECT file, uuid, arg_max(role, ord) AS role, arg_max(length(text), ord) AS n_chars FROM m GROUP BY 1, 2",
    "tool_messages": f"WITH {_MESSAGES} SELECT 't' || (conv_id % 50) AS tool_use_id, min(ord) AS ord FROM m WHERE role = 'assistant' AND n_tools > 0 GROUP BY 1",
    "index_rows": """
WITH r AS (SELECT doc_id, text, source, lang, CASE WHEN doc_id % 2 = 0 THEN source ELSE '' END AS asked FROM documents WHERE doc_id % 5 > 0 AND length(text) >= 50)
SELECT CASE WHEN doc_id % 3 = 0 THEN coalesce(lang, 'training') ELSE 'training' END AS category, 'proj' || (doc_id % 4) AS project, count(*) AS n, sum(length(text) + CASE WHEN asked <> '' THEN length(asked) + 7 ELSE 0 END)::BIGINT AS n_chars FROM r GROUP BY 1, 2""",
    "keyword_rows": """
WITH r AS (SELECT CASE WHEN doc_id % 2 = 0 AND source <> '' THEN source || chr(10) || text ELSE text END AS t FROM documents WHERE length(text) >= 50)
SELECT md5(t)[1:12] AS id, 'training' AS category, count(*) AS n, max(length(t)) AS n_chars FROM r GROUP BY 1""",
}


def _finish() -> None:
    from skein.plans.oracles import SQL as OTHERS

    SQL["competence_lookup"] = f"""
WITH known AS ({OTHERS['competence_map']}), t AS (SELECT DISTINCT upper(event_type || ':' || (user_id % 9)) AS topic FROM events)
SELECT t.topic, coalesce(level, 'Unknown') AS level, coalesce(round(score, 6), 0.0)::DOUBLE AS score FROM t LEFT JOIN known k ON lower(k.topic) = lower(t.topic)"""
    SQL["session_stats"] = f"WITH p AS ({OTHERS['pair_quality']}) SELECT category, count(DISTINCT conv_id) AS sessions, count(*) AS pairs FROM p GROUP BY ROLLUP (category)"


_finish()
