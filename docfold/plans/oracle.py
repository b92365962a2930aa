"""SQL for DuckDB that gives the rows of the queries, written apart from their Spark plans."""

from __future__ import annotations

from .queries import K, QUESTION, RECENT_DAYS, VARIANTS
from .views import CHAT_EVENTS, LINES, MARKUP, MODEL_LEAVES, PAGES

CHUNKS = "SELECT doc_id, text, lang, source, embedding, label FROM documents JOIN embeddings ON doc_id = vec_id"
TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}_]+')"


def scored(n: int, base: str = CHUNKS) -> str:
    return f"""
        SELECT c.* EXCLUDE (embedding), q.vec_id AS query_id,
               round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
        FROM ({base}) c, (SELECT vec_id, embedding FROM embeddings WHERE vec_id < {n}) q
    """


def tokens(text: str, least: int = 2) -> str:
    return f"list_distinct(list_filter({TOKENS.format(text)}, lambda x: length(x) >= {least}))"


def word_share(text: str, question: str = f"'{QUESTION}'") -> str:
    return f"(len(list_intersect({tokens(question)}, {tokens(text)})) / greatest(len({tokens(question)}), 1))"


def substring_share(text: str, least: int = 4, question: str = f"'{QUESTION}'") -> str:
    return f"(len(list_filter({tokens(question, least)}, lambda t: contains(lower({text}), t))) / greatest(len({tokens(question, least)}), 1))"


def lines(text: str) -> str:
    return rf"list_filter(list_transform(regexp_split_to_array({text}, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '')"


def words(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


def share(items: str, test: str) -> str:
    return f"(CASE WHEN len({items}) > 0 THEN len(list_filter({items}, lambda x: {test})) / len({items}) ELSE 0.0 END)"


LOOSE = "^[=~^#*+-]+$"
STEP_START = r"^((?:step\s+)?(?:\d+|[a-zA-Z])[).:-]\s+)"
CAPTION = r"(?i)^(?:figure|fig\.?|diagram|workflow|architecture|table|chart|image|screenshot|screen)\s*[\dA-Za-z.-]*[:\-]?\s+"
ENUMERATED = r"^(?:[\(\[]?[\d٠-٩IVXivxA-Za-z]+[\)\].:-]\s*).+"


def heuristic(x: str) -> str:
    letters, upper = rf"length(regexp_replace({x}, '[^\p{{L}}]', '', 'g'))", rf"length(regexp_replace({x}, '[^\p{{Lu}}]', '', 'g'))"
    titled = f"{x} = array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
    return rf"""({x} <> '' AND len({words(x)}) <= 8 AND NOT regexp_matches({x}, '[.;?!]$') AND NOT regexp_matches({x}, '{STEP_START}')
        AND (({letters} > 0 AND {upper} > 0.75 * {letters}) OR ({titled} AND len({words(x)}) <= 6)))"""


def page_heading(x: str) -> str:
    digits = rf"length(regexp_replace({x}, '\D', '', 'g'))"
    return f"(len({words(x)}) > 0 AND (CASE WHEN ends_with({x}, ':') THEN len({words(x)}) <= 6 ELSE {heuristic(x)} AND {digits} <= 4 END))"


def table_like(x: str) -> str:
    border = r"\s{2,}|\t|\|"
    own = lines(x)
    return rf"""((len({own}) >= 2 AND len(list_filter({own}[1:4], lambda y: NOT regexp_matches(y, '{border}'))) = 0)
        OR (len({own}) = 1 AND len(regexp_extract_all({own}[1], '{border}')) >= 2 AND len({words(x)}) >= 3))"""


def normalized(x: str) -> str:
    return rf"regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace({x}, '\r\n?', E'\n', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{{3,}}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g')"


def paths(heads: str, rows: str, key: str, at: str, first: str = "''") -> str:
    """(key, at, path) for rows: the titles of heads (key, at, level, title) that no later one up to there closes."""
    return f"""
        SELECT r.{key}, r.{at}, {first} || coalesce(string_agg(h.title, ' > ' ORDER BY h.at), '') AS path FROM {rows} r LEFT JOIN (
            SELECT *, (SELECT min(g.at) FROM {heads} g WHERE g.{key} = h.{key} AND g.at > h.at AND g.level <= h.level) AS closed FROM {heads} h) h
        ON h.{key} = r.{key} AND h.at <= r.{at} AND (h.closed IS NULL OR h.closed > r.{at}) GROUP BY ALL
    """


STEP = share(lines("text"), r"regexp_matches(x, '(?i)^(?:step\s+\d+|\d+[.)]|[a-z]\)|[-*•])')")
LIST = share(lines("text"), r"regexp_matches(x, '^(?:\d+[.)]|[A-Za-z]\)|[-*•])')")
REFERENCE = share(lines("text"), "regexp_matches(x, '[:=|<>(]')")
NUMERIC = share(words("text"), r"regexp_matches(x, '[\d%]')")
LEAD = f"{lines('text')}[1]"
DEFINITION = f"""(CASE WHEN len({lines('text')}) = 0 THEN 0.0 ELSE
    CASE WHEN len({words('source')}) <= 8 THEN 0.1 ELSE 0 END
    + CASE WHEN contains({LEAD}, ':') OR len({words(LEAD)}) <= 12 THEN 0.1 ELSE 0 END
    + CASE WHEN len({lines('text')}) <= 6 THEN 0.08 ELSE 0 END END)"""
PENALTY = rf"""(CASE WHEN regexp_full_match(lower(trim(source)), 'page\s+\d+') THEN 0.06
    WHEN len({words('source')}) <= 3 AND (text = '' OR len(regexp_split_to_array(regexp_replace(text, '(\r\n|\r|\n)$', ''), '\r\n|\r|\n')) <= 2) THEN 0.03 ELSE 0.0 END)"""
SHAPES = {
    "steps": f"least(0.07, {STEP} * 0.22)",
    "parameter_list": f"least(0.08, {REFERENCE} * 0.24)",
    "comparison": f"least(0.07, ({REFERENCE} + {LIST}) * 0.16)",
    "limit": f"least(0.07, ({NUMERIC} + {LIST}) * 0.14)",
    "rule": f"least(0.06, {LIST} * 0.16)",
    "definition": f"least(0.05, {DEFINITION} * 0.18)",
}

#: Paragraph windows as a left fold with one struct type for state and items.
WINDOWS = r"""
    WITH items AS (
        SELECT {keys}, list_transform(list_filter(list_transform(string_split(text, {border}), lambda p: trim(p, ' ')), lambda p: p <> ''),
            lambda p: {{'out': []::STRUCT(t VARCHAR, n BIGINT)[][], 'cur': [{{'t': p, 'n': len({words})}}], 'n': len({words})}}) AS xs
        FROM {base}
    ),
    folded AS (
        SELECT {keys}, list_reduce(xs, lambda s, x: CASE WHEN s.n + x.n > {most} THEN
            {{'out': list_append(s.out, s.cur),
              'cur': list_concat(list_slice(s.cur, {start}, len(s.cur)), x.cur),
              'n': list_sum(list_transform(list_slice(s.cur, {start}, len(s.cur)), lambda y: y.n))::BIGINT + x.n}}
            ELSE {{'out': s.out, 'cur': list_concat(s.cur, x.cur), 'n': s.n + x.n}} END) AS s
        FROM items WHERE len(xs) > 0
    ),
    shaped AS (
        SELECT {keys}, list_filter(list_transform(list_append(s.out, s.cur), lambda w: {{
            'n_words': list_sum(list_transform(w, lambda y: y.n))::BIGINT, 'content': array_to_string(list_transform(w, lambda y: y.t), {border})}}),
            lambda w: w.n_words >= {least}) AS ws FROM folded
    )
    SELECT {keys}, unnest(range(len(ws))) AS chunk_index, unnest(ws, recursive := true) FROM shaped
"""


def windows(most: int, overlap: int, least: int = 0, base: str = "documents", keys: str = "doc_id", border: str = r"E'\n'") -> str:
    # The first item that is carried over: the last one from which the words to the end reach the overlap.
    start = f"coalesce(list_max(list_filter(range(1, len(s.cur) + 1), lambda i: list_sum(list_transform(list_slice(s.cur, i, len(s.cur)), lambda y: y.n)) >= {overlap})), 1)"
    return WINDOWS.format(words=words("p"), most=most, start=start, least=least, base=base, keys=keys, border=border)


PROFILED = f"""
    SELECT doc_id, score, source AS title, lang, source, text, label,
           CASE WHEN place < n THEN 0.18 * (n - place) / n ELSE 0 END AS ai_bonus
    FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) - 1 AS place, least(count(*) OVER (), {max(2 * K, 8)}) AS n FROM ({scored(1)}))
"""
IMAGES = f"SELECT vec_id AS image_id, label::BIGINT AS related_chunk_id, 'img/' || vec_id AS image_path, label::BIGINT AS document_id, score FROM ({scored(1, 'SELECT * FROM embeddings')})"
TOP_CHUNKS = f"""
    SELECT doc_id AS chunk_id, doc_id AS document_id, ['img/' || doc_id, 'img/' || label] AS image_refs, score,
           row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({scored(1)}) QUALIFY rank <= 4
"""
FALLBACK = f"""
    SELECT 'ref::' || path AS image_id, document_id, chunk_id AS related_chunk_id, path AS image_path, greatest(score - 0.01 * place, 0) AS score FROM (
        SELECT *, row_number() OVER (PARTITION BY path ORDER BY rank, place) AS n FROM (
            SELECT *, unnest(image_refs) AS path, unnest(range(len(image_refs))) AS place FROM ({TOP_CHUNKS}))) WHERE n = 1
"""
BLOCKS = r"""
    SELECT doc_id, source, lang, order_index, text,
           CASE WHEN n <= 3 THEN 'heading' WHEN regexp_matches(text, '^[AS]') THEN 'step' WHEN regexp_matches(text, '^E') THEN 'figure' ELSE 'paragraph' END AS block_type
    FROM (SELECT *, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n FROM (
        SELECT doc_id, source, lang, unnest(range(len(parts))) AS order_index, unnest(parts) AS text
        FROM (SELECT doc_id, source, lang, string_split(text, E'\n') AS parts FROM documents)))
"""
ARCHETYPES = f"""
        SELECT doc_id, CASE WHEN pictures AND (regulatory OR procedural OR technical) THEN 'mixed_multimodal' WHEN procedural THEN 'procedural' WHEN regulatory THEN 'regulatory'
               WHEN technical THEN 'technical' WHEN reference THEN 'reference' ELSE 'knowledge' END AS archetype FROM (
            SELECT doc_id, bool_or(block_type = 'figure') AS pictures,
                   bool_or(regexp_matches(lower(text), 'policy|standard|governance|compliance|control|shall|must')) AS regulatory,
                   bool_or(regexp_matches(lower(text), 'procedure|step|runbook|rollback|prerequisite|verify')) OR count(*) FILTER (block_type = 'step') >= 2 AS procedural,
                   bool_or(regexp_matches(lower(text), 'architecture|design|component|interface|topology|diagram')) AS technical,
                   bool_or(regexp_matches(lower(text), 'faq|reference|parameter|command|field')) AS reference FROM ({BLOCKS}) GROUP BY doc_id)
"""


def groups(archetypes: str, path: str = "''") -> str:
    """Groups of blocks as a left fold over each document, with one struct type for state and items."""
    return f"""
    WITH told AS (
        SELECT *, {path} AS path, CASE WHEN block_type = 'step' THEN 'step' WHEN archetype IN ('regulatory', 'knowledge', 'technical', 'reference', 'mixed_multimodal') AND block_type IN ('paragraph', 'figure') THEN 'prose'
                       WHEN block_type = 'figure' THEN 'next' ELSE 'alone' END AS mode
        FROM ({BLOCKS}) JOIN ({archetypes}) USING (doc_id)
    ),
    listed AS (
        SELECT doc_id, list({{'out': []::BIGINT[], 'g': -1::BIGINT, 'kind': block_type, 'path': path, 'mode': mode, 'pending': false}} ORDER BY order_index) AS xs FROM told GROUP BY doc_id
    ),
    folded AS (
        SELECT doc_id, list_reduce(list_prepend({{'out': []::BIGINT[], 'g': -1::BIGINT, 'kind': '', 'path': '', 'mode': 'none', 'pending': false}}, xs), lambda s, b:
            CASE WHEN b.kind = 'heading' THEN
                {{'out': list_append(s.out, s.g + (NOT s.pending)::BIGINT), 'g': s.g + (NOT s.pending)::BIGINT, 'kind': '', 'path': '', 'mode': 'none', 'pending': true}}
            WHEN s.pending THEN {{'out': list_append(s.out, s.g), 'g': s.g, 'kind': b.kind, 'path': b.path, 'mode': b.mode, 'pending': false}}
            WHEN s.path = b.path AND ((s.mode = 'step' AND b.kind IN ('paragraph', 'figure')) OR (s.mode = 'prose' AND b.kind <> 'step') OR s.mode = 'next') THEN
                {{'out': list_append(s.out, s.g), 'g': s.g, 'kind': s.kind, 'path': s.path, 'mode': CASE WHEN s.mode = 'next' THEN 'alone' ELSE s.mode END, 'pending': false}}
            ELSE {{'out': list_append(s.out, s.g + 1), 'g': s.g + 1, 'kind': b.kind, 'path': b.path, 'mode': b.mode, 'pending': false}} END).out AS gs
        FROM listed
    )
    SELECT doc_id, unnest(range(len(gs))) AS order_index, unnest(gs) AS "group" FROM folded
    """


GROUPS = groups(ARCHETYPES)
GROUPED = f"""
    SELECT doc_id, "group", any_value(archetype) AS archetype, any_value(source) AS source, any_value(lang) AS lang, list(doc_id || '-block-' || order_index ORDER BY order_index) AS ids,
           list(block_type ORDER BY order_index) AS kinds, {normalized("coalesce(string_agg(trim(text, ' '), E'\\n\\n' ORDER BY order_index) FILTER (trim(text, ' ') <> ''), '')")} AS text, list(order_index ORDER BY order_index) AS ns
    FROM ({BLOCKS}) JOIN ({ARCHETYPES}) USING (doc_id) JOIN ({GROUPS}) USING (doc_id, order_index) GROUP BY doc_id, "group"
"""
CHUNK_ROWS = f"""
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "group", w) - 1 AS chunk_index, lang AS title,
           CASE WHEN list_contains(kinds, 'figure') THEN CASE WHEN len(list_distinct(kinds)) > 1 THEN 'figure_explainer_chunk' ELSE 'image_caption_chunk' END
                WHEN archetype = 'procedural' AND list_contains(kinds, 'step') THEN 'procedure_chunk' WHEN archetype = 'mixed_multimodal' AND list_contains(kinds, 'step') THEN 'mixed_context_chunk'
                WHEN archetype = 'regulatory' THEN 'policy_clause_chunk' WHEN archetype = 'reference' THEN 'reference_entry_chunk'
                WHEN list_contains(kinds, 'heading') THEN 'section_chunk' ELSE 'narrative_chunk' END AS chunk_type
    FROM (SELECT doc_id, "group", chunk_index AS w, content FROM ({windows(220, 40, base=f"({GROUPED})", keys='doc_id, "group"', border=r"E'\n\n'")})) JOIN ({GROUPED}) USING (doc_id, "group")
"""
#: Images that the blocks show, as in the view: three on some, the first and last of them the same.
SHOWN = f"""
    SELECT doc_id, order_index, unnest(CASE WHEN order_index % 6 = 3 THEN [0, 1] WHEN block_type = 'figure' THEN [0] ELSE [] END) AS k FROM ({BLOCKS})
"""
SHOWN_IN = f"""
    SELECT c.doc_id, c.chunk_index, c.chunk_type, c.ids, c.ns, c.lang, order_index, k, CASE WHEN k = 1 THEN 'img/logo' ELSE 'img/' || c.doc_id || '/' || order_index % 4 END AS image_path,
           CASE WHEN k = 1 THEN '' ELSE 'i' || order_index % 4 END AS image_id, CASE WHEN order_index % 2 = 0 THEN 'Figure ' || order_index ELSE 'seen' END AS caption_text
    FROM ({CHUNK_ROWS}) c JOIN ({SHOWN}) s ON s.doc_id = c.doc_id AND list_contains(c.ns, s.order_index)
"""
LANGUAGES = """coalesce(nullif(array_to_string(list_filter(list_concat(
    CASE WHEN len(list_filter(ns, lambda n: n % 5 = 2)) > 0 AND (len(list_filter(ns, lambda n: n % 5 = 3)) = 0 OR list_min(list_filter(ns, lambda n: n % 5 = 2)) < list_min(list_filter(ns, lambda n: n % 5 = 3))) THEN [lang, 'xx'] ELSE [] END,
    CASE WHEN len(list_filter(ns, lambda n: n % 5 = 3)) > 0 THEN ['yy'] ELSE [] END,
    CASE WHEN len(list_filter(ns, lambda n: n % 5 = 2)) > 0 AND len(list_filter(ns, lambda n: n % 5 = 3)) > 0 AND list_min(list_filter(ns, lambda n: n % 5 = 2)) > list_min(list_filter(ns, lambda n: n % 5 = 3)) THEN [lang, 'xx'] ELSE [] END),
    lambda x: x IS NOT NULL), ','), ''), lang)"""
#: In files with sheets all documents are tabular, so that no kind merges prose.
ARCHETYPES_FILED = "SELECT doc_id, 'tabular' AS archetype FROM documents"
GROUPS_FILED = groups(ARCHETYPES_FILED, "(order_index // 5)::VARCHAR")
ISLANDS = f"""
    SELECT doc_id, first_line, last_line, text, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS block FROM (
        SELECT doc_id, min(line_no) AS first_line, max(line_no) AS last_line, string_agg(line, E'\\n' ORDER BY line_no) AS text FROM (
            SELECT *, sum((trim(line) = '')::INT) OVER (PARTITION BY doc_id ORDER BY line_no) AS island FROM ({LINES})) WHERE trim(line) <> '' GROUP BY doc_id, island)
"""
HEADINGS = rf"""
    SELECT doc_id, line_no, line, CASE WHEN trim(line) <> '' AND regexp_full_match(rule, '=+|-+|~+|\^+|"+|`+|:+|#+|\*+|\++')
           AND length(rule) >= length(trim(line)) THEN strpos('=-~^"`:#*+', left(rule, 1)) END AS level
    FROM (SELECT *, trim(lead(line) OVER (PARTITION BY doc_id ORDER BY line_no)) AS rule FROM ({LINES}))
"""
ANSWERS = f"""
    SELECT o_orderkey, path, model, value, lower(trim(regexp_replace(value, '\\s+', ' ', 'g'))) AS norm FROM ({MODEL_LEAVES})
"""
CONSENSUS = f"""
    SELECT o_orderkey, path, norm AS consensus_norm, value AS consensus_value, votes FROM (
        SELECT o_orderkey, path, norm, count(*) AS votes, arg_min(value, model) AS value FROM ({ANSWERS}) GROUP BY ALL)
    QUALIFY row_number() OVER (PARTITION BY o_orderkey, path ORDER BY votes DESC, norm DESC) = 1
"""
WHOLE = f"""
    SELECT p.o_orderkey, p.path, m.model, a.value, a.norm, a.value IS NOT NULL AS present,
           CASE WHEN regexp_full_match(trim(a.value), '[-+]?\\d+(?:\\.\\d+)?') THEN trim(a.value)::DOUBLE END AS number,
           array_to_string(regexp_extract_all(a.value, '[-+]?\\d+(?:\\.\\d+)?'), ' ') AS toks, len({words('a.value')}) AS n_words
    FROM (SELECT DISTINCT o_orderkey, path FROM ({ANSWERS})) p JOIN (SELECT DISTINCT o_orderkey, model FROM ({ANSWERS})) m USING (o_orderkey)
    LEFT JOIN ({ANSWERS}) a ON a.o_orderkey = p.o_orderkey AND a.path = p.path AND a.model = m.model
"""
ISSUES = f"""
    SELECT o_orderkey, path, count(*) FILTER (NOT present) AS n_missing,
           CASE WHEN count(number) = count(*) FILTER (present) AND count(DISTINCT number) > 1 THEN 'numeric_mismatch'
                WHEN count(DISTINCT toks) FILTER (present) > 1 THEN 'number_token_mismatch'
                WHEN count(DISTINCT norm) > 1 AND count(DISTINCT n_words) FILTER (present) > 1 THEN 'word_count_mismatch'
                WHEN count(DISTINCT norm) > 1 THEN 'value_mismatch' END AS issue
    FROM ({WHOLE}) GROUP BY o_orderkey, path
"""

ASKED = f"SELECT doc_id AS question_id, left(text, 90) AS question, doc_id % 100 = 0 AS visual, doc_id % 200 = 150 AS uploaded FROM ({CHUNKS}) WHERE doc_id % 50 = 0"
WORDINGS = f"SELECT doc_id - doc_id % 50 AS question_id, doc_id % 50 AS variant, left(text, 90) AS variant_text, embedding FROM ({CHUNKS}) WHERE doc_id % 50 < 2"


def found_by(rows: str, key: str, k: int) -> str:
    """(question_id, key, score, variants): the k best of each wording, merged by question."""
    return f"""
        SELECT question_id, {key}, max(score) AS score, list(DISTINCT variant ORDER BY variant) AS variants, list(DISTINCT variant_text) AS matched FROM (
            SELECT q.question_id, variant, variant_text, {key}, round(list_cosine_similarity(r.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score
            FROM ({rows}) r, ({WORDINGS}) q QUALIFY row_number() OVER (PARTITION BY q.question_id, variant ORDER BY score DESC, {key}) <= {k}) GROUP BY question_id, {key}
    """


def best_share(text: str, variants: str = "list_append(matched, question)") -> str:
    return f"list_max(list_transform({variants}, lambda v: {word_share(text, 'v')}))"


STORED = f"SELECT doc_id AS chunk_id, label::BIGINT AS document_id, source || '/' || doc_id % 7 AS source_path, source, lang, text, label, CASE WHEN label > 2 THEN ['img/' || doc_id, 'img/x' || label] ELSE [] END AS refs, embedding FROM ({CHUNKS})"
PICTURES = f"""
    SELECT doc_id + 1000000 AS image_id, 'img/' || (doc_id + 3) AS image_path, doc_id % 10 AS document_id, 'scan' || doc_id % 4 AS source_path, lang AS section, left(text, 40) AS caption,
           CASE WHEN doc_id % 3 = 0 THEN doc_id END AS related_chunk_id, embedding FROM ({CHUNKS})
"""
ANSWERS_BY_QUESTION = f"""
    WITH asked AS MATERIALIZED ({ASKED}), found AS MATERIALIZED ({found_by(STORED, "chunk_id", max(4 * K, 12))}),
    seen AS MATERIALIZED (SELECT * FROM ({found_by(PICTURES, "image_id", min(2 * 4, 2 * K))}) JOIN (SELECT * EXCLUDE (embedding) FROM ({PICTURES})) USING (image_id) JOIN asked USING (question_id)),
    support AS (
        SELECT question_id, related_chunk_id AS chunk_id, max(s) AS support FROM (
            SELECT *, round(least(0.24, score * 0.16 + {word_share("caption || ' ' || section || ' ' || source_path", "question")} * 0.22), 6) AS s FROM seen WHERE related_chunk_id IS NOT NULL)
        WHERE s > 0.07 GROUP BY ALL
    ),
    both_ AS (SELECT question_id, chunk_id, coalesce(score, 0) AS score, coalesce(matched, []) AS matched, coalesce(len(variants), 1) AS n_queries, coalesce(support, 0) AS support FROM found FULL JOIN support USING (question_id, chunk_id)),
    placed AS (
        SELECT *, CASE WHEN place < n THEN 0.18 * (n - place) / n ELSE 0 END AS ai FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) - 1 AS place, least(count(*) OVER (PARTITION BY question_id), {max(2 * K, 8)}) AS n FROM both_)
    ),
    ranked AS (
        SELECT *, round(0.58 * score + 0.12 * {best_share("source || ' ' || lang || ' ' || source || ' ' || text || ' ' || source_path")} + 0.05 * {best_share("source || ' ' || lang || ' ' || source")}
                     + CASE WHEN label > 2 THEN 0.03 ELSE 0 END + least(0.04, 0.015 * (n_queries - 1))
                     + least(0.18, CASE WHEN label <= 4 OR {STEP} >= 0.18 THEN 0.08 ELSE 0 END + CASE WHEN {LIST} >= 0.18 THEN 0.06 ELSE 0 END + CASE WHEN label > 2 THEN 0.04 ELSE 0 END)
                     + {SHAPES["limit"]} + support + ai - {PENALTY}, 6) AS rank_score
        FROM placed JOIN (SELECT * EXCLUDE (embedding) FROM ({STORED})) USING (chunk_id) JOIN asked USING (question_id)
    ),
    kept AS (
        SELECT * REPLACE (most AS rank_score) FROM (
            SELECT *, max(rank_score) OVER w AS most, row_number() OVER (PARTITION BY question_id, source_path, lang, source
                ORDER BY length(text) DESC, len({words('text')}) DESC, len(refs) DESC, rank_score DESC, chunk_id) AS best
            FROM ranked WINDOW w AS (PARTITION BY question_id, source_path, lang, source)) WHERE best = 1
    ),
    top AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY rank_score DESC, chunk_id) AS rank FROM kept QUALIFY rank <= {K}),
    tiered AS (
        SELECT s.*, CASE WHEN EXISTS (SELECT 1 FROM top t WHERE t.question_id = s.question_id AND t.rank <= 4 AND (t.chunk_id = s.related_chunk_id OR list_contains(t.refs, s.image_path))) THEN 1
                         WHEN NOT visual THEN NULL
                         WHEN EXISTS (SELECT 1 FROM top t WHERE t.question_id = s.question_id AND t.rank <= 4 AND (t.document_id = s.document_id OR t.source_path = s.source_path)) THEN 2 ELSE 3 END AS tier
        FROM seen s
    ),
    chosen AS MATERIALIZED (SELECT * FROM tiered WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY question_id)),
    pictures AS (
        SELECT question_id, image_id::VARCHAR AS id, tier, round(0.76 * score + 0.16 * {best_share("caption || ' ' || section || ' ' || source_path")} + CASE WHEN visual THEN 0.08 ELSE 0 END, 6) AS score FROM chosen
        UNION ALL
        SELECT question_id, 'ref::' || path, 4, round(0.76 * greatest(rank_score - 0.01 * place, 0) + 0.16 * {best_share("source || ' ' || lang || ' ' || source || ' ' || source_path", "[question]")} + CASE WHEN visual THEN 0.08 ELSE 0 END, 6) FROM (
            SELECT *, row_number() OVER (PARTITION BY question_id, path ORDER BY rank, place) AS first FROM (SELECT * EXCLUDE (place), unnest(refs) AS path, unnest(range(len(refs))) AS place FROM top WHERE rank <= 4))
        WHERE first = 1 AND question_id NOT IN (SELECT question_id FROM chosen)
    )
    SELECT question_id, 'chunk' AS kind, rank, chunk_id::VARCHAR AS id, rank_score AS score, NULL::INT AS tier FROM top
    UNION ALL
    SELECT question_id, 'image', rank, id, score, tier FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, id) AS rank FROM pictures WHERE question_id NOT IN (SELECT question_id FROM asked WHERE uploaded)) WHERE rank <= 4
    UNION ALL
    SELECT question_id, 'image', rank, image_id::VARCHAR, score, 0 FROM (
        SELECT a.question_id, image_id, round(list_cosine_similarity(p.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY a.question_id ORDER BY score DESC, image_id) AS rank
        FROM asked a JOIN ({CHUNKS}) c ON c.doc_id = a.question_id, ({PICTURES}) p WHERE uploaded) WHERE rank <= 4
"""

ANSWER_EVENTS = r"""
    SELECT request_id, asked_at, session_id, nullif(left(text, 2000), '') AS question_text,
           nullif(left(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')), 2000), '') AS question_normalized,
           turn = 0 AS had_image, 8 AS top_k, error IS NULL AS success, coalesce(answer, 7) AS latency_ms, CASE WHEN answer > 0 THEN 'm' || answer % 3 END AS answer_model,
           top_source_path, top_section_path, coalesce(n, 0) AS retrieved_count, error AS error_message
    FROM (
        SELECT c.*, c.conv_id || ':' || c.turn AS request_id, c.conv_id::VARCHAR AS session_id, answer,
               make_timestamp((1700000000 + c.conv_id * 3600 + c.turn * 60) * 1000000) AS asked_at,
               CASE WHEN length(c.text) < 30 THEN 'the question is too short' WHEN answer IS NULL THEN 'no answer' END AS error
        FROM conversations c LEFT JOIN (SELECT conv_id, turn - 1 AS turn, max(length(text)) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1, 2) a ON a.conv_id = c.conv_id AND a.turn = c.turn
        WHERE role = 'user'
    ) LEFT JOIN (
        SELECT c.conv_id || ':' || c.turn AS request_id, count(*) AS n, arg_min(source, rank) AS top_source_path, arg_min(lang, rank) FILTER (lang IS NOT NULL) AS top_section_path
        FROM conversations c, (VALUES (1), (2), (3)) v(rank) JOIN documents d ON d.doc_id = c.conv_id * 11 + c.turn * 5 + rank * 400 WHERE role = 'user' GROUP BY 1
    ) USING (request_id)
"""
IMAGE_BLOCKS = f"""
    WITH told AS (
        SELECT doc_id, source, source || '.png' AS file, l, doc_id % 7 = 6 AS broken, list_transform(l, lambda x: {normalized('x')}) AS ll
        FROM (SELECT doc_id, source, list_filter(string_split(text, E'\\n'), lambda x: trim(x, ' ') <> '') AS l FROM documents)
    ),
    parts AS (
        SELECT doc_id, source, file, CASE WHEN broken THEN source WHEN doc_id % 4 = 1 THEN coalesce(nullif({normalized("coalesce(left(l[1], 30), '')")}, ''), source) ELSE source END AS title,
               CASE WHEN NOT broken AND doc_id % 5 > 1 THEN coalesce(ll[2], '') ELSE '' END AS summary,
               list_filter(CASE WHEN NOT broken AND doc_id % 2 = 0 THEN ll[1:10] ELSE [] END, lambda x: x <> '') AS texts,
               CASE WHEN NOT broken AND doc_id % 6 = 0 THEN 'chart' ELSE 'unknown' END AS image_type,
               CASE WHEN broken THEN [] ELSE list_transform(range(6), lambda i: {{'h': CASE WHEN (doc_id + i) % 3 > 0 THEN {normalized("coalesce(left(l[i + 1], 20), '')")} ELSE '' END,
                   'c': coalesce(ll[i + 2], ''), 'k': ['table', 'note', 'paragraph', 'code', 'quote', 'list_item'][i + 1]}}) END AS sections
        FROM told
    ),
    rooted AS (SELECT *, CASE WHEN title <> source THEN source || ' > ' || title ELSE source END AS root FROM parts),
    every AS (
        SELECT doc_id, image_type, 0 AS o, 0 AS p, 'heading' AS block_type, title AS text, 1 AS heading_level, root AS section_path, 'image_title' AS layout_hint FROM rooted WHERE title <> source
        UNION ALL SELECT doc_id, image_type, 1, 0, 'figure', CASE WHEN summary <> '' THEN summary WHEN len(texts) > 0 THEN texts[1] ELSE 'Image file: ' || file END, NULL, root, 'image_summary' FROM rooted
        UNION ALL SELECT doc_id, image_type, 2, 0, 'note', {normalized("array_to_string(texts[1:8], chr(10))")}, NULL, root || ' > Visible Text', 'visible_text' FROM rooted WHERE len(texts) > 0
        UNION ALL SELECT doc_id, image_type, 3 + i, 0, 'heading', s.h, 2, root || ' > ' || s.h, 'image_section_heading' FROM (SELECT *, unnest(sections) AS s, unnest(range(len(sections))) AS i FROM rooted) WHERE s.c <> '' AND s.h <> ''
        UNION ALL SELECT doc_id, image_type, 3 + i, 1, s.k, s.c, NULL, CASE WHEN s.h <> '' THEN root || ' > ' || s.h ELSE root END, 'image_section' FROM (SELECT *, unnest(sections) AS s, unnest(range(len(sections))) AS i FROM rooted) WHERE s.c <> ''
    )
    SELECT * EXCLUDE (o, p), row_number() OVER (PARTITION BY doc_id ORDER BY o, p) - 1 AS order_index FROM every
"""
#: Windows fold the blocks of a unit: items are blocks here, and are not cut further.
BLOCK_WINDOWS = """
    WITH items AS (
        SELECT doc_id, strategy, unit, min(order_index) AS first, list({{'out': []::STRUCT(t VARCHAR, n BIGINT, id VARCHAR)[][], 'cur': [{{'t': text, 'n': n, 'id': block_id}}], 'n': n}} ORDER BY order_index) AS xs
        FROM ({base}) GROUP BY doc_id, strategy, unit
    ),
    folded AS (
        SELECT doc_id, strategy, unit, first, list_reduce(xs, lambda s, x: CASE WHEN s.n + x.n > 220 THEN
            {{'out': list_append(s.out, s.cur), 'cur': list_concat(list_slice(s.cur, {start}, len(s.cur)), x.cur),
              'n': list_sum(list_transform(list_slice(s.cur, {start}, len(s.cur)), lambda y: y.n))::BIGINT + x.n}}
            ELSE {{'out': s.out, 'cur': list_concat(s.cur, x.cur), 'n': s.n + x.n}} END) AS s FROM items
    )
    SELECT doc_id, strategy, unit, first, unnest(list_append(s.out, s.cur)) AS w, unnest(range(len(s.out) + 1)) AS place FROM folded
"""
FILED = f"""
    SELECT *, doc_id || '-block-' || order_index AS block_id, len({words('text')}) AS n,
           CASE strategy WHEN 'pdf_section_window' THEN 'p' || order_index // 6 || '|' || order_index // 5 WHEN 'slide_window' THEN CASE WHEN doc_id % 7 = 1 THEN (order_index // 4)::VARCHAR ELSE '' END
                WHEN 'rst_section_window' THEN (order_index // 5)::VARCHAR WHEN 'xlsx_sheet_window' THEN (order_index % 2)::VARCHAR ELSE "group"::VARCHAR END AS unit
    FROM (
        SELECT *, CASE WHEN doc_id % 3 = 1 AND doc_id % 5 <> 2 THEN ['slide_window', 'generic_blocks', '', 'pdf_section_window', 'xlsx_sheet_window'][doc_id % 5 + 1]
                       ELSE ['pdf_section_window', 'slide_window', 'rst_section_window', 'xlsx_sheet_window', 'generic_blocks', 'xlsx_sheet_window', 'slide_window'][doc_id % 7 + 1] END AS strategy
        FROM ({BLOCKS}))
    JOIN ({ARCHETYPES_FILED}) USING (doc_id) JOIN ({GROUPS_FILED}) USING (doc_id, order_index) WHERE trim(text, ' ') <> ''
"""
STRATEGY_CHUNKS = f"""
    WITH filed AS MATERIALIZED ({FILED}),
    kinds AS (SELECT doc_id, strategy, unit, list(DISTINCT block_type) AS kinds, any_value(archetype) AS archetype FROM filed GROUP BY ALL),
    windows AS ({BLOCK_WINDOWS.format(base="filed", start="coalesce(list_max(list_filter(range(1, len(s.cur) + 1), lambda i: list_sum(list_transform(list_slice(s.cur, i, len(s.cur)), lambda y: y.n)) >= 40)), 1)")})
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first, place) - 1 AS chunk_index, strategy,
           CASE strategy WHEN 'slide_window' THEN 'slide_chunk' WHEN 'xlsx_sheet_window' THEN 'row_chunk'
                WHEN 'pdf_section_window' THEN CASE WHEN list_contains(kinds, 'figure') THEN CASE WHEN len(kinds) > 1 THEN 'figure_explainer_chunk' ELSE 'image_caption_chunk' END
                    WHEN archetype = 'procedural' AND list_contains(kinds, 'step') THEN 'procedure_chunk' WHEN archetype = 'regulatory' THEN 'policy_clause_chunk' ELSE 'section_chunk' END
                WHEN 'rst_section_window' THEN CASE WHEN archetype = 'procedural' AND list_contains(kinds, 'step') THEN 'procedure_chunk' WHEN archetype = 'regulatory' THEN 'policy_clause_chunk'
                    WHEN archetype = 'reference' THEN 'reference_entry_chunk' ELSE 'section_chunk' END
                ELSE CASE WHEN doc_id % 7 = 1 THEN 'slide_chunk' WHEN list_contains(kinds, 'figure') THEN CASE WHEN len(kinds) > 1 THEN 'figure_explainer_chunk' ELSE 'image_caption_chunk' END
                    WHEN archetype = 'procedural' AND list_contains(kinds, 'step') THEN 'procedure_chunk' WHEN archetype = 'mixed_multimodal' AND list_contains(kinds, 'step') THEN 'mixed_context_chunk'
                    WHEN archetype = 'regulatory' THEN 'policy_clause_chunk' WHEN archetype = 'reference' THEN 'reference_entry_chunk'
                    WHEN list_contains(kinds, 'heading') THEN 'section_chunk' ELSE 'narrative_chunk' END END AS chunk_type,
           array_to_string(list_transform(w, lambda x: x.id), ',') AS block_ids, array_to_string(list_transform(w, lambda x: x.t), E'\\n\\n') AS content
    FROM windows JOIN kinds USING (doc_id, strategy, unit)
"""
ASKED_MODELS = """
    SELECT o_orderkey, unnest(['a', 'b', 'c', 'd']) AS model, unnest([o_orderkey % 7 <> 0, o_orderkey % 3 <> 0, o_orderkey % 2 <> 0, o_orderkey % 5 <> 0]) AS parsed FROM orders
"""
GATED = f"""
    WITH asked AS MATERIALIZED ({ASKED_MODELS}), gate AS (SELECT o_orderkey, count(*) FILTER (parsed) >= 2 AS available FROM asked GROUP BY 1),
    answers AS MATERIALIZED (SELECT a.* FROM ({ANSWERS}) a JOIN asked m ON m.o_orderkey = a.o_orderkey AND m.model = a.model AND m.parsed JOIN gate g ON g.o_orderkey = a.o_orderkey AND available),
    told AS (
        SELECT *, CASE WHEN regexp_full_match(trim(value), '[-+]?\\d+(?:\\.\\d+)?') THEN trim(value)::DOUBLE END AS number,
               array_to_string(regexp_extract_all(value, '[-+]?\\d+(?:\\.\\d+)?'), ' ') AS toks, len({words('value')}) AS n_words FROM answers
    ),
    issues AS (
        SELECT o_orderkey, path, 4 - count(*) AS n_missing,
               CASE WHEN count(number) = count(*) AND count(DISTINCT number) > 1 THEN 'numeric_mismatch' WHEN count(DISTINCT toks) > 1 THEN 'number_token_mismatch'
                    WHEN count(DISTINCT norm) > 1 AND count(DISTINCT n_words) > 1 THEN 'word_count_mismatch' WHEN count(DISTINCT norm) > 1 THEN 'value_mismatch' END AS issue
        FROM told GROUP BY 1, 2
    )
    SELECT o_orderkey, available, path, n_missing, issue FROM gate LEFT JOIN issues USING (o_orderkey) WHERE issue IS NOT NULL OR n_missing > 1 OR NOT available
"""

def cleaned(question: bool, asked: str = "NULL") -> str:
    fold = lambda x: f"replace(lower({x}), 'ß', 'ss')"
    bare = r"""regexp_replace(regexp_replace(regexp_replace(x, '^\s*(?:[-*]|\d+[.)])\s*', ''), '^\s+|\s+$', '', 'g'), '^["'' ]+|["'' ]+$', '', 'g')"""
    mark = "CASE WHEN ends_with(y, '?') THEN y ELSE y || '?' END" if question else "y"
    return rf"""
        SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_position(list_transform(l, lambda z: {fold("z")}), {fold("x")}) = i)[1:3], E'\n') AS found FROM (
            SELECT *, list_filter(list_transform(list_filter(list_transform(regexp_split_to_array(text, '\r\n|\r|\n'), lambda x: {bare}), lambda x: x <> ''), lambda y: {mark}),
                                  lambda x: {asked} IS NULL OR {fold("x")} <> {fold(asked)}) AS l FROM conversations)
    """


def in_windows(base: str, keys: str) -> str:
    """Windows of 220 words over the blocks (keys, order_index, block_id, text, n) of each unit."""
    start = "coalesce(list_max(list_filter(range(1, len(s.cur) + 1), lambda i: list_sum(list_transform(list_slice(s.cur, i, len(s.cur)), lambda y: y.n)) >= 40)), 1)"
    return BLOCK_WINDOWS.replace("doc_id, strategy, unit", keys).format(base=base, start=start)


SHEET_ROWS = """
    SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS row_no, count(*) OVER (PARTITION BY o_custkey) AS n_rows,
           first(o_orderpriority) OVER w AS h1, first(o_orderkey) OVER w AS h2, first(o_orderstatus) OVER w AS h3,
           h1 || ': ' || o_orderpriority || ' | ' || h2 || ': ' || o_orderkey || ' | ' || h3 || ': ' || o_orderstatus AS shown
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)
"""
SHEET_CHUNKS = f"""
    WITH r AS MATERIALIZED ({SHEET_ROWS}),
    heads AS (
        SELECT doc_id, -1 AS place, 'table_chunk' AS chunk_type, 'Headers: ' || any_value(h1) || ', ' || any_value(h2) || ', ' || any_value(h3)
               || coalesce(E'\\n\\nSample rows:\\n' || string_agg(shown, E'\\n' ORDER BY row_no) FILTER (row_no BETWEEN 2 AND 6), '') AS content, NULL::BIGINT AS row_start FROM r GROUP BY doc_id
    ),
    data AS (SELECT doc_id, 'orders' AS sheet_name, row_no AS order_index, row_no::VARCHAR AS block_id, shown AS text, len({words('shown')}) AS n FROM r WHERE row_no > 1 OR n_rows = 1),
    body AS (SELECT doc_id, place, 'row_chunk', array_to_string(list_transform(w, lambda x: x.t), E'\\n'), list_min(list_transform(w, lambda x: x.id::BIGINT)) FROM ({in_windows("data", "doc_id, sheet_name")}))
    SELECT doc_id, 'orders' AS sheet_name, 0 AS region, place AS "window", chunk_type, content, row_start, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS chunk_index
    FROM (SELECT * FROM heads UNION ALL SELECT * FROM body)
"""
PAGE_CHUNKS = f"""
    WITH b AS MATERIALIZED (SELECT *, order_index // 100 AS page_number, doc_id || '-block-' || order_index AS block_id, len({words('text')}) AS n FROM ({BLOCKS})),
    whole AS (
        SELECT doc_id, page_number, order_index, block_id, block_type, text, n FROM b WHERE block_type <> 'heading'
        UNION ALL SELECT h.doc_id, p.page_number, h.order_index, h.block_id, h.block_type, h.text, h.n FROM b h JOIN (SELECT DISTINCT doc_id, page_number FROM b) p USING (doc_id) WHERE h.block_type = 'heading'
    ),
    w AS ({in_windows("whole", "doc_id, page_number")}),
    kinds AS (SELECT doc_id, page_number, place, list(DISTINCT block_type) AS kinds FROM (SELECT *, unnest(list_transform(w, lambda x: x.id)) AS block_id FROM w) JOIN (SELECT DISTINCT doc_id, block_id, block_type FROM b) USING (doc_id, block_id) GROUP BY ALL)
    SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, place) - 1 AS chunk_index, len(w) AS n_blocks, array_to_string(list_transform(w, lambda x: x.t), E'\\n\\n') AS content,
           CASE WHEN list_contains(kinds, 'figure') THEN CASE WHEN len(kinds) > 1 THEN 'figure_explainer_chunk' ELSE 'image_caption_chunk' END
                WHEN archetype = 'procedural' AND list_contains(kinds, 'step') THEN 'procedure_chunk' WHEN archetype = 'regulatory' THEN 'policy_clause_chunk' ELSE 'section_chunk' END AS chunk_type
    FROM w JOIN kinds USING (doc_id, page_number, place) JOIN ({ARCHETYPES}) USING (doc_id)
"""
MARKUP_CHUNKS = f"""
    WITH h AS MATERIALIZED ({HEADINGS}), placed AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading_line FROM h),
    body AS MATERIALIZED (SELECT doc_id, heading_line, line_no, line FROM placed WHERE level IS NULL AND line_no > heading_line + 1),
    cut AS (SELECT *, sum((trim(line, ' ') = '')::INT) OVER (PARTITION BY doc_id, heading_line ORDER BY line_no) AS island FROM body),
    units AS (SELECT doc_id, heading_line, min(line_no) AS order_index, min(line_no)::VARCHAR AS block_id, string_agg(trim(line, ' '), E'\\n' ORDER BY line_no) AS text FROM cut WHERE trim(line, ' ') <> '' GROUP BY doc_id, heading_line, island),
    counted AS (SELECT *, len({words('text')}) AS n FROM units),
    heads AS MATERIALIZED (SELECT doc_id, line_no AS at, level, trim(line, ' ') AS title FROM h WHERE level IS NOT NULL)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY heading_line, place) - 1 AS chunk_index, path, array_to_string(list_transform(w, lambda x: x.t), E'\\n\\n') AS content,
           CASE archetype WHEN 'regulatory' THEN 'policy_clause_chunk' WHEN 'reference' THEN 'reference_entry_chunk' ELSE 'section_chunk' END AS chunk_type
    FROM ({in_windows("counted", "doc_id, heading_line")}) JOIN ({paths("heads", "(SELECT DISTINCT doc_id, heading_line FROM body)", "doc_id", "heading_line")}) USING (doc_id, heading_line) JOIN ({ARCHETYPES}) USING (doc_id)
"""

LISTED = r"list_filter(regexp_extract_all(text, '{0}', 1), lambda x, i: NOT {1} OR list_position(regexp_extract_all(text, '{0}', 1), x) = i)"
ARTIFACTS = {
    "anchors": LISTED.format(r"(?m)^\s*\.\. _([^:]+):\s*$", "false"), "images": LISTED.format(r"(?m)^\s*\.\. (?:image|figure)::\s*(\S+)", "false"),
    "labels": LISTED.format(r"(?m)^\s*:label:\s*(\S+)", "false"), "directives": LISTED.format(r"(?m)^\s*\.\. ([a-z-]+)::", "true"),
}


def said(label: str, value: str, nothing: str = "none") -> str:
    return f"'{label}: ' || coalesce(nullif(({value})::VARCHAR, ''), '{nothing}') || chr(10)"


TEXT_HEAD = " || ".join([said("Document title", "source"), said("Archetype", "'knowledge'"), said("Section path", "source || ' > ' || coalesce(lang, '-')"), said("Content type", "'section_chunk'")])
CONTENT = "chr(10) || 'Content:' || chr(10) || text"
FORMAT_TEXTS = f"""
    SELECT doc_id,
           sha256({TEXT_HEAD} || {said("Page number", "doc_id % 9")} || {said("Layout hints", "CASE WHEN doc_id % 2 = 0 THEN 'heading, paragraph' END")} || {CONTENT}) AS paged,
           sha256({TEXT_HEAD} || {said("Slide number", "doc_id % 5 + 1")} || {said("Layout hints", "'heading, paragraph'")} || {CONTENT}) AS slide,
           sha256({TEXT_HEAD} || {said("RST anchors", f"array_to_string({ARTIFACTS['anchors']}, ', ')")} || {said("RST images", f"array_to_string({ARTIFACTS['images']}, ', ')")}
                  || {said("RST equation labels", f"array_to_string({ARTIFACTS['labels']}, ', ')")} || {said("RST directives", f"array_to_string({ARTIFACTS['directives']}, ', ')")}
                  || {said("Inline math count", "len(regexp_extract_all(text, ':math:`[^`]+`'))")} || {said("Location", "'lines ' || doc_id || '-' || (doc_id + 7)")} || {CONTENT}) AS markup,
           sha256({TEXT_HEAD} || {said("Sheet name", "'s'")} || {said("Region type", "'table'")} || {said("Headers", "CASE WHEN doc_id % 3 > 0 THEN 'heading, paragraph' END")}
                  || {said("Row range", "CASE WHEN doc_id % 2 > 0 THEN '1-5' ELSE 'n/a' END")} || {CONTENT}) AS sheet,
           sha256({said("Titre", "source")} || {said("Document", "'D-1'")} || {said("Section", "source || ' > ' || coalesce(lang, '-')")} || {said("Ancres", f"array_to_string({ARTIFACTS['anchors']}, ', ')", "aucune")}
                  || {said("Images", "CASE WHEN doc_id % 2 = 0 THEN 'heading, paragraph' END", "aucune")} || chr(10) || text) AS french,
           sha256({said("عنوان الوثيقة", "source", "")} || {said("القسم", "'الفصل الأول'", "")} || {said("المادة", "CASE WHEN doc_id % 2 = 0 THEN 'المادة 3' END", "")} || {said("الصفحة", "doc_id % 4", "")} || chr(10) || text) AS arabic
    FROM ({MARKUP}) JOIN (SELECT doc_id, source, lang FROM documents) USING (doc_id)
"""

PARTS = """
    SELECT *, p_size * 10 AS w, floor(p_retailprice)::INT AS h, 'img/' || p_partkey || CASE p_size % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.JPG' ELSE '.txt' END AS image_path,
           CASE WHEN w < 120 OR h < 48 OR w * h < 12000 THEN 'too_small' WHEN count(*) OVER (PARTITION BY p_brand, p_type) >= 5 AND w * h <= 90000 THEN 'repeated_small_asset' END AS drop_reason
    FROM part
"""
CHAPTERS = f"""
    SELECT doc_id, line_no, CASE WHEN line_no % 15 = 2 THEN 'الفصل ' || line_no WHEN line_no % 6 = 4 THEN 'المادة (' || line_no || ')' WHEN line_no % 17 = 5 THEN 'المادة 3. نص' ELSE trim(line, ' ') END AS own,
           line_no % 15 = 2 AS is_chapter, line_no % 15 <> 2 AND line_no % 6 = 4 AS is_article FROM ({LINES}) WHERE line_no % 40 <> 7
"""
#: Windows that carry back lines: items are blocks of one or more lines.
LINE_WINDOWS = f"""
    WITH items AS (
        SELECT doc_id, list_transform(list_filter(string_split(text, '. '), lambda x: x <> ''), lambda b: {{'out': []::VARCHAR[], 'cur': string_split(b, chr(10)), 'n': len({words('b')})}}) AS xs FROM documents
    ),
    folded AS (
        SELECT doc_id, list_reduce(xs, lambda s, x: CASE WHEN s.n + x.n > 40 THEN
            {{'out': list_append(s.out, array_to_string(s.cur, chr(10))),
              'cur': list_concat(list_concat({{kept}}, ['']), x.cur), 'n': {{n}} + x.n}}
            ELSE {{'out': s.out, 'cur': list_concat(list_concat(s.cur, ['']), x.cur), 'n': s.n + x.n}} END) AS s FROM items WHERE len(xs) > 0
    )
    SELECT doc_id, unnest(range(len(s.out) + 1)) AS place, unnest(list_append(s.out, array_to_string(s.cur, chr(10)))) AS content FROM folded
"""
_kept = f"list_slice(s.cur, coalesce(list_max(list_filter(range(1, len(s.cur) + 1), lambda i: len({words('array_to_string(list_slice(s.cur, i, len(s.cur)), chr(10))')}) >= 8)), 1), len(s.cur))"
LINE_WINDOWS = LINE_WINDOWS.replace("{kept}", _kept).replace("{n}", f"len({words(f'array_to_string({_kept}, chr(10))')})")

ORACLE: dict[str, str] = {
    "image_search_filtered": """
        SELECT query_id, image_id, document_id, file_type, score, rank FROM (
            SELECT q.vec_id AS query_id, i.image_id, i.document_id, o.lang AS file_type, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
                   row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, i.image_id) AS rank
            FROM (SELECT doc_id AS image_id, doc_id * 7 % 1000 AS document_id FROM documents) i JOIN documents o ON o.doc_id = i.document_id AND o.lang IN ('de', 'fr') JOIN embeddings v ON v.vec_id = i.image_id, embeddings q
            WHERE q.vec_id % 50 = 0) WHERE rank <= 8
    """,
    "table_search": f"""
        SELECT query_id, rank, doc_id, score, sha256(left(text, 4000)) AS shown FROM (
            SELECT q.vec_id AS query_id, c.doc_id, c.text, round(list_cosine_similarity(c.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, c.doc_id) AS rank
            FROM ({CHUNKS}) c, embeddings q WHERE q.vec_id % 50 = 0) WHERE rank <= 12
    """,
    "prompts_by_question": f"""
        WITH w AS MATERIALIZED (SELECT * FROM ({WORDINGS}) WHERE variant = 0),
        s AS (
            SELECT question_id, string_agg('[S' || rank || '] ' || source || ' | ' || concat_ws(' > ', lang, source) || ' | ' || source_path || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS t FROM (
                SELECT w.question_id, c.*, row_number() OVER (PARTITION BY w.question_id ORDER BY round(list_cosine_similarity(c.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) DESC, chunk_id) AS rank FROM ({STORED}) c, w) WHERE rank <= 3 GROUP BY 1
        ),
        i AS (
            SELECT question_id, string_agg('[I' || rank || '] ' || source_path || ' | ' || coalesce(section, '') || ' | ' || image_path || chr(10) || caption, chr(10) || chr(10) ORDER BY rank) AS t FROM (
                SELECT w.question_id, p.*, row_number() OVER (PARTITION BY w.question_id ORDER BY round(list_cosine_similarity(p.embedding::DOUBLE[], w.embedding::DOUBLE[]), 6) DESC, image_id) AS rank
                FROM ({PICTURES}) p, w WHERE w.question_id % 100 = 0) WHERE rank <= 2 GROUP BY 1
        )
        SELECT question_id, 'User question:' || chr(10) || question || chr(10) || chr(10) || 'Retrieved context:' || chr(10) || s.t || chr(10) || chr(10) || 'Relevant images:' || chr(10) || coalesce(i.t, 'None') AS prompt
        FROM ({ASKED}) JOIN s USING (question_id) LEFT JOIN i USING (question_id)
    """,
    "doc_upsert_times": """
        WITH new AS (SELECT doc_id * 2 AS doc_id FROM labels)
        SELECT doc_id, lang, make_timestamp(doc_id * 1000000) AS created_at, make_timestamp(doc_id * 1000000) AS updated_at FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM new)
        UNION ALL SELECT n.doc_id, 'xx', make_timestamp(coalesce(d.doc_id, 5000) * 1000000), make_timestamp(1000000::BIGINT * 1000000) FROM new n LEFT JOIN documents d ON d.doc_id = n.doc_id
    """,
    "file_digests": "SELECT doc_id, sha1(coalesce(text, '')) AS digest, sha256(coalesce(text, '')) AS checksum FROM documents",
    "counts_of_any": "SELECT 'documents' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 'no_such_table', 0 UNION ALL SELECT 'labels', count(*) FROM labels",
    "unique_images": "SELECT p_brand, p_type AS digest, min(p_partkey) AS p_partkey FROM part GROUP BY 1, 2",
    "image_captions": f"""
        SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN p_name WHEN n <= 4 THEN 'seen ' || image_path WHEN p_size % 5 > 0 THEN 'Image from ' || p_type ELSE 'Document image' END AS caption_text
        FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM ({PARTS}))
    """,
    "existing_images": f"SELECT p_partkey, image_path FROM ({PARTS}) WHERE p_partkey % 2 = 0 AND p_size % 3 < 2",
    "drop_counts": f"SELECT p_brand, drop_reason, count(*) AS n_images FROM ({PARTS}) WHERE drop_reason IS NOT NULL GROUP BY 1, 2",
    "pruned_blocks": f"""
        SELECT p_partkey, block_type, array_to_string(ids, ',') AS image_ids FROM (
            SELECT *, CASE WHEN p_partkey % 10 = 0 THEN 'heading' ELSE 'figure' END AS block_type,
                   list_concat(CASE WHEN drop_reason IS NULL THEN [p_partkey::VARCHAR] ELSE [] END, CASE WHEN p_partkey % 3 = 0 THEN [] ELSE ['other'] END) AS ids FROM ({PARTS}))
        WHERE block_type = 'heading' OR p_partkey % 4 = 0 OR len(ids) > 0
    """,
    "linked_images": f"""
        WITH shown AS MATERIALIZED ({SHOWN_IN})
        SELECT doc_id, 'img/' || doc_id || '/' || k AS image_path, (SELECT arg_min(sha256(s.doc_id || '|' || s.chunk_index), s.chunk_index) FROM shown s WHERE s.doc_id = d.doc_id AND s.image_path = 'img/' || d.doc_id || '/' || t.k) AS related_chunk_id
        FROM documents d, range(4) t(k)
    """,
    "pages_to_render": f"""
        SELECT doc_id, page_number FROM ({PAGES}) WHERE length(text) % 2 = 0 AND (length(text) % 50 >= 25 OR contains(text, 'Note 7')) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY page_number) <= 3
    """,
    "chapter_lines": f"""
        WITH t AS (
            SELECT *, max(CASE WHEN is_chapter THEN line_no END) OVER w AS c, max(CASE WHEN is_article THEN line_no END) OVER w AS a FROM ({CHAPTERS}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
        )
        SELECT doc_id, line_no, 'الفصل ' || c AS chapter, CASE WHEN a > coalesce(c, -1) THEN 'المادة (' || a || ')' END AS article FROM t WHERE NOT is_chapter AND NOT is_article AND (c IS NOT NULL OR a IS NOT NULL)
    """,
    "page_lines": f"SELECT doc_id, line_no FROM ({LINES}) WHERE line_no % 5 > 2 AND trim(line, ' ') NOT IN ('', 'Header') AND NOT regexp_full_match(trim(line, ' '), '[0-9٠-٩]+')",
    "slide_chunks": f"""
        WITH b AS MATERIALIZED (SELECT *, order_index // 8 AS slide_number, doc_id || '-block-' || order_index AS block_id, len({words('text')}) AS n FROM ({BLOCKS})),
        w AS ({in_windows("b", "doc_id, slide_number").replace("> 220", "> 60").replace(">= 40", ">= 12")})
        SELECT doc_id, slide_number, row_number() OVER (PARTITION BY doc_id ORDER BY slide_number, place) - 1 AS chunk_index, 'slide_chunk' AS chunk_type,
               (SELECT string_agg(DISTINCT block_type, ',' ORDER BY block_type) FROM b WHERE b.doc_id = w.doc_id AND list_contains(list_transform(w.w, lambda x: x.id), b.block_id)) AS block_types,
               array_to_string(list_transform(w, lambda x: x.t), E'\\n\\n') AS content FROM w
    """,
    "line_windows": LINE_WINDOWS,
    "section_places": f"""
        SELECT doc_id, page_number, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY first) - 1 AS place, source || ' > part ' || part AS path, ids AS block_ids FROM (
            SELECT doc_id, source, order_index // 6 + 1 AS page_number, order_index // 5 AS part, min(order_index) AS first, string_agg(doc_id || '-block-' || order_index, ',' ORDER BY order_index) AS ids FROM ({BLOCKS}) GROUP BY 1, 2, 3, 4)
    """,
    "paired_rows": "SELECT doc_id, lang, label FROM documents JOIN embeddings ON vec_id = doc_id",
    "run_statuses": """
        SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' ELSE 'failed' END AS status,
               round(CASE event_id % 4 WHEN 2 THEN round(0.45 * value + 0.55 * value, 2) ELSE value END, 2) AS overall FROM events
    """,
    "format_texts": FORMAT_TEXTS,
    "cleaned_lists": f"SELECT conv_id, turn, found AS questions FROM ({cleaned(True)})",
    "rewrites": f"SELECT conv_id, turn, found AS rewrites FROM ({cleaned(False, lines('text') + '[1]')})",
    "closed_labels": r"""
        SELECT conv_id, turn, array_to_string(list_filter(l, lambda x, i: list_contains(['the', 'of', 'de la', 'und', 'que', 'in'], x) AND list_position(l, x) = i), ',') AS labels
        FROM (SELECT *, list_transform(regexp_split_to_array(lower(text), '[,\n]'), lambda x: trim(x, ' ')) AS l FROM conversations)
    """,
    "query_profiles": """
        SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE '' END AS intents, CASE WHEN source IN ('src1', 'src2') THEN source || ',src3' ELSE 'src3' END AS evidence,
               CASE WHEN doc_id % 2 = 0 THEN 'rule' END AS shape,
               sha256(array_to_string(list_filter([lower(text), upper(lang), source, 'x'], lambda x: x IS NOT NULL)[1:3], '|')) AS rewrites FROM documents
    """,
    "location_hints": f"""
        SELECT doc_id, order_index, CASE WHEN order_index % 4 = 1 THEN 'page ' || (order_index // 20 + 1) WHEN order_index % 3 = 0 THEN 'line ' || order_index ELSE source END AS place FROM ({BLOCKS})
    """,
    "evidence_counts": f"""
        SELECT document_id, greatest(coalesce(any_value(n), 0), count(DISTINCT ref)) AS images
        FROM (SELECT document_id, unnest(CASE WHEN len(refs) > 0 THEN refs ELSE [NULL] END) AS ref FROM ({STORED})) LEFT JOIN (SELECT document_id, count(*) AS n FROM ({PICTURES}) GROUP BY 1) USING (document_id) GROUP BY 1
    """,
    "parse_stats": rf"""
        WITH l AS (SELECT doc_id, unnest(range(len(p))) AS n, unnest(p) AS line FROM (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS p FROM ({MARKUP}))),
        b AS (SELECT *, sum((trim(line, ' ') = '')::INT) OVER (PARTITION BY doc_id ORDER BY n) AS block FROM l)
        SELECT count(DISTINCT doc_id) AS documents, count(DISTINCT (doc_id, block)) AS blocks, sum(len(regexp_extract_all(line, ':math:`[^`]+`')))::BIGINT AS math_inline,
               count(*) FILTER (regexp_matches(line, '^[ \t]*\.\. math::[ \t]*$')) AS math_block, count(*) FILTER (regexp_matches(line, '^\s*\.\. (?:image|figure)::\s*\S')) AS images FROM b WHERE trim(line, ' ') <> ''
    """,
    "block_artifacts": rf"""
        SELECT doc_id, array_to_string(regexp_extract_all(text, '(?m)^\s*\.\. _([^:]+):\s*$', 1), ',') AS anchors, array_to_string(regexp_extract_all(text, '(?m)^\s*\.\. (?:image|figure)::\s*(\S+)', 1), ',') AS image_refs,
               array_to_string(list_filter(regexp_extract_all(text, '(?m)^\s*\.\. ([a-z-]+)::', 1), lambda x, i: list_position(regexp_extract_all(text, '(?m)^\s*\.\. ([a-z-]+)::', 1), x) = i), ',') AS directives,
               array_to_string(regexp_extract_all(text, '(?m)^\s*:label:\s*(\S+)', 1), ',') AS equation_labels, len(regexp_extract_all(text, ':math:`[^`]+`'))::BIGINT AS inline_math FROM ({MARKUP})
    """,
    "json_leaves": """
        SELECT doc_id, 'doc_id' AS path, doc_id::VARCHAR AS value FROM documents UNION ALL SELECT doc_id, 'inner.lang', lang FROM documents WHERE lang IS NOT NULL
        UNION ALL SELECT doc_id, 'inner.list[0]', coalesce(source, '') FROM documents UNION ALL SELECT doc_id, 'inner.list[1]', coalesce(lang, '') FROM documents
    """,
    "sheet_chunks": SHEET_CHUNKS,
    "page_chunks": PAGE_CHUNKS,
    "markup_chunks": MARKUP_CHUNKS,
    "answer_events": ANSWER_EVENTS,
    "analytics_export_rows": f"""
        SELECT strftime(asked_at, '%Y-%m-%dT%H:%M:%S') AS asked_at, session_id, coalesce(question_text, '') AS question_text, coalesce(question_normalized, '') AS question_normalized,
               CASE WHEN had_image THEN 'yes' ELSE 'no' END AS had_image, top_k::VARCHAR AS top_k, CASE WHEN success THEN 'yes' ELSE 'no' END AS success, latency_ms::VARCHAR AS latency_ms,
               coalesce(answer_model, '') AS answer_model, coalesce(top_source_path, '') AS top_source_path, coalesce(top_section_path, '') AS top_section_path,
               retrieved_count::VARCHAR AS retrieved_count, coalesce(error_message, '') AS error_message FROM ({ANSWER_EVENTS})
    """,
    "image_blocks": IMAGE_BLOCKS,
    "segment_blocks": rf"""
        WITH every AS (
            SELECT doc_id, doc_id || '-block-' || order_index AS block_id, block_type, order_index, text FROM ({BLOCKS}) WHERE doc_id % 2 = 0
            UNION ALL
            SELECT doc_id, doc_id || '-seg-' || n, CASE WHEN kind = 'paragraph' AND regexp_matches(trim(text, ' '), '{STEP_START}') THEN 'step' WHEN kind IN ('table', 'table_row', 'list_item', 'note') THEN kind
                   WHEN kind = 'code_block' THEN 'code' WHEN kind = 'image_caption' THEN 'caption' ELSE 'paragraph' END, n, text
            FROM (SELECT doc_id, n, CASE WHEN n % 3 = 0 THEN n || '. ' || line ELSE line END AS text,
                         ['paragraph', 'table', 'table_row', 'json_object', 'code_block', 'image_caption', 'slide', 'list_item', 'note'][n * n % 9 + 1] AS kind
                  FROM (SELECT doc_id, unnest(range(len(l))) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, E'\n') AS l FROM documents WHERE doc_id % 2 = 1)))
        )
        SELECT *, trim(regexp_extract(trim(text, ' '), '{STEP_START}', 1), ' ') AS step_number FROM every
    """,
    "strategy_chunks": STRATEGY_CHUNKS,
    "json_issues_gated": GATED,
    "vector_topk_many": """
        SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score,
               row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) AS rank
        FROM embeddings v, embeddings q WHERE q.vec_id % 50 = 0 QUALIFY rank <= 12
    """,
    "multi_query_merge_many": f"SELECT question_id, chunk_id, score, len(variants) AS n_queries FROM ({found_by(STORED, 'chunk_id', 20)})",
    "answers_by_question": ANSWERS_BY_QUESTION,
    "hybrid_search": f"""
        SELECT doc_id, score, round(0.8 * score + 0.2 * {substring_share("source || ' ' || text")}, 6) AS rank_score, left(text, 420) AS excerpt
        FROM (SELECT * FROM ({scored(1)}) ORDER BY score DESC, doc_id LIMIT {max(4 * K, 12)}) ORDER BY rank_score DESC, doc_id LIMIT {K}
    """,
    "vector_topk_chunks": f"""
        SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({scored(VARIANTS)})) WHERE rank <= 12
    """,
    "vector_topk_filtered": f"SELECT doc_id, lang, score FROM ({scored(1)}) WHERE lang IN ('de', 'fr') ORDER BY score DESC, doc_id LIMIT 12",
    "vector_topk_images": f"SELECT s.doc_id, quality, score FROM ({scored(1)}) s JOIN labels l ON l.doc_id = s.doc_id WHERE quality = 1 ORDER BY score DESC, s.doc_id LIMIT 8",
    "multi_query_merge": f"""
        SELECT doc_id, max(score) AS score, arg_max(query_id, (score, -query_id)) AS best_query, list(DISTINCT query_id ORDER BY query_id) AS matched_queries
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM ({scored(VARIANTS)})) WHERE rank <= 40 GROUP BY doc_id
    """,
    "lookup_by_ids": "SELECT doc_id, lang, source, 0.0::DOUBLE AS score FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)",
    "query_list": "SELECT conv_id, turn, CASE WHEN text = lower(text) THEN text ELSE text || '|' || lower(text) END AS queries FROM conversations WHERE role = 'user'",
    "hybrid_rank_rich": f"""
        SELECT doc_id, score, round(ai_bonus, 6) AS ai_bonus,
               round(0.58 * score + 0.12 * {word_share("title || ' ' || lang || ' ' || source || ' ' || text")} + 0.05 * {word_share("lang || ' ' || source")}
                     + CASE WHEN label > 2 THEN 0.03 ELSE 0 END + 0.015
                     + least(0.18, CASE WHEN label <= 4 OR {STEP} >= 0.18 THEN 0.08 ELSE 0 END
                                 + CASE WHEN {LIST} >= 0.18 THEN 0.06 ELSE 0 END + CASE WHEN label > 2 THEN 0.04 ELSE 0 END)
                     + {SHAPES["limit"]} + ai_bonus - {PENALTY}, 6) AS rank_score
        FROM ({PROFILED})
    """,
    "rank_bonuses": "SELECT doc_id, "
    + ", ".join(f"round({v}, 6)::DOUBLE AS {k}_bonus" for k, v in SHAPES.items())
    + f", round(0.08 + CASE WHEN {LIST} >= 0.18 THEN 0.06 ELSE 0 END, 6)::DOUBLE AS structural, {PENALTY}::DOUBLE AS penalty FROM documents",
    "line_densities": f"""
        SELECT doc_id, round({STEP}, 6) AS step_density, round({LIST}, 6) AS list_density, round({REFERENCE}, 6) AS reference_density,
               round({NUMERIC}, 6) AS numeric_density, round({DEFINITION}, 6)::DOUBLE AS definition_density FROM documents
    """,
    "section_consolidate": f"""
        SELECT doc_id, source, lang, most AS rank_score FROM (
            SELECT *, max(score) OVER (PARTITION BY source, lang) AS most,
                   row_number() OVER (PARTITION BY source, lang ORDER BY length(text) DESC, len({words('text')}) DESC, (label > 2) DESC, score DESC, doc_id) AS n FROM ({PROFILED})) WHERE n = 1
    """,
    "image_chunk_support": f"""
        SELECT related_chunk_id AS chunk_id, round(max(s), 6) AS support FROM (
            SELECT *, least(0.24, score * 0.16 + least(1.0, related_chunk_id / 10) * 0.22) AS s FROM ({IMAGES})) WHERE s > 0.07 GROUP BY 1
    """,
    "image_candidate_tiers": f"""
        WITH t AS ({TOP_CHUNKS}), refs AS (SELECT unnest(image_refs) AS r FROM t), tiers AS (
            SELECT image_id::VARCHAR AS image_id, image_path, score,
                   CASE WHEN related_chunk_id IN (SELECT chunk_id FROM t) OR image_path IN (SELECT r FROM refs) THEN 1
                        WHEN document_id IN (SELECT document_id FROM t) THEN 2 ELSE 3 END AS tier FROM ({IMAGES}))
        SELECT * FROM tiers WHERE tier = (SELECT min(tier) FROM tiers)
    """,
    "image_fallback": f"SELECT * REPLACE (round(score, 6) AS score) FROM ({FALLBACK})",
    "image_rerank": f"""
        SELECT doc_id, score, round(0.76 * score + 0.16 * {word_share('text')} + 0.08, 6) AS image_score FROM ({scored(1)}) ORDER BY image_score DESC, doc_id LIMIT 4
    """,
    "prompt_blocks": f"""
        SELECT string_agg('[S' || rank || '] Document ' || doc_id || ' | ' || lang || ' | ' || source || E'\\n' || text, E'\\n\\n' ORDER BY rank) AS prompt
        FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({scored(1)})) WHERE rank <= 5
    """,
    "lexical_overlap": f"""
        SELECT doc_id, round({word_share('text')}, 6) AS whole_words, round({substring_share('text')}, 6) AS parts,
               round(greatest({word_share("text || ' ' || lang || ' ' || source")}, {word_share("text || ' ' || lang || ' ' || source", "'the table'")}), 6) AS caption FROM documents
    """,
    "vector_literals": """
        SELECT vec_id, '[' || array_to_string(list_transform(embedding, lambda x: printf('%.9f', x::DOUBLE)), ', ') || ']' AS literal,
               round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm FROM embeddings
    """,
    "query_tokens": rf"""
        SELECT conv_id, turn, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), ' ') AS tokens, len({tokens('text', 4)})::INT AS n_long
        FROM (SELECT *, list_filter({TOKENS.format('text')}, lambda x: length(x) >= 2) AS t FROM conversations)
    """,
    "question_normalize": r"""
        SELECT conv_id, turn, trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}_\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS question,
               regexp_replace(lower(trim(text)), '\s+', ' ', 'g') AS label, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS folded FROM conversations
    """,
    "normalize_text": r"""
        SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(text, '\r\n?', E'\n', 'g'), chr(160), ' '), '[ \t]+', ' ', 'g'), '\n{3,}', E'\n\n', 'g'), '^\s+|\s+$', '', 'g') AS text,
               regexp_matches(text, '[\x{0600}-\x{06FF}]') AS is_arabic FROM documents
    """,
    "detect_languages": r"""
        SELECT doc_id, coalesce(nullif(concat_ws(',', CASE WHEN regexp_matches(text, '[\x{0600}-\x{06FF}]') THEN 'ar' END, CASE WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'zh' END,
               CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'ja' END, CASE WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' END), ''), 'unknown') AS tags FROM documents
    """,
    "excerpts": r"""
        SELECT doc_id, left(text, 420) AS fixed, CASE WHEN length(text) <= 900 THEN text ELSE regexp_replace(left(text, cut), '\s+$', '') || ' ...' END AS at_border FROM (
            SELECT *, CASE WHEN strpos(b, E'\n\n') > 0 AND 900 - strpos(b, E'\n\n') - 1 >= 540 THEN 900 - strpos(b, E'\n\n') - 1
                           WHEN strpos(b, ' ') > 0 THEN 900 - strpos(b, ' ') ELSE 900 END AS cut FROM (SELECT *, reverse(left(text, 900)) AS b FROM documents))
    """,
    "asset_urls": r"""
        SELECT page_id, '/assets/' || regexp_replace(regexp_replace(regexp_replace(url, '^https?://[^/]+', '/data'), '^/+', ''), '^data/', '') AS asset,
               CASE WHEN stem = '' THEN name ELSE stem END AS title FROM (
            SELECT *, trim(regexp_replace(CASE WHEN regexp_matches(name, '.\.[^.]*$') THEN regexp_replace(name, '\.[^.]*$', '') ELSE name END, '[_-]', ' ', 'g')) AS stem
            FROM (SELECT *, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS name FROM pages))
    """,
    "text_numbers": r"""
        SELECT doc_id, array_to_string(regexp_extract_all(text, '[-+]?\d+(?:\.\d+)?'), ' ') AS numbers, trim(regexp_extract(trim(text), '^((?:step\s+)?(?:\d+|[a-zA-Z])[).:-]\s+)', 1)) AS step,
               len(regexp_extract_all(text, ':math:`[^`]+`'))::BIGINT AS formulas FROM documents
    """,
    "embedding_text": r"""
        SELECT doc_id, sha256('Document title: ' || source || E'\nArchetype: knowledge\nSection path: ' || lang || ' > ' || source || E'\nContent type: narrative_chunk\nLocation: unknown\n\nContent:\n' || text) AS digest FROM documents
    """,
    "checksum_identity": "SELECT left(sha256(text), 32) AS document_id, count(*) AS copies, min(doc_id) AS first_id FROM documents GROUP BY 1",
    "blank_line_blocks": f"SELECT doc_id, first_line, last_line, text, block FROM ({ISLANDS})",
    "sections": f"""
        WITH h AS MATERIALIZED ({HEADINGS}), placed AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN line_no END) OVER (PARTITION BY doc_id ORDER BY line_no) AS heading_line FROM h),
        body AS (SELECT doc_id, heading_line, count(*) AS n_lines FROM placed WHERE level IS NULL AND line_no > heading_line + 1 GROUP BY ALL),
        heads AS MATERIALIZED (SELECT doc_id, line_no AS at, level, trim(line) AS title FROM h WHERE level IS NOT NULL)
        SELECT doc_id, heading_line, n_lines, path FROM body JOIN ({paths("heads", "body", "doc_id", "heading_line")}) USING (doc_id, heading_line)
    """,
    "typed_blocks": f"""
        WITH told AS (
            SELECT *, trim(line) AS own, trim(lag(line) OVER w) AS b, trim(lead(line) OVER w) AS a FROM ({LINES}) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)
        ),
        levels AS (
            SELECT doc_id, line_no, own, CASE WHEN own <> '' AND regexp_matches(a, '{LOOSE}') AND strpos('=-~^"`:#*+', left(a, 1)) > 0 THEN strpos('=-~^"`:#*+', left(a, 1))
                   WHEN coalesce(a, '') = '' AND coalesce(b, '') = '' AND {heuristic('own')} THEN 2 END AS level
            FROM told WHERE NOT (regexp_matches(own, '{LOOSE}') AND length(own) >= 3)
        ),
        kinds AS (
            SELECT *, CASE WHEN own = '' THEN 'blank' WHEN level IS NOT NULL THEN 'heading' WHEN regexp_matches(own, '{STEP_START}') THEN 'step'
                           WHEN regexp_matches(own, '^[-*•]\\s+') THEN 'list_item' ELSE 'paragraph' END AS block_type FROM levels
        ),
        starts AS (SELECT *, CASE WHEN block_type = 'paragraph' AND lag(block_type) OVER w = 'paragraph' THEN 0 ELSE 1 END AS s FROM kinds WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
        islands AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line_no) AS block FROM starts),
        made AS (SELECT doc_id, block_type, min(line_no) AS first_line, max(level) AS heading_level, string_agg(own, ' ' ORDER BY line_no) AS text FROM islands WHERE block_type <> 'blank' GROUP BY doc_id, block, block_type),
        heads AS MATERIALIZED (SELECT doc_id, line_no AS at, level, own AS title FROM levels WHERE level IS NOT NULL)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_line) - 1 AS order_index, block_type, text, heading_level, path AS section_path
        FROM made JOIN ({paths("heads", "made", "doc_id", "first_line")}) USING (doc_id, first_line)
    """,
    "page_units": f"""
        WITH parts AS (SELECT doc_id, document_title, page_number, unnest(range(len(p))) AS part, unnest(p) AS paragraph FROM (
            SELECT *, list_filter(list_transform(string_split(text, E'\\n\\n'), lambda x: {normalized('x')}), lambda x: x <> '') AS p FROM ({PAGES}))),
        cut AS (SELECT * EXCLUDE (l), unnest(range(len(l))) AS n, unnest(l) AS line FROM (
            SELECT *, list_filter(list_transform(string_split(paragraph, E'\\n'), lambda x: {normalized('x')}), lambda x: x <> '') AS l FROM parts)),
        told AS (
            SELECT *, len({words('line')}) BETWEEN 1 AND 14 AND NOT {table_like('line')} AND NOT regexp_matches(line, '{CAPTION}') AND NOT regexp_matches(line, '{STEP_START}')
                   AND NOT regexp_matches(line, '[.;?!]$')
                   AND CASE WHEN regexp_matches(line, '{ENUMERATED}') THEN len({words('line')}) <= 10 AND NOT regexp_matches(line, '[,،;؛]')
                            ELSE contains(line, ':') AND (ends_with(line, ':') OR len({words('line')}) <= 12) OR {page_heading('line')} END AS head
            FROM cut
        ),
        runs AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id, page_number, part ORDER BY n) AS run FROM told),
        units AS (SELECT doc_id, document_title, page_number, part, head, min(n) AS n, string_agg(line, E'\\n' ORDER BY n) AS text FROM runs GROUP BY doc_id, document_title, page_number, part, run, head),
        typed AS (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, part, n) - 1 AS order_index,
                   CASE WHEN head THEN 'heading' WHEN {table_like('text')} THEN 'table' WHEN regexp_matches(trim(text), '{STEP_START}') THEN 'step'
                        WHEN regexp_matches(trim(text), '{CAPTION}') THEN 'caption' WHEN {page_heading('trim(text)')} THEN 'heading' ELSE 'paragraph' END AS block_type
            FROM units
        ),
        levels AS (
            SELECT *, CASE WHEN block_type <> 'heading' THEN NULL WHEN NOT head THEN 1
                           WHEN regexp_matches(text, '{ENUMERATED}') AND len({words('text')}) <= 10 AND NOT regexp_matches(text, '[,،;؛]') THEN 2
                           WHEN contains(text, ':') THEN CASE WHEN regexp_matches(text, '[\\d٠-٩]') THEN 2 ELSE 1 END
                           WHEN len({words('text')}) <= 4 THEN 1 ELSE 2 END AS level FROM typed
        ),
        heads AS MATERIALIZED (SELECT doc_id, order_index AS at, level, text AS title FROM levels WHERE level IS NOT NULL)
        SELECT doc_id, page_number, order_index, block_type, text, level AS heading_level,
               CASE WHEN head THEN 'line_heuristic' WHEN block_type = 'heading' THEN 'heuristic' END AS heading_style,
               document_title || ' > ' || CASE WHEN path = '' THEN 'Page ' || page_number ELSE path END AS section_path
        FROM levels JOIN ({paths("heads", "levels", "doc_id", "order_index")}) USING (doc_id, order_index)
    """,
    "window_chunks": windows(30, 8),
    "window_chunks_min_words": windows(60, 12, 20),
    "document_archetype": ARCHETYPES,
    "group_blocks": GROUPS,
    "build_chunks": f"""
        SELECT doc_id, chunk_index, sha256(doc_id || '|' || chunk_index) AS chunk_id, chunk_type, array_to_string(ids, ',') AS block_ids, content FROM ({CHUNK_ROWS})
    """,
    "chunk_attributes": f"""
        SELECT doc_id, chunk_index, chunk_type, title, lang AS path, page AS page_number, {LANGUAGES} AS languages,
               'block_ids=' || to_json(ids)::VARCHAR || '; block_types=' || to_json(kinds)::VARCHAR || '; document_archetype=' || archetype
                   || coalesce('; ' || (SELECT string_agg('k' || r || '=' || kinds[list_position(ns, m)], '; ' ORDER BY r)
                        FROM (SELECT r, list_max(list_filter(ns, lambda n: n % 3 = r)) AS m FROM range(3) t(r)) WHERE m IS NOT NULL), '')
                   || '; last=' || list_max(ns) || '; source=' || source AS metadata,
               coalesce((SELECT string_agg(image_path, ',' ORDER BY o, k) FROM (
                   SELECT image_path, min(order_index * 2 + k) AS o, min(k) AS k FROM shown s WHERE s.doc_id = c.doc_id AND s.chunk_index = c.chunk_index GROUP BY image_path)), '') AS image_refs,
               sha256('Document title: ' || title || E'\\nArchetype: ' || archetype || E'\\nSection path: ' || lang || E'\\nContent type: ' || chunk_type || E'\\nLocation: '
                      || coalesce('page ' || page, 'unknown') || E'\\n\\nContent:\\n' || content) AS embedded
        FROM (SELECT *, list_min(list_filter(ns, lambda n: n % 4 = 1)) // 20 + 1 AS page FROM ({CHUNK_ROWS})) c
    """.replace("FROM shown s", f"FROM ({SHOWN_IN}) s"),
    "chunk_image_rows": f"""
        WITH shown AS MATERIALIZED ({SHOWN_IN}),
        linked AS (
            SELECT doc_id, image_path, image_id, lang AS title, caption_text, lang AS related_section_path, sha256(doc_id || '|' || chunk_index) AS related_chunk_id,
                   array_to_string(ids, ',') AS related_block_ids, {LANGUAGES} AS language_tags
            FROM shown QUALIFY row_number() OVER (PARTITION BY doc_id, image_path ORDER BY chunk_index, order_index, k) = 1
        )
        SELECT * FROM linked UNION ALL
        SELECT doc_id, 'img/' || doc_id || '/' || k, 'i' || k, source, CASE WHEN k = 1 THEN 'plan' ELSE '' END, source, NULL, '', lang
        FROM documents d, range(4) t(k) WHERE NOT EXISTS (SELECT 1 FROM linked l WHERE l.doc_id = d.doc_id AND l.image_path = 'img/' || d.doc_id || '/' || k)
    """,
    "block_window_overlap": f"""
        SELECT b.doc_id, block, w.win AS "window" FROM ({ISLANDS}) b JOIN (SELECT doc_id, floor(line_no / 50)::BIGINT AS win, min(line_no) AS f, max(line_no) AS l FROM ({LINES}) GROUP BY 1, 2) w
        ON b.doc_id = w.doc_id AND first_line <= l AND last_line >= f
    """,
    "image_prune": """
        SELECT p_partkey, CASE WHEN w < 120 OR h < 48 OR w * h < 12000 THEN 'too_small' WHEN n >= 5 AND w * h <= 90000 THEN 'repeated_small_asset' END AS drop_reason FROM (
            SELECT p_partkey, p_size * 10 AS w, floor(p_retailprice)::INT AS h, count(*) OVER (PARTITION BY p_brand, p_type) AS n FROM part)
    """,
    "regions": """
        WITH items AS (SELECT l_orderkey, l_linenumber AS row_no, max(l_returnflag) AS flag, max(l_quantity) AS q, max(l_tax) AS tax FROM lineitem GROUP BY 1, 2),
        filled AS (SELECT *, 2 + (tax > 0.04)::INT AS n, row_no - row_number() OVER (PARTITION BY l_orderkey ORDER BY row_no) AS island FROM items WHERE flag <> 'R'),
        told AS (SELECT *, first(n) OVER w AS head, row_number() OVER w AS i FROM filled WINDOW w AS (PARTITION BY l_orderkey, island ORDER BY row_no)),
        summed AS (SELECT l_orderkey, min(row_no) AS first_row, max(row_no) AS last_row, count(*) AS n_rows, max(head) AS head, count(*) FILTER (i > 1 AND n > 2) AS wide,
                          count(*) FILTER (i > 1 AND q > 25) AS numbers, count(*) FILTER (i > 1 AND n = head) AS same, count(*) FILTER (n <= 2) AS narrow FROM told GROUP BY l_orderkey, island)
        SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY first_row) - 1 AS region, first_row, last_row, n_rows,
               CASE WHEN head = 2 AND n_rows > 1 AND wide = 0 AND numbers = 0 THEN 'key_value'
                    WHEN n_rows > 1 AND same >= greatest(1, (n_rows - 1) // 2) THEN 'table'
                    WHEN narrow >= greatest(1, n_rows - 1) THEN 'key_value' ELSE 'table' END AS region_type FROM summed
    """,
    "answer_shapes": r"""
        SELECT conv_id, turn, CASE WHEN contains(text, 'que') THEN CASE WHEN regexp_matches(lower(text), 'compare|difference|versus|vs') THEN 'comparison' ELSE 'parameter_list' END
               WHEN contains(text, 'the') THEN CASE WHEN regexp_matches(lower(text), 'how many|how much|limit|maximum') THEN 'limit' ELSE 'rule' END
               WHEN regexp_matches(lower(text), 'what is|define|meaning') THEN 'definition' ELSE 'summary' END AS shape FROM conversations WHERE role = 'user'
    """,
    "follow_ups": f"""
        WITH made AS (SELECT row_number() OVER (ORDER BY score DESC, doc_id) AS place, 'What else does ' || source || ' say?' AS question FROM ({scored(1)})),
        every AS (SELECT * FROM made WHERE place <= 3 UNION ALL SELECT * FROM (VALUES (1000, 'Where does it apply?'), (1001, 'Who is concerned?'), (1002, 'What changed?')))
        SELECT question, min(place) AS place FROM every GROUP BY question ORDER BY place, question LIMIT 3
    """,
    "document_list": "SELECT doc_id, source, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id",
    "priority_pick": "SELECT s_suppkey, s_nationkey FROM supplier ORDER BY CASE WHEN s_acctbal > 0 THEN 0 ELSE 1 END, s_nationkey, s_suppkey LIMIT 1",
    "doc_upsert": """
        SELECT doc_id, lang, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'xx', quality FROM labels
    """,
    "doc_replace": """
        WITH gone AS (SELECT DISTINCT conv_id FROM conversations WHERE role = 'system')
        SELECT conv_id, turn, role FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM gone) UNION ALL SELECT conv_id, 0, 'replaced' FROM gone
    """,
    "doc_cascade_delete": """
        WITH gone AS (SELECT doc_id AS g FROM labels WHERE toxic = 1)
        SELECT 'documents' AS name, count(*) AS n_rows FROM documents WHERE doc_id NOT IN (SELECT g FROM gone)
        UNION ALL SELECT 'embeddings', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT g FROM gone)
        UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT g FROM gone)
    """,
    "corpus_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n_rows FROM {t}" for t in ("documents", "embeddings", "labels", "pages")),
    "document_counts": """
        SELECT doc_id, (SELECT count(*) FROM embeddings WHERE vec_id = doc_id) AS n_vectors, (SELECT count(*) FROM labels l WHERE l.doc_id = d.doc_id) AS n_labels FROM documents d
    """,
    "usage_summary": f"""
        SELECT count(*) AS total_questions, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed, count(*) FILTER (had_image) AS with_image,
               count(DISTINCT session_id) AS unique_sessions, round(avg(latency_ms), 2) AS avg_latency_ms
        FROM ({CHAT_EVENTS}) WHERE asked_at >= (SELECT max(ts) FROM events) - INTERVAL {RECENT_DAYS} DAY
    """,
    "top_questions": f"""
        SELECT question_normalized, min(question_text) FILTER (asked_at = latest) AS question_text, count(*) AS times_asked, strftime(max(asked_at), '%Y-%m-%dT%H:%M:%S') AS last_asked
        FROM (SELECT *, max(asked_at) OVER (PARTITION BY question_normalized) AS latest FROM ({CHAT_EVENTS})) GROUP BY 1 ORDER BY times_asked DESC, max(asked_at) DESC, 1 LIMIT 10
    """,
    "top_sources": f"""
        SELECT coalesce(top_source_path, '(unknown)') AS source_path, coalesce(top_section_path, '(unknown)') AS section_path, count(*) AS hits
        FROM ({CHAT_EVENTS}) WHERE success GROUP BY 1, 2 ORDER BY hits DESC, 1, 2 LIMIT 10
    """,
    "daily_counts": f"SELECT strftime(asked_at, '%Y-%m-%d') AS day, count(*) AS questions FROM ({CHAT_EVENTS}) GROUP BY 1",
    "analytics_export": f"""
        SELECT strftime(asked_at, '%Y-%m-%dT%H:%M:%S') AS asked_at, session_id, question_text, CASE WHEN had_image THEN 'yes' ELSE 'no' END AS had_image,
               CASE WHEN success THEN 'yes' ELSE 'no' END AS success, coalesce(top_source_path, '') AS top_source_path FROM ({CHAT_EVENTS})
    """,
    "event_capture": "SELECT conv_id, turn, nullif(left(text, 2000), '') AS question_text, nullif(left(text, 1000), '') AS error_message, nullif(left(role, 256), '') AS session_id FROM conversations",
    "recent_queries": """
        SELECT session_id, question, latest AS "at", place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY latest DESC, question) AS place FROM (
            SELECT conv_id AS session_id, text AS question, max(turn) AS latest FROM conversations WHERE role = 'user' GROUP BY 1, 2)) WHERE place <= 8
    """,
    "json_columns": """
        SELECT event_id, event_type || ',x' AS listed, 0 AS none, json(props)::VARCHAR AS object, 'repaired' AS status FROM events
    """,
    "json_consensus": CONSENSUS,
    "json_issues": f"SELECT * FROM ({ISSUES}) WHERE issue IS NOT NULL OR n_missing > 0",
    "json_model_summary": f"""
        WITH w AS (
            SELECT model, present, issue,
                   CASE issue WHEN 'numeric_mismatch' THEN number IS DISTINCT FROM try_cast(trim(consensus_value) AS DOUBLE)
                              WHEN 'number_token_mismatch' THEN toks <> array_to_string(regexp_extract_all(consensus_value, '[-+]?\\d+(?:\\.\\d+)?'), ' ')
                              WHEN 'word_count_mismatch' THEN n_words <> len({words('consensus_value')}) WHEN 'value_mismatch' THEN norm <> consensus_norm ELSE false END AND present AS wrong
            FROM ({WHOLE}) JOIN ({ISSUES}) USING (o_orderkey, path) JOIN ({CONSENSUS}) USING (o_orderkey, path)),
        s AS (SELECT model, count(*) FILTER (NOT present) AS missing_fields, count(*) FILTER (wrong) AS value_mismatches,
                     count(*) FILTER (wrong AND issue = 'numeric_mismatch') AS numeric_mismatches, count(*) FILTER (wrong AND issue = 'number_token_mismatch') AS number_token_mismatches,
                     count(*) FILTER (wrong AND issue = 'word_count_mismatch') AS word_count_mismatches FROM w GROUP BY model)
        SELECT *, row_number() OVER (ORDER BY missing_fields, value_mismatches, numeric_mismatches, number_token_mismatches, word_count_mismatches, model) AS place FROM s
    """,
    "two_hop_lookup": """
        WITH asked AS (SELECT ' ' || upper(n_name) AS place FROM nation UNION ALL SELECT DISTINCT c_mktsegment FROM customer),
        via AS (SELECT lower(trim(n_name)) AS alias, lower(trim(r_name)) AS name FROM nation JOIN region ON n_regionkey = r_regionkey)
        SELECT place, r_name AS name, r_regionkey, r_name IS NOT NULL AS found,
               CASE WHEN r_name IS NULL THEN (SELECT string_agg(lower(r_name), ', ' ORDER BY lower(r_name)) FROM region) END AS supported
        FROM asked LEFT JOIN via ON alias = lower(trim(place)) LEFT JOIN region ON lower(trim(r_name)) = coalesce(via.name, lower(trim(place)))
    """,
    "record_rendering": """
        SELECT n_regionkey, string_agg(n_name || ': n_nationkey=' || n_nationkey || ', n_regionkey=' || n_regionkey, '; ' ORDER BY n_name) AS rendered FROM nation GROUP BY 1
    """,
    "latest_active": "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
}
ORACLE["image_anchors"] = rf"""
    SELECT doc_id, page_number, arg_min(doc_id || '-' || order_index, (rank, order_index)) AS anchor_block FROM (
        SELECT *, CASE WHEN block_type = 'caption' THEN 1 WHEN block_type = 'paragraph' AND regexp_matches(text, '(?i)\b(?:figure|diagram|image|screenshot|chart)\b') THEN 2
                       WHEN block_type = 'step' THEN 3 WHEN block_type NOT IN ('heading', 'table') THEN 4 END AS rank FROM ({ORACLE["page_units"]}))
    WHERE rank IS NOT NULL GROUP BY 1, 2
"""
ORACLE["region_titles"] = f"""
    SELECT l_orderkey, region, CASE WHEN region_type = 'key_value' THEN flag ELSE 'Table ' || (region + 1) || ': ' || flag || ', ' || quantity || taxed END AS title
    FROM ({ORACLE["regions"]}) r JOIN (
        SELECT l_orderkey, l_linenumber AS first_row, max(l_returnflag) AS flag, CASE WHEN max(l_quantity) > 25 THEN max(l_quantity)::INT::VARCHAR ELSE 'few' END AS quantity,
               CASE WHEN max(l_tax) > 0.04 THEN ', taxed' ELSE '' END AS taxed FROM lineitem GROUP BY 1, 2) USING (l_orderkey, first_row)
"""
