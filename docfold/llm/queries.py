"""One query for each operator, over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_tools, common, exact_dedup, fingerprints, html_extract, language_id, near_dedup, packing, periodic_runs, substring_dedup, token_counts, toxicity, turn_repair

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_file(name: str) -> bytes:
    """A public vocabulary's bytes, read on the driver and sent to the tasks from there."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    labels = common.table(spark, sf_dir, "labels")
    held_out = common.remainder(F.col("doc_id"), 5) == 0
    field = toxicity.fit(docs, labels, common.remainder(labels["doc_id"], 5) != 0)
    scored = toxicity.score(docs.select("doc_id", "text"), field)
    value = F.col("toxicity.score")
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        value.alias("score"),
        (value >= 0.5).cast("int").alias("predicted"),
        F.col("toxicity.spans").alias("spans"),
    )


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return bpe.round_trip_digests(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), pattern())


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(common.table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    lengths = bpe.count_tokens(docs, tokenizer_file("byte_bpe_multi_50k.tiktoken"), pattern())
    return token_counts.limit_answers(common.checkpoint(token_counts.length_histogram(lengths)))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(common.table(spark, sf_dir, "documents"))


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(common.table(spark, sf_dir, "pages"))


def op7_chat_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = chat_tools.conversation_calls(common.table(spark, sf_dir, "conversations"))
    return chat_tools.link(calls, results, chat_tools.TOOLS, others)


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(common.table(spark, sf_dir, "documents"), width=2, percent=80)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    models = language_id.fit(docs, common.remainder(docs["doc_id"], 3) != 1)
    judged = language_id.predict(docs.select("doc_id", "text"), models)
    return judged.select(
        "doc_id",
        (common.remainder(F.col("doc_id"), 3) == 1).alias("held_out"),
        F.col("language.lang_pred").alias("lang_pred"),
        F.col("language.score").alias("score"),
        F.col("language.rejected").alias("rejected"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    tokenizer = tokenizer_file("byte_bpe_50k.json").decode()
    pieces = packing.token_pieces(docs, tokenizer, end_id=2, capacity=1024)
    return packing.pack(pieces, capacity=1024)


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair_damaged(common.table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.run_digests(common.table(spark, sf_dir, "documents"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removal_digests(common.table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_byte_bpe, op3_fingerprints, op4_token_counts, op5_exact_dedup, op6_html_extraction, op7_chat_tools,
        op8_minhash, op9_language_id, op10_packing, op11_turn_repair, op12_periodic_runs, op13_substring_dedup,
    )
}

ORACLE_SQL = {
    "op5_exact_dedup": r"""
        WITH rows AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM rows
    """,
    "op7_chat_tools": r"""
        WITH RECURSIVE calls AS (
            SELECT conv_id, turn, min(text) AS text, conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id
            FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
        ),
        results AS (
            SELECT conv_id::VARCHAR || ':' || (turn - 1)::VARCHAR AS call_id, min(text) AS content
            FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
        ),
        placed AS (
            SELECT c.conv_id, c.turn, c.call_id, 0::BIGINT AS level FROM calls c
            WHERE NOT EXISTS (SELECT 1 FROM calls p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 2)
            UNION ALL
            SELECT c.conv_id, c.turn, c.call_id, p.level + 1 FROM calls c JOIN placed p ON p.conv_id = c.conv_id AND p.turn = c.turn - 2
        ),
        linked AS (
            SELECT call_id, c.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered, turn, text, content, level
            FROM (SELECT * FROM calls JOIN placed USING (conv_id, turn, call_id)) c FULL JOIN results r USING (call_id)
        ),
        told AS (SELECT *, CASE WHEN NOT called THEN 'orphan' WHEN answered THEN 'linked' ELSE 'unanswered' END AS status FROM linked)
        SELECT call_id, status, level,
               CASE WHEN called THEN text IS NOT NULL END AS valid,
               CASE WHEN called THEN CASE WHEN text IS NULL THEN ['missing:text'] ELSE []::VARCHAR[] END END AS faults,
               '{' || CASE WHEN called AND text IS NOT NULL THEN '"arguments":{"text":' || to_json(text)::VARCHAR || ',"turn":' || turn::VARCHAR || '},' ELSE '' END
                   || '"id":' || to_json(call_id)::VARCHAR
                   || CASE WHEN called THEN ',"level":' || level::VARCHAR ELSE '' END
                   || CASE WHEN content IS NOT NULL THEN ',"result":' || to_json(content)::VARCHAR ELSE '' END
                   || ',"status":"' || status || '"'
                   || CASE WHEN called THEN ',"tool":"reply"' ELSE '' END || '}' AS message
        FROM told
        UNION ALL
        SELECT call_id, 'context', NULL, NULL, NULL,
               '{' || CASE WHEN c.text IS NOT NULL THEN '"context":' || to_json(c.text)::VARCHAR || ',' ELSE '' END || '"id":' || to_json(call_id)::VARCHAR
                   || CASE WHEN c.role IS NOT NULL THEN ',"role":' || to_json(c.role)::VARCHAR ELSE '' END || ',"status":"context"}'
        FROM (SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS call_id, min({'role': role, 'text': text}) AS c
              FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant') GROUP BY conv_id, turn) WHERE call_id IS NOT NULL
    """,
    "op8_minhash": r"""
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
            FROM documents
        ),
        shingles AS (
            SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
                   ELSE list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s
            FROM words
        ),
        sizes AS (SELECT doc_id, count(s) AS n FROM words LEFT JOIN shingles USING (doc_id) GROUP BY doc_id),
        shared AS (
            SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared_n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ),
        links AS (
            SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared_n >= 80 * (x.n + y.n - shared_n)
        ),
        either AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reached AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT r.a, e.b FROM reached r JOIN either e ON e.a = r.b)
        SELECT r.a AS doc_id, any_value(n) AS n_shingles, min(r.b) AS component_id, r.a = min(r.b) AS kept
        FROM reached r JOIN sizes s ON s.doc_id = r.a GROUP BY r.a
    """,
    "op11_turn_repair": r"""
        WITH RECURSIVE folds AS (
            SELECT list(list_reduce([i] || [0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS f
            FROM range(256) t(i)
        ),
        keyed AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: ascii(ch)::BIGINT) AS bytes
            FROM conversations
        ),
        drawn AS (
            SELECT conv_id, turn, role, text,
                   xor(list_reduce([4294967295::BIGINT] || bytes, lambda c, b: xor(c >> 8, f[(xor(c, b) & 255) + 1])), 4294967295::BIGINT) % 20 AS kind
            FROM keyed, folds
        ),
        spoilt AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM drawn
        ),
        placed AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM spoilt
        ),
        told AS (
            SELECT conv_id, turn, role, text, pos, left(role, 1) AS initial,
                   NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                   NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
            FROM placed
        ),
        counts AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
                   count(*) FILTER (open AND NOT blank AND NOT again) AS truncated,
                   count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
            FROM told GROUP BY conv_id
        ),
        steps AS (
            SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 'r': ''} AS x,
                   NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS s, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS u, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR) AS v
            FROM counts
            UNION ALL
            SELECT conv_id, pos, dx,
                   list_min([ds, CASE WHEN keep AND initial = 's' THEN {'c': x.c + late, 'a': x.a || 'K', 'r': x.r || line} END]),
                   list_min([du, CASE WHEN keep AND initial = 'u' THEN list_min([
                                     CASE WHEN x.c IS NOT NULL THEN {'c': x.c + late, 'a': x.a || 'K', 'r': x.r || line} END,
                                     CASE WHEN s.c IS NOT NULL THEN {'c': s.c + late, 'a': s.a || 'K', 'r': s.r || line} END,
                                     CASE WHEN v2.c IS NOT NULL THEN {'c': v2.c + late, 'a': v2.a || 'K', 'r': v2.r || line} END]) END,
                             CASE WHEN keep THEN list_min([
                                     CASE WHEN x.c IS NOT NULL THEN {'c': x.c + 2 + late, 'a': x.a || 'R', 'r': x.r || chr(10) || 'user:' || text} END,
                                     CASE WHEN s.c IS NOT NULL THEN {'c': s.c + 2 + late, 'a': s.a || 'R', 'r': s.r || chr(10) || 'user:' || text} END,
                                     CASE WHEN v2.c IS NOT NULL THEN {'c': v2.c + 2 + late, 'a': v2.a || 'R', 'r': v2.r || chr(10) || 'user:' || text} END]) END]),
                   list_min([dv, CASE WHEN keep AND initial = 'a' THEN {'c': u2.c + late, 'a': u2.a || 'K', 'r': u2.r || line} END,
                             CASE WHEN keep THEN {'c': u2.c + 2 + late, 'a': u2.a || 'R', 'r': u2.r || chr(10) || 'assistant:' || text} END])
            FROM (
                SELECT *, CASE WHEN x.c IS NOT NULL THEN {'c': x.c + 3, 'a': x.a || 'D', 'r': x.r} END AS dx,
                       CASE WHEN s.c IS NOT NULL THEN {'c': s.c + 3, 'a': s.a || 'D', 'r': s.r} END AS ds,
                       {'c': u2.c + 3, 'a': u2.a || 'D', 'r': u2.r} AS du, {'c': v2.c + 3, 'a': v2.a || 'D', 'r': v2.r} AS dv
                FROM (
                    SELECT *, list_min([v, {'c': u2.c + 2, 'a': u2.a || 'I', 'r': u2.r || chr(10) || 'assistant:'}]) AS v2
                    FROM (
                        SELECT t.conv_id, t.pos, t.text, t.initial, p.x, p.s, p.v, chr(10) || t.role || ':' || t.text AS line,
                               NOT t.blank AND NOT t.again AS keep, t.open::BIGINT AS late,
                               list_min([p.u, CASE WHEN p.x.c IS NOT NULL THEN {'c': p.x.c + 2, 'a': p.x.a || 'I', 'r': p.x.r || chr(10) || 'user:'} END,
                                         CASE WHEN p.s.c IS NOT NULL THEN {'c': p.s.c + 2, 'a': p.s.a || 'I', 'r': p.s.r || chr(10) || 'user:'} END,
                                         CASE WHEN p.v.c IS NOT NULL THEN {'c': p.v.c + 2, 'a': p.v.a || 'I', 'r': p.v.r || chr(10) || 'user:'} END]) AS u2
                        FROM steps p JOIN told t ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.pos = p.i + 1
                    )
                )
            )
        ),
        ended AS (
            SELECT p.conv_id, list_min([x, v, CASE WHEN u.c IS NOT NULL THEN {'c': u.c + 2, 'a': u.a || 'I', 'r': u.r || chr(10) || 'assistant:'} END,
                                      CASE WHEN s.c IS NOT NULL THEN {'c': s.c + 4, 'a': s.a || 'II', 'r': s.r || chr(10) || 'user:' || chr(10) || 'assistant:'} END]) AS best
            FROM steps p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND p.i = c.n
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
               coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
    "op13_substring_dedup": r"""
        WITH texts AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        windows AS (
            SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM texts WHERE len(w) >= 50)
        ),
        firsts AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS first FROM windows),
        gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM firsts WHERE first < doc_id),
        placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM texts),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM placed ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
        counts AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
        SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM texts LEFT JOIN counts USING (doc_id) LEFT JOIN kept USING (doc_id)
    """,
}
