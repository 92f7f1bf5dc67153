"""Shared SQL definitions (DuckDB) matching model_tables and the retrieval operators."""

from __future__ import annotations

from corpusframe.functions import fixed

TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in dict.fromkeys(values)) + "]"


CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def define(name: str, body: str, needs: tuple[str, ...] = ()) -> None:
    CTES[name] = (needs, body.strip())


def with_ctes(sql: str, names: tuple[str, ...]) -> str:
    """Prefix the SQL with the named definitions and everything they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in CTES[name][0]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql.strip()
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered) + "\n" + sql.strip()


define("library", """
SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS document_id,
  'doc_' || d.doc_id || CASE d.lang WHEN 'en' THEN '.txt' WHEN 'fr' THEN '.md' WHEN 'de' THEN '.docx' ELSE '.pdf' END AS filename,
  CASE d.lang WHEN 'en' THEN 'text/plain' WHEN 'fr' THEN 'text/markdown'
    WHEN 'de' THEN 'application/vnd.openxmlformats-officedocument.wordprocessingml.document' ELSE 'application/pdf' END AS mime,
  CAST(strlen(d.text) AS BIGINT) AS size_bytes, d.text AS content, d.source,
  TIMESTAMP '2026-01-01' + to_minutes(d.doc_id) AS created_at,
  CASE WHEN l.quality = 0 AND l.toxic = 1 THEN 'PROCESSING' WHEN l.quality = 0 THEN 'FAILED' ELSE 'READY' END AS status,
  CASE WHEN l.quality IS NOT NULL THEN split_part(d.text, chr(10), 1) END AS summary,
  'files/' || d.source || '/' || d.doc_id AS storage_path
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
""")
define("chunks", """
SELECT d.doc_id, (d.doc_id // 20) || ':' || (d.doc_id % 20) AS chunk_id, CAST(d.doc_id // 20 AS VARCHAR) AS document_id,
  'book_' || (d.doc_id // 20) || '.txt' AS filename, d.doc_id % 20 AS chunk_index, d.text AS content,
  CAST((d.doc_id % 20) // 4 + 1 AS INTEGER) AS page_number, e.embedding,
  's' || e.label AS section_id, 'Section ' || e.label AS section_title,
  'Part ' || (e.label % 3) || ' > Section ' || e.label AS section_path
FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id
""")
define("books", """
SELECT document_id, filename, string_agg(content, chr(10) || chr(10) ORDER BY chunk_index) AS content,
  CASE WHEN count(l.quality) > 8 THEN min_by(content, chunk_index) END AS summary,
  CASE WHEN count(*) FILTER (l.quality = 0) >= 3 THEN 'FAILED' ELSE 'READY' END AS status,
  TIMESTAMP '2026-01-01' + to_days(CAST(document_id AS INTEGER)) AS created_at
FROM chunks c LEFT JOIN labels l ON l.doc_id = c.doc_id GROUP BY document_id, filename
""", ("chunks",))
define("questions", """
SELECT item_id AS question_id, text AS question, embedding FROM benchmark LEFT JOIN embeddings ON vec_id = item_id
""")
define("question_texts", """
SELECT 'b' || item_id AS question_id, text AS question FROM benchmark
UNION ALL SELECT 'c' || conv_id || '-' || turn, text FROM conversations WHERE role = 'user'
""")
define("prompts", """
SELECT p_partkey AS question_id, CASE p_size % 10
  WHEN 0 THEN 'Which documents mention ' || p_name || '?'
  WHEN 1 THEN 'What does each policy say about ' || p_name || '?'
  WHEN 2 THEN 'I have taken ' || p_size || ' of 22 ' || p_name || '. How many are left?'
  WHEN 3 THEN p_name
  WHEN 4 THEN 'What about ' || p_name || '?'
  WHEN 5 THEN 'Hello there!!'
  WHEN 6 THEN 'Thank you very much.'
  WHEN 7 THEN 'Compare ' || p_name || ' across all the files of ' || p_brand
  WHEN 8 THEN 'How much ' || p_name || ' of type ' || p_type || ' do employees of ' || p_brand || ' get?'
  ELSE 'total of ' || p_size || ' ' || p_name || ' at ' || p_retailprice END AS question
FROM part
""")
define("runs", """
SELECT event_id AS run_id, user_id AS chat_id,
  'How is item  ' || CAST(json_extract(props, '$.k') AS BIGINT) || ' doing after ' || event_type || '?' AS question,
  event_type <> 'error' AS answered,
  CASE event_type WHEN 'view' THEN 'agentic' WHEN 'purchase' THEN 'hybrid' WHEN 'signup' THEN 'custom' ELSE 'naive' END AS mode,
  value AS latency_ms, ts AS created_at, CAST(json_extract(props, '$.k') AS BIGINT) AS item
FROM events
""")
define("turned", """
SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY created_at, run_id) - 1 AS turn_index FROM runs
""", ("runs",))
define("turns", """
SELECT 'c' || u.conv_id || '-' || u.turn AS run_id, u.conv_id AS chat_id, u.turn AS turn_index, u.text AS question,
  a.text AS answer, a.text IS NOT NULL AS answered,
  'file_' || (u.conv_id % 7) AS f1, 'file_' || (u.turn % 3) AS f2
FROM conversations u LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user'
""")
define("tree_blocks", """
SELECT CAST(l_orderkey AS VARCHAR) AS document_id,
  CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS pos, 'part ' || l_partkey AS text,
  CASE WHEN l_partkey % 6 > 0 THEN CAST(l_partkey % 6 AS INTEGER) END AS heading_level,
  CASE WHEN l_suppkey % 3 > 0 THEN CAST(l_quantity AS INTEGER) END AS page_number
FROM lineitem
""")
# Headings with the preamble where a document opens with body text.
define("headings", """
SELECT document_id, pos, text AS title, heading_level AS level, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS section_no
FROM (
  SELECT document_id, pos, text, heading_level FROM tree_blocks WHERE heading_level IS NOT NULL
  UNION ALL
  SELECT document_id, min(pos) - 1, 'Preamble', 1 FROM tree_blocks GROUP BY document_id HAVING arg_min(coalesce(heading_level, 0), pos) = 0
)
""", ("tree_blocks",))
define("deep_blocks", """
SELECT CAST(l_orderkey // 4 AS VARCHAR) AS document_id, l_orderkey * 100000000000 + CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 1000 + l_suppkey AS pos, 'part ' || l_partkey AS text,
  CASE WHEN l_partkey % 41 > 0 THEN CAST(l_partkey % 41 AS INTEGER) END AS heading_level
FROM lineitem
""")
define("deep_headings", """
SELECT document_id, pos, text AS title, heading_level AS level, row_number() OVER (PARTITION BY document_id ORDER BY pos) AS section_no
FROM (
  SELECT document_id, pos, text, heading_level FROM deep_blocks WHERE heading_level IS NOT NULL
  UNION ALL
  SELECT document_id, min(pos) - 1, 'Preamble', 1 FROM deep_blocks GROUP BY document_id HAVING arg_min(coalesce(heading_level, 0), pos) = 0
)
""", ("deep_blocks",))
define("deep_parents", """
SELECT h.document_id, h.section_no, h.title, h.level, max(a.section_no) AS parent
FROM deep_headings h LEFT JOIN deep_headings a ON a.document_id = h.document_id AND a.section_no < h.section_no AND a.level < h.level GROUP BY ALL
""", ("deep_headings",))
define("deep_paths", """
SELECT document_id, section_no, parent, title AS path FROM deep_parents
UNION ALL SELECT u.document_id, u.section_no, p.parent, p.title || ' > ' || u.path
FROM deep_paths u JOIN deep_parents p ON p.document_id = u.document_id AND p.section_no = u.parent
""", ("deep_parents",))
define("owned", """
SELECT b.document_id, b.pos, b.text, b.page_number, max(h.section_no) AS section_no
FROM tree_blocks b JOIN headings h ON h.document_id = b.document_id AND h.pos < b.pos
WHERE b.heading_level IS NULL GROUP BY ALL
""", ("headings",))
define("part_chunks", """
SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS chunk_id, p_brand AS document_id, p_brand || '.md' AS filename,
  'Stores keep ' || p_size || ' units of the ' || lower(p_type) || ' kind. Ask for ' || p_name || '.' AS content,
  CASE WHEN p_brand <> 'Brand#3' THEN TIMESTAMP '2026-01-01' + to_days(CAST(split_part(p_brand, '#', 2) AS INTEGER)) END AS uploaded_at
FROM part
""")
define("answers", """
SELECT conv_id * 100 + turn AS question_id, CASE (conv_id + turn) % 5
  WHEN 0 THEN text || m WHEN 1 THEN 'NOT_FOUND ' || text WHEN 2 THEN m WHEN 3 THEN text || m || ' see [appendix]' ELSE text END AS answer
FROM (SELECT *, ' [' || (turn + 1) || ', ' || (conv_id % 9) || '] and [' || (turn + 1) || ']' AS m FROM conversations WHERE role <> 'system')
""")


def bm25(prefix: str, chunks: str, questions: str, column: str = "question") -> None:
    """Okapi scores of every (question, chunk) sharing a term, and their ranks."""
    toks = TOK.format("content")
    define(f"{prefix}_dl", f"SELECT chunk_id, document_id, {toks} AS toks, len({toks}) AS dl FROM {chunks}", (chunks,))
    define(f"{prefix}_corpus", f"SELECT count(*) AS n, sum(dl) / count(*) AS avgdl FROM {prefix}_dl", (f"{prefix}_dl",))
    define(f"{prefix}_tf", f"SELECT chunk_id, document_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, document_id, dl, unnest(toks) AS term FROM {prefix}_dl) GROUP BY ALL", (f"{prefix}_dl",))
    define(f"{prefix}_raw", f"SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS x FROM (SELECT term, count(*) AS df FROM {prefix}_tf GROUP BY term), {prefix}_corpus", (f"{prefix}_tf", f"{prefix}_corpus"))
    define(f"{prefix}_idf", f"SELECT term, df, CASE WHEN x < 0 THEN 0.25 * (SELECT avg(x) FROM {prefix}_raw) ELSE x END AS idf FROM {prefix}_raw", (f"{prefix}_raw",))
    define(f"{prefix}_q", f"SELECT question_id, term, count(*) AS qtf FROM (SELECT question_id, unnest({TOK.format(column)}) AS term FROM {questions}) GROUP BY ALL", (questions,))
    define(f"{prefix}_scores", f"""
SELECT question_id, chunk_id, document_id,
  round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 6) AS score
FROM {prefix}_q JOIN {prefix}_idf USING (term) JOIN {prefix}_tf USING (term), {prefix}_corpus GROUP BY ALL
""", (f"{prefix}_q", f"{prefix}_idf", f"{prefix}_tf", f"{prefix}_corpus"))
    define(prefix, f"SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, chunk_id) AS rank FROM {prefix}_scores WHERE score > 0", (f"{prefix}_scores",))


ASKED = "SELECT 'p' || question_id AS question_id, question FROM prompts UNION ALL SELECT question_id, question FROM question_texts"
DISTANCE = "round(pow(list_distance(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[])), 2), 9)"

bm25("bm25", "chunks", "questions")
define("topical", f"""
SELECT question_id, CASE WHEN topic <> '' THEN topic ELSE question END AS question FROM (
  SELECT question_id, question, array_to_string(list_filter({TOK.format('question')}, lambda t: len(t) > 2 AND NOT list_contains({sql_list(fixed.SCAFFOLDING)}, t)), ' ') AS topic FROM questions)
""", ("questions",))
define("knn", f"""
SELECT question_id, chunk_id, document_id, section_id, score,
  row_number() OVER (PARTITION BY question_id ORDER BY score, chunk_id) AS rank
FROM (SELECT q.question_id, c.chunk_id, c.document_id, c.section_id, {DISTANCE.format('q.embedding', 'c.embedding')} AS score
  FROM questions q, chunks c WHERE c.embedding IS NOT NULL AND q.embedding IS NOT NULL)
""", ("questions", "chunks"))


def rrf(name: str, dense: str, sparse: str, needs: tuple[str, ...], wide: int) -> None:
    """Fused list of two ranked lists, insertion order breaking ties."""
    define(f"{name}_groups", f"""
SELECT question_id, chunk_id, document_id, round(sum(1.0 / (60 + rank)), 12) AS f,
  max(rank) FILTER (side = 0) AS semantic_rank, max(rank) FILTER (side = 1) AS keyword_rank, min(rank) FILTER (side = 0) AS first,
  arg_max(score, rank) FILTER (side = 0) AS distance, arg_max(score, rank) FILTER (side = 1) AS bm
FROM (SELECT question_id, chunk_id, document_id, score, rank, 0 AS side FROM {dense}
      UNION ALL SELECT question_id, chunk_id, document_id, score, rank, 1 FROM {sparse}) GROUP BY ALL
""", needs)
    define(name, f"""
SELECT question_id, chunk_id, document_id, CASE WHEN semantic_rank IS NOT NULL THEN distance ELSE bm END AS score, rank, round(f, 6) AS fused_score,
  semantic_rank, keyword_rank, (semantic_rank IS NOT NULL)::INTEGER + (keyword_rank IS NOT NULL)::INTEGER AS n_sources
FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY f DESC, semantic_rank IS NULL, coalesce(first, keyword_rank), chunk_id) AS rank FROM {name}_groups)
WHERE rank <= {wide}
""", (f"{name}_groups",))


define("dense10", "SELECT * FROM knn WHERE rank <= 10", ("knn",))
define("sparse10", "SELECT * FROM bm25 WHERE rank <= 10", ("bm25",))
rrf("fused10", "dense10", "sparse10", ("dense10", "sparse10"), 10)
define("reranked", """
SELECT * EXCLUDE (rank), rank AS given, row_number() OVER (PARTITION BY question_id ORDER BY fused_score DESC, n_sources DESC, coalesce(score, 1e9), rank) AS rank
FROM fused10
""", ("fused10",))

# Document -> section -> chunk.
define("ready_profiles", """
SELECT document_id AS chunk_id, document_id, filename || ' ' || CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE substr(content, 1, 2000) END AS content
FROM books WHERE status = 'READY'
""", ("books",))
bm25("doc_bm25", "ready_profiles", "questions")
define("doc_rank", """
SELECT * FROM (
  SELECT q.question_id, p.document_id, coalesce(s.score, 0) AS score,
    row_number() OVER (PARTITION BY q.question_id ORDER BY coalesce(s.score, 0) DESC, p.document_id) AS rank
  FROM questions q CROSS JOIN ready_profiles p LEFT JOIN doc_bm25_scores s ON s.question_id = q.question_id AND s.document_id = p.document_id)
WHERE rank <= 3
""", ("questions", "doc_bm25_scores", "ready_profiles"))
define("section_hits", """
SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, chunk_id) AS place
FROM (SELECT k.question_id, k.chunk_id, k.document_id, k.section_id, k.score FROM knn k JOIN doc_rank d USING (question_id, document_id))
""", ("knn", "doc_rank"))
define("sections", """
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score, first) AS rank FROM (
  SELECT h.question_id, h.document_id, coalesce(h.section_id, 'whole-document') AS section_id, min(h.score) AS score, min(h.place) AS first
  FROM section_hits h JOIN (SELECT question_id, greatest(8 * count(*), 4) AS k FROM doc_rank GROUP BY question_id) n USING (question_id)
  WHERE h.place <= n.k GROUP BY ALL)) WHERE rank <= 4
""", ("section_hits", "doc_rank"))
define("tree_all", """
SELECT k.question_id, k.chunk_id, k.document_id, k.section_id, k.score, row_number() OVER (PARTITION BY k.question_id ORDER BY k.score, k.chunk_id) AS rank
FROM knn k WHERE EXISTS (SELECT 1 FROM sections s WHERE s.question_id = k.question_id AND s.document_id = k.document_id)
  AND (EXISTS (SELECT 1 FROM sections s WHERE s.question_id = k.question_id AND s.section_id = k.section_id)
    OR NOT EXISTS (SELECT 1 FROM sections s WHERE s.question_id = k.question_id AND s.section_id <> 'whole-document'))
""", ("knn", "sections"))
