"""Queries over sources, gates, scalar projections, structure and chunks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusframe.functions import fixed, text
from corpusframe.operators import chunking, ingest, routing, structure
from corpusframe.plans import model_tables as m
from corpusframe.plans.model_sql import ASKED, TOK, define, sql_list
from corpusframe.plans.registry import query
from corpusframe.session import settle
from corpusframe.sources.tables import read_table


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE lang = 'en' AND n_chars > 500")
def scan_documents(spark, d):
    docs = read_table(spark, d, "documents")
    return docs.where("lang = 'en' and n_chars > 500").select("doc_id", "lang", "source", "n_chars")


@query("""
SELECT 'old' AS version, c.document_id, c.chunk_id, length(c.content) AS chars FROM chunks c
WHERE c.document_id NOT IN (SELECT document_id FROM books WHERE status = 'FAILED')
UNION ALL SELECT 'new', document_id, document_id || ':0', length(content) FROM books WHERE status = 'FAILED'
""", ("books",))
def chunk_replace(spark, d):
    """Books that failed are re-ingested as one chunk each."""
    old = m.chunks(spark, d, vectors=False).select(
        F.lit("old").alias("version"), "document_id", "chunk_id", F.length("content").cast("bigint").alias("chars"))
    new = m.books(spark, d).where("status = 'FAILED'").select(
        F.lit("new").alias("version"), "document_id", F.concat("document_id", F.lit(":0")).alias("chunk_id"),
        F.length("content").cast("bigint").alias("chars"))
    return chunking.replace_chunks(old, new)


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    props = F.from_json("props", "k bigint")
    return read_table(spark, d, "events").select("event_id", props.k.alias("k"))


@query("""
SELECT doc_id, CAST(0 AS INTEGER) AS pos, text, CASE WHEN n_chars % 3 = 0 THEN CAST(1 AS INTEGER) END AS page_number FROM documents
""")
def decoded_blocks(spark, d):
    """A third hold stored blocks, a third an unreadable value, a third nothing."""
    stored = F.to_json(F.array(F.struct("text", F.lit(1).alias("page_number"))))
    docs = m.texts(spark, d).withColumn(
        "blocks", F.when(F.col("n_chars") % 3 == 0, stored).when(F.col("n_chars") % 3 == 1, "{not json"))
    return ingest.decode_blocks(docs, "doc_id", "blocks", "text").select("doc_id", "pos", "text", "page_number")


@query("""
SELECT doc_id, CASE WHEN size_bytes > 5242880 THEN 'too_large'
  WHEN mime = 'application/pdf' AND NOT content LIKE '%PDF%' THEN 'type_mismatch'
  WHEN mime LIKE '%wordprocessingml%' AND NOT starts_with(content, 'PK') THEN 'type_mismatch' END AS reject_reason
FROM library
""", ("library",))
def gate_documents(spark, d):
    files = m.library(spark, d).select(
        "doc_id", "mime", F.col("size_bytes").alias("size"), F.col("content").cast("binary").alias("head"))
    return ingest.gate_files(files).select("doc_id", "reject_reason")


GATES = """CASE WHEN size_bytes > 5242880 THEN 'too_large' WHEN mime = 'application/pdf' AND NOT starts_with(content, '%PDF') THEN 'type_mismatch'
  WHEN mime LIKE '%wordprocessingml%' AND NOT starts_with(content, 'PK') THEN 'type_mismatch' END"""
SQUASHED = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"


@query(f"""
SELECT doc_id, CASE WHEN gate IS NULL AND body <> '' THEN sha256(body) END AS document_id,
  CASE WHEN gate IS NOT NULL THEN 'rejected' WHEN body = '' THEN 'failed' WHEN doc_id <> first THEN 'duplicate' ELSE 'accepted' END AS status,
  CASE WHEN gate IS NOT NULL THEN gate WHEN body = '' THEN 'no_text' WHEN doc_id <> first THEN CAST(first AS VARCHAR) END AS reason,
  CASE WHEN gate IS NULL AND body = '' THEN 'parse' END AS failure_kind
FROM (SELECT *, min(CASE WHEN gate IS NULL THEN doc_id END) OVER (PARTITION BY body) AS first
  FROM (SELECT doc_id, {GATES} AS gate, {SQUASHED.format('content')} AS body FROM library))
""", ("library",))
def ingest_outcomes(spark, d):
    """What becomes of every file: accepted, duplicate, rejected or without text."""
    return ingest.ingest_outcomes(_uploads(spark, d), path="doc_id")


def _uploads(spark, d):
    return m.library(spark, d).select(
        "doc_id", "mime", F.col("size_bytes").alias("size"), F.col("content").cast("binary").alias("head"), "content")


define("uploads", f"SELECT doc_id, doc_id % 5 = 0 AS before, {GATES} AS gate, {SQUASHED.format('content')} AS body FROM library", ("library",))


@query("""
SELECT f.doc_id, CASE WHEN f.gate IS NULL AND f.body <> '' THEN sha256(f.body) END AS document_id,
  CASE WHEN f.gate IS NOT NULL THEN 'rejected' WHEN f.body = '' THEN 'failed' WHEN f.doc_id <> o.first THEN 'duplicate' ELSE 'accepted' END AS status,
  CASE WHEN f.gate IS NOT NULL THEN f.gate WHEN f.body = '' THEN 'no_text' WHEN f.doc_id <> o.first THEN CAST(o.first AS VARCHAR) END AS reason,
  CASE WHEN f.gate IS NULL AND f.body = '' THEN 'parse' END AS failure_kind
FROM uploads f LEFT JOIN (SELECT body, coalesce(min(doc_id) FILTER (before), min(doc_id)) AS first FROM uploads WHERE gate IS NULL GROUP BY body) o ON o.body = f.body
WHERE NOT f.before
""", ("uploads",))
def library_duplicates(spark, d):
    """Uploads after every fifth file has been stored: contents of the library are duplicates of what it holds."""
    files = _uploads(spark, d)
    first = ingest.ingest_outcomes(files.where("doc_id % 5 = 0"), path="doc_id").where("status = 'accepted'")
    return ingest.ingest_outcomes(
        files.where("doc_id % 5 <> 0"), path="doc_id", library=first.select("document_id", F.col("doc_id").alias("path")))


@query(f"SELECT doc_id, sha256(text) AS sha256, sha256({SQUASHED.format('text')}) AS content_sha256 FROM documents")
def content_hash(spark, d):
    return ingest.content_hashes(m.texts(spark, d), "text").select("doc_id", "sha256", "content_sha256")


@query(f"""
SELECT doc_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256({SQUASHED.format('text')})) AS first FROM documents)
""")
def dedup_report(spark, d):
    docs = ingest.content_hashes(m.texts(spark, d), "text").select("doc_id", "content_sha256")
    return ingest.dedup_exact(docs, "content_sha256", "doc_id").select("doc_id", "duplicate_of")


@query(f"""
SELECT 'new' AS kind, conv_id, turn, CAST(NULL AS BIGINT) AS stored_as FROM conversations c
WHERE sha256({SQUASHED.format('c.text')}) NOT IN (SELECT sha256({SQUASHED.format('b.text')}) FROM benchmark b)
UNION ALL SELECT 'duplicate', conv_id, turn, min(item_id) FROM conversations c JOIN benchmark b
  ON sha256({SQUASHED.format('c.text')}) = sha256({SQUASHED.format('b.text')}) GROUP BY conv_id, turn
UNION ALL SELECT 'duplicate', -d.doc_id, -1, min(o.doc_id) FROM documents d JOIN documents o
  ON sha256({SQUASHED.format('d.text')}) = sha256({SQUASHED.format('o.text')}) AND o.source < d.source GROUP BY d.doc_id
""")
def dedup_anti(spark, d):
    """New rows against a library: conversation texts against benchmark, and documents across sources."""
    lib = ingest.content_hashes(read_table(spark, d, "benchmark"), "text")
    new = ingest.content_hashes(read_table(spark, d, "conversations"), "text")
    kept = ingest.dedup_against(new, lib).select(
        F.lit("new").alias("kind"), "conv_id", "turn", F.lit(None).cast("bigint").alias("stored_as"))
    known = ingest.duplicates_report(new, lib, "item_id").select(
        F.lit("duplicate").alias("kind"), "conv_id", "turn", "stored_as")
    # Per hash, the sources in order give every document the first id of an earlier source.
    docs = ingest.content_hashes(m.texts(spark, d), "text").select("doc_id", "source", "content_sha256")
    firsts = docs.groupBy("content_sha256", "source").agg(F.min("doc_id").alias("first"))
    before = Window.partitionBy("content_sha256").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    earlier = firsts.withColumn("stored_as", F.min("first").over(before)).where("stored_as is not null")
    across = docs.join(earlier.drop("first"), ["content_sha256", "source"])
    return kept.unionByName(known).unionByName(across.select(
        F.lit("duplicate").alias("kind"), (-F.col("doc_id")).alias("conv_id"), F.lit(-1).cast("bigint").alias("turn"), "stored_as"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(array_to_string(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)),
  lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS cleaned
FROM documents
""")
def clean_text(spark, d):
    return m.texts(spark, d).select("doc_id", text.clean_text(F.col("text")).alias("cleaned"))


LINES = "SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, trim(unnest(l)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
WORDS = r"len(string_split(regexp_replace(line, '\s+', ' ', 'g'), ' '))"
LEVEL = rf"""CASE WHEN line = '' OR length(line) > 120 THEN NULL
  WHEN regexp_matches(line, '(?i)^(?:section\s+)?(\d+(?:\.\d+)*)\.?\s+\S')
    THEN least(len(string_split(regexp_extract(line, '(?i)^(?:section\s+)?(\d+(?:\.\d+)*)\.?\s+\S', 1), '.')) + 1, 6)
  WHEN regexp_matches(line, '[.,;:]$') THEN NULL
  WHEN regexp_matches(line, '^[A-Za-z][A-Za-z ]{{1,30}}:\s*\S') THEN NULL
  WHEN regexp_matches(line, '\p{{Lu}}') AND NOT regexp_matches(line, '[\p{{Ll}}\p{{Lt}}]') AND {WORDS} <= 12 THEN 1
  WHEN {WORDS} BETWEEN 2 AND 8 AND NOT regexp_matches(line, '[.?!]$')
    AND NOT regexp_matches(line, '(?:^|\s)[\p{{Ll}}\p{{Lt}}\p{{Lm}}\p{{Lo}}]') THEN 1 END"""


@query(f"""
WITH lines AS ({LINES})
SELECT doc_id, CAST(pos AS INTEGER) AS pos, line, CAST({LEVEL} AS INTEGER) AS level FROM lines
UNION ALL SELECT -o, CAST(0 AS INTEGER), line, CAST({LEVEL} AS INTEGER) FROM (
  SELECT o_orderkey AS o, CASE o_custkey % 4 WHEN 0 THEN o_orderpriority WHEN 1 THEN 'Section ' || (o_custkey % 30) || '.' || (o_orderkey % 9) || ' Totals'
    WHEN 2 THEN 'Status: ' || o_orderstatus ELSE 'Annual Leave ' || o_orderkey END AS line FROM orders)
""")
def heading_levels(spark, d):
    """Every line of every document, and order notes that take the numbered and labelled shapes."""
    docs = m.texts(spark, d).select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("pos", "line"))
    c, o = F.col("o_custkey"), F.col("o_orderkey")
    note = (
        F.when(c % 4 == 0, F.col("o_orderpriority"))
        .when(c % 4 == 1, F.concat(F.lit("Section "), c % 30, F.lit("."), o % 9, F.lit(" Totals")))
        .when(c % 4 == 2, F.concat(F.lit("Status: "), "o_orderstatus"))
        .otherwise(F.concat(F.lit("Annual Leave "), o))
    )
    notes = read_table(spark, d, "orders").select((-o).alias("doc_id"), F.lit(0).alias("pos"), note.alias("line"))
    return docs.unionByName(notes).select(
        "doc_id", "pos", text.strip(F.col("line")).alias("line")
    ).withColumn("level", text.heading_level(F.col("line")))


@query(f"""
WITH lines AS ({LINES}), marked AS (SELECT doc_id, pos, line, {LEVEL} AS level FROM lines),
parts AS (SELECT *, sum(CASE WHEN line = '' OR level IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS cut FROM marked),
groups AS (SELECT doc_id, cut, level IS NOT NULL AS head, max(level) AS level, string_agg(line, chr(10) ORDER BY pos) AS text, min(pos) AS place
  FROM parts WHERE line <> '' GROUP BY doc_id, cut, level IS NOT NULL)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS INTEGER) AS pos, text, CAST(level AS INTEGER) AS heading_level FROM groups
""")
def text_blocks(spark, d):
    docs = m.texts(spark, d)
    return ingest.blocks_from_text(docs, "doc_id", "text").select("doc_id", "pos", "text", "heading_level")


@query(r"""
WITH pieces AS (
  SELECT doc_id, i, trim(regexp_replace(l[i + 1], '[^A-Za-z0-9]+', ' ', 'g')) AS c
  FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))
), blocks AS (
  SELECT doc_id, i, 0 AS n, CASE i % 7 WHEN 0 THEN c WHEN 1 THEN 'P ' || c WHEN 2 THEN c WHEN 3 THEN c || chr(10) || '# no heading'
    WHEN 4 THEN 'Q ' || c WHEN 5 THEN c || repeat(chr(10), 2) || 'n' || repeat(chr(10), 2) || i || repeat(chr(10), 2) || 'x' ELSE 'H ' || c END AS text,
    CASE i % 7 WHEN 0 THEN 1 + i % 6 WHEN 6 THEN 2 END AS heading_level FROM pieces WHERE c <> ''
  UNION ALL SELECT doc_id, i, 1, 'second ' || i, NULL FROM pieces WHERE c <> '' AND i % 7 = 2)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1 AS INTEGER) AS pos, text, CAST(heading_level AS INTEGER) AS heading_level FROM blocks
""")
def markdown_blocks(spark, d):
    """Every document written as Markdown, its lines taking turns as headings, paragraphs, items, code, quotes and tables."""
    def piece(c, i):
        n = i % 7
        shape = (
            F.when(n == 0, F.concat(F.expr("''"), F.repeat(F.lit("#"), 1 + i % 6), F.lit(" "), c, F.lit(" ##")))
            .when(n == 1, F.concat(F.lit("P "), c)).when(n == 2, F.concat(F.lit("- "), c, F.lit("\n- second "), i.cast("string")))
            .when(n == 3, F.concat(F.lit("```text\n"), c, F.lit("\n# no heading\n```"))).when(n == 4, F.concat(F.lit("> Q "), c))
            .when(n == 5, F.concat(F.lit("| "), c, F.lit(" | n |\n|---|:-:|\n| "), i.cast("string"), F.lit(" | x |")))
            .otherwise(F.concat(F.lit("H "), c, F.lit("\n-----")))
        )
        return F.when(c != "", shape).otherwise("")

    # The words of every line, found and joined once: what is no letter or digit costs ten times as much to replace.
    words = F.transform(F.split("text", "\n"), lambda line: F.array_join(F.regexp_extract_all(line, F.lit("[A-Za-z0-9]+"), F.lit(0)), " "))
    lines = m.texts(spark, d).select("doc_id", words.alias("lines"))
    docs = lines.select("doc_id", F.array_join(F.transform("lines", piece), "\n\n").alias("text"))
    return ingest.blocks_from_markdown(docs, "doc_id", "text").select("doc_id", "pos", "text", "heading_level")


@query(r"""
SELECT page_id, CAST(0 AS INTEGER) AS pos, CAST(1 AS INTEGER) AS heading_level,
  trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1[^>]*>(.*?)</h1>', 1), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS title
FROM pages
""")
def html_headings(spark, d):
    return ingest.html_headings(m.texts(spark, d, "pages"))


@query()
def html_blocks(spark, d):
    """Whole pages walked element by element (tested against hand-made pages)."""
    return ingest.blocks_from_html(m.texts(spark, d, "pages")).select("page_id", "pos", "heading_level", "text")


FAILURES = [
    "Incorrect API key provided", "billing hard limit", "Rate limit reached", "connection refused by host",
    "model not found", "request timed out", "HTTP 503 from upstream", "corrupt xref table",
    "No such file or directory", "something odd happened",
]


def _has(needles):
    return "(" + " OR ".join(f"contains(h, '{n}')" for n in needles) + ")"


@query(f"""
SELECT event_id, CASE WHEN {' OR '.join(_has(n) for _, n, _ in fixed.PROVIDER_FAILURES)} THEN 'provider'
    WHEN {_has(fixed.PARSE_FAILURES)} THEN 'parse' WHEN {_has(fixed.STORAGE_FAILURES)} THEN 'storage' ELSE 'unknown' END AS kind,
  CASE {' '.join(f"WHEN {_has(n)} THEN '{r}'" for r, n, _ in fixed.PROVIDER_FAILURES)}
    WHEN {_has(fixed.PARSE_FAILURES)} THEN 'parse' WHEN {_has(fixed.STORAGE_FAILURES)} THEN 'storage' ELSE 'unknown' END AS reason,
  CASE {' '.join(f"WHEN {_has(n)} THEN {r}" for _, n, r in fixed.PROVIDER_FAILURES)}
    WHEN {_has(fixed.PARSE_FAILURES)} THEN false ELSE true END AS retryable
FROM (SELECT event_id, lower(CASE WHEN user_id % 7 = 0 THEN 'RateLimitError' WHEN user_id % 7 = 1 THEN 'FileNotFoundError' ELSE 'ValueError' END || ' ' ||
  {sql_list(FAILURES)}[CAST(json_extract(props, '$.k') AS BIGINT) % 10 + 1] || ' in call ' || event_id) AS h FROM events)
""")
def classify_failures(spark, d):
    user, k = F.col("user_id") % 7, F.get_json_object("props", "$.k").cast("int")
    kind = F.when(user == 0, "RateLimitError").when(user == 1, "FileNotFoundError").otherwise("ValueError")
    message = F.concat(F.element_at(text.words_in(FAILURES), k % 10 + 1), F.lit(" in call "), "event_id")
    return read_table(spark, d, "events").select("event_id", text.failure(kind, message).alias("f")).select("event_id", "f.*")


def _phrases(kind):
    return [p.replace("'", " ") for p in fixed.SMALLTALK[kind]]


FORM = r"trim(regexp_replace(regexp_replace(lower(question), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
SMALLTALK_SQL = "CASE WHEN length(question) > 40 THEN NULL " + " ".join(
    f"WHEN list_contains({sql_list(_phrases(k))}, {FORM}) THEN '{k}'" for k in fixed.SMALLTALK) + " END"
@query(f"SELECT question_id, {SMALLTALK_SQL} AS kind FROM ({ASKED})", ("prompts", "question_texts"))
def smalltalk(spark, d):
    return m.asked(spark, d).select("question_id", text.smalltalk_kind(F.col("question")).alias("kind"))


WIDE = "(" + " OR ".join(f"regexp_matches(question, '(?i){p}')" for p in fixed.LIBRARY_WIDE) + ")"
MATCHED = "coalesce(" + ", ".join(f"nullif(regexp_extract(question, '(?i){p}', 0), '')" for p in fixed.LIBRARY_WIDE) + ")"
DEPENDENT = "(" + " OR ".join(f"regexp_matches(question, '(?i){p}')" for p in fixed.DEPENDENT) + ")"
ALONE = f"CASE WHEN {WIDE} THEN true WHEN len(regexp_extract_all(question, '[A-Za-z0-9'']+')) <= 4 THEN false ELSE NOT {DEPENDENT} END"


@query(f"""
SELECT question_id, kind AS smalltalk, matched, CASE WHEN kind IS NOT NULL THEN 'smalltalk' WHEN later AND NOT alone THEN 'follow_up'
  WHEN wide THEN 'library_wide' ELSE 'ranked' END AS route
FROM (SELECT question_id, {SMALLTALK_SQL} AS kind, {MATCHED} AS matched, {WIDE} AS wide, {ALONE} AS alone, length(question) % 2 = 0 AS later FROM ({ASKED}))
""", ("prompts", "question_texts"))
def route_questions(spark, d):
    asked = m.asked(spark, d).withColumn("later", F.length("question") % 2 == 0)
    return routing.question_router(asked, has_history="later").select("question_id", "smalltalk", "matched", "route")


@query(f"""
SELECT question_id, array_to_string(list_filter({TOK.format('question')}, lambda t: len(t) > 2 AND NOT list_contains({sql_list(fixed.SCAFFOLDING)}, t)), ' ') AS topic
FROM ({ASKED})
""", ("prompts", "question_texts"))
def topic_terms(spark, d):
    return m.asked(spark, d).select("question_id", F.array_join(text.topic_terms(F.col("question")), " ").alias("topic"))


@query(f"""
SELECT question_id, CASE WHEN NOT contains(s, '?') AND len(w) BETWEEN 1 AND 6 AND NOT list_contains({sql_list(fixed.ASK_WORDS)}, w[1])
  THEN 'What do the documents say about ' || s || '?' ELSE s END AS asked
FROM (SELECT question_id, trim(question) AS s, regexp_extract_all(lower(trim(question)), '[a-zA-Z'']+') AS w FROM ({ASKED}))
""", ("prompts", "question_texts"))
def as_question(spark, d):
    return m.asked(spark, d).select("question_id", text.as_question(F.col("question")).alias("asked"))


@query(f"SELECT question_id, {ALONE} AS self_contained FROM ({ASKED})", ("prompts", "question_texts"))
def turn_dependency(spark, d):
    return m.asked(spark, d).select("question_id", text.looks_self_contained(F.col("question")).alias("self_contained"))


@query(rf"""
SELECT question_id, CASE WHEN n = 0 THEN false WHEN n >= 2 THEN true ELSE intent END AS needs_calculation FROM (
  SELECT question_id, len(regexp_extract_all(question, '\d+(?:[.,]\d+)?')) AS n,
    ({' OR '.join(f"contains(lower(question), '{w}')" for w in fixed.ARITHMETIC_INTENT)}) AS intent FROM ({ASKED}))
""", ("prompts", "question_texts"))
def needs_calc(spark, d):
    return m.asked(spark, d).select("question_id", text.needs_calculation(F.col("question")).alias("needs_calculation"))


@query(f"SELECT doc_id, len({TOK.format('text')}) AS tokens, len(list_distinct({TOK.format('text')})) AS distinct_tokens FROM documents")
def token_counts(spark, d):
    toks = text.tokens(F.col("text"))
    return m.texts(spark, d).select(
        "doc_id", F.size(toks).cast("bigint").alias("tokens"), F.size(F.array_distinct(toks)).cast("bigint").alias("distinct_tokens"))


@query(r"""
SELECT question_id, length(regexp_replace(regexp_replace(answer, '\[([\d\s,]+)\]', '', 'g'), '[^\p{L}]', '', 'g')) < 15 AS degenerate FROM answers
""", ("answers",))
def degenerate_answers(spark, d):
    return m.answers(spark, d).select("question_id", text.is_degenerate(F.col("answer")).alias("degenerate"))


@query(rf"""
SELECT doc_id, CASE WHEN s = '' THEN 'Untitled' WHEN length(s) <= 80 THEN s ELSE rtrim(substr(s, 1, 80)) || '…' END AS title,
  CASE WHEN length(s) <= 140 THEN s ELSE rtrim(substr(s, 1, 140)) || '…' END AS summary,
  CASE WHEN length(s) <= 420 THEN s WHEN length(h) - 1 > 210 THEN h ELSE rtrim(substr(s, 1, 420)) || '…' END AS excerpt
FROM (SELECT doc_id, s, regexp_extract(substr(s, 1, 420), '(?s)^(.*[.?!]) ', 1) AS h FROM (SELECT doc_id, {SQUASHED.format('text')} AS s FROM documents))
""")
def excerpts(spark, d):
    c = F.col("text")
    return m.texts(spark, d).select(
        "doc_id", text.clip_title(c).alias("title"), text.clip(c, 140).alias("summary"), text.excerpt(c, 420).alias("excerpt"))


@query(r"""
SELECT page_id, CASE WHEN starts_with(h, 'www.') THEN substr(h, 5) WHEN h = '' THEN 'web' ELSE h END AS domain
FROM (SELECT page_id, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)', 1) AS h FROM pages)
""")
def page_domains(spark, d):
    return m.texts(spark, d, "pages").select("page_id", text.domain_of(F.col("url")).alias("domain"))


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS at
FROM events
""")
def utc_iso(spark, d):
    return read_table(spark, d, "events").select("event_id", text.to_utc_iso(F.col("ts")).alias("at"))


@query("""
SELECT chunk_id, filename || coalesce(', Section ' || section_title, '') || ', Page ' || page_number AS label,
  chunk_index AS index_in_document FROM chunks
""", ("chunks",))
def citation_labels(spark, d):
    return m.chunks(spark, d).select(
        "chunk_id", text.citation_label(F.col("filename"), F.col("section_title"), F.col("page_number")).alias("label"),
        text.chunk_index_of(F.col("chunk_id")).cast("bigint").alias("index_in_document"))


RAW_META = """SELECT event_id, CASE WHEN user_id % 3 > 0 THEN 'd' || user_id END AS document_id, CASE WHEN user_id % 4 > 0 THEN 'f' || user_id || '.md' END AS filename,
  CASE WHEN event_id % 5 = 0 THEN 'd' || user_id || ':' || event_id END AS chunk_id, event_id % 11 AS chunk_index,
  CASE WHEN event_type = 'view' THEN 'page ' || user_id WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS page FROM events"""


@query(f"""
SELECT event_id, coalesce(document_id, 'unknown') AS document_id, coalesce(filename, 'unknown') AS filename,
  coalesce(chunk_id, coalesce(document_id, 'unknown') || ':' || chunk_index) AS chunk_id, TRY_CAST(page AS INTEGER) AS page_number FROM ({RAW_META})
""")
def tolerant_cast(spark, d):
    """Stored metadata with missing or unreadable fields still makes a hit."""
    u = F.col("user_id")
    raw = read_table(spark, d, "events").select(
        "event_id", F.when(u % 3 > 0, F.concat(F.lit("d"), u)).alias("document_id"),
        F.when(u % 4 > 0, F.concat(F.lit("f"), u, F.lit(".md"))).alias("filename"),
        F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("d"), u, F.lit(":"), "event_id")).alias("chunk_id"),
        (F.col("event_id") % 11).alias("chunk_index"),
        F.when(F.col("event_type") == "view", F.concat(F.lit("page "), u))
        .when(F.col("event_type") != "error", u.cast("string")).alias("page_number"))
    return chunking.hits_from_metadata(raw).select("event_id", "document_id", "filename", "chunk_id", "page_number")


@query("""
SELECT conv_id, turn, coalesce(TRY_CAST(last AS INTEGER), 0) AS chunk_index FROM (
  SELECT conv_id, turn, CASE role WHEN 'user' THEN CAST(turn AS VARCHAR) WHEN 'system' THEN 'x' || turn ELSE '' END AS last FROM conversations)
""")
def chunk_index_of(spark, d):
    last = F.when(F.col("role") == "user", F.col("turn").cast("string")).when(F.col("role") == "system", F.concat(F.lit("x"), "turn")).otherwise("")
    return read_table(spark, d, "conversations").select(
        "conv_id", "turn", text.chunk_index_of(F.concat(F.lit("doc:"), "conv_id", F.lit(":"), last)).alias("chunk_index"))


TREE = """
SELECT document_id, section_no, title, level, 's' || section_no AS section_id,
  (SELECT 's' || max(p.section_no) FROM headings p WHERE p.document_id = h.document_id AND p.section_no < h.section_no AND p.level < h.level) AS parent_section_id,
  (SELECT coalesce(string_agg(a.title, ' > ' ORDER BY a.section_no) || ' > ', '') FROM headings a WHERE a.document_id = h.document_id AND a.section_no < h.section_no AND a.level < h.level
    AND NOT EXISTS (SELECT 1 FROM headings b WHERE b.document_id = h.document_id AND b.section_no > a.section_no AND b.section_no < h.section_no AND b.level <= a.level)) || title AS path
FROM headings h
"""


@query(TREE, ("headings",))
def section_tree(spark, d):
    tree = structure.section_tree(m.tree_blocks(spark, d))
    return tree.select("document_id", "section_no", "title", "level", "section_id", "parent_section_id",
                       F.array_join("path", " > ").alias("path"))


@query("""
SELECT p.document_id, p.section_no, p.title, p.level, 's' || p.section_no AS section_id, 's' || p.parent AS parent_section_id, u.path
FROM deep_parents p JOIN deep_paths u ON u.document_id = p.document_id AND u.section_no = p.section_no AND u.parent IS NULL
""", ("deep_paths",))
def section_depths(spark, d):
    """Trees of levels 1 to 40."""
    tree = structure.section_tree(m.deep_blocks(spark, d))
    return tree.select("document_id", "section_no", "title", "level", "section_id", "parent_section_id",
                       F.array_join("path", " > ").alias("path"))


@query("""
SELECT document_id, section_no, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS text, min(page_number) AS page_start, max(page_number) AS page_end
FROM owned GROUP BY document_id, section_no
""", ("owned",))
def section_text(spark, d):
    return structure.section_text(m.tree_blocks(spark, d)).select("document_id", "section_no", "text", "page_start", "page_end")


@query("""
SELECT document_id, string_agg(repeat('  ', greatest(level - 1, 0)) || '- [s' || section_no || '] ' || title, chr(10) ORDER BY section_no) AS outline
FROM headings GROUP BY document_id
""", ("headings",))
def section_outline(spark, d):
    return structure.section_outline(structure.section_tree(m.tree_blocks(spark, d)))


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS chunk_index, CAST(i * 800 AS INTEGER) AS start, substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content
FROM documents, unnest(range(CAST(greatest(ceil((length(text) - 200) / 800.0), 1) AS BIGINT))) AS t(i)
WHERE trim(substr(text, CAST(i * 800 + 1 AS BIGINT), 1000)) <> ''
""")
def chunk_windows(spark, d):
    return chunking.chunk_windows(m.texts(spark, d), "doc_id", "text")


@query()
def chunk_sections(spark, d):
    """Documents to blocks, sections and recursive chunks with their pages (tested by brute force)."""
    docs = m.texts(spark, d)
    # Texts are read once for the sections' text and the spans of their blocks, and cut once for chunks and their pages.
    blocks = settle(ingest.blocks_from_text(docs, "doc_id", "text").withColumn("page_number", (F.floor(F.col("pos") / 5) + 1).cast("int")))
    chunks = settle(chunking.chunk_sections(structure.section_text(blocks, "doc_id"), "doc_id"))
    spans = chunking.block_spans(structure.section_blocks(blocks, "doc_id"), "doc_id")
    pages = chunking.chunk_pages(chunks, spans, "doc_id").select("doc_id", "section_no", "chunk_index", "page_number")
    return chunks.join(pages, ["doc_id", "section_no", "chunk_index"])


@query("""
WITH blocks AS (SELECT doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
spans AS (SELECT doc_id, pos, CASE WHEN pos % 4 > 0 THEN (pos - 1) // 5 + 1 END AS page,
  coalesce(sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s,
  sum(length(line) + 2) OVER (PARTITION BY doc_id ORDER BY pos) - 2 AS e FROM blocks),
starts AS (SELECT doc_id, i, i * 800 AS at FROM documents, unnest(range(CAST(greatest(ceil((length(text) - 200) / 800.0), 1) AS BIGINT))) AS t(i)
  WHERE trim(substr(text, CAST(i * 800 + 1 AS BIGINT), 1000)) <> ''),
fallback AS (SELECT doc_id, min(page) AS page FROM spans GROUP BY doc_id),
held AS (SELECT t.doc_id, t.i, t.at, arg_max(x.e, x.s) AS e, max(x.s) AS s FROM starts t JOIN spans x ON x.doc_id = t.doc_id AND x.s <= t.at GROUP BY ALL),
pre AS (SELECT t.doc_id, t.i, arg_max(x.page, x.s) AS page FROM starts t JOIN spans x ON x.doc_id = t.doc_id AND x.s <= t.at AND x.page IS NOT NULL GROUP BY ALL)
SELECT h.doc_id, CAST(h.i AS BIGINT) AS chunk_index, CAST(CASE WHEN h.at < h.e THEN coalesce(x.page, f.page) ELSE coalesce(p.page, f.page) END AS INTEGER) AS page_number
FROM held h JOIN fallback f USING (doc_id) LEFT JOIN spans x ON x.doc_id = h.doc_id AND x.s = h.s AND x.e = h.e LEFT JOIN pre p ON p.doc_id = h.doc_id AND p.i = h.i
""")
def chunk_pages(spark, d):
    """Windows of the joined lines, each on the page of the line it starts in."""
    docs = m.texts(spark, d)
    lines = docs.select("doc_id", F.lit(1).alias("section_no"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    pos = F.col("pos") + 1
    blocks = lines.withColumn("page_number", F.when(pos % 4 > 0, F.floor(F.col("pos") / 5) + 1).cast("int"))
    starts = chunking.chunk_windows(docs, "doc_id", "text").withColumn("section_no", F.lit(1))
    return chunking.chunk_pages(starts, chunking.block_spans(blocks, "doc_id"), "doc_id").select("doc_id", "chunk_index", "page_number")


@query("""
SELECT doc_id, CAST(i AS INTEGER) AS part, CAST(i * step AS INTEGER) AS start, substr(text, CAST(i * step + 1 AS BIGINT), 12000) AS window_text FROM (
  SELECT doc_id, text, CASE WHEN ceil(length(text) / 12000.0) <= 6 THEN 12000 ELSE (length(text) - 12000) // 5 END AS step,
    CAST(least(greatest(ceil(length(text) / 12000.0), 1), 6) AS BIGINT) AS n FROM documents), unnest(range(n)) AS t(i)
""")
def summary_windows(spark, d):
    return chunking.summary_windows(m.texts(spark, d), "doc_id", "text")


@query("""
SELECT document_id, filename || ' ' || CASE WHEN coalesce(summary, '') <> '' THEN summary ELSE substr(content, 1, 2000) END AS profile FROM library
""", ("library",))
def doc_profiles(spark, d):
    return chunking.document_profiles(m.library(spark, d)).select("document_id", "profile")


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS document_id, coalesce(b.blocks > 0, false) AS structure_available, b.page_count,
  coalesce(c.n, 0) AS chunk_count, coalesce(h.n, 0) AS n_sections, h.with_content
FROM orders o
LEFT JOIN (SELECT document_id, count(*) AS blocks, max(page_number) AS page_count FROM tree_blocks GROUP BY 1) b ON b.document_id = CAST(o_orderkey AS VARCHAR)
LEFT JOIN (SELECT document_id, count(*) AS n FROM tree_blocks WHERE heading_level IS NULL GROUP BY 1) c ON c.document_id = CAST(o_orderkey AS VARCHAR)
LEFT JOIN (SELECT h.document_id, count(*) AS n, string_agg('s' || h.section_no || '=' || coalesce(length(t.text), 0), ' ' ORDER BY h.section_no) AS with_content
  FROM headings h LEFT JOIN (SELECT document_id, section_no, string_agg(text, chr(10) || chr(10)) AS text FROM owned GROUP BY 1, 2) t USING (document_id, section_no) GROUP BY 1) h
  ON h.document_id = CAST(o_orderkey AS VARCHAR)
""", ("owned", "headings"))
def doc_structure(spark, d):
    blocks = m.tree_blocks(spark, d)
    docs = read_table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("document_id"), F.lit("").alias("content"))
    out = chunking.document_structure(docs, blocks, blocks.where("heading_level is null").select("document_id"))
    entry = F.transform("sections", lambda s: F.concat(s.section_id, F.lit("="), s.character_count))
    return out.select(
        "document_id", "structure_available", "page_count", "chunk_count", F.size("sections").cast("bigint").alias("n_sections"),
        F.when(F.size("sections") > 0, F.array_join(entry, " ")).alias("with_content"))


@query("""
SELECT 'customer ' || c_custkey AS document_id, coalesce(n, 0) AS chunk_count FROM customer
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey
""")
def chunk_counts(spark, d):
    docs = read_table(spark, d, "customer").select(F.concat(F.lit("customer "), "c_custkey").alias("document_id"))
    chunks = read_table(spark, d, "orders").select(F.concat(F.lit("customer "), "o_custkey").alias("document_id"))
    return chunking.chunk_counts(docs, chunks)
